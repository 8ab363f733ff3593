"""Queries over token functions (T), windows (W), pooling (P) and sampling masks (G)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqdrift import vocab as V
from seqdrift.functions import table_functions
from seqdrift.functions import tokens as T
from seqdrift.operators import extraction as X
from seqdrift.operators import pooling as P
from seqdrift.operators import sampling
from seqdrift.operators import windows as W
from seqdrift.operators.settle import shared_folder
from seqdrift.plans.base import BASE_SQL, events, sequences, table, token_text
from seqdrift.sources import io as S

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _by_token(case: str, source: str = "tok") -> str:
    """SQL for a function of each token."""
    return BASE_SQL + f"SELECT seq_id, string_agg(CAST({case} AS VARCHAR), ' ' ORDER BY pos) AS tokens FROM {source} GROUP BY seq_id"


def _tokens(spark: SparkSession, sf_dir: str, function, kinds: str = "mixed") -> DataFrame:
    return sequences(spark, sf_dir, kinds).select("seq_id", token_text(function(F.col("tokens"))).alias("tokens"))


@query(_by_token("CASE WHEN tok >= 11000 AND tok < 27512 THEN (tok - 11000) % 128 + 5 * 128 + 11000 WHEN tok >= 38513 AND tok < 55025 THEN (tok - 38513) % 128 + 5 * 128 + 38513 ELSE tok END"))
def T01_set_instrument(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tokens(spark, sf_dir, lambda t: T.set_instrument(t, 5))


@query(
    BASE_SQL
    + """SELECT s.seq_id, concat_ws(' ', '55026', k.kept) AS tokens FROM seqs s LEFT JOIN (
        SELECT seq_id, string_agg(time || ' ' || dur || ' ' || note, ' ' ORDER BY ev_idx) AS kept FROM ev
        WHERE note = 55025 OR floor((note - CASE WHEN time >= 27513 AND time < 55025 THEN 38513 ELSE 11000 END) / 128.0) = 0 GROUP BY seq_id
    ) k ON k.seq_id = s.seq_id"""
)
def T02_filter_instrument(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tokens(spark, sf_dir, lambda t: T.filter_instrument(t, 0))


@query(_by_token("CASE WHEN tok < 27512 THEN tok + 27513 WHEN tok >= 55028 AND tok < 55156 THEN tok + 128 ELSE tok END"))
def T03_set_anticipated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tokens(spark, sf_dir, lambda t: T.set_anticipated(t, True))


@query(_by_token("CASE WHEN tok >= 27513 AND tok < 55025 THEN tok - 27513 ELSE tok END"))
def T03_unset_anticipated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tokens(spark, sf_dir, lambda t: T.set_anticipated(t, False))


_NAMES = "[" + ", ".join(f"'{n}'" for n in V.PITCH_NAMES) + "]"
_SHIFTED = """, r AS (
    SELECT seq_id, ev_idx, note = 55025 AS is_sep, note = 27512 AS is_rest, time >= 27513 AND time < 37513 AS antic,
           CASE WHEN time >= 27513 AND time < 37513 THEN 27513 ELSE 0 END AS shift, time, dur, note FROM ev
)
"""
_READABLE = f"""{_SHIFTED}
SELECT seq_id, CAST(0 AS INTEGER) AS pos, 'AR' AS special_token, CAST(NULL AS DOUBLE) AS onset, CAST(NULL AS DOUBLE) AS duration, CAST(NULL AS INTEGER) AS instrument, CAST(NULL AS VARCHAR) AS pitch, CAST(NULL AS BOOLEAN) AS anticipated FROM seqs
UNION ALL
SELECT seq_id, CAST(row_number() OVER (PARTITION BY seq_id ORDER BY ev_idx) AS INTEGER), CASE WHEN is_sep THEN 'SEP' WHEN is_rest THEN 'REST' END,
       CASE WHEN NOT is_sep THEN (time - shift) / 100.0::DOUBLE END, CASE WHEN NOT is_sep THEN (dur - shift - 10000) / 100.0::DOUBLE END,
       CASE WHEN NOT is_sep AND NOT is_rest THEN CAST(floor((note - shift - 11000) / 128.0) AS INTEGER) END,
       CASE WHEN NOT is_sep AND NOT is_rest THEN {_NAMES}[(note - shift - 11000) % 128 % 12 + 1] || CAST(CAST(floor((note - shift - 11000) % 128 / 12.0) - 1 AS INTEGER) AS VARCHAR) END,
       CASE WHEN NOT is_sep THEN antic END
FROM r
"""


@query(
    BASE_SQL
    + _READABLE.replace("SELECT seq_id, CAST(0", ", e AS (SELECT seq_id, CAST(0", 1)
    + ") SELECT seq_id, pos, coalesce(special_token, '') AS special_token, coalesce(onset, -1) AS onset, coalesce(duration, -1) AS duration, coalesce(instrument, -1) AS instrument, coalesce(pitch, '') AS pitch, coalesce(anticipated, false) AS anticipated FROM e"
)
def T04_readable_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sequences(spark, sf_dir).select("seq_id", F.posexplode(T.readable_events(F.col("tokens"))).alias("pos", "e"))
    absent = {"special_token": "", "onset": -1.0, "duration": -1.0, "instrument": -1, "pitch": "", "anticipated": False}
    return rows.select("seq_id", "pos", *[F.coalesce(F.col(f"e.{c}"), F.lit(x)).alias(c) for c, x in absent.items()])


@query(ORACLE_SQL["T04_readable_events"])
def T04_table_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows by SQL text, from a table function."""
    table_functions.register(spark)
    return spark.sql(
        """SELECT seq_id, pos, coalesce(special_token, '') AS special_token, coalesce(onset, -1D) AS onset, coalesce(duration, -1D) AS duration,
        coalesce(instrument, -1) AS instrument, coalesce(pitch, '') AS pitch, coalesce(anticipated, false) AS anticipated
        FROM token_events(TABLE({seqs}) PARTITION BY seq_id)""",
        seqs=sequences(spark, sf_dir),
    )


@query(BASE_SQL + _SHIFTED + "SELECT CAST(floor((note - shift - 11000) / 128.0) AS INTEGER) AS instrument, count(*) AS n, max((time - shift) / 100.0::DOUBLE) AS last_onset FROM r WHERE NOT is_sep AND NOT is_rest GROUP BY 1")
def T05_events_by_instrument(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sequences(spark, sf_dir).select(F.explode(T.readable_events(F.col("tokens"))).alias("e")).where("e.instrument is not null")
    return rows.groupBy(F.col("e.instrument").alias("instrument")).agg(F.count("*").alias("n"), F.max("e.onset").alias("last_onset"))


@query(f"SELECT event_id, {_NAMES}[event_id % 128 % 12 + 1] || CAST(CAST(floor(event_id % 128 / 12.0) - 1 AS INTEGER) AS VARCHAR) AS pitch FROM events")
def T06_pitch_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", T.pitch_name((F.col("event_id") % 128).cast("int")).alias("pitch"))


_BROKEN = "CASE WHEN seq_id % 7 = 1 AND pos = 2 THEN -1 WHEN seq_id % 7 = 2 AND pos = 2 THEN 60000 WHEN seq_id % 7 = 3 AND pos = 2 THEN 11005 ELSE tok END"


def _broken(tokens):
    return F.transform(tokens, lambda t, i: F.when((F.col("seq_id") % 7 == 1) & (i == 2), -1).when((F.col("seq_id") % 7 == 2) & (i == 2), 60_000).when((F.col("seq_id") % 7 == 3) & (i == 2), 11_005).otherwise(t).cast("int"))


_VALIDITY = (
    BASE_SQL
    + f""", bad AS (SELECT seq_id, pos, {_BROKEN} AS tok FROM tok),
    three AS (SELECT a.seq_id, a.tok AS time, b.tok AS dur, c.tok AS note FROM bad a JOIN bad b ON b.seq_id = a.seq_id AND b.pos = a.pos + 1 JOIN bad c ON c.seq_id = a.seq_id AND c.pos = a.pos + 2 WHERE a.pos % 3 = 1),
    e AS (SELECT *, CASE WHEN time >= 27513 AND time < 37513 THEN 27513 ELSE 0 END AS shift, time = 55025 OR dur = 55025 OR note = 55025 OR note = 27512 AS special FROM three),
    f AS (SELECT seq_id, bool_or(NOT special AND (time - shift < 0 OR time - shift > 10000)) AS o, bool_or(NOT special AND (dur - shift - 10000 < 0 OR dur - shift - 10000 > 1000)) AS d FROM e GROUP BY seq_id),
    g AS (SELECT seq_id, bool_or(tok < 0) AS neg, bool_or(tok >= 55028) AS big FROM bad GROUP BY seq_id),
    v AS (SELECT g.seq_id, CASE WHEN neg THEN 'negative token' WHEN big THEN 'token beyond the vocabulary' WHEN o THEN 'onset out of range' WHEN d THEN 'duration out of range' END AS reason FROM g JOIN f USING (seq_id))
"""
)


@query(_VALIDITY + "SELECT seq_id, reason FROM v")
def T07_invalid_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences(spark, sf_dir).select("seq_id", T.invalid_reason(_broken(F.col("tokens"))).alias("reason"))


@query(_VALIDITY + "SELECT coalesce(reason, 'valid') AS reason, count(*) AS n FROM v GROUP BY 1")
def T13_count_invalid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.count_invalid(sequences(spark, sf_dir).withColumn("tokens", _broken(F.col("tokens"))))


def _with_velocity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from seqdrift.operators.events import to_sequences
    from seqdrift.plans.base import events

    return to_sequences(events(spark, sf_dir).withColumn("vel", F.lit(V.VELOCITY) + F.col("note") % 128), lead=V.AR)


@query(BASE_SQL + "SELECT seq_id, array_to_string(tokens, ' ') AS tokens FROM seqs")
def T08_strip_velocity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_velocity(spark, sf_dir).select("seq_id", token_text(T.strip_velocity(F.col("tokens"))).alias("tokens"))


@query(BASE_SQL + "SELECT seq_id, '55026 ' || array_to_string(tokens[3:], ' ') AS tokens FROM seqs")
def T09_force_ar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tokens(spark, sf_dir, lambda t: T.force_ar(F.slice(t, F.lit(2), F.size(t) - 1)))


_SPLIT_SQL = """SELECT s.seq_id, concat_ws(' ', '55026', k.a) AS input_ids, concat_ws(' ', '55026', k.b) AS output_ids FROM seqs s LEFT JOIN (
    SELECT seq_id, string_agg(time || ' ' || dur || ' ' || note, ' ' ORDER BY ev_idx) FILTER (WHERE note = 55025 OR i = 0) AS a,
           string_agg(time || ' ' || dur || ' ' || note, ' ' ORDER BY ev_idx) FILTER (WHERE note = 55025 OR i = 1) AS b
    FROM (SELECT *, floor((note - CASE WHEN time >= 27513 AND time < 55025 THEN 38513 ELSE 11000 END) / 128.0) AS i FROM ev) GROUP BY seq_id
) k ON k.seq_id = s.seq_id"""


@query(BASE_SQL + _SPLIT_SQL)
def T10_input_output_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = S.prepare(sequences(spark, sf_dir), split_io=True)
    return made.select("seq_id", token_text(F.col("input_ids")).alias("input_ids"), token_text(F.col("output_ids")).alias("output_ids"))


@query(BASE_SQL + "SELECT seq_id, array_to_string(tokens, ' ') AS tokens FROM seqs ORDER BY seq_id LIMIT 10")
def T11_head_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tokens(spark, sf_dir, lambda t: t).orderBy("seq_id").limit(10)


@query(BASE_SQL + "SELECT seq_id, CAST(len(tokens) AS INTEGER) AS n, CAST(list_sum(tokens) AS BIGINT) AS total FROM seqs")
def T12_parse_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = sequences(spark, sf_dir).select("seq_id", F.concat(F.lit("  "), token_text(F.col("tokens")), F.lit(" ")).alias("text"))
    parsed = text.select("seq_id", T.parse_tokens(F.col("text")).alias("tokens"))
    return parsed.select("seq_id", F.size("tokens").alias("n"), F.aggregate("tokens", F.lit(0).cast("bigint"), lambda s, x: s + x).alias("total"))


@query(
    BASE_SQL
    + """SELECT seq_id, seq_id % 4 AS batch_id, CAST(len(tokens) AS INTEGER) AS length, CAST(max(len(tokens)) OVER (PARTITION BY seq_id % 4) AS INTEGER) AS padded,
       array_to_string(tokens || list_resize(CAST([] AS INTEGER[]), max(len(tokens)) OVER (PARTITION BY seq_id % 4) - len(tokens), 0), ' ') AS input_ids FROM seqs"""
)
def T14_collate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sequences(spark, sf_dir).select("seq_id", (F.col("seq_id") % 4).alias("batch_id"), F.col("tokens").alias("input_ids"))
    return S.collate(rows).select("seq_id", "batch_id", "length", F.size("input_ids").alias("padded"), token_text(F.col("input_ids")).alias("input_ids"))


@query(
    BASE_SQL
    + """SELECT seq_id, CAST(ev_idx AS INTEGER) AS j, time - s AS time, dur - s - 10000 AS dur, CAST(floor((note - s - 11000) / 128.0) AS INTEGER) AS instr,
       CAST(((note - s - 11000) % 128 + 128) % 128 AS INTEGER) AS pitch, note >= 27513 AS anticipated
       FROM (SELECT *, CASE WHEN note >= 27513 THEN 27513 ELSE 0 END AS s FROM ev)"""
)
def T15_rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sequences(spark, sf_dir).select("seq_id", F.explode(T.rendered(F.slice("tokens", F.lit(2), F.size("tokens") - 1))).alias("e"))
    return rows.select("seq_id", "e.j", "e.time", "e.dur", "e.instr", "e.pitch", "e.anticipated")


# Windows: 8 events, stride 2 events.

_WINDOWS = """, w AS (
    SELECT seq_id, tokens, CAST(unnest(range(0, CAST(len(tokens) AS BIGINT) - 1 - 24 + 1, 6)) AS INTEGER) AS start FROM seqs WHERE len(tokens) > 1 AND len(tokens) - 1 >= 24
), win AS (SELECT seq_id, start, [tokens[1]] || tokens[start + 2 : start + 25] AS input_ids FROM w)"""


def _windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.materialise(W.window_index(sequences(spark, sf_dir), 8, 2), 8)


@query(BASE_SQL + _WINDOWS + " SELECT seq_id, start FROM w")
def W01_window_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.window_index(sequences(spark, sf_dir), 8, 2).select("seq_id", "start")


@query(BASE_SQL + "SELECT seq_id, CAST(unnest(range(0, CAST(len(tokens) AS BIGINT) - 1, 6)) AS INTEGER) AS start FROM seqs WHERE len(tokens) > 1")
def W01_window_index_keep_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.window_index(sequences(spark, sf_dir), 8, 2, drop_last=False).select("seq_id", "start")


@query(BASE_SQL + _WINDOWS + " SELECT seq_id, start, array_to_string(input_ids, ' ') AS input_ids FROM win")
def W02_materialise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _windows(spark, sf_dir).select("seq_id", "start", token_text(F.col("input_ids")).alias("input_ids"))


@query(ORACLE_SQL["W02_materialise"])
def W02_table_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    table_functions.register(spark)
    text = "SELECT seq_id, start, array_join(input_ids, ' ') AS input_ids FROM token_windows(TABLE({seqs}) PARTITION BY seq_id, events => 8, step => 2)"
    return spark.sql(text, seqs=sequences(spark, sf_dir))


_GAPS = """, x AS (SELECT seq_id, start, unnest(range(0, 8)) AS i, input_ids FROM win),
    e AS (SELECT seq_id, start, i, input_ids[2 + 3 * i] AS time, input_ids[3 + 3 * i] AS dur, input_ids[4 + 3 * i] AS note FROM x),
    f AS (SELECT *, CASE WHEN time >= 27513 AND time < 37513 THEN 27513 ELSE 0 END AS s FROM e WHERE note NOT IN (55025, 27512)),
    g AS (SELECT seq_id, start, i, CAST(trunc((time - s) / 100::DOUBLE * 100::DOUBLE) AS INTEGER) AS onset, CAST(trunc((dur - s - 10000) / 100::DOUBLE * 100::DOUBLE) AS INTEGER) AS d FROM f),
    h AS (SELECT seq_id, start, onset - max(onset + d) OVER (PARTITION BY seq_id, start ORDER BY onset, d, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS gap FROM g),
    k AS (SELECT win.seq_id, win.start, coalesce(min(CAST(h.gap <= 500 AS INTEGER)), 1) = 1 AS ok FROM win LEFT JOIN h ON h.seq_id = win.seq_id AND h.start = win.start GROUP BY win.seq_id, win.start)
    SELECT seq_id, start, ok FROM k"""


@query(BASE_SQL + _WINDOWS + _GAPS)
def W03_silence_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _windows(spark, sf_dir).select("seq_id", "start", W.acceptable_gaps(F.col("input_ids")).alias("ok"))


@query(BASE_SQL + _WINDOWS + _GAPS)
def W03_silence_filter_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.acceptable_gaps_by_join(_windows(spark, sf_dir))


@query(BASE_SQL + _WINDOWS + " SELECT seq_id, start, array_to_string(input_ids[1 : 24], ' ') AS input_ids, array_to_string(input_ids[2 : 25], ' ') AS labels FROM win")
def W04_lm_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.with_labels(_windows(spark, sf_dir), "lm").select("seq_id", "start", token_text(F.col("input_ids")).alias("input_ids"), token_text(F.col("labels")).alias("labels"))


@query(BASE_SQL + ", b AS (SELECT seq_id, tokens FROM seqs)" + _WINDOWS + " SELECT w.seq_id, w.start, array_to_string(list_transform(b.tokens[w.start + 1 : w.start + 25], lambda x: x + 1), ' ') AS labels FROM w JOIN b USING (seq_id)")
def W05_base_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    based = _windows(spark, sf_dir).withColumn("base_labels", F.transform("tokens", lambda t: t + 1))
    return W.with_labels(based, "base").select("seq_id", "start", token_text(F.col("labels")).alias("labels"))


@query(BASE_SQL + _WINDOWS + " SELECT least(200, count(*)) AS n, count(*) > 0 AS any_window FROM w")
def W06_window_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    picked = W.sample(W.window_index(sequences(spark, sf_dir), 8, 2), 200)
    return picked.select("seq_id", "start").distinct().agg(F.count("*").alias("n"), (F.count("*") > 0).alias("any_window"))


# Pooling: four positions of sixteen dimensions from each embedding.

_LONG = "x AS (SELECT vec_id AS sample_id, CAST((i - 1) // 16 AS INTEGER) AS pos, CAST((i - 1) % 16 AS INTEGER) AS dim, CAST(embedding[i] AS DOUBLE) AS v FROM (SELECT vec_id, embedding, unnest(range(1, 65)) AS i FROM embeddings))"


def _states(spark: SparkSession, sf_dir: str) -> DataFrame:
    emb = F.col("embedding").cast("array<double>")
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("sample_id"), F.transform(F.sequence(F.lit(0), F.lit(3)), lambda p: F.slice(emb, p * 16 + 1, F.lit(16))).alias("h"))


def _long_emb(df: DataFrame) -> DataFrame:
    return df.select("sample_id", F.posexplode("emb").alias("dim", "value")).select("sample_id", "dim", F.round("value", 6).alias("value"))


def _mean_std(where: str = "true") -> str:
    return f"""WITH {_LONG}, p AS (SELECT sample_id, dim, avg(v) AS m, stddev_pop(v) AS s FROM x WHERE {where} GROUP BY sample_id, dim)
        SELECT sample_id, dim, round(m, 6) AS value FROM p UNION ALL SELECT sample_id, CAST(dim + 16 AS INTEGER), round(s, 6) FROM p"""


@query(_mean_std())
def P04_pool_mean_std(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long_emb(_states(spark, sf_dir).select("sample_id", P.pool_mean_std(F.col("h")).alias("emb")))


@query(_mean_std())
def P04_pool_long_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _states(spark, sf_dir).select("sample_id", F.lit(0).alias("layer"), F.posexplode("h").alias("pos", "h"))
    return _long_emb(P.pool_positions(rows).select("sample_id", "emb"))


@query(_mean_std("pos >= 1"))
def P05_pool_last_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long_emb(_states(spark, sf_dir).select("sample_id", P.pool_last_k(F.col("h"), 3).alias("emb")))


@query(
    f"""WITH {_LONG}, n AS (SELECT sample_id, pos, sqrt(sum(v * v)) AS norm FROM x GROUP BY sample_id, pos),
    w AS (SELECT sample_id, pos, norm / (sum(norm) OVER (PARTITION BY sample_id) + 1e-8) AS w FROM n),
    m AS (SELECT x.sample_id, dim, sum(v * w) AS m FROM x JOIN w USING (sample_id, pos) GROUP BY x.sample_id, dim),
    d AS (SELECT x.sample_id, x.dim, sqrt(sum(w * (v - m) * (v - m)) + 1e-8) AS s FROM x JOIN w USING (sample_id, pos) JOIN m ON m.sample_id = x.sample_id AND m.dim = x.dim GROUP BY x.sample_id, x.dim)
    SELECT sample_id, dim, round(m, 6) AS value FROM m UNION ALL SELECT sample_id, CAST(dim + 16 AS INTEGER), round(s, 6) FROM d"""
)
def P06_norm_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long_emb(_states(spark, sf_dir).select("sample_id", P.norm_weighted_mean_std(F.col("h")).alias("emb")))


@query(f"WITH {_LONG} SELECT CAST(pos AS INTEGER) AS layer, count(DISTINCT sample_id) AS n, round(avg(v), 6) AS mean FROM x GROUP BY pos")
def P07_layer_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = _states(spark, sf_dir)
    layers = {p: h.select("sample_id", F.col("h")[p].alias("emb")) for p in range(4)}
    return P.concat_layers(layers).select("sample_id", "layer", F.explode("emb").alias("v")).groupBy("layer").agg(F.countDistinct("sample_id").alias("n"), F.round(F.avg("v"), 6).alias("mean"))


@query()
def P01_extract_representations(spark: SparkSession, sf_dir: str) -> DataFrame:
    windows = _windows(spark, sf_dir).withColumn("sample_id", F.xxhash64("seq_id", "start"))
    return P.extract_representations(windows, P.toy_hidden_states(8), [0, 12]).select("sample_id", "layer", F.size("emb").alias("dims"), F.round(F.col("emb")[0], 6).alias("first"))


# Extraction: windows of at most 8 events, the ends of sequences included; layers 0 to 4 of the toy model, two dimensions.

_STATES = """, w AS (SELECT seq_id, tokens, CAST(unnest(range(0, CAST(len(tokens) AS BIGINT) - 1, 6)) AS INTEGER) AS start FROM seqs WHERE len(tokens) > 1),
    win AS (SELECT seq_id * 100000 + start AS sample_id, [tokens[1]] || tokens[start + 2 : start + 25] AS ids FROM w),
    sized AS (SELECT sample_id, ids, len(ids) AS n, (row_number() OVER (ORDER BY sample_id) - 1) // 100 AS batch FROM win),
    padded AS (SELECT sample_id, ids, n, max(n) OVER (PARTITION BY batch) AS longest FROM sized),
    x AS (SELECT sample_id, n, {longest} AS longest, unnest(ids) AS tok FROM padded),
    v AS (SELECT sample_id, n, longest, layer, dim, sin(CAST((tok + 1) * dim AS DOUBLE) * 0.618::DOUBLE + layer) AS v, sin(dim * 0.618::DOUBLE + layer) AS pad
          FROM x, (SELECT unnest(range(0, 5)) AS layer), (SELECT unnest(range(1, 3)) AS dim)),
    m AS (SELECT sample_id, layer, dim, any_value(n) AS n, any_value(longest) AS longest, any_value(pad) AS pad, (sum(v) + (any_value(longest) - any_value(n)) * any_value(pad)) / any_value(longest) AS mean FROM v GROUP BY ALL),
    s AS (SELECT m.sample_id, m.layer, m.dim, any_value(mean) AS mean, sqrt((sum((v - mean) * (v - mean)) + any_value((m.longest - m.n) * (m.pad - mean) * (m.pad - mean))) / any_value(m.longest)) AS std
          FROM m JOIN v ON v.sample_id = m.sample_id AND v.layer = m.layer AND v.dim = m.dim GROUP BY m.sample_id, m.layer, m.dim)
    SELECT sample_id, CAST(layer AS INTEGER) AS layer, CAST(dim - 1 AS INTEGER) AS dim, round(mean, 6) AS value FROM s
    UNION ALL SELECT sample_id, CAST(layer AS INTEGER), CAST(dim + 1 AS INTEGER), round(std, 6) FROM s"""


def _ragged(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = W.materialise(W.window_index(sequences(spark, sf_dir), 8, 2, drop_last=False), 8)
    return made.select((F.col("seq_id") * 100_000 + F.col("start")).alias("sample_id"), "input_ids")


def _by_dimension(rows: DataFrame) -> DataFrame:
    return rows.select("sample_id", "layer", F.posexplode("emb").alias("dim", "value")).withColumn("value", F.round("value", 6))


@query(BASE_SQL + _STATES.format(longest="n"))
def P02_extract_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_dimension(X.extract_layers(_ragged(spark, sf_dir), X.toy(2, 4)))


@query(BASE_SQL + _STATES.format(longest="longest"))
def P02_extract_layers_pad_compat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_dimension(X.extract_layers(_ragged(spark, sf_dir), X.toy(2, 4), pad_compat=True))


@query(BASE_SQL + _STATES.format(longest="n"))
def P08_extract_all_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All layers through the cache: extracted and committed together, then read."""
    cache = S.EmbeddingCache(spark, f"{shared_folder(spark)}/{uuid.uuid4().hex}")
    return _by_dimension(X.extract_all_layers(cache, _ragged(spark, sf_dir), X.toy(2, 4), "windows", "0"))


# Logits: each embedding's 64 values stand for 64 tokens.

_LOGITS = "l AS (SELECT vec_id, i - 1 AS token, CAST(embedding[i] AS DOUBLE) AS x FROM (SELECT vec_id, embedding, unnest(range(1, 65)) AS i FROM embeddings))"


def _kept(df: DataFrame, logits) -> DataFrame:
    marked = df.select("vec_id", F.filter(F.transform(logits, lambda x, i: F.when(x > float("-inf"), i)), lambda i: i.isNotNull()).alias("kept"))
    return marked.select("vec_id", F.array_join(F.col("kept").cast("array<string>"), " ").alias("kept"))


def _logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("logits"))


@query(
    f"""WITH {_LOGITS}, p AS (SELECT vec_id, token, x, exp(x) / sum(exp(x)) OVER (PARTITION BY vec_id) AS p FROM l),
    c AS (SELECT vec_id, token, coalesce(sum(p) OVER (PARTITION BY vec_id ORDER BY x DESC, token ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM p)
    SELECT vec_id, string_agg(CAST(token AS VARCHAR), ' ' ORDER BY token) AS kept FROM c WHERE before <= 0.9 GROUP BY vec_id"""
)
def G02_nucleus(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _logits(spark, sf_dir)
    return _kept(df, T.nucleus(F.col("logits"), 0.9))


@query(f"WITH {_LOGITS} SELECT vec_id, string_agg(CAST(token AS VARCHAR), ' ' ORDER BY token) AS kept FROM l WHERE token >= 20 GROUP BY vec_id")
def G03_future_logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kept(_logits(spark, sf_dir), T.future_logits(F.col("logits"), 20))


# Logits over the whole vocabulary: each label's mean embedding, repeated.

_WIDE = """WITH e AS (SELECT label, CAST(unnest(embedding) AS DOUBLE) AS v, unnest(range(0, 64)) AS d FROM embeddings),
    c AS (SELECT label, d, round(avg(v), 6) AS v FROM e GROUP BY ALL),
    l AS (SELECT label, token, v FROM c JOIN (SELECT unnest(range(0, 55028)) AS token) ON token % 64 = d),
    f AS (SELECT label, mask, token, v FROM l, ranges WHERE {allowed}),
    t AS (SELECT label, mask, max(v) AS top FROM f GROUP BY ALL)
    SELECT f.label, f.mask, count(*) AS n, min(token) AS low, max(token) AS high, min(token) FILTER (WHERE v = top) AS best
    FROM f JOIN t ON t.label = f.label AND t.mask = f.mask GROUP BY ALL"""


def _vocabulary_logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("d", "v"))
    means = each.groupBy("label", "d").agg(F.round(F.avg(F.col("v").cast("double")), 6).alias("v"))
    rows = means.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("d", "v")))["v"].alias("v"))
    tokens = F.sequence(F.lit(0), F.lit(V.vocabulary_size(False) - 1))
    wide = F.transform(F.array("v"), lambda v: F.transform(tokens, lambda i: F.get(v, i % 64)))[0]  # the means are sorted once
    return rows.select("label", wide.alias("logits"))


def _masked(df: DataFrame, name: str, logits) -> DataFrame:
    """How many tokens a mask leaves, the least and greatest, and the likeliest, which is the least of equal ones."""
    ids = F.filter(F.transform("logits", lambda x, i: F.when(x > float("-inf"), i)), lambda i: i.isNotNull())
    best = F.array_position("logits", F.array_max("logits")) - 1
    left = df.select("label", logits.alias("logits")).select("label", ids.alias("i"), best.alias("best"))
    spans = [F.size("i").cast("bigint").alias("n"), F.array_min("i").cast("bigint").alias("low"), F.array_max("i").cast("bigint").alias("high")]
    return left.select("label", F.lit(name).alias("mask"), *spans, "best")


@query(_WIDE.replace("WITH e", "WITH ranges AS (SELECT * FROM (VALUES ('time', 99, 299), ('duration', 10000, 10999), ('note', 11000, 27511)) r(mask, low, high)), e").format(allowed="token BETWEEN ranges.low AND ranges.high"))
def G01_safe_logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _vocabulary_logits(spark, sf_dir)
    parts = [_masked(df, name, T.safe_logits(F.col("logits"), slot, 100)) for slot, name in enumerate(("time", "duration", "note"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(_WIDE.replace("WITH e", "WITH ranges AS (SELECT 'instrument 0' AS mask), e").format(allowed="token < 11128 OR token >= 27512"))
def G04_instrument_logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _masked(_vocabulary_logits(spark, sf_dir), "instrument 0", T.instrument_logits(F.col("logits"), 0))


def _with_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole plain sequences moved to start at 0, with their anticipated events as controls in order of time."""
    every = events(spark, sf_dir).where(F.col("note") != V.SEP)
    event = F.struct(F.col("time").alias("time"), "ev_idx", "dur", "note")
    sides = every.groupBy("seq_id").agg(*[F.array_sort(F.collect_list(F.when(side, event))).alias(name) for name, side in (("tokens", F.col("note") < V.ANTICIPATED), ("controls", F.col("note") >= V.ANTICIPATED))])
    return sides.select("seq_id", *[F.flatten(F.transform(c, lambda e: F.array(e["time"], e["dur"], e["note"]))).alias(c) for c in ("tokens", "controls")])


@query()
def G06_generate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six new events a sequence, its controls put in ahead of the music."""
    # A prompt is what lies before the first control; all controls that the new music reaches are put in.
    rows = _with_controls(spark, sf_dir).where(F.size("controls") > 0)
    first = F.get("controls", F.lit(0)) - V.ANTICIPATED - V.DELTA
    before = F.flatten(F.filter(F.transform(F.sequence(F.lit(0), F.floor(F.size("tokens") / 3).cast("int")), lambda i: F.slice("tokens", i * 3 + 1, F.lit(3))), lambda e: F.get(e, F.lit(0)) < first))
    return sampling.decode(rows.withColumn("tokens", before), sampling.toy_decoder(), 6).select("seq_id", token_text(F.col("tokens")).alias("tokens"))


@query()
def G07_generate_ar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole sequence, its controls as plain events, with new events among its own up to its last one."""
    every = events(spark, sf_dir).where(F.col("note") != V.SEP)
    is_control = F.col("note") >= V.ANTICIPATED
    time = F.when(is_control, F.col("time") - V.ANTICIPATED).otherwise(F.col("time"))
    event = F.struct(time.alias("time"), "ev_idx", F.array("time", "dur", "note").alias("tokens"))
    rows = every.groupBy("seq_id").agg(F.array_sort(F.collect_list(event)).alias("events"), F.min(F.when(is_control, time)).alias("first"))
    # New music begins where the first control is within reach; what follows there comes in as it is reached.
    start = F.col("first") - V.DELTA
    sides = {"tokens": lambda e: start.isNull() | (e["time"] < start), "controls": lambda e: e["time"] >= start}
    parts = rows.select("seq_id", *[F.flatten(F.filter("events", keep)["tokens"]).alias(name) for name, keep in sides.items()])
    return sampling.decode(parts, sampling.toy_decoder(), None, autoregressive=True).select("seq_id", token_text(F.col("tokens")).alias("tokens"))


@query()
def G08_generate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two new events after each whole sequence."""
    return sampling.decode(sequences(spark, sf_dir, "plain").withColumn("tokens", F.slice("tokens", F.lit(2), F.size("tokens"))), sampling.toy_decoder(), 2).select("seq_id", token_text(F.col("tokens")).alias("tokens"))
