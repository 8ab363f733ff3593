"""Queries over the event algebra (O), MIDI (M) and live sessions (R)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqdrift import vocab as V
from seqdrift.operators import events as E
from seqdrift.operators import midi as M
from seqdrift.operators.settle import settled, shared_folder
from seqdrift.plans.base import BASE_SQL, events, notes, table
from seqdrift.streaming import pedal as R

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


_REAL = "time - CASE WHEN note >= 27513 THEN 27513 ELSE 0 END"
_LENGTH = "dur - CASE WHEN note >= 27513 THEN 37513 ELSE 10000 END"
_INSTR = "CAST(floor((note - CASE WHEN note >= 27513 THEN 38513 ELSE 11000 END) / 128.0) AS INTEGER)"


@query(BASE_SQL + f"SELECT seq_id, ev_idx, time, CAST(CASE WHEN rt + rd > 6000 THEN dur - (rt + rd - 6000) ELSE dur END AS INTEGER) AS dur, note FROM (SELECT *, {_REAL} AS rt, {_LENGTH} AS rd FROM ev) WHERE rt BETWEEN 2000 AND 6000")
def O01_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.clip(events(spark, sf_dir), 20, 60)


@query(BASE_SQL + f"SELECT seq_id, ev_idx, time, dur, note FROM (SELECT *, ({_REAL}) / 100::DOUBLE AS s FROM ev) WHERE NOT (s > 20 AND s < 60)")
def O02_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.mask(events(spark, sf_dir), 20, 60)


@query(BASE_SQL + "SELECT seq_id, ev_idx, time, dur, note FROM ev WHERE NOT (dur > 10050 AND note % 2 = 0)")
def O03_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.delete(events(spark, sf_dir), (F.col("dur") > 10_050) & (F.col("note") % 2 == 0))


@query(BASE_SQL + "SELECT seq_id, CAST(row_number() OVER (PARTITION BY seq_id ORDER BY time, ev_idx) - 1 AS INTEGER) AS ev_idx, time, dur, note FROM ev")
def O04_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.sort(events(spark, sf_dir))


@query(BASE_SQL + "SELECT seq_id, ev_idx, time, dur, note, CASE WHEN note < 27513 THEN 'event' ELSE 'control' END AS part FROM ev")
def O05_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    plain, controls = E.split(events(spark, sf_dir))
    return plain.withColumn("part", F.lit("event")).unionByName(controls.withColumn("part", F.lit("control")))


_PAD = """, g AS (
    SELECT *, lag(time, 1, 0) OVER w AS before, row_number() OVER (PARTITION BY seq_id ORDER BY ev_idx DESC) = 1 AS is_last, max(time) OVER (PARTITION BY seq_id) AS latest FROM plain WINDOW w AS (PARTITION BY seq_id ORDER BY ev_idx)
), p AS (
    SELECT seq_id, ev_idx, 1 AS side, time, dur, note FROM g
    UNION ALL SELECT seq_id, ev_idx, 0, before + 100 * CAST(i AS INTEGER), 10000, 27512 FROM (SELECT *, unnest(range(1, CAST(greatest(ceil((time - before) / 100.0) - 1, 0) AS BIGINT) + 1)) AS i FROM g)
    UNION ALL SELECT seq_id, ev_idx, 2, time + 100 * CAST(i AS INTEGER), 10000, 27512 FROM (SELECT *, unnest(range(1, CAST(greatest(ceil((latest - time) / 100.0) - 1, 0) AS BIGINT) + 1)) AS i FROM g WHERE is_last)
)"""


@query(BASE_SQL + _PAD + " SELECT seq_id, CAST(row_number() OVER (PARTITION BY seq_id ORDER BY ev_idx, side, time) - 1 AS INTEGER) AS ev_idx, CAST(time AS INTEGER) AS time, CAST(dur AS INTEGER) AS dur, CAST(note AS INTEGER) AS note FROM p")
def O06_pad(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.pad(events(spark, sf_dir, "plain"))


@query(BASE_SQL + "SELECT seq_id, ev_idx, time, dur, note FROM ev WHERE note <> 27512")
def O07_unpad(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.unpad(events(spark, sf_dir))


_ANTICIPATE = """, e AS (SELECT seq_id, ev_idx AS place, time, dur, note, lag(time, 1, 0) OVER (PARTITION BY seq_id ORDER BY ev_idx) AS clock FROM plain),
    c AS (SELECT *, time - 27513 - 500 AS due FROM ev WHERE note >= 27513 AND note <> 55025),
    h AS (SELECT c.seq_id, c.ev_idx, c.time, c.dur, c.note, coalesce(min(e.place) FILTER (WHERE e.clock >= c.due), 2147483647) AS hit FROM c LEFT JOIN e ON e.seq_id = c.seq_id GROUP BY ALL),
    q AS (SELECT *, max(hit) OVER (PARTITION BY seq_id ORDER BY ev_idx ROWS UNBOUNDED PRECEDING) AS place FROM h)"""


def _anticipated(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    plain, controls = E.split(events(spark, sf_dir))
    return E.anticipate(plain, controls.where(F.col("note") != V.SEP))


@query(
    BASE_SQL
    + _ANTICIPATE
    + """ SELECT seq_id, CAST(row_number() OVER (PARTITION BY seq_id ORDER BY place, kind, ev_idx) - 1 AS INTEGER) AS ev_idx, time, dur, note FROM (
        SELECT seq_id, place, 0 AS kind, ev_idx, time, dur, note FROM q WHERE place < 2147483647 UNION ALL SELECT seq_id, place, 1, place, time, dur, note FROM e)"""
)
def O08_anticipate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _anticipated(spark, sf_dir)[0]


@query(BASE_SQL + _ANTICIPATE + " SELECT seq_id, ev_idx, time, dur, note FROM q WHERE place = 2147483647")
def O08_left_over(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _anticipated(spark, sf_dir)[1]


@query(BASE_SQL + ", g AS (SELECT seq_id, time - lag(time, 1, 0) OVER (PARTITION BY seq_id ORDER BY ev_idx) AS gap FROM plain) SELECT seq_id, CAST(greatest(max(gap), 0) AS INTEGER) AS sparsity FROM g GROUP BY seq_id")
def O09_sparsity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.sparsity(events(spark, sf_dir, "plain"))


_FIRST = f", f AS (SELECT *, {_REAL} AS rt, {_INSTR} AS instr, sum(CASE WHEN note = 55025 THEN 1 ELSE 0 END) OVER (PARTITION BY seq_id ORDER BY ev_idx ROWS UNBOUNDED PRECEDING) AS seps FROM ev)"


@query(BASE_SQL + _FIRST + " SELECT seq_id, coalesce(min(rt) FILTER (WHERE seps = 0), 0) / 100::DOUBLE AS min_time FROM f GROUP BY seq_id")
def O10_min_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.min_time(events(spark, sf_dir))


@query(BASE_SQL + _FIRST + " SELECT seq_id, CAST(coalesce(min(rt) FILTER (WHERE seps = 0 AND instr = 5), 0) AS INTEGER) AS min_time FROM f GROUP BY seq_id")
def O10_min_time_of_instrument(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.min_time(events(spark, sf_dir), seconds=False, instr=5)


@query(BASE_SQL + _FIRST + " SELECT seq_id, coalesce(max(rt) FILTER (WHERE note <> 55025), 0) / 100::DOUBLE AS max_time FROM f GROUP BY seq_id")
def O11_max_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.max_time(events(spark, sf_dir))


@query(BASE_SQL + f"SELECT seq_id, {_INSTR} AS instr, count(*) AS n FROM ev WHERE note < 55025 GROUP BY 1, 2")
def O12_instruments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.instruments(events(spark, sf_dir))


@query(BASE_SQL + _FIRST + " SELECT seq_id, ev_idx, CAST(CASE WHEN note <> 55025 AND seps = 0 THEN time + 25 ELSE time END AS INTEGER) AS time, dur, note FROM f")
def O13_translate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.translate(events(spark, sf_dir), 25)


@query(
    BASE_SQL
    + """, b AS (SELECT seq_id, 0 AS src, ev_idx, time, dur, note FROM plain
        UNION ALL SELECT seq_id, 1, ev_idx, time - 27513, dur - 27513, note - 27513 FROM ev WHERE note >= 27513 AND note <> 55025)
    SELECT seq_id, CAST(row_number() OVER (PARTITION BY seq_id ORDER BY time, src, ev_idx) - 1 AS INTEGER) AS ev_idx, CAST(time AS INTEGER) AS time, CAST(dur AS INTEGER) AS dur, CAST(note AS INTEGER) AS note FROM b"""
)
def O14_combine(spark: SparkSession, sf_dir: str) -> DataFrame:
    plain, controls = E.split(events(spark, sf_dir))
    return E.combine(plain, controls.where(F.col("note") != V.SEP))


# MIDI. Each user's events are messages: a third are offs, deltas come from the clock, pitches are few enough to meet.

_MIDI = """, m AS (
    SELECT seq_id, ev_idx AS msg_idx, (t - lag(t, 1, 0) OVER (PARTITION BY seq_id ORDER BY ev_idx)) / 100::DOUBLE AS delta,
           CASE WHEN event_id % 13 = 0 THEN 'program_change' WHEN event_id % 3 = 0 THEN 'note_off' ELSE 'note_on' END AS type,
           CASE WHEN instr = 128 THEN 9 ELSE instr % 4 END AS channel, 60 + pitch % 3 AS note, CASE WHEN event_id % 5 = 0 THEN 0 ELSE pitch % 127 + 1 END AS velocity, instr % 128 AS program FROM notes
), a AS (
    SELECT *, sum(delta) OVER (PARTITION BY seq_id ORDER BY msg_idx) AS at,
           coalesce(last_value(CASE WHEN type = 'program_change' THEN program END IGNORE NULLS) OVER (PARTITION BY seq_id, channel ORDER BY msg_idx ROWS UNBOUNDED PRECEDING), 0) AS prog FROM m
), n AS (
    SELECT *, CASE WHEN channel = 9 THEN 128 ELSE prog END AS instr, type = 'note_on' AND velocity > 0 AS is_on FROM a WHERE type <> 'program_change'
), b AS (
    SELECT *, sum(CASE WHEN is_on THEN 1 ELSE -1 END) OVER (PARTITION BY seq_id, instr, note, channel ORDER BY msg_idx) AS balance FROM n
), g AS (
    SELECT *, least(0, coalesce(min(balance) OVER (PARTITION BY seq_id, instr, note, channel ORDER BY msg_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS lowest FROM b
), k AS (
    SELECT *, row_number() OVER (PARTITION BY seq_id, instr, note, channel, is_on ORDER BY msg_idx) AS nth FROM g WHERE is_on OR balance >= lowest
), compound AS (
    SELECT o.seq_id, CAST(row_number() OVER (PARTITION BY o.seq_id ORDER BY o.msg_idx) - 1 AS INTEGER) AS note_idx, CAST(round_even(o.at * 100, 0) AS INTEGER) AS onset,
           CAST(coalesce(round_even((f.at - o.at) * 100, 0), -1) AS INTEGER) AS dur, CAST(o.note AS INTEGER) AS pitch, CAST(o.instr AS INTEGER) AS instr, CAST(o.velocity AS INTEGER) AS velocity
    FROM k o LEFT JOIN k f ON f.seq_id = o.seq_id AND f.instr = o.instr AND f.note = o.note AND f.channel = o.channel AND f.nth = o.nth AND NOT f.is_on WHERE o.is_on
)"""


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    before = F.lag("t", 1, 0).over(Window.partitionBy("seq_id").orderBy("ev_idx"))
    return notes(spark, sf_dir).select(
        "seq_id",
        F.col("ev_idx").alias("msg_idx"),
        ((F.col("t") - before) / F.lit(100.0)).alias("delta"),
        F.when(F.col("event_id") % 13 == 0, "program_change").when(F.col("event_id") % 3 == 0, "note_off").otherwise("note_on").alias("type"),
        F.when(F.col("instr") == 128, 9).otherwise(F.col("instr") % 4).cast("int").alias("channel"),
        (60 + F.col("pitch") % 3).cast("int").alias("note"),
        F.when(F.col("event_id") % 5 == 0, 0).otherwise(F.col("pitch") % 127 + 1).cast("int").alias("velocity"),
        (F.col("instr") % 128).cast("int").alias("program"),
    )


@query(BASE_SQL + _MIDI + " SELECT * FROM compound")
def M01_midi_to_compound(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.to_compound(_messages(spark, sf_dir))


@query(
    BASE_SQL
    + _MIDI
    + """, t AS (SELECT seq_id, instr, min(note_idx) AS first FROM compound GROUP BY ALL),
    ch AS (SELECT seq_id, instr, CASE WHEN instr = 128 THEN 9 WHEN r >= 9 THEN r + 1 ELSE r END AS channel FROM (SELECT *, row_number() OVER (PARTITION BY seq_id, instr = 128 ORDER BY first) - 1 AS r FROM t)),
    x AS (SELECT seq_id, instr, note_idx, pitch, velocity, onset AS tick, 0 AS side FROM compound UNION ALL SELECT seq_id, instr, note_idx, pitch, 0, onset + CASE WHEN dur < 0 THEN 25 ELSE dur END, 1 FROM compound)
    SELECT x.seq_id, x.instr, CAST(ch.channel AS INTEGER) AS channel, CAST(row_number() OVER w - 1 AS INTEGER) AS msg_idx, CAST(tick - lag(tick, 1, 0) OVER w AS INTEGER) AS delta,
           CASE WHEN side = 0 THEN 'note_on' ELSE 'note_off' END AS type, pitch, CAST(velocity AS INTEGER) AS velocity
    FROM x JOIN ch USING (seq_id, instr) WINDOW w AS (PARTITION BY x.seq_id, x.instr ORDER BY tick, side, note_idx)"""
)
def M02_compound_to_midi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.to_messages(M.to_compound(_messages(spark, sf_dir)))


_EVENTS = " SELECT seq_id, note_idx AS ev_idx, onset AS time, CAST(10000 + CASE WHEN dur = -1 THEN 25 ELSE least(dur, 999) END AS INTEGER) AS dur, CAST(11000 + 128 * instr + pitch AS INTEGER) AS note FROM compound"


@query(BASE_SQL + _MIDI + _EVENTS)
def M03_compound_to_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.midi_to_events(_messages(spark, sf_dir)).select("seq_id", "ev_idx", "time", "dur", "note")


@query(BASE_SQL + _MIDI + " SELECT seq_id, CAST(count(*) FILTER (WHERE dur >= 1000) AS BIGINT) AS truncations FROM compound GROUP BY seq_id")
def M03_truncations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.truncations(M.to_compound(_messages(spark, sf_dir)))


@query(
    BASE_SQL
    + """, s AS (SELECT *, sum(CASE WHEN note = 55025 THEN 1 ELSE 0 END) OVER (PARTITION BY seq_id ORDER BY ev_idx ROWS UNBOUNDED PRECEDING) AS segment, CASE WHEN note >= 27513 THEN 27513 ELSE 0 END AS shift FROM ev WHERE note <> 27512),
    r AS (SELECT seq_id, ev_idx, segment, time - shift AS t, dur - shift - 10000 AS d, note - shift - 11000 AS v FROM s WHERE note <> 55025),
    e AS (SELECT seq_id, segment, greatest(max(t + d), 0) AS fin FROM r GROUP BY ALL),
    o AS (SELECT seq_id, segment, coalesce(sum(fin) OVER (PARTITION BY seq_id ORDER BY segment ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM e)
    SELECT r.seq_id, CAST(row_number() OVER (PARTITION BY r.seq_id ORDER BY ev_idx) - 1 AS INTEGER) AS note_idx, CAST(t + base AS INTEGER) AS onset, CAST(d AS INTEGER) AS dur, CAST(v % 128 AS INTEGER) AS pitch, CAST(v // 128 AS INTEGER) AS instr, CAST(72 AS INTEGER) AS velocity
    FROM r JOIN o USING (seq_id, segment)"""
)
def M04_events_to_compound(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.events_to_compound(events(spark, sf_dir))


@query(BASE_SQL + _MIDI + f", e2 AS ({_EVENTS}) SELECT count(*) * 2 AS messages, count(DISTINCT seq_id) AS n_seq, CAST(sum(note) AS BIGINT) AS note_sum FROM e2")
def M05_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = M.events_to_midi(M.midi_to_events(_messages(spark, sf_dir)).drop("truncated"))
    return back.agg(F.count("*").alias("messages"), F.countDistinct("seq_id").alias("n_seq"), F.sum(F.when(F.col("type") == "note_on", V.NOTE + 128 * F.col("instr") + F.col("pitch"))).cast("bigint").alias("note_sum"))


@query(BASE_SQL + "SELECT seq_id, ev_idx, CAST(time - first_value(time) OVER (PARTITION BY seq_id ORDER BY ev_idx) AS INTEGER) AS time, dur, note FROM plain")
def M07_rebase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.rebase(events(spark, sf_dir, "plain"))


# Live messages: note 48 is the pedal and comes up naturally.

_LIVE = """WITH m AS (
    SELECT user_id AS device, event_id, epoch_us(ts) / 1000000::DOUBLE AS ts, CASE WHEN event_id % 3 = 0 THEN 'note_off' ELSE 'note_on' END AS type,
           CAST(48 + event_id % 24 AS INTEGER) AS note, CAST(event_id % 4 * 30 AS INTEGER) AS velocity, CAST(0 AS INTEGER) AS channel FROM events
), s AS (
    SELECT *, CAST(sum(CASE WHEN note = 48 THEN 1 ELSE 0 END) OVER (PARTITION BY device ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS INTEGER) AS session FROM m
), l AS (
    SELECT *, CASE WHEN type = 'note_on' AND velocity = 0 THEN 'note_off' ELSE type END AS kind FROM s WHERE session % 2 = 1 AND note <> 48
)"""


def live_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("device"),
        "event_id",
        (F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1_000_000.0)).alias("ts"),
        F.when(F.col("event_id") % 3 == 0, "note_off").otherwise("note_on").alias("type"),
        (48 + F.col("event_id") % 24).cast("int").alias("note"),
        (F.col("event_id") % 4 * 30).cast("int").alias("velocity"),
        F.lit(0).alias("channel"),
    )


@query(_LIVE + " SELECT device, event_id, session, session % 2 = 1 AND note <> 48 AS active FROM s")
def R01_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.sessions(live_messages(spark, sf_dir), order=("ts", "event_id")).select("device", "event_id", "session", "active")


@query(
    _LIVE
    + """ SELECT device, round(ts, 6) AS ts, session, CAST(count(*) OVER w AS INTEGER) AS n_buffer, array_to_string(list(note) OVER w, ' ') AS notes, array_to_string(list(kind) OVER w, ' ') AS types
    FROM l WINDOW w AS (PARTITION BY device, session ORDER BY ts, event_id ROWS BETWEEN 39 PRECEDING AND CURRENT ROW)"""
)
def R02_buffers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = R.buffers(live_messages(spark, sf_dir), order=("ts", "event_id"))
    return rows.select("device", F.round("ts", 6).alias("ts"), "session", "n_buffer", F.array_join(F.col("buffer.note").cast("array<string>"), " ").alias("notes"), F.array_join(F.col("buffer.type"), " ").alias("types"))


@query(_LIVE + " SELECT kind AS type, count(*) AS n FROM l GROUP BY 1")
def R03_normalised_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    live = R.sessions(live_messages(spark, sf_dir), order=("ts", "event_id")).where("active")
    return live.select(R.normalised_type().alias("type")).groupBy("type").agg(F.count("*").alias("n"))


@query()
def R04_scored_buffers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every live buffer, scored by a toy model's pooled states."""
    from seqdrift.operators import pooling as P

    rows = R.buffers(live_messages(spark, sf_dir), order=("ts", "event_id"))

    def score(sequences: DataFrame) -> DataFrame:
        windows = sequences.select(F.col("seq_id").alias("sample_id"), F.col("tokens").alias("input_ids"))
        return P.extract_representations(windows, P.toy_hidden_states(4), [12])

    return R.score_rows(rows, score).select("sample_id", F.round(F.col("emb")[0], 6).alias("score"))


@query(_LIVE + ", d AS (SELECT device, ts - lag(ts) OVER (PARTITION BY device ORDER BY ts, event_id) AS gap FROM m) SELECT device, round(sum(coalesce(gap, 0)), 3) AS seconds FROM d GROUP BY device")
def M08_buffer_to_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    buffer = live_messages(spark, sf_dir).withColumnRenamed("device", "seq_id")
    return M.buffer_to_messages(buffer).groupBy(F.col("seq_id").alias("device")).agg(F.round(F.sum("delta"), 3).alias("seconds"))


@query()
def R04_stream_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every live message through a stream that keeps its buffer, tokenises it and scores it where the state is."""
    from seqdrift.operators import pooling as P
    from seqdrift.streaming import live as L

    folder = f"{shared_folder(spark)}/live-{uuid.uuid4().hex}"
    messages = live_messages(spark, sf_dir).drop("event_id")
    messages.write.parquet(f"{folder}/in")
    session = spark.newSession()
    session.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    session.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    model = P.toy_hidden_states(4)

    def score(tokens: list[list[int]]) -> list[float]:
        return [float(h[:, 0].mean()) for h in model(tokens, [12])[12]]

    scored = L.stream_scores(session.readStream.schema(messages.schema).parquet(f"{folder}/in"), score)
    scored.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema(L.LIVE).parquet(f"{folder}/out")
    return rows.select("device", F.round("ts", 6).alias("ts"), "kind", "session", "n_buffer", F.size("tokens").alias("n_tokens"), F.round("score", 6).alias("score"))


# Files: what is written comes back as notes, paired first in, first out; a note without an end lasts 25 ticks.


@query(
    BASE_SQL
    + _MIDI
    + """, o AS (SELECT seq_id, instr, pitch, onset, velocity, row_number() OVER (PARTITION BY seq_id, instr, pitch ORDER BY onset, note_idx) AS nth FROM compound),
    f AS (SELECT seq_id, instr, pitch, onset + CASE WHEN dur < 0 THEN 25 ELSE dur END AS fin, row_number() OVER (PARTITION BY seq_id, instr, pitch ORDER BY onset + CASE WHEN dur < 0 THEN 25 ELSE dur END, note_idx) AS nth FROM compound)
    SELECT o.seq_id, o.onset, CAST(f.fin - o.onset AS INTEGER) AS dur, o.pitch, o.instr, o.velocity FROM o JOIN f ON f.seq_id = o.seq_id AND f.instr = o.instr AND f.pitch = o.pitch AND f.nth = o.nth"""
)
def S11_S12_midi_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user's notes, written as files, committed, read and paired again."""
    from seqdrift.sources import midi_files
    from seqdrift.sources.io import encode_midi

    midi_files.register(spark)
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    compound = settled(M.to_compound(_messages(spark, sf_dir)))  # its pairing would be planned, and done, for each use of it
    encode_midi(M.to_messages(compound)).write.format("midi_files").mode("append").save(path)
    return M.to_compound(spark.read.format("midi_files").load(path)).drop("note_idx")


@query(_LIVE + " SELECT device, round(ts, 6) AS ts, type, CAST(note AS INTEGER) AS note, CAST(velocity AS INTEGER) AS velocity, CAST(channel AS INTEGER) AS channel FROM m")
def S13_live_port(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every device's log through the streaming source, in two runs of one query: the second goes on from the checkpoint."""
    from pyspark.sql import Window

    from seqdrift.streaming import port

    port.register(spark)
    folder = f"{shared_folder(spark)}/port-{uuid.uuid4().hex}"
    messages = live_messages(spark, sf_dir)
    half = F.ntile(2).over(Window.partitionBy("device").orderBy("ts", "event_id"))
    for upto in (1, 2):  # the second time, the first half's records are written again as they were
        settled(port.write_log(messages.withColumn("half", half).where(F.col("half") <= upto), f"{folder}/log", ("ts", "event_id")))
        stream = spark.readStream.format("live_port").load(f"{folder}/log")
        stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(port.MESSAGES).parquet(f"{folder}/out").withColumn("ts", F.round("ts", 6))
