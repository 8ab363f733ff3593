"""The registered training-data queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqdrift.llm.bpe import encode_documents
from seqdrift.llm.common import table
from seqdrift.llm.decontaminate import find_leaks
from seqdrift.llm.divergence import source_divergence
from seqdrift.llm.hyperlang import held_out, identify, learn_prototypes
from seqdrift.llm.jaccard import jaccard_components
from seqdrift.llm.linedup import drop_repeated_lines
from seqdrift.llm.merkle import fingerprint_documents
from seqdrift.llm.middle import fill_in_middle, restored
from seqdrift.llm.packing import pack_documents
from seqdrift.llm.pii import find_personal_data, train
from seqdrift.llm.rlz import remove_duplicate_substrings
from seqdrift.llm.sharding import shard_by_bytes
from seqdrift.llm.toolchat import link_tool_calls


def op1_rlz_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_duplicate_substrings(table(spark, sf_dir, "documents"), width=35)


def op2_skip_chain_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return find_personal_data(docs, train(docs))


def op3_adaptive_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), shingle=3, percent=90)


def op4_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_bytes(table(spark, sf_dir, "documents"), n_shards=40)


def op5_hyperlang(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", held_out())
    return identify(docs, learn_prototypes(docs), carry=("doc_id", "held_out"))


def op6_square_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op7_tool_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_tool_calls(table(spark, sf_dir, "conversations"))


def op8_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(table(spark, sf_dir, "documents"))


def op9_cgk_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_line_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = drop_repeated_lines(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(table(spark, sf_dir, "documents"))


def op12_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    coded = encode_documents(table(spark, sf_dir, "documents"), path)
    listed = F.sha2(F.array_join("ids", ","), 256)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), listed.alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(table(spark, sf_dir, "documents"))
    hashes = F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256")
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *hashes)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_rlz_substrings, op2_skip_chain_pii, op3_adaptive_jaccard, op4_byte_shards, op5_hyperlang, op6_square_packing, op7_tool_chat, op8_merkle, op9_cgk_leaks, op10_line_suffixes, op11_source_divergence, op12_word_bpe, op13_fill_in_middle)}

ORACLE_SQL: dict[str, str] = {
    "op10_line_suffixes": """
        WITH lines AS (
            SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents
        ), runs AS (SELECT doc_id, pos, line, lead(line) OVER (PARTITION BY doc_id ORDER BY pos) AS follower FROM lines),
        copies AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY line, follower ORDER BY doc_id, pos) AS copy FROM runs WHERE follower IS NOT NULL),
        alone AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY line ORDER BY doc_id, pos) AS copy FROM lines
                  WHERE len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) > 50),
        gone AS (SELECT doc_id, pos FROM copies WHERE copy > 1 UNION SELECT doc_id, pos + 1 FROM copies WHERE copy > 1
                 UNION SELECT doc_id, pos FROM alone WHERE copy > 1)
        SELECT d.doc_id, count(l.pos) AS n_lines, count(g.pos) AS n_removed,
               sha256(coalesce(string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (WHERE g.pos IS NULL), '')) AS kept_sha256
        FROM documents d LEFT JOIN lines l ON l.doc_id = d.doc_id LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.pos = l.pos
        GROUP BY d.doc_id
    """,
    "op7_tool_chat": """
        SELECT conv_id, turn, role, CAST(0 AS BIGINT) AS n_calls, 'plain' AS status, turn AS order_turn, CAST(0 AS INTEGER) AS order_step,
               '{"content":' || CAST(to_json(text) AS VARCHAR) || ',"conv_id":' || conv_id || ',"role":"' || role || '","turn":' || turn || '}' AS line
        FROM conversations
    """,
    "op11_source_divergence": """
        WITH d AS (SELECT row_number() OVER () AS doc, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
        words AS (SELECT doc, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
        kept AS (SELECT lang, term, count(*) AS n FROM words GROUP BY lang, term HAVING count(DISTINCT doc) >= 10),
        langs AS (SELECT lang, count(*) AS v, sum(n)::BIGINT AS total FROM kept GROUP BY lang),
        groups AS (SELECT DISTINCT lang, source FROM d),
        counts AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM words w JOIN kept k ON k.lang = w.lang AND k.term = w.term GROUP BY ALL),
        filled AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang, g.source)::BIGINT AS total
                   FROM groups g JOIN kept k ON k.lang = g.lang LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
        shares AS (SELECT f.lang, f.source, f.term, f.n, 1 + (1000000000 * (f.n + 2)) // (f.total + 2 * l.v) AS p,
                          1 + (1000000000 * (k.n + 2)) // (l.total + 2 * l.v) AS q
                   FROM filled f JOIN langs l ON l.lang = f.lang JOIN kept k ON k.lang = f.lang AND k.term = f.term),
        sums AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p))::BIGINT AS value
                 FROM shares a JOIN shares b ON b.lang = a.lang AND b.term = a.term AND b.source <> a.source GROUP BY ALL),
        pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
                  FROM groups a JOIN groups b ON b.lang = a.lang AND b.source <> a.source
                  LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
        terms AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q)) // (p + q) AS value FROM shares WHERE n > 0 AND p > q),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item))::INTEGER AS rank
                   FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
        SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 10
    """,
    "op13_fill_in_middle": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
        drawn AS (SELECT doc_id, text, length(text) AS n, ('0x' || substr(h, 1, 8))::UBIGINT::BIGINT AS h1, ('0x' || substr(h, 9, 8))::UBIGINT::BIGINT AS h2,
                         ('0x' || substr(h, 17, 8))::UBIGINT::BIGINT AS h3, ('0x' || substr(h, 25, 8))::UBIGINT::BIGINT AS h4 FROM d),
        cut AS (SELECT doc_id, text, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
                       CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
                            WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM drawn),
        parts AS (SELECT *, substring(text, 1, a) AS prefix, substring(text, a + 1, b - a) AS middle, substring(text, b + 1) AS suffix FROM cut)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                      ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256
        FROM parts
    """,
}
