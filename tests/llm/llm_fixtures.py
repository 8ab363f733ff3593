"""Small document tables for the training-data operators."""

import random

from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
#: Columns that clash with the operators' own names.
CLASHING = ("k", "h", "n", "node", "label", "bucket", "size", "at", "rank", "pos", "shard")


def documents(spark, rows, extra=True):
    """rows: (doc_id, text) or (doc_id, text, lang)."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "src0", len(r[1]) if r[1] is not None else None) for r in rows]
    df = spark.createDataFrame(full, DOCS)
    if extra:
        from pyspark.sql import functions as F

        df = df.withColumns({c: F.lit(7) for c in CLASHING})
    return df


def words(rng: random.Random, n: int, vocabulary: int = 500) -> list[str]:
    return [f"w{rng.randrange(vocabulary)}x" for _ in range(n)]


def odd_rows():
    """Nulls, empty and long texts, ties and repeated rows, odd characters."""
    long = " ".join(f"t{i % 97}" for i in range(20_000))
    return [(1, None), (2, ""), (3, " \t\n"), (4, long), (5, long + " end"), (6, "a b c"), (6, "a b c"), (6, "other text"), (None, "no id here"), (None, None), (7, "é \x1c ü x \U0001f600"), (8, "one"), (9, "x" * 5000)]
