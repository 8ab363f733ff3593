"""Repeated line runs from a suffix array built by prefix doubling."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqdrift.llm.common import discard, free_name, key_columns, nested, running_total, settle, split_by_keys

MIN_LINES = 2
#: A repeated run of fewer lines counts too when it is one line of more words than this.
LONG_WORDS = 50
_WORD = r"[^\x20\x09-\x0d]+"


def later_runs(docs: DataFrame, min_lines: int = MIN_LINES, long_words: int | None = LONG_WORDS) -> DataFrame:
    """(k, h, pos, size, source): maximal runs of lines that also start earlier, at ``source`` (k, h, pos).

    Runs are of ``min_lines`` lines or more, or single lines of more than ``long_words`` words (None: none of those).
    Earlier is by (doc_id, text hash, line). The suffixes are those of the documents' line-ID sequences. A rank is the
    number of suffixes that sort before its group when compared by their first ``depth`` lines, so equal ranks are the
    suffix array's intervals with a longest common prefix of at least ``depth``. Each round ranks pairs (rank here, rank
    ``depth`` lines on) and doubles the depth, until no interval is left; suffixes of a unique rank repeat nothing more
    and leave. Each suffix that is not the first of its interval points from its deepest interval to that first one, and
    neighbours that point side by side are one run.
    """
    lines = docs.where("text is not null").select(*[c.alias(n) for n, c in key_columns().items()], F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    long = F.lit(False) if long_words is None or min_lines < 2 else (F.length("line") > 2 * long_words) & (F.regexp_count("line", F.lit(_WORD)) > long_words)
    # A line is known by two hashes of different seeds.
    ids = lines.select("k", "h", F.col("pos").cast("long").alias("pos"), F.xxhash64("line").alias("a"), F.xxhash64(F.lit("second"), "line").alias("b"), long.alias("long")).distinct()
    rows, depth, found = settle(ids), 1, []
    while True:
        groups = settle(rows.groupBy("a", "b").agg(F.count("*").alias("n"), F.min(F.struct("k", "h", "pos")).alias("source")).where("n > 1"))
        if depth >= min_lines:
            found.append(settle(_later(rows, groups, depth)))
        elif depth == 1 and long_words is not None:
            found.append(settle(_later(rows.where("long"), groups, 1)))
        if groups.isEmpty():
            discard(rows, groups)
            break
        ranks = running_total(groups.select("a", "b", "n"), ["a", "b"], "n").select("a", "b", F.col("before").alias("rank"))
        ranked = settle(rows.join(ranks, ["a", "b"]).select("k", "h", "pos", "rank"))
        discard(rows, groups)
        step = depth if depth >= min_lines else min(depth, min_lines - depth)  # up to min_lines, a shorter step overlaps
        ahead = Window.partitionBy("k", "h").orderBy("pos").rangeBetween(step, step)
        rows = settle(ranked.select("k", "h", "pos", F.col("rank").alias("a"), F.max("rank").over(ahead).alias("b")).where("b is not null"))
        discard(ranked)
        depth += step
    deepest = reduce(DataFrame.unionByName, found).groupBy("k", "h", "pos").agg(F.max(F.struct("size", "source")).alias("d"))
    pointed = deepest.select("k", "h", "pos", "d.size", "d.source")
    # Neighbours on one diagonal have the same source text and the same distance to it.
    side = Window.partitionBy("k", "h", "source.k", "source.h", F.col("pos") - F.col("source.pos")).orderBy("pos")
    starts = F.coalesce(F.lag("pos").over(side) != F.col("pos") - 1, F.lit(True))
    numbered = pointed.withColumn("starts", starts).withColumn("run", F.sum(F.col("starts").cast("int")).over(side))
    runs = numbered.groupBy("k", "h", F.col("source.k").alias("sk"), F.col("source.h").alias("sh"), (F.col("pos") - F.col("source.pos")).alias("away"), "run")
    runs = runs.agg(F.min("pos").alias("pos"), F.max(F.col("pos") + F.col("size")).alias("end"))
    return runs.select("k", "h", "pos", (F.col("end") - F.col("pos")).alias("size"), F.struct(F.col("sk").alias("k"), F.col("sh").alias("h"), (F.col("pos") - F.col("away")).alias("pos")).alias("source"))


def _later(rows: DataFrame, groups: DataFrame, size: int) -> DataFrame:
    met = rows.join(groups, ["a", "b"]).where(F.struct("k", "h", "pos") != F.col("source"))
    return met.select("k", "h", "pos", F.lit(size).cast("long").alias("size"), "source")


def cut_repeated_lines(docs: DataFrame, min_lines: int = MIN_LINES, long_words: int | None = LONG_WORDS) -> DataFrame:
    """``drop_repeated_lines`` as (row, text, n_lines, n_removed, longest_run): ``row`` holds the table's columns."""
    runs = settle(later_runs(docs, min_lines, long_words))
    # Overlapping runs of a document, merged into stretches, so what is listed does not outgrow the text.
    before = Window.partitionBy("k", "h").orderBy("pos", "size").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("k", "h").orderBy("pos", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    opens = runs.withColumn("opens", F.coalesce(F.max(F.col("pos") + F.col("size")).over(before) < F.col("pos"), F.lit(True)))
    stretches = opens.withColumn("part", F.sum(F.col("opens").cast("int")).over(upto)).groupBy("k", "h", "part")
    stretches = stretches.agg(F.min("pos").alias("from"), F.max(F.col("pos") + F.col("size") - 1).alias("to"), F.max("size").alias("size"))
    cuts = settle(stretches.groupBy("k", "h").agg(F.collect_list(F.struct("from", "to")).alias("gone"), F.max("size").alias("longest_run")))

    some, none = split_by_keys(nested(docs, **key_columns()), cuts, ["k", "h"])  # texts without cuts stay where they are
    some = some.join(cuts.hint("shuffle_hash"), ["k", "h"], "left")
    blank = none.withColumns({"gone": F.lit(None).cast(some.schema["gone"].dataType), "longest_run": F.lit(None).cast("long")})
    kept = some.unionByName(blank)
    text = F.col("row.text")
    lines = F.split(text, "\n")
    positions = F.flatten(F.transform("gone", lambda x: F.sequence(x["from"], x["to"])))
    rest = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1).cast("array<bigint>"), positions)
    # One lambda argument holds both arrays, so each is made once a row.
    both = F.array(F.struct(lines.alias("lines"), rest.alias("rest")))
    cut = F.transform(both, lambda x: F.array_join(F.transform(x["rest"], lambda i: x["lines"][i.cast("int")]), "\n"))[0]
    removed = F.aggregate("gone", F.lit(0).cast("long"), lambda n, x: n + x["to"] - x["from"] + 1)
    return kept.select(
        "row",
        F.when(F.col("gone").isNull(), text).otherwise(cut).alias("text"),
        F.when(text.isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines"),
        F.coalesce(removed, F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("longest_run", F.lit(0)).cast("long").alias("longest_run"),
    )


def drop_repeated_lines(docs: DataFrame, min_lines: int = MIN_LINES, long_words: int | None = LONG_WORDS) -> DataFrame:
    """Delete every line inside a run of at least ``min_lines`` lines, or of more than ``long_words`` words, that occurs
    earlier in the corpus.

    Returns all columns of the table, with ``text`` cut, and n_lines, n_removed and longest_run (lines of the longest run
    deleted) added; where the table has such a column, its own stays and the added one gets an underscore. Earlier means
    a smaller (doc_id, text hash, line number); the first copy stays whole, and copies inside one document count.
    Rows equal in doc_id and text are one document and get one result. Null text stays null with no lines; an empty
    text is one empty line; a text of fewer than ``min_lines`` lines stays unless a line of it is long. The first copy
    of a line lies in no run that occurs earlier, so it is never cut.
    """
    cut = cut_repeated_lines(docs, min_lines, long_words)
    own = [F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns]
    return cut.select(*own, *[F.col(c).alias(free_name(docs, c)) for c in ("n_lines", "n_removed", "longest_run")])
