"""Table functions against the DataFrame forms, and sketched thresholds against exact ones."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqdrift import vocab as V
from seqdrift.functions import table_functions
from seqdrift.functions import tokens as T
from seqdrift.operators import windows as W
from seqdrift.streaming import thresholds as Q


@pytest.fixture(scope="module")
def sequences(spark):
    table_functions.register(spark)
    body = [x for i in range(12) for x in (i * 9, V.DURATION + i, (V.NOTE + i * 130, V.REST)[i % 5 == 4])]
    ahead = [V.ANTICIPATED + 7, V.ANTICIPATED + V.DURATION + 3, V.ANTICIPATED + V.NOTE + 61]
    rows = [(1, [V.AR, *body], "a"), (2, [V.AAR, *ahead, V.SEP, V.SEP, V.SEP, *body], None), (3, [V.AR], "b"), (4, [], "c"), (5, None, "d"), (6, [5, *body, 17], "e"), (1, [V.AR, *body], "a")]
    return spark.createDataFrame(rows, "seq_id long, tokens array<int>, extra string")


def _sorted(df):
    return sorted(map(str, (tuple(r) for r in df.collect())))


@pytest.mark.parametrize("drop_last", [True, False])
def test_windows_by_sql(spark, sequences, drop_last):
    got = spark.sql(f"SELECT * FROM token_windows(TABLE({{s}}) PARTITION BY seq_id, events => 3, step => 2, drop_last => {str(drop_last).lower()})", s=sequences)
    assert got.columns == ["seq_id", "extra", "start", "input_ids"]
    plain = W.materialise(W.window_index(sequences, 3, 2, drop_last=drop_last), 3)
    assert _sorted(got) == _sorted(plain.select(*got.columns))


def test_events_by_sql(spark, sequences):
    got = spark.sql("SELECT * FROM token_events(TABLE({s}) PARTITION BY seq_id)", s=sequences)
    plain = sequences.where(F.size("tokens") > 0).select("seq_id", "extra", F.posexplode(T.readable_events(F.col("tokens"))).alias("pos", "e"))
    assert _sorted(got) == _sorted(plain.select("seq_id", "extra", "pos", *[f"e.{c}" for c in got.columns[3:]]))


def test_arguments_are_checked_when_a_query_is_analysed(spark, sequences):
    for text, reason in (
        ("token_windows(TABLE({s}) PARTITION BY seq_id, events => 0)", "constant of at least 1"),
        ("token_events(TABLE(SELECT 1 AS a))", "column tokens"),
        ("token_events(TABLE(SELECT 1 AS tokens))", "must be an array"),
        ("token_windows(TABLE(SELECT tokens, 1 AS start FROM {s}))", "names of the output"),
    ):
        with pytest.raises(Exception, match=reason):
            spark.sql(f"SELECT * FROM {text}", s=sequences).columns


def _ranks(values, score):
    return (values < score).mean(), (values <= score).mean()


def test_sketches_of_a_stream_stay_within_the_rank_error(spark, tmp_path):
    rng = np.random.default_rng(5)
    scores = {0: rng.lognormal(0, 3, 20_000), 1: rng.integers(0, 40, 20_000).astype(float)}
    rows = [(d, float(x)) for d, xs in scores.items() for x in xs] + [(0, None), (0, float("nan")), (2, None)]
    frame = spark.createDataFrame(rows, "detector int, score double").repartition(6)
    path = str(tmp_path)
    for part in (0, 1):
        frame.where(F.pmod(F.hash("score"), F.lit(2)) == part).write.mode("append").parquet(f"{path}/in")
        stream = spark.readStream.schema("detector int, score double").option("maxFilesPerTrigger", 2).parquet(f"{path}/in")
        Q.keep(stream, f"{path}/sketches", f"{path}/state", ["detector"], 512).awaitTermination()
    seen = spark.read.schema("detector int, score double").parquet(f"{path}/in").where("score is not null and not isnan(score)").collect()
    kept = Q.kept(spark, f"{path}/sketches", ["detector"])
    counts = {r["detector"]: r["n"] for r in kept.select("detector", F.kll_sketch_get_n_double("sketch").alias("n")).collect()}
    found = Q.thresholds(kept, [0.01, 0.5, 0.9, 0.99]).collect()
    assert {r["detector"] for r in found} == {0, 1} and len(found) == 8
    for r in found:
        values = np.array([x["score"] for x in seen if x["detector"] == r["detector"]])
        low, high = _ranks(values, r["score"])
        assert counts[r["detector"]] == len(values)
        assert low - 2 * Q.rank_error(512) <= r["share"] <= high + 2 * Q.rank_error(512)


def test_tables_without_scores_have_no_threshold(spark):
    empty = spark.createDataFrame([(None,), (float("nan"),)], "score double")
    assert Q.thresholds(Q.sketches(empty), [0.5]).count() == 0
    assert Q.thresholds(Q.merged(Q.sketches(empty)), [0.5]).count() == 0
