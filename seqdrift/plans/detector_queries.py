"""Queries over detectors (H), fitted transformations (F), evaluation (E), analysis (A), results (N), export (X), sources (S).

Embeddings: labels 0-4 are in distribution; of those, every fifth vec_id is held out and the others are the reference.
"""

from __future__ import annotations

import tempfile

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqdrift.operators import analysis as A
from seqdrift.operators import evaluation as E
from seqdrift.operators import results as N
from seqdrift.operators import scoring as H
from seqdrift.operators.layout import neighbour_preservation, spectral_layout
from seqdrift.operators.mixture import GaussianMixture, MixtureModel, MixtureScore, density_expression
from seqdrift.operators.neighbours import nearest_join
from seqdrift.operators.settle import settled
from seqdrift.operators.transforms import PCA, Apply, Ensemble, Extract, KMeansDistance, StandardScaler, Subsample, row_mean
from seqdrift.plans.base import BASE_SQL, events, sequences, table
from seqdrift.sources import io as S

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("sample_id"), F.col("embedding").cast("array<double>").alias("emb"), "label")


def _splits(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return E.dataset_splits(_embeddings(spark, sf_dir), "label", range(5))


_KNN = """WITH x AS (SELECT vec_id, label, label <= 4 AND vec_id % 5 <> 0 AS ref, CAST(unnest(embedding) AS DOUBLE) AS v, unnest(range(1, 65)) AS i FROM embeddings),
    d AS (SELECT n.vec_id, n.label, r.vec_id AS ref_id, sqrt(sum((n.v - r.v) * (n.v - r.v))) AS dist FROM x n JOIN x r ON r.i = n.i AND r.ref AND NOT n.ref GROUP BY ALL),
    k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY dist, ref_id) AS nth FROM d),
    s AS (SELECT vec_id, label > 4 AS is_ood, avg(dist) AS score FROM k WHERE nth <= 5 GROUP BY ALL)"""


def _knn_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, inside, outside = _splits(spark, sf_dir)
    return H.k_nearest_neighbors(train, inside.unionByName(outside), 5, cap=None).select("sample_id", (F.col("label") > 4).alias("is_ood"), "score")


@query(_KNN + " SELECT vec_id AS sample_id, is_ood, round(score, 6) AS score FROM s")
def H06_knn_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _knn_scores(spark, sf_dir).withColumn("score", F.round("score", 6))


@query(_KNN + " SELECT vec_id AS sample_id, CAST(nth - 1 AS INTEGER) AS nth, round(dist, 6) AS distance FROM k WHERE nth <= 5")
def H07_knn_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, inside, outside = _splits(spark, sf_dir)
    found = H.k_nearest_neighbors(train, inside.unionByName(outside), 5, cap=None, distances=True)
    return found.select("sample_id", F.posexplode("distances").alias("nth", "distance")).withColumn("distance", F.round("distance", 6))


@query(_KNN + " SELECT vec_id AS sample_id, CAST(nth - 1 AS INTEGER) AS nth, ref_id, round(dist, 6) AS distance FROM k WHERE nth <= 5")
def H07_neighbour_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which reference rows are nearest, over cells of a few rows."""
    train, inside, outside = _splits(spark, sf_dir)
    rows = inside.unionByName(outside).select(F.col("sample_id").alias("nid"), F.col("emb").alias("x"))
    found = nearest_join(train.select(F.col("sample_id").alias("id"), F.col("emb").alias("x")), rows, 5, cell_bytes=1 << 16)
    each = found.select(F.col("nid").alias("sample_id"), F.posexplode("found").alias("nth", "f"))
    return each.select("sample_id", "nth", F.col("f.id").alias("ref_id"), F.round("f.distance", 6).alias("distance"))


_CONFUSION = """ , c AS (SELECT count(*) FILTER (WHERE is_ood AND score > t) AS tp, count(*) FILTER (WHERE is_ood AND score <= t) AS fn,
    count(*) FILTER (WHERE NOT is_ood AND score > t) AS fp, count(*) FILTER (WHERE NOT is_ood AND score <= t) AS tn FROM s, t)
    SELECT CAST(tp AS BIGINT) AS tp, CAST(fn AS BIGINT) AS fn, CAST(fp AS BIGINT) AS fp, CAST(tn AS BIGINT) AS tn, round(tp / (tp + fn), 6) AS tpr, round(fp / (fp + tn), 6) AS fpr FROM c"""


def _rounded(confusion: DataFrame) -> DataFrame:
    return confusion.withColumns({"tpr": F.round("tpr", 6), "fpr": F.round("fpr", 6)})


@query(_KNN + ", t AS (SELECT quantile_cont(score, 0.7) AS t FROM s)" + _CONFUSION)
def H06_E03_knn_detector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: nearest-neighbour scores, an exact 0.7 quantile as threshold, confusion counts and rates."""
    scores = settled(_knn_scores(spark, sf_dir))  # the join would be done for the counts, the quantile and the rates each
    return _rounded(E.confusion(scores, E.threshold(scores, "percentile", 0.7)))


# A score any engine can make: the document's length, with the labelled quality as ground truth.

_LENGTHS = "WITH s AS (SELECT d.doc_id, CAST(d.n_chars AS DOUBLE) AS score, l.quality = 0 AS is_ood FROM documents d JOIN labels l ON l.doc_id = d.doc_id)"


def _length_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "n_chars"), table(spark, sf_dir, "labels").select("doc_id", "quality")
    return docs.join(labels, "doc_id").select("doc_id", F.col("n_chars").cast("double").alias("score"), (F.col("quality") == 0).alias("is_ood"))


@query(
    _LENGTHS
    + """, o AS (SELECT score, row_number() OVER (ORDER BY score) - 1 AS i FROM s),
    p AS (SELECT avg(CASE WHEN is_ood THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END) * (count(*) - 1) AS place FROM s),
    b AS (SELECT max(score) FILTER (WHERE i = floor(place)) AS low, max(score) FILTER (WHERE i = ceil(place)) AS high, max(place - floor(place)) AS part FROM o, p)
    SELECT round((SELECT quantile_cont(score, 0.7) FROM s), 6) AS given, round(low + (high - low) * part, 6) AS by_share FROM b"""
)
def E01_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = _length_scores(spark, sf_dir)
    row = (E.threshold(scores, "percentile", 0.7), E.threshold(scores))
    return spark.createDataFrame([row], "given double, by_share double").select(F.round("given", 6).alias("given"), F.round("by_share", 6).alias("by_share"))


@query(_LENGTHS + " SELECT unnest([0.05, 0.5, 0.7, 0.95])::DOUBLE AS share, round(unnest((SELECT quantile_cont(score, [0.05, 0.5, 0.7, 0.95]) FROM s)), 6) AS score, true AS within_bound")
def E01_stream_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact thresholds, and whether those of the stream's merged sketches lie within twice the rank error."""
    import uuid

    from seqdrift.operators.settle import shared_folder
    from seqdrift.streaming import thresholds as Q

    folder, shares = f"{shared_folder(spark)}/{uuid.uuid4().hex}", [0.05, 0.5, 0.7, 0.95]
    scores = _length_scores(spark, sf_dir).select(F.col("score").cast("double").alias("score"))
    scores.repartition(4).write.parquet(f"{folder}/scores")
    stream = spark.readStream.schema("score double").option("maxFilesPerTrigger", 2).parquet(f"{folder}/scores")
    Q.keep(stream, f"{folder}/sketches", f"{folder}/state").awaitTermination()
    found = Q.thresholds(Q.kept(spark, f"{folder}/sketches"), shares)
    at_rest = spark.read.schema("score double").parquet(f"{folder}/scores")
    exact = spark.createDataFrame(list(zip(shares, E.percentiles(at_rest, "score", shares), strict=True)), "share double, exact double")
    asked, slack = {r["share"]: r["score"] for r in found.collect()}, 2 * Q.rank_error()
    ranks = [F.struct(F.lit(s).alias("share"), F.avg((F.col("score") < q).cast("double")).alias("below"), F.avg((F.col("score") <= q).cast("double")).alias("upto")) for s, q in asked.items()]
    near = (F.col("r.below") <= F.col("r.share") + slack) & (F.col("r.upto") >= F.col("r.share") - slack)
    rows = at_rest.agg(F.array(*ranks).alias("a")).select(F.explode("a").alias("r")).select("r.share", near.alias("near"))
    return exact.join(F.broadcast(rows), "share", "left").select("share", F.round("exact", 6).alias("score"), F.coalesce("near", F.lit(False)).alias("within_bound"))


@query(_LENGTHS + ", t AS (SELECT 1500.0::DOUBLE AS t)" + _CONFUSION)
def E02_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(E.confusion(_length_scores(spark, sf_dir), 1500.0))


@query(_LENGTHS + ", t AS (SELECT quantile_cont(score, 0.7) AS t FROM s)" + _CONFUSION)
def E03_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = _length_scores(spark, sf_dir)
    return _rounded(E.confusion(scores, E.threshold(scores, "percentile", 0.7)))


_ROC = """, q AS (SELECT quantile_cont(score, list_transform(range(0, 100), lambda j: j / 99.0::DOUBLE)) AS cuts FROM s),
    t AS (SELECT unnest(range(0, 100)) AS t_idx, unnest(cuts) AS t FROM q),
    r AS (SELECT t_idx, t, count(*) FILTER (WHERE is_ood AND score > t) / count(*) FILTER (WHERE is_ood) AS tpr, count(*) FILTER (WHERE NOT is_ood AND score > t) / count(*) FILTER (WHERE NOT is_ood) AS fpr FROM t, s GROUP BY ALL)"""


@query(_LENGTHS + _ROC + " SELECT CAST(t_idx AS INTEGER) AS t_idx, round(t, 6) AS threshold, round(tpr, 6) AS tpr, round(fpr, 6) AS fpr FROM r")
def E04_roc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.roc(_length_scores(spark, sf_dir)).select("t_idx", *[F.round(c, 6).alias(c) for c in ("threshold", "tpr", "fpr")])


@query(_LENGTHS + ", b AS (SELECT score, count(*) FILTER (WHERE is_ood) AS o, count(*) FILTER (WHERE NOT is_ood) AS i FROM s GROUP BY score), c AS (SELECT *, coalesce(sum(i) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM b) SELECT round(sum(o * (below + i / 2)) / (sum(o) * sum(i)), 6) AS auroc FROM c")
def E04_exact_auroc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.mann_whitney_auroc(_length_scores(spark, sf_dir)).select(F.round("auroc", 6).alias("auroc"))


@query(_LENGTHS + _ROC + ", a AS (SELECT (fpr - lag(fpr) OVER w) * (tpr + lag(tpr) OVER w) / 2 AS area FROM r WINDOW w AS (ORDER BY fpr, tpr)) SELECT round(sum(area), 6) AS auroc FROM a")
def E04_auroc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.auroc(_length_scores(spark, sf_dir)).select(F.round("auroc", 6).alias("auroc"))


_BINS = ", r AS (SELECT min(score) AS lo, (max(score) - min(score)) / 50 AS w FROM s), p AS (SELECT doc_id, is_ood, CAST(least(floor((score - lo) / w), 49) AS INTEGER) AS bin FROM s, r)"


@query(_LENGTHS + _BINS + ", g AS (SELECT CAST(b AS INTEGER) AS bin, o AS is_ood FROM (SELECT unnest(range(0, 50)) AS b) x, (VALUES (true), (false)) y(o)) SELECT g.bin, g.is_ood, round(lo + g.bin * w, 6) AS low, count(p.doc_id) AS n FROM g CROSS JOIN r LEFT JOIN p ON p.bin = g.bin AND p.is_ood = g.is_ood GROUP BY ALL")
def E05_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.histogram(_length_scores(spark, sf_dir)).select("bin", "is_ood", F.round("low", 6).alias("low"), "n")


@query(_LENGTHS + _BINS + ", k AS (SELECT *, row_number() OVER (PARTITION BY bin, is_ood ORDER BY doc_id) AS nth, count(*) OVER (PARTITION BY bin, is_ood) AS n FROM p) SELECT bin, is_ood, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) FILTER (WHERE nth <= 20) || CASE WHEN max(n) > 20 THEN ' (+' || (max(n) - 20) || ' more)' ELSE '' END AS label FROM k GROUP BY ALL")
def E05_histogram_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.histogram(_length_scores(spark, sf_dir), index="doc_id").where("n > 0").select("bin", "is_ood", "label")


@query()
def E06_run_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, inside, outside = _splits(spark, sf_dir)
    found = E.run_ood_detection(H.standard_detector(train), inside, outside)
    (tp, fn), (fp, tn) = found["confusion_matrix"]
    return spark.createDataFrame([(found["threshold"], tp, fn, fp, tn, found["auroc"])], "threshold double, tp bigint, fn bigint, fp bigint, tn bigint, auroc double")


@query("SELECT CASE WHEN label <= 4 AND vec_id % 5 <> 0 THEN 'train' WHEN label <= 4 THEN 'id_test' ELSE 'ood' END AS part, count(*) AS n FROM embeddings GROUP BY 1")
def E08_dataset_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [df.select(F.lit(name).alias("part")) for name, df in zip(("train", "id_test", "ood"), _splits(spark, sf_dir), strict=True)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("part").agg(F.count("*").alias("n"))


# The covariance of two features has a closed-form inverse, so SQL can follow; the features are of whole vectors.

_TWO = """WITH e AS (SELECT vec_id, label, list_avg(list_transform(embedding, lambda v: CAST(v AS DOUBLE))) AS x, sqrt(list_sum(list_transform(embedding, lambda v: CAST(v AS DOUBLE) * CAST(v AS DOUBLE)))) AS y FROM embeddings),
    m AS (SELECT avg(x) AS mx, avg(y) AS my, var_samp(x) + 1e-6 AS a, var_samp(y) + 1e-6 AS b, covar_samp(x, y) AS c FROM e WHERE label <= 4 AND vec_id % 5 <> 0)"""
_QUADRATIC = "(b * (x - mx) * (x - mx) - 2 * c * (x - mx) * (y - my) + a * (y - my) * (y - my)) / (a * b - c * c)"


def _mean_and_length(df: DataFrame) -> DataFrame:
    length = F.sqrt(F.aggregate("emb", F.lit(0.0), lambda s, v: s + v * v))
    return df.withColumn("emb", F.array(row_mean(F.col("emb")), length))


@query(_TWO + f" SELECT vec_id AS sample_id, round(sqrt({_QUADRATIC}), 6) AS score FROM e, m WHERE label > 4 OR vec_id % 5 = 0")
def H01_mahalanobis(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, inside, outside = map(_mean_and_length, _splits(spark, sf_dir))
    return H.mahalanobis_distance(train, inside.unionByName(outside)).select("sample_id", F.round("score", 6).alias("score"))


# Fixed parameters of 64 dimensions: dimension i has mean i / 64 - 0.5 and variance 1 + i / 32, a second component the reverse.

_DIMS = "WITH x AS (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS v, unnest(range(0, 64)) AS i FROM embeddings)"
_MEANS = [[i / 64 - 0.5 for i in range(64)], [0.5 - i / 64 for i in range(64)]]
_VARIANCES = [[1 + i / 32 for i in range(64)], [3 - i / 32 for i in range(64)]]
_WEIGHTS = (0.3, 0.7)


@query(_DIMS + " SELECT vec_id AS sample_id, round(sum(v * v / (1 + i / 32.0::DOUBLE)), 6) AS score FROM x GROUP BY vec_id")
def H02_from_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    form = H.mahalanobis_from_stats(F.col("emb"), np.zeros(64), covariance=np.diag(_VARIANCES[0]), squared=True)
    return _embeddings(spark, sf_dir).select("sample_id", F.round(form, 6).alias("score"))


@query(_DIMS + " SELECT vec_id AS sample_id, round(-0.5 * sum(v * v / (1 + i / 32.0::DOUBLE) + ln(1 + i / 32.0::DOUBLE) + ln(2 * pi())), 6) AS log_prob FROM x GROUP BY vec_id")
def H03_gaussian_log_prob(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.gaussian_log_prob(_embeddings(spark, sf_dir), np.zeros(64), np.diag(_VARIANCES[0])).select("sample_id", F.round("log_prob", 6).alias("log_prob"))


_COMPONENT_SQL = (
    _DIMS
    + """, p AS (SELECT vec_id, ln(0.3) - 0.5 * sum((v - (i / 64.0::DOUBLE - 0.5)) ** 2 / (1 + i / 32.0::DOUBLE) + ln(1 + i / 32.0::DOUBLE) + ln(2 * pi())) AS a,
        ln(0.7) - 0.5 * sum((v - (0.5 - i / 64.0::DOUBLE)) ** 2 / (3 - i / 32.0::DOUBLE) + ln(3 - i / 32.0::DOUBLE) + ln(2 * pi())) AS b,
        sqrt(sum((v - (i / 64.0::DOUBLE - 0.5)) ** 2 / (1 + i / 32.0::DOUBLE + 1e-6))) AS da, sqrt(sum((v - (0.5 - i / 64.0::DOUBLE)) ** 2 / (3 - i / 32.0::DOUBLE + 1e-6))) AS db FROM x GROUP BY vec_id)"""
)


def _mixture():
    return MixtureModel(np.array(_WEIGHTS), np.array(_MEANS), np.array(_VARIANCES), 0.0, "emb", "emb")


@query(_COMPONENT_SQL + " SELECT vec_id AS sample_id, round(-(greatest(a, b) + ln(exp(a - greatest(a, b)) + exp(b - greatest(a, b)))), 6) AS score FROM p")
def H04_mixture_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    form = density_expression(F.col("emb"), np.array(_WEIGHTS), np.array(_MEANS), np.array(_VARIANCES))
    return _embeddings(spark, sf_dir).select("sample_id", F.round(form, 6).alias("score"))


@query(_COMPONENT_SQL + " SELECT vec_id AS sample_id, round(least(da, db), 6) AS score FROM p")
def H05_min_distance_of_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mixture of given parameters, written and read back."""
    path = _scratch(spark)
    _mixture().write().save(path)
    return MixtureModel.load(path).score(_embeddings(spark, sf_dir), "min_md").select("sample_id", F.round("score", 6).alias("score"))


@query()
def H05_mixture_min_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, inside, outside = _splits(spark, sf_dir)
    model = GaussianMixture(2, tolerance=1e-4).fit(train)
    return model.score(inside.unionByName(outside), "min_md").select("sample_id", F.round("score", 6).alias("score"))


@query("SELECT vec_id AS sample_id, round(list_avg(list_transform(embedding, lambda v: CAST(v AS DOUBLE))), 6) AS score FROM embeddings WHERE label > 4")
def H08_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, _, outside = _splits(spark, sf_dir)
    return H.identity(train, outside.withColumn("emb", F.array(row_mean(F.col("emb"))))).select("sample_id", F.round("score", 6).alias("score"))


@query()
def H09_detector_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, inside, outside = _splits(spark, sf_dir)
    return H.standard_detector(train).score(inside.unionByName(outside)).select("sample_id", F.round("score", 6).alias("score"))


@query()
def H11_token_detector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From tokens to scores: two thirds of the users are the reference, the others are scored."""
    from seqdrift.operators.pooling import toy_embeddings

    rows = sequences(spark, sf_dir, "plain")
    train, new = rows.where(F.col("seq_id") % 3 != 0), rows.where(F.col("seq_id") % 3 == 0)
    detector = H.standard_detector(train, 4, Extract(toy_embeddings, dimensions=4, layer=12))
    return detector.score(new).select("sample_id", F.round("score", 6).alias("score"))


@query()
def X01_exported_detector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores by the exported parameters; the tests hold them against the detector's own."""
    train, inside, outside = _splits(spark, sf_dir)
    parameters = H.detector_parameters(H.standard_detector(train))
    return H.score_with_parameters(inside.unionByName(outside), parameters).select("sample_id", F.round("score", 6).alias("score"))


_SCALED = "WITH x AS (SELECT vec_id, label, CAST(unnest(embedding) AS DOUBLE) AS v, unnest(range(0, 64)) AS dim FROM embeddings), m AS (SELECT dim, avg(v) AS mean, stddev_pop(v) AS sd FROM x WHERE label <= 4 AND vec_id % 5 <> 0 GROUP BY dim)"


@query(_SCALED + " SELECT vec_id AS sample_id, CAST(dim AS INTEGER) AS dim, round((v - mean) / sd, 6) AS value FROM x JOIN m USING (dim) WHERE label > 4")
def F04_standard_scaler(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, _, outside = _splits(spark, sf_dir)
    scaled = StandardScaler().fit(train).transform(outside)
    return scaled.select("sample_id", F.posexplode("emb").alias("dim", "value")).withColumn("value", F.round("value", 6))


@query("SELECT vec_id AS sample_id, round(list_avg(list_transform(embedding, lambda v: CAST(v AS DOUBLE))), 6) AS score FROM embeddings")
def F09_row_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Apply(row_mean, outputCol="score").transform(_embeddings(spark, sf_dir)).select("sample_id", F.round("score", 6).alias("score"))


@query(_SCALED + " SELECT vec_id AS sample_id, round(avg((v - mean) / sd), 6) AS score FROM x JOIN m USING (dim) WHERE label > 4 GROUP BY vec_id")
def F01_scaler_then_row_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.ml import Pipeline

    train, _, outside = _splits(spark, sf_dir)
    model = Pipeline(stages=[StandardScaler(), Apply(row_mean, outputCol="score")]).fit(train)
    return model.transform(outside).select("sample_id", F.round("score", 6).alias("score"))


@query(_SCALED + " SELECT vec_id AS sample_id, round(avg((v - mean) / sd), 6) AS score FROM x JOIN m USING (dim) WHERE label > 4 GROUP BY vec_id")
def S15_saved_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fitted pipeline, written, read back and scoring as before."""
    from pyspark.ml import Pipeline, PipelineModel

    train, _, outside = _splits(spark, sf_dir)
    path = _scratch(spark)
    Pipeline(stages=[StandardScaler(), Apply(row_mean, outputCol="score")]).fit(train).write().save(path)
    return PipelineModel.load(path).transform(outside).select("sample_id", F.round("score", 6).alias("score"))


@query(_SCALED + " SELECT vec_id AS sample_id, CAST(dim AS INTEGER) AS dim, round((v - mean) / sd, 6) AS value FROM x JOIN m USING (dim) WHERE label > 4")
def F10_extract_then_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extraction is the pipeline's first stage: what goes in are rows of numbers as text, not embeddings."""
    from pyspark.ml import Pipeline

    def as_text(df: DataFrame) -> DataFrame:
        return df.select("sample_id", F.array_join(F.col("emb").cast("array<string>"), " ").alias("text"))

    train, _, outside = _splits(spark, sf_dir)
    model = Pipeline(stages=[Extract(from_text), StandardScaler()]).fit(as_text(train))
    scaled = model.transform(as_text(outside))
    return scaled.select("sample_id", F.posexplode("emb").alias("dim", "value")).withColumn("value", F.round("value", 6))


def from_text(df: DataFrame) -> DataFrame:
    return df.withColumn("emb", F.split("text", " ").cast("array<double>"))


@query()
def F02_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, _, outside = _splits(spark, sf_dir)
    model = Ensemble(lambda: [PCA(5), StandardScaler()], 3, 10, seed=42).fit(train)
    return model.transform(outside).select("sample_id", F.size("emb").alias("dims"), F.round(F.col("emb")[0], 6).alias("first"))


#: The features that a seeded choice of 16 of 64 takes.
_CHOSEN = np.random.default_rng(42).permutation(64)[:16].tolist()


@query(f"SELECT vec_id AS sample_id, CAST(i AS INTEGER) AS place, round(CAST(embedding[{_CHOSEN}[i + 1] + 1] AS DOUBLE), 6) AS value FROM embeddings, range(0, 16) AS r(i) WHERE label > 4")
def F03_subsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, _, outside = _splits(spark, sf_dir)
    return Subsample(16).fit(train).transform(outside).select("sample_id", F.posexplode("emb").alias("place", "value")).withColumn("value", F.round("value", 6))


@query()
def F05_pca(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, _, outside = _splits(spark, sf_dir)
    return PCA(5).fit(train).transform(outside).select("sample_id", F.posexplode("emb").alias("component", "value")).withColumn("value", F.round("value", 6))


@query(
    """WITH m AS (SELECT var_samp(CAST(l_quantity AS DOUBLE)) AS a, var_samp(CAST(l_extendedprice AS DOUBLE) / 1000) AS c, covar_samp(CAST(l_quantity AS DOUBLE), CAST(l_extendedprice AS DOUBLE) / 1000) AS b FROM lineitem),
    v AS (SELECT *, (a + c) / 2 + sqrt(((a - c) / 2) ** 2 + b * b) AS top FROM m), x AS (SELECT *, b / sqrt(b * b + (top - a) ** 2) AS x, (top - a) / sqrt(b * b + (top - a) ** 2) AS y FROM v),
    s AS (SELECT *, CASE WHEN (CASE WHEN abs(x) >= abs(y) THEN x ELSE y END) < 0 THEN -1 ELSE 1 END AS sign FROM x)
    SELECT round(x * sign, 6) AS loading_quantity, round(y * sign, 6) AS loading_price, round(top, 4) AS variance, round(top / (a + c), 6) AS ratio FROM s"""
)
def F05_pca_plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two features of every line item, by the passes that wide rows take."""
    features = F.array(F.col("l_quantity").cast("double"), F.col("l_extendedprice").cast("double") / 1000)
    p = PCA(1, dense_width=1).fit(table(spark, sf_dir, "lineitem").select(features.alias("emb"))).fitted
    row = (*(round(float(v), 6) for v in p["components"][0]), round(float(p["explained_variance"][0]), 4), round(float(p["explained_variance_ratio"][0]), 6))
    return spark.createDataFrame([row], "loading_quantity double, loading_price double, variance double, ratio double")


@query()
def F06_mixture_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, _, _ = _splits(spark, sf_dir)
    model = GaussianMixture(3, diagonal=False, tolerance=1e-3).fit(train)
    return spark.createDataFrame([(i, float(w)) for i, w in enumerate(model.weights)], "component int, weight double")


@query()
def F07_mixture_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, _, outside = _splits(spark, sf_dir)
    return MixtureScore(2).fit(train).transform(outside).select("sample_id", F.round(F.col("emb")[0], 6).alias("score"))


@query()
def F08_kmeans_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, _, outside = _splits(spark, sf_dir)
    return KMeansDistance(3).fit(train).transform(outside).select("sample_id", F.posexplode("emb").alias("centre", "distance")).withColumn("distance", F.round("distance", 6))


# Analysis.


@query("SELECT round(avg(sqrt(list_sum(list_transform(embedding, lambda v: CAST(v AS DOUBLE) * CAST(v AS DOUBLE))))), 6) AS mean_magnitude FROM embeddings")
def A06_mean_magnitude(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.mean_magnitude(_embeddings(spark, sf_dir)).select(F.round("mean_magnitude", 6).alias("mean_magnitude"))


@query()
def A06_effective_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _embeddings(spark, sf_dir)
    found = (A.components_needed(rows, 0.95), A.eigenvalue_entropy(rows))
    return spark.createDataFrame([found], "effective_dimension int, eigenvalue_entropy double")


@query()
def A08_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding in two dimensions."""
    placed = spectral_layout(_embeddings(spark, sf_dir))
    return placed.select("sample_id", F.round(F.col("place")[0], 3).alias("x"), F.round(F.col("place")[1], 3).alias("y"))


@query()
def A08_preservation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of the exact nearest neighbours the layout keeps."""
    rows = _embeddings(spark, sf_dir)
    return neighbour_preservation(rows, spectral_layout(rows)).withColumn("preserved", F.round("preserved", 3))


@query()
def A02_mardia(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([A.mardia(_embeddings(spark, sf_dir))])


@query()
def A03_henze_zirkler(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([A.henze_zirkler(_embeddings(spark, sf_dir))])


@query()
def A04_royston(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([A.royston(_embeddings(spark, sf_dir))])


@query()
def A05_shapiro(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([A.shapiro(_embeddings(spark, sf_dir))])


@query()
def A07_spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.spectrum(_embeddings(spark, sf_dir), 20).select("component", F.round("ratio", 6).alias("ratio"), F.round("cumulative", 6).alias("cumulative"))


@query()
def A09_layer_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    layers = _embeddings(spark, sf_dir).withColumn("layer", (F.col("label") % 2).cast("int"))
    return A.layer_metrics(layers)


_COMPARED = "SELECT event_type AS dataset, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS row, CAST(event_id % 100 AS INTEGER) AS time, CAST(event_id % 7 AS INTEGER) AS dur, CAST(event_id % 128 AS INTEGER) AS note FROM events"


@query(f"WITH c AS ({_COMPARED}) SELECT CAST(row AS INTEGER) AS row, max(time) FILTER (WHERE dataset = 'click') AS click__time, max(note) FILTER (WHERE dataset = 'click') AS click__note, max(time) FILTER (WHERE dataset = 'view') AS view__time, max(note) FILTER (WHERE dataset = 'view') AS view__note FROM c WHERE row < 50 GROUP BY row")
def A10_event_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("dataset"), F.col("event_id").alias("ev_idx"), (F.col("event_id") % 100).cast("int").alias("time"), (F.col("event_id") % 7).cast("int").alias("dur"), (F.col("event_id") % 128).cast("int").alias("note"))
    return A.event_comparison(rows).select("row", "click__time", "click__note", "view__time", "view__note")


@query("SELECT least(count(*), 100) AS n, 16 AS dims FROM embeddings")
def A01_subsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.subsample(_embeddings(spark, sf_dir), rows=100, columns=16).agg(F.count("*").alias("n"), F.max(F.size("emb")).alias("dims"))


# Results: experiment records made from orders, one per (customer segment, priority).

_STATS = """WITH r AS (SELECT 'p' || (o_custkey % 12) AS transformations, 's' || (o_orderkey % 5) AS scoring_function,
    count(*) FILTER (WHERE o_orderkey % 3 = 0) AS tp, count(*) FILTER (WHERE o_orderkey % 3 = 1) AS fn, count(*) FILTER (WHERE o_orderkey % 7 < 3) AS fp, count(*) FILTER (WHERE o_orderkey % 7 >= 3) AS tn FROM orders GROUP BY 1, 2),
    s AS (SELECT *, tp + fn + fp + tn AS total, (tp * 1.0::DOUBLE / (tp + fn) + tn * 1.0::DOUBLE / (fp + tn)) / 2 AS auroc FROM r)"""


def _stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    counts = table(spark, sf_dir, "orders").groupBy(F.concat(F.lit("p"), F.col("o_custkey") % 12).alias("transformations"), F.concat(F.lit("s"), key % 5).alias("scoring_function"))
    cells = counts.agg(F.count_if(key % 3 == 0).alias("tp"), F.count_if(key % 3 == 1).alias("fn"), F.count_if(key % 7 < 3).alias("fp"), F.count_if(key % 7 >= 3).alias("tn"))
    area = (F.col("tp") / (F.col("tp") + F.col("fn")) + F.col("tn") / (F.col("fp") + F.col("tn"))) / 2
    return cells.select("transformations", "scoring_function", F.array(F.array("tp", "fn"), F.array("fp", "tn")).alias("confusion_matrix"), area.alias("auroc"))


@query(_STATS + " SELECT transformations, scoring_function, tp, fn, fp, tn, round(auroc, 6) AS auroc FROM s")
def N01_unnest_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.unnest_confusion(_stats(spark, sf_dir)).withColumn("auroc", F.round("auroc", 6))


@query(
    _STATS
    + """ SELECT g.transformations, g.scoring_function, s.transformations IS NOT NULL AS recorded, round(auroc, 6) AS auroc
    FROM (SELECT 'p' || i AS transformations, 's' || j AS scoring_function FROM (SELECT unnest(range(0, 16)) AS i) x, (SELECT unnest(range(0, 5)) AS j) y) g
    LEFT JOIN s ON s.transformations = g.transformations AND s.scoring_function = g.scoring_function"""
)
def E07_experiment_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every combination of settings, with what has been recorded of it."""
    grid = E.experiment_grid(spark, transformations=[f"p{i}" for i in range(16)], scoring_function=[f"s{j}" for j in range(5)])
    stats = _stats(spark, sf_dir).select("transformations", "scoring_function", F.lit(True).alias("recorded"), F.round("auroc", 6).alias("auroc"))
    return grid.join(stats, ["transformations", "scoring_function"], "left").withColumn("recorded", F.coalesce("recorded", F.lit(False)))


@query(_STATS + " SELECT transformations, scoring_function, total FROM s WHERE total >= 100")
def N02_with_enough(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.with_enough(N.unnest_confusion(_stats(spark, sf_dir))).select("transformations", "scoring_function", "total")


@query(_STATS + " SELECT transformations, scoring_function, CAST(row_number() OVER (ORDER BY auroc DESC, transformations, scoring_function) - 1 AS INTEGER) AS rank FROM s")
def N03_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.ranked(_stats(spark, sf_dir)).select("transformations", "scoring_function", "rank")


@query(_STATS + " SELECT count(*) AS n, round(max(auroc), 6) AS max, round(min(auroc), 6) AS min, round(avg(auroc), 6) AS mean FROM s")
def N04_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.overview(_stats(spark, sf_dir)).select("n", *[F.round(c, 6).alias(c) for c in ("max", "min", "mean")])


@query(_STATS + " SELECT transformations, scoring_function, round(auroc, 6) AS auroc FROM s ORDER BY auroc DESC, transformations, scoring_function LIMIT 20")
def N05_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.top(_stats(spark, sf_dir)).select("transformations", "scoring_function", F.round("auroc", 6).alias("auroc"))


@query(_STATS + " SELECT scoring_function, count(*) AS n, round(avg(auroc), 6) AS mean, round(stddev_samp(auroc), 6) AS std, round(min(auroc), 6) AS min, round(max(auroc), 6) AS max FROM s GROUP BY 1")
def N06_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.by_group(_stats(spark, sf_dir)).select("scoring_function", "n", *[F.round(c, 6).alias(c) for c in ("mean", "std", "min", "max")])


@query(_STATS + " SELECT transformations, scoring_function, printf('%.4f', auroc) AS auroc FROM s")
def N07_formatted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.formatted(_stats(spark, sf_dir), "auroc").select("transformations", "scoring_function", "auroc")


# Sources: what is written comes back. Round trips use the folder that the session's checkpoints go to.


def _scratch(spark: SparkSession) -> str:
    import uuid

    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if shared is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="seqdrift-")
    return f"{shared.rstrip('/')}/sources-{uuid.uuid4().hex}"


_SEQ_SUMS = " SELECT seq_id, CAST(len(tokens) AS INTEGER) AS n, CAST(list_sum(tokens) AS BIGINT) AS total FROM seqs"


def _sums(df: DataFrame, column: str = "tokens") -> DataFrame:
    return df.select("seq_id", F.size(column).alias("n"), F.aggregate(column, F.lit(0).cast("bigint"), lambda s, x: s + x).alias("total"))


@query(BASE_SQL + _SEQ_SUMS + " WHERE seq_id % 3 = 0")
def S01_split_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _scratch(spark)
    sequences(spark, sf_dir).withColumn("split", F.when(F.col("seq_id") % 3 == 0, "test").otherwise("train")).write.partitionBy("split").parquet(path)
    return _sums(S.split_scan(spark, path, "test"))


@query(BASE_SQL + " SELECT count(*) AS n, CAST(sum(list_sum(tokens)) AS BIGINT) AS total FROM plain_seqs")
def S02_text_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _scratch(spark)
    sequences(spark, sf_dir, "plain").select(F.array_join(F.col("tokens").cast("array<string>"), " ")).write.text(path)
    return _sums(S.text_scan(spark, path), "input_ids").agg(F.count("*").alias("n"), F.sum("total").alias("total"))


@query("SELECT user_id AS seq_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) - 1 AS INTEGER) AS msg_idx, round(epoch_us(ts) / 1000000::DOUBLE, 6) AS ts, CAST(event_id % 128 AS INTEGER) AS note FROM events")
def S03_S04_recording(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A recording of every user, written and read back."""
    path = _scratch(spark)
    ts = F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("seq_id"), F.col("event_id").alias("msg_idx"), ts.alias("ts"), F.lit("note_on").alias("type"), (F.col("event_id") % 128).cast("int").alias("note"), F.lit(64).alias("velocity"), F.lit(0).alias("channel"))
    S.write_recordings(rows, path)
    return S.read_recordings(spark, path).select("seq_id", "msg_idx", F.round("ts", 6).alias("ts"), "note")


@query("SELECT vec_id AS sample_id, CAST(label AS INTEGER) AS layer, round(list_sum(list_transform(embedding, lambda v: CAST(v AS DOUBLE))), 6) AS total FROM embeddings WHERE label IN (1, 3)")
def S05_S06_embedding_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    cache = S.EmbeddingCache(spark, _scratch(spark))
    cache.write(_embeddings(spark, sf_dir).withColumn("layer", F.col("label").cast("int")).drop("label"), "all", "mean_std")
    total = F.aggregate("emb", F.lit(0.0), lambda s, v: s + v)
    return cache.read("all", "mean_std", [1, 3]).select("sample_id", "layer", F.round(total, 6).alias("total"))


@query(BASE_SQL + " SELECT CASE WHEN seq_id % 3 = 0 THEN 'test' ELSE 'train' END AS split, count(*) AS n, min(seq_id) AS first_id FROM seqs GROUP BY 1")
def S10_split_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.split_probe(sequences(spark, sf_dir).withColumn("split", F.when(F.col("seq_id") % 3 == 0, "test").otherwise("train")))


@query()
def S11_S12_midi_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MIDI files written from notes and parsed again; the tests check that notes come back."""
    from seqdrift.operators import midi as M

    compound = M.events_to_compound(events(spark, sf_dir, "plain"))
    files = S.encode_midi(M.to_messages(compound))
    return files.select("seq_id", F.length("content").alias("bytes"))


@query(_STATS + " SELECT count(*) AS n, round(avg(auroc), 6) AS mean FROM s")
def S16_S17_experiment_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _scratch(spark)
    S.append_stats(_stats(spark, sf_dir).withColumns({"true_positive_rate": F.lit(0.5), "false_positive_rate": F.lit(0.5)}), path)
    return S.read_stats(spark, path).agg(F.count("*").alias("n"), F.round(F.avg("auroc"), 6).alias("mean"))


@query("SELECT nation.n_name AS n_name, count(*) AS n FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1")
def S18_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _scratch(spark)
    rows = table(spark, sf_dir, "customer").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    S.write_csv(rows.select("n_name"), path)
    return spark.read.option("header", True).csv(path).groupBy("n_name").agg(F.count("*").alias("n"))


@query(BASE_SQL + " SELECT seq_id FROM (SELECT seq_id, row_number() OVER (ORDER BY seq_id) - 1 AS nth FROM seqs) WHERE nth % 7 = 0 ORDER BY nth LIMIT 10")
def S21_grid_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.grid_selection(sequences(spark, sf_dir), 7, 10).select("seq_id")

