"""Transforms, scores, evaluation, normality tests, streams and the registered catalogue."""

import math

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from seqdrift.operators import analysis as A
from seqdrift.operators import evaluation as E
from seqdrift.operators import linalg as L
from seqdrift.operators import pooling as P
from seqdrift.operators import sampling as G
from seqdrift.operators import scoring as H
from seqdrift.operators import transforms as F_
from seqdrift.operators.mixture import GaussianMixture
from seqdrift.operators.transforms import PCA, Apply, Ensemble, KMeansDistance, StandardScaler
from seqdrift.sources import io as S
from seqdrift.streaming import pedal as R


def emb(spark, rows):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(rows)], "sample_id long, emb array<double>")


def values(df, column="emb"):
    return np.array([r[0] for r in df.orderBy("sample_id").select(column).collect()])


TRAIN = [(1, 1), (1.1, 1), (0.9, 1.2)]


def test_mahalanobis_grows(spark):
    got = values(H.mahalanobis_distance(emb(spark, [(1, 1), (1.1, 0.9), (0.9, 1.2)]), emb(spark, [(1.05, 1), (3, 3), (5, 5)])), "score")
    assert (got >= 0).all() and got[0] < got[1] < got[2]


def test_mahalanobis_equals_numpy(spark):
    rng = np.random.default_rng(0)
    train, new = rng.normal(size=(200, 5)), rng.normal(size=(20, 5))
    inverse = np.linalg.inv(np.cov(train.T) + 1e-6 * np.eye(5))
    want = np.sqrt(np.einsum("ni,ij,nj->n", new - train.mean(0), inverse, new - train.mean(0)))
    assert np.allclose(values(H.mahalanobis_distance(emb(spark, train), emb(spark, new)), "score"), want)


def test_one_dimensional_scores(spark):
    train = spark.createDataFrame([(0, 1.0), (1, 2.0), (2, 4.0)], "sample_id long, emb double")
    assert values(H.k_nearest_neighbors(train, train, 1), "score").tolist() == [0, 0, 0]
    assert len(values(H.mahalanobis_distance(train, train), "score")) == 3


@pytest.mark.parametrize(("inside", "outside", "method", "value", "tpr", "fpr"), [([(1, 1), (1, 1.1), (1.2, 0.9)], [(3, 3), (4, 4), (1, 1.1), (5, 5)], "percentile", None, 3 / 4, 1 / 3), ([(1, 1), (1, 1.1), (1.2, 0.9)], [(3, 3), (4, 4), (1, 1.1), (5, 5)], "percentile", 0.8, 1 / 2, 0), ([(1, 1), (1, 1.1), (1.2, 0.9)], [(3, 3), (4, 4), (5, 5)], "value", 10, 1, 0)])
def test_detector_examples(spark, inside, outside, method, value, tpr, fpr):
    detector = H.OODDetector([PCA(2), StandardScaler()], H.mahalanobis_distance, emb(spark, TRAIN))
    scores = E.pooled(detector.score(emb(spark, inside)), detector.score(emb(spark, outside)))
    row = E.confusion(scores, E.threshold(scores, method, value)).first()
    assert row.tpr == pytest.approx(tpr) and row.fpr == pytest.approx(fpr)


def test_affine_pipeline(spark):
    matrix = np.random.default_rng(3).normal(size=(2, 5))
    project = Apply(lambda x: F.transform(F.array(x), lambda y: F.array(*[y[0] * float(matrix[0, j]) + y[1] * float(matrix[1, j]) for j in range(5)]))[0])
    model = Pipeline(stages=[project, PCA(2), StandardScaler(), Apply(lambda x: F.transform(x, lambda v: v + 1))]).fit(emb(spark, TRAIN))
    got = values(model.transform(emb(spark, [*TRAIN, (2, 3), (3, 5)])))
    assert got[:3].sum() == pytest.approx(6.0)
    assert np.allclose(got[0] + got[4] - 2 * got[3], 0, atol=1e-5)


def test_scaler_and_pca_equal_numpy(spark):
    x = np.random.default_rng(1).normal(size=(100, 6)) @ np.diag([5, 3, 1, 1, 0.5, 0.1]) + 100
    assert np.allclose(values(StandardScaler().fit(emb(spark, x)).transform(emb(spark, x))), (x - x.mean(0)) / x.std(0))
    model = PCA(3).fit(emb(spark, x))
    got = values(model.transform(emb(spark, x)))
    u, s, _ = np.linalg.svd(x - x.mean(0), full_matrices=False)
    assert np.allclose(np.abs(got), np.abs(u[:, :3] * s[:3]), atol=1e-6)
    assert np.allclose(model.fitted["explained_variance_ratio"], (s**2 / (s**2).sum())[:3])


def test_ensemble(spark):
    x = np.random.default_rng(5).normal(size=(8, 20))
    model = Ensemble(lambda: [PCA(5), StandardScaler()], 3, 10, seed=42).fit(emb(spark, x))
    assert values(model.transform(emb(spark, x))).shape == (8, 5)
    members = values(model.member_outputs(emb(spark, x)), "members_")
    assert not np.allclose(members[:, 0], members[:, 1])
    with pytest.raises(ValueError):
        Ensemble(lambda: [], 2, 30).fit(emb(spark, x))


def test_kmeans_example(spark):
    train = [(1, 2), (1.5, 2.5), (2, 3), (5, 6), (5.5, 6.5), (6, 7), (10, 11), (10.5, 11.5)]
    got = values(KMeansDistance(3).fit(emb(spark, train)).transform(emb(spark, [(1.2, 2.3), (5.3, 6.4), (10.2, 11.3)])))
    want = [[0.360555, 6.010823, 12.728119], [5.445181, 0.223607, 6.930007], [12.374571, 6.717886, 0.070711]]
    assert np.allclose(got, want, atol=1e-5)


@pytest.mark.parametrize("diagonal", [True, False])
def test_mixture_recovery(spark, diagonal):
    rng = np.random.default_rng(42)
    means = np.array([(5, 5, 5, 5), (10, 0, 0, 0), (-10, -10, -10, -10)])
    spread = np.array([(1, 1, 1, 1), (2, 1, 2, 2), (2, 2, 1, 2)])
    x = np.concatenate([rng.normal(m, s, size=(100, 4)) for m, s in zip(means, spread, strict=True)])
    model = GaussianMixture(3, diagonal=diagonal, tolerance=1e-4).fit(emb(spark, x))
    found = model.get_params()["means"]
    assert all(np.abs(found - m).max(axis=1).min() < 1 for m in means) and np.allclose(model.weights, 1 / 3, atol=0.05)
    density = values(model.score(emb(spark, [(5, 5, 5, 5), (50, 50, 50, 50)])), "score")
    assert density[0] < density[1]


def test_min_distance_example(spark):
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.normal(0, 0.5, (100, 2)), rng.normal(10, 0.5, (100, 2))])
    model = GaussianMixture(2, tolerance=1e-4).fit(emb(spark, x))
    got = values(model.score(emb(spark, [(-1, 1), (0.5, 0.5), (5, 5), (10, 10), (12, 7)]), "min_md"), "score")
    assert np.allclose(got[[0, 1, 3]], [math.sqrt(2) / 0.5, math.sqrt(0.5) / 0.5, 0], atol=1)
    with pytest.raises(ValueError):
        model.score(emb(spark, [(0, 0)]), "other")
    with pytest.raises(ValueError):
        GaussianMixture(2)


def test_knn_equals_numpy(spark):
    rng = np.random.default_rng(2)
    train, new = rng.normal(size=(50, 3)), rng.normal(size=(9, 3))
    d = np.sort(np.sqrt(((new[:, None] - train[None]) ** 2).sum(2)), axis=1)
    assert np.allclose(values(H.k_nearest_neighbors(emb(spark, train), emb(spark, new), 4), "score"), d[:, :4].mean(1))
    with pytest.raises(ValueError):
        H.k_nearest_neighbors(emb(spark, train), emb(spark, new), 51)


def test_exported_parameters(spark, tmp_path):
    x = np.random.default_rng(9).normal(size=(60, 12))
    detector = H.standard_detector(emb(spark, x), 4)
    S.write_parameters(spark, H.detector_parameters(detector), f"{tmp_path}/p")
    back = H.score_with_parameters(emb(spark, x), S.read_parameters(spark, f"{tmp_path}/p"))
    assert np.allclose(values(back, "score"), values(detector.score(emb(spark, x)), "score"))


def plain_auroc(inside, outside):
    pool = np.array([*inside, *outside])
    cuts = np.percentile(pool, np.linspace(0, 1, 100) * 100)
    points = sorted(((np.mean(np.array(inside) > c), np.mean(np.array(outside) > c)) for c in cuts))
    return sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(points, points[1:], strict=False))


def test_auroc(spark):
    rng = np.random.default_rng(4)
    inside, outside = rng.normal(0, 1, 80).round(2).tolist(), rng.normal(1, 1, 70).round(2).tolist()
    scores = E.pooled(*(spark.createDataFrame([(v,) for v in part], "score double") for part in (inside, outside)))
    assert E.auroc(scores).first().auroc == pytest.approx(plain_auroc(inside, outside))
    exact = np.mean([(o > i) + (o == i) / 2 for o in outside for i in inside])
    assert E.mann_whitney_auroc(scores).first().auroc == pytest.approx(exact)


def test_histogram(spark):
    scores = spark.createDataFrame([(float(i), i % 2 == 0, i) for i in range(100)], "score double, is_ood boolean, id long")
    got = E.histogram(scores, 10, index="id", listed=2).collect()
    assert len(got) == 20 and sum(r.n for r in got) == 100
    assert next(r.label for r in got if r.bin == 9 and r.is_ood) == "90,92 (+3 more)"
    same = E.histogram(spark.createDataFrame([(1.0, True)], "score double, is_ood boolean"), 4).collect()
    assert sum(r.n for r in same) == 1


def test_pooling(spark):
    h = np.random.default_rng(8).normal(size=(5, 3))
    df = spark.createDataFrame([(0, h.tolist())], "sample_id long, h array<array<double>>")
    assert np.allclose(values(df.withColumn("emb", P.pool_mean_std(F.col("h")))), np.concatenate((h.mean(0), h.std(0))))
    assert np.allclose(values(df.withColumn("emb", P.pool_last_k(F.col("h"), 9))), np.concatenate((h.mean(0), h.std(0))))
    assert np.allclose(values(df.withColumn("emb", P.pool_last_k(F.col("h"), 2))), np.concatenate((h[-2:].mean(0), h[-2:].std(0))))
    single = spark.createDataFrame([(0, [[1.0, 2.0]])], "sample_id long, h array<array<double>>")
    assert values(single.withColumn("emb", P.pool_mean_std(F.col("h")))).tolist() == [[1, 2, 0, 0]]
    broken = spark.createDataFrame([(0, [[float("nan")]])], "sample_id long, h array<array<double>>")
    with pytest.raises(Exception, match="NaN"):
        broken.select(P.pool_mean_std(F.col("h"))).collect()


@pytest.mark.parametrize("batch", [8, 100])
def test_extraction_and_cache(spark, tmp_path, batch):
    windows = spark.createDataFrame([(i, [55026, i, i + 1]) for i in range(20)], "sample_id long, input_ids array<int>")
    made = P.extract_representations(windows, P.toy_hidden_states(4), [0, 2], batch_size=batch)
    cache = S.EmbeddingCache(spark, f"{tmp_path}/cache")
    assert cache.read("d", "mean_std", [0]) is None
    cache.write(made, "d", "mean_std")
    assert cache.read("d", "mean_std", [0, 1]) is None
    back = cache.read("d", "mean_std", [0, 2])
    assert back.count() == 40 and {r.layer for r in back.select("layer").distinct().collect()} == {0, 2}
    a = {(r.sample_id, r.layer): r.emb for r in made.collect()}
    assert all(np.allclose(a[r.sample_id, r.layer], r.emb) for r in back.collect())
    cache.clear()


def test_special_functions():
    assert L.chi2_sf(3.841458820694124, 1) == pytest.approx(0.05)
    assert L.chi2_sf(18.307038053275146, 10) == pytest.approx(0.05)
    assert L.normal_ppf(0.975) == pytest.approx(1.959963984540054)
    assert L.normal_sf(1.959963984540054) == pytest.approx(0.025)


def _bimodal(alpha, n, d):
    rng = np.random.RandomState(42)
    return np.concatenate((np.zeros((n, d)), np.ones((n, d)))) + alpha * rng.randn(2 * n, d)


@pytest.mark.parametrize(("alpha", "normal"), [(100, True), (0.001, False)])
def test_normality(spark, alpha, normal):
    wide = emb(spark, _bimodal(alpha, 1000, 10))
    got = A.mardia(wide)
    assert (got["kurtosis_p"] > 0.05) == normal and (not normal or got["skewness_p"] > 0.05)
    narrow = emb(spark, _bimodal(alpha, 500, 20))
    assert (A.henze_zirkler(narrow)["hz_p_value"] > 0.05) == normal
    assert (A.royston(narrow)["royston_p"] > 0.05) == normal
    assert (A.shapiro(narrow)["shapiro_p"] > 0.05) == normal


@pytest.mark.parametrize("tile", [1 << 22, 30, 1])
def test_mardia_equals_double_sum(spark, monkeypatch, tile):
    """In one pass, in passes of a few planes and of one plane each."""
    x = np.random.default_rng(6).exponential(size=(40, 5))
    z = (x - x.mean(0)) @ np.linalg.inv(np.linalg.cholesky(np.cov(x.T, bias=True))).T
    g = z @ z.T
    got = A.mardia(emb(spark, x), tile=tile)
    assert got["skewness"] == pytest.approx(40 * (g**3).mean() / 6)
    assert got["kurtosis"] == pytest.approx(((np.diag(g) ** 2).mean() - 35) / math.sqrt(8 * 35 / 40))
    monkeypatch.setattr(A, "MAX_TENSOR_WIDTH", 4)
    with pytest.raises(ValueError, match="third moments of 5"):
        A.mardia(emb(spark, x))


def test_spectrum(spark):
    x = np.random.default_rng(6).normal(size=(80, 4))
    rows = A.spectrum(emb(spark, x)).orderBy("component").collect()
    assert rows[-1].cumulative == pytest.approx(1) and A.components_needed(emb(spark, x), 0.95) <= 4


def test_sampling_masks():
    model = G.toy_model()
    tokens = G.generate(model, [0, 10010, 11060], 5, seed=1)
    assert len(tokens) == 18
    for t, d, n in zip(tokens[3::3], tokens[4::3], tokens[5::3], strict=True):
        assert 0 <= t < 10_000 and 10_000 <= d < 11_000 and 11_000 <= n < 11_128
    times = tokens[0::3]
    assert times == sorted(times)
    controlled = G.generate(model, [0, 10010, 11060], 3, controls=[27_513 + 100, 37_523, 38_573], seed=1)
    assert 27_613 in controlled and len(controlled) == 15


def _messages(spark):
    rng = np.random.default_rng(11)
    rows = []
    for device in (1, 2):
        for i in range(150):
            note = 48 if rng.random() < 0.08 else int(rng.integers(49, 72))
            rows.append((device, float(i) + device / 10, "note_on" if rng.random() < 0.6 else "note_off", note, int(rng.integers(0, 3)) * 40, 0))
    return spark.createDataFrame(rows, "device long, ts double, type string, note int, velocity int, channel int")


def test_stream_equals_batch(spark, tmp_path):
    messages = _messages(spark)
    for low in range(0, 160, 40):
        messages.where((F.col("ts") >= low) & (F.col("ts") < low + 40)).coalesce(1).write.mode("append").json(f"{tmp_path}/in")
    stream = spark.readStream.schema(messages.schema).option("maxFilesPerTrigger", 1).json(f"{tmp_path}/in")
    query = R.stream_buffers(stream, size=10).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    query.awaitTermination()
    row = lambda r: (r.device, r.ts, r.session, r.n_buffer, tuple(map(tuple, r.buffer)))
    got, want = sorted(map(row, spark.read.parquet(f"{tmp_path}/out").collect())), sorted(map(row, R.buffers(messages, size=10).collect()))
    late = [w for w in want if w not in got]
    assert want and not late and len(got) == len(want)


def test_live_scoring(spark):
    def score(sequences):
        return sequences.select("seq_id", F.size("tokens").alias("n"))

    got = R.score_rows(R.buffers(_messages(spark), size=10), score)
    assert got.count() > 0 and all(r.n % 3 == 1 for r in got.collect())


@pytest.fixture(scope="module")
def vectors(spark, tmp_path_factory):
    folder, x = str(tmp_path_factory.mktemp("vectors")), np.random.default_rng(11).normal(size=(200, 64))
    rows = [(i, [float(v) for v in r], i % 8) for i, r in enumerate(x)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{folder}/embeddings.parquet")
    return folder, x.astype(np.float32).astype(float)


def test_normality_queries_take_whole_vectors(spark, vectors):
    from seqdrift.plans import detector_queries as D

    folder, x = vectors
    n, p = x.shape
    c = x - x.mean(0)
    g = c @ np.linalg.inv(np.cov(x.T, bias=True)) @ c.T
    got = D.A02_mardia(spark, folder).first()
    assert got["skewness"] == pytest.approx(n * (g**3).mean() / 6) and got["kurtosis"] == pytest.approx(((np.diag(g) ** 2).mean() - p * (p + 2)) / math.sqrt(8 * p * (p + 2) / n))
    b2 = 0.5 * (n * (2 * p + 1) / 4) ** (2 / (p + 4))
    pairs = np.diag(g)[:, None] + np.diag(g)[None] - 2 * g
    hz = np.exp(-b2 / 2 * pairs).sum() / n - 2 * (1 + b2) ** (-p / 2) * np.exp(-b2 / (2 * (1 + b2)) * np.diag(g)).sum() + n * (1 + 2 * b2) ** (-p / 2)
    got = D.A03_henze_zirkler(spark, folder).first()
    assert got["hz"] == pytest.approx(hz, abs=1e-12) and 0 <= got["hz_p_value"] <= 1


@pytest.mark.parametrize("name", ["H05_mixture_min_distance", "A04_royston", "A09_layer_metrics", "F06_mixture_fit", "F07_mixture_score", "F08_kmeans_distances"])
def test_detector_queries_take_whole_vectors(spark, vectors, monkeypatch, name):
    from seqdrift.plans import detector_queries as D

    class Seen(Exception):
        pass

    def stop(df, *args, **kwargs):
        raise Seen(df.select(F.max(F.size("emb"))).first()[0], args, kwargs)

    monkeypatch.setattr(A, "royston", stop)
    monkeypatch.setattr(A, "layer_metrics", stop)
    for stage in (D.GaussianMixture, D.MixtureScore, D.KMeansDistance):
        monkeypatch.setattr(stage, "_fit", lambda self, df: stop(df, getattr(self, "restarts", 10)))
    with pytest.raises(Seen) as seen:
        D.QUERIES[name](spark, vectors[0])
    assert seen.value.args[0] == 64 and seen.value.args[1] in ((), (10,)) and not seen.value.args[2]


def test_catalogue():
    import __spark_entry__

    queries, oracle = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(oracle) <= set(queries) and len(queries) > 100


def test_library_does_not_import_the_training_subpackage():
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent / "seqdrift"
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert "seqdrift.llm" not in path.read_text()


@pytest.mark.parametrize("name", ["H06_E03_knn_detector", "O08_anticipate", "W03_silence_filter", "R02_buffers"])
def test_registered_queries_run(spark, name):
    import __spark_entry__

    assert __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001").count() > 0


def test_wide_vectors(spark):
    """Products that do not fit an expression against NumPy."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(400, 80)) @ rng.normal(size=(80, 80))
    df = emb(spark, x)
    d = x - x.mean(0)
    want = np.sqrt(((d @ np.linalg.inv(np.cov(x.T) + 1e-6 * np.eye(80))) * d).sum(1))
    got = H.mahalanobis_distance(df, df).orderBy("sample_id").collect()
    assert np.allclose([r.score for r in got], want)
    scaled = F_.StandardScaler().fit(df).transform(df).orderBy("sample_id").collect()
    assert np.allclose([r.emb for r in scaled], d / x.std(0))
    projected = np.array([r.emb for r in F_.PCA(20).fit(df).transform(df).orderBy("sample_id").collect()])
    assert np.allclose(np.cov(projected.T), np.diag(np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1][:20]), atol=1e-6 * projected.var())


def test_inversion_in_a_session(spark):
    """A wide covariance on the driver, whose process has forked to start the session, against plain solves."""
    x = np.random.default_rng(8).normal(size=(700, 300))
    df = emb(spark, x)
    covariance, d = np.cov(x.T), x - x.mean(0)
    squares = np.array([row @ np.linalg.solve(covariance, row) for row in d[:40]])
    got = np.array([r.score for r in H.mahalanobis_distance(df, df, eps=0.0).orderBy("sample_id").limit(40).collect()])
    assert np.allclose(got**2, squares)
    logs = H.gaussian_log_prob(df, x.mean(0), covariance).orderBy("sample_id").limit(40).collect()
    assert np.allclose([r.log_prob for r in logs], -0.5 * (squares + 300 * np.log(2 * np.pi) + np.linalg.slogdet(covariance)[1]))


def test_saved_pipelines_score_alike(spark, tmp_path):
    from pyspark.ml import Pipeline, PipelineModel

    from seqdrift.operators.mixture import MixtureScore

    rng = np.random.default_rng(7)
    df = emb(spark, rng.normal(size=(60, 12)))
    stages = {
        "plain": [F_.PCA(5), F_.StandardScaler(), F_.KMeansDistance(3, restarts=2)],
        "ensemble": [F_.Ensemble(lambda: [F_.PCA(2), F_.StandardScaler()], 3, 6, seed=1), F_.Apply(F_.row_mean, outputCol="score")],
        "mixture": [F_.Subsample(4), MixtureScore(2)],
    }
    for name, each in stages.items():
        model = Pipeline(stages=each).fit(df)
        model.write().save(f"{tmp_path}/{name}")
        again = PipelineModel.load(f"{tmp_path}/{name}")
        a, b = (sorted(map(repr, m.transform(df).collect())) for m in (model, again))
        assert a == b
    with pytest.raises(Exception, match="no name to be found by"):
        Pipeline(stages=[F_.Apply(lambda x: x)]).fit(df).write().save(f"{tmp_path}/nameless")


def _doubled(x):
    return F.transform(x, lambda v: v * 2)


def test_saved_stages_name_known_functions_only(spark, tmp_path, monkeypatch):
    """A written stage runs functions of the package and registered ones; nothing else is imported or called."""
    from pyspark.ml import PipelineModel

    df = emb(spark, np.ones((3, 2)))
    with pytest.raises(Exception, match="not registered"):
        PipelineModel(stages=[F_.Apply(_doubled)]).write().save(f"{tmp_path}/unknown")
    F_.register_function(_doubled)
    PipelineModel(stages=[F_.Apply(_doubled)]).write().save(f"{tmp_path}/known")
    assert PipelineModel.load(f"{tmp_path}/known").transform(df).first().emb == [2.0, 2.0]
    monkeypatch.setattr(F_, "_REGISTERED", {})
    with pytest.raises(ValueError, match="neither registered"):
        PipelineModel.load(f"{tmp_path}/known")
    for name in ("os:system", "seqdrift.operators.transforms:importlib.import_module", "seqdrift.operators.transforms:json.loads", "seqdrift.operators.transforms:nothing", "antigravity:x"):
        with pytest.raises(ValueError, match="neither registered"):
            F_._function_of(name)
    assert F_._function_of("seqdrift.operators.transforms:row_mean") is F_.row_mean


def test_restarts_of_kmeans_run_side_by_side(spark, monkeypatch):
    """Two runs wait for each other, so one after another they would never end; the best run's centres are the same."""
    import threading

    from pyspark.ml.clustering import KMeans

    from seqdrift.operators.transforms import KMeansDistance

    points = spark.createDataFrame([([float(i % 3 * 10 + i % 7), float(i % 5)],) for i in range(60)], "emb array<double>")
    alone, both, plain = KMeansDistance(3, restarts=1).fit(points), threading.Barrier(2), KMeans.fit

    def fit(self, *rows):
        both.wait(timeout=60)
        return plain(self, *rows)

    monkeypatch.setattr(KMeans, "fit", fit)
    best = KMeansDistance(3, restarts=2).fit(points)
    near = [[min(r.emb) ** 2 for r in m.transform(points).collect()] for m in (alone, best)]
    assert sum(near[1]) <= sum(near[0]) + 1e-9
