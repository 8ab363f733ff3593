"""Layers of padded batches against the plain forms, one window at a time."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqdrift.operators import extraction as X
from seqdrift.operators import pooling as P
from seqdrift.sources.io import EmbeddingCache

WINDOWS = [(i, [(7 * i + 3 * j) % 500 for j in range(1 + i * i % 23)]) for i in range(60)]


@pytest.fixture(scope="module")
def windows(spark):
    return spark.createDataFrame(WINDOWS, "sample_id long, input_ids array<int>").repartition(3)


def _rows(df):
    return {(r["sample_id"], r["layer"]): np.array(r["emb"]) for r in df.collect()}


def _counting(path, depth=3):
    """The toy model, which notes each load and each window that it is given."""

    def load():
        inner = X.toy(4, depth).load()
        with open(path / "loads", "a") as out:
            out.write("load\n")

        def run(ids, layers):
            with open(path / "windows", "a") as out:
                out.write("\n" * len(ids))
            return inner(ids, layers)

        return run

    return X.Model(f"counting {path}", load, depth)


@pytest.mark.parametrize(("pool", "plain"), [(X.mean_std, P.pool_mean_std), (X.last_k(3), lambda h: P.pool_last_k(h, 3)), (X.norm_weighted, P.norm_weighted_mean_std)])
def test_pools_equal_the_column_forms(windows, pool, plain):
    got = _rows(X.extract_layers(windows, X.toy(4, 3), pool=pool, batch_size=7))
    expected = _rows(P.extract_representations(windows, P.toy_hidden_states(4), [0, 1, 2, 3], plain))
    assert got.keys() == expected.keys()
    for key, emb in expected.items():
        np.testing.assert_allclose(got[key], emb, atol=1e-12)


def test_padding_counts_only_when_asked_for(windows):
    got = _rows(X.extract_layers(windows, X.toy(4, 1), [1], batch_size=8, pad_compat=True))
    for low in range(0, len(WINDOWS), 8):
        batch = WINDOWS[low : low + 8]
        longest = max(len(ids) for _, ids in batch)
        for i, ids in batch:
            h = P.toy_hidden_states(4)([ids + [0] * (longest - len(ids))], [1])[1][0]
            np.testing.assert_allclose(got[i, 1], np.concatenate((h.mean(axis=0), h.std(axis=0))), atol=1e-12)


def test_one_pass_a_window_one_load_a_worker_and_none_from_the_cache(spark, windows, tmp_path):
    model, cache = _counting(tmp_path), EmbeddingCache(spark, str(tmp_path / "cache"))
    first = _rows(X.extract_all_layers(cache, windows, model, "set", "1", batch_size=7))
    passes = len((tmp_path / "windows").read_text())
    assert passes == len(WINDOWS) and {layer for _, layer in first} == {0, 1, 2, 3}
    assert len((tmp_path / "loads").read_text().split()) <= 4
    again = _rows(X.extract_all_layers(EmbeddingCache(spark, str(tmp_path / "cache")), windows, model, "set", "1"))
    assert again.keys() == first.keys() and len((tmp_path / "windows").read_text()) == passes
    _rows(X.extract_all_layers(cache, windows, model, "set", "2"))
    assert len((tmp_path / "windows").read_text()) == 2 * passes
    cache.forget()


def test_numbers_follow_the_order_across_ranges(spark):
    rows = spark.range(1000).select((F.col("id") * 37 % 1000).alias("sample_id"))
    assert all(r["nth"] == r["sample_id"] for r in X.numbered(rows, ["sample_id"], "nth").collect())


@pytest.mark.parametrize("pad_compat", [False, True])
def test_odd_windows(spark, pad_compat):
    shape = "sample_id long, input_ids array<int>, batch_ string, row_ string"
    assert X.extract_layers(spark.createDataFrame([], shape), X.toy(2, 1), pad_compat=pad_compat).count() == 0
    odd = spark.createDataFrame([(1, [], "a", None), (2, None, "b", None), (3, [5], None, "c"), (4, [5], None, "c")], shape)
    got = _rows(X.extract_layers(odd, X.toy(2, 1), pad_compat=pad_compat))
    assert sorted(got) == [(3, 0), (3, 1), (4, 0), (4, 1)]
    np.testing.assert_array_equal(got[3, 0][2:], 0)


def test_refuses_nan_and_unknown_layers(windows):
    with pytest.raises(ValueError, match="layers"):
        X.extract_layers(windows, X.toy(2, 1), [2])
    broken = X.Model("broken", lambda: lambda ids, layers: {layer: np.full((*ids.shape, 2), np.nan) for layer in layers}, 1)
    with pytest.raises(Exception, match="NaN in the hidden states"):
        X.extract_layers(windows, broken).collect()


def test_states_stay_in_the_task(spark, windows):
    """Means and deviations are taken beside the model: no column of states, equal rows for any batch, NaN fails."""
    made = P.extract_representations(windows.where(F.size("input_ids") > 0), P.toy_hidden_states(4), [0, 2], batch_size=3)
    assert "array<array<double>>" not in made._jdf.queryExecution().analyzed().toString() and "transform" not in made._jdf.queryExecution().analyzed().toString()
    got, expected = _rows(made), _rows(P.extract_representations(windows, P.toy_hidden_states(4), [0, 2], lambda h: P.pool_mean_std(h)))
    assert got.keys() == expected.keys()
    for key, emb in expected.items():
        np.testing.assert_allclose(got[key], emb, atol=1e-12)
    with pytest.raises(Exception, match="NaN in hidden states"):
        P.extract_representations(windows, lambda batch, layers: {0: [np.full((len(x), 2), np.nan) for x in batch]}, [0]).collect()
