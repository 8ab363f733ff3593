"""The embedding cache: writes that become visible at once, again and again, or not at all."""

import pytest

from seqdrift.sources import io as S


def rows(spark, values):
    return spark.createDataFrame([(i, layer, [float(v)]) for layer, v in values.items() for i in range(3)], "sample_id long, layer int, emb array<double>")


def held(df):
    return sorted((r.layer, r.sample_id, r.emb[0]) for r in df.collect())


def test_writing_again_replaces(spark, tmp_path):
    cache = S.EmbeddingCache(spark, f"{tmp_path}/c")
    for v in (1, 1, 2):
        cache.write(rows(spark, {0: v, 2: v + 10}), "d", "p", "007")
        assert held(cache.read("d", "p", [0, 2], "007")) == [(0, i, v) for i in range(3)] + [(2, i, v + 10) for i in range(3)]
    fresh = S.EmbeddingCache(spark, f"{tmp_path}/c")
    assert held(fresh.read("d", "p", [2], "007")) == [(2, i, 12.0) for i in range(3)]
    assert fresh.read("d", "p", [2], "7") is None and fresh.read("d", "q", [2], "007") is None
    # A later write of some layers leaves the others in force.
    cache.write(rows(spark, {2: 5}), "d", "p", "007")
    assert held(cache.read("d", "p", [0, 2], "007")) == [(0, i, 2.0) for i in range(3)] + [(2, i, 5.0) for i in range(3)]


def test_a_failed_write_is_not_seen(spark, tmp_path, monkeypatch):
    cache = S.EmbeddingCache(spark, f"{tmp_path}/c")

    def crash(*args):
        raise RuntimeError("lost")

    for before in (None, 1):
        if before:
            cache.write(rows(spark, {0: before}), "d", "p")
        with monkeypatch.context() as m:
            m.setattr(cache, "_commit", crash)
            with pytest.raises(RuntimeError):
                cache.write(rows(spark, {0: 9, 1: 9}), "d", "p")
        found = S.EmbeddingCache(spark, f"{tmp_path}/c")
        assert found.read("d", "p", [0, 1]) is None
        assert (found.read("d", "p", [0]) is None) if before is None else held(found.read("d", "p", [0])) == [(0, i, 1.0) for i in range(3)]


def test_clearing_empties_the_files(spark, tmp_path):
    cache = S.EmbeddingCache(spark, f"{tmp_path}/c")
    cache.clear()
    cache.write(rows(spark, {0: 1}), "d", "p")
    cache.read("d", "p", [0])
    beside = tmp_path / "c" / "mine.txt"
    beside.write_text("stays")
    cache.clear()
    assert cache.read("d", "p", [0]) is None and beside.read_text() == "stays"
    assert sum(spark.read.schema(cache.ROWS).parquet(str(p)).count() for p in (tmp_path / "c" / "data").iterdir()) == 0
    cache.write(rows(spark, {0: 4}), "d", "p")
    assert held(cache.read("d", "p", [0])) == [(0, i, 4.0) for i in range(3)]
