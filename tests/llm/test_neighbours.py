import numpy as np
import pytest

from loomstead.llm import neighbours
from loomstead.llm.neighbours import DIMENSIONS, REACH, SURE, Shard, chi_square, nearest

SF = "/root/testdata/sf0.01"


def brute(ids, x, k=20):
    out = {}
    for i, q in zip(ids, x):
        if i % 20 == 0:
            s = x @ q
            out[int(i)] = [int(ids[j]) for j in np.lexsort((ids, -np.round(s, 12))) if ids[j] != i][:k]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append(r.vec_id)
    return out


def recall(got, want):
    return np.mean([len(set(got[q]) & set(want[q])) / len(want[q]) for q in want])


def test_recall_on_the_table(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    pdf = df.toPandas()
    x = np.array(pdf.embedding.tolist(), np.float64)
    assert recall(found(nearest(df)), brute(pdf.vec_id.to_numpy(), x)) >= 0.95


def clustered(n, seed, spread=0.4, norms=True):
    rng = np.random.default_rng(seed)
    centers = rng.standard_normal((n // 100, 32))
    return (centers[rng.integers(0, len(centers), n)] + spread * rng.standard_normal((n, 32))) * (rng.random((n, 1)) if norms else 1)


def table(spark, ids, x):
    return spark.createDataFrame([(int(i), v.tolist(), 0) for i, v in zip(ids, x)], "vec_id long, embedding array<double>, kind int")


def test_stopping_test_saves_work():
    x = clustered(16_384, 1, norms=False)
    ids = np.arange(len(x))
    shard, want, got = Shard(ids, x, np.linalg.norm(x, axis=1).max()), brute(ids, x), {}
    asked = ids[::200]
    for i in range(0, len(asked), 64):
        place, _ = shard.search(asked[i : i + 64], x[asked[i : i + 64]], 20)
        got |= {int(q): shard.ids[p].tolist() for q, p in zip(asked[i : i + 64], place)}
    assert shard.verified < 0.3 * len(asked) * len(x)
    assert recall(got, {q: want[q] for q in got}) >= 0.95


def test_recall_over_parts_and_shards(spark):
    """Four parts and an equal vector in a tenth of the rows; the stop lets most parts be."""
    x = clustered(50_000, 5)
    x[1000:6000] = x[1000]
    ids = np.arange(50_000) * 3
    got, want = found(nearest(table(spark, ids, x), every=1500)), brute(ids, x)
    want = {q: v for q, v in want.items() if q % 1500 == 0}
    assert set(got) == set(want) and recall(got, want) >= 0.95
    assert got[3000] == want[3000] and got[6000] == want[6000]


def test_part_of_several_shards(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "SHARD", 700)
    monkeypatch.setattr(neighbours, "PARTS", 2)
    x = clustered(6000, 3)
    ids = np.arange(6000)
    assert recall(found(nearest(table(spark, ids, x))), brute(ids, x)) >= 0.95


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [0.5, 0.0]), (2, [0.5, 0.0]), (3, [-1.0, 0.0]), (4, None), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (9, [1.0]), (None, [1.0, 1.0]), (20, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert [tuple(r) for r in nearest(df).orderBy("rank").collect()] == [(0, 1, 1, 0.5), (0, 2, 2, 0.5), (0, 3, 3, -1.0)]
    assert nearest(df.limit(0)).collect() == []


@pytest.mark.parametrize(("x", "p"), [(15.507, 0.95), (3.490, 0.1)])
def test_chi_square(x, p):
    assert abs(chi_square(np.array(x), 8) - p) < 1e-3


def test_reach_is_where_the_test_holds():
    assert abs(chi_square(np.array(REACH), DIMENSIONS) - SURE) < 1e-6


def test_text_ids(spark):
    df = spark.createDataFrame([("20", [1.0, 0.0]), ("x", [1.0, 0.0]), ("3", [0.5, 0.0])], "vec_id string, embedding array<double>")
    assert [tuple(r) for r in nearest(df).collect()] == [(20, 1, 3, 0.5)]
