import numpy as np
import pytest
from palimspark.llm import ann, impact_index
from pyspark.sql import functions as F

SCHEMA = "vec_id long, embedding array<float>, label int, v int, id string, b int, q int, score double"


def table(spark, rows):
    return spark.createDataFrame([(i, v, None, None, None, None, None, None) for i, v in rows], SCHEMA)


def rows_of(seed, n=1200, d=24):
    x = np.random.default_rng(seed).standard_normal((n, d)).astype(np.float32)
    return [(i, x[i].tolist()) for i in range(n)]


def odd_rows(d=24):
    nan, inf = float("nan"), float("inf")
    return [(2000, None), (2100, [0.0] * d), (2200, [nan] + [1.0] * (d - 1)), (2300, [inf] * d), (2400, [None] * d), (2500, [1.0, 2.0]), (None, [1.0] * d), (2600, [])]


def test_nearest_recall_and_scores(spark):
    rows = rows_of(1)
    x = np.array([v for _, v in rows])
    got = ann.nearest(table(spark, rows + odd_rows()), rows_per_block=256).collect()
    hit = total = 0
    for q in range(0, 1200, 100):
        d = np.sqrt(((x.astype(np.float64) - x[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        own = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in own] == list(range(1, 11))
        assert [r.score for r in own] == sorted(r.score for r in own)
        assert all(abs(r.score - d[r.vec_id]) < 1e-9 for r in own)
        hit += len({r.vec_id for r in own} & set(np.argsort(d, kind="stable")[:10].tolist()))
        total += 10
    assert hit / total >= 0.9 and {r.query_id for r in got} == set(range(0, 1200, 100))


def test_top_k_is_exact(spark):
    rows = rows_of(2)
    x = np.floor(np.array([v for _, v in rows], dtype=np.float64) * 1024).astype(np.int64)
    got = impact_index.top_k(table(spark, rows + odd_rows()), rows_per_block=256).collect()
    zero = 2100  # takes part
    assert {r.query_id for r in got} == set(range(0, 1200, 100)) | {zero}
    for q in range(0, 1200, 100):
        s = x @ x[q]
        s[q] = -(10**15)
        want = [(int(i), int(s[i])) for i in np.lexsort((np.arange(1200), -s))[:10]]
        assert [(r.vec_id, r.score) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] == want


def test_ties_repeats_and_few_rows(spark):
    rows = [(100, [1.0, 0.0]), (100, [1.0, 0.0]), (3, [0.5, 0.5]), (2, [0.5, 0.5]), (2, [0.5, 0.5]), (7, [0.0, 1.0])]
    near = [(r.vec_id, r.rank) for r in ann.nearest(table(spark, rows)).orderBy("rank").collect()]
    assert near == [(2, 1), (2, 2), (3, 3), (7, 4)]
    best = [(r.vec_id, r.score) for r in impact_index.top_k(table(spark, rows)).orderBy("rank").collect()]
    assert best == [(2, 524288), (2, 524288), (3, 524288), (7, 0)]


def test_empty_tables(spark):
    for rows in ([], odd_rows()[:1], [(100, [1.0, 2.0])]):
        assert ann.nearest(table(spark, rows)).collect() == []
        assert impact_index.top_k(table(spark, rows)).collect() == []


def test_index_returns_every_code_within_the_radius():
    codes = np.random.default_rng(3).integers(0, 2**40, 2000, dtype=np.uint64)
    index = ann.Index(codes, 40)
    for radius in (0, 1, 5, 11, 16):
        code = codes[7] ^ np.uint64(0b1011)
        assert index.within(code, radius).tolist() == np.flatnonzero(np.bitwise_count(codes ^ code) <= radius).tolist()


def test_a_row_may_be_in_only_one_block(spark):
    """A third of the rows share an id and a vector; blocks stay even and nothing is lost."""
    rows = rows_of(4, 400) + [(5000, [0.25] * 24)] * 200
    got = impact_index.top_k(table(spark, rows), k=600, rows_per_block=64).where("query_id = 100").count()
    assert got == 599


def kinds(n=6000, d=48):
    """Vectors by name, and which of two strata each is in."""
    rng = np.random.default_rng(11)
    normal = rng.standard_normal((n, d))
    centres = rng.standard_normal((120, d))[rng.integers(0, 120, n)]
    few = np.arange(n) < n // 60
    yield "gaussian", normal, few
    yield "clusters", centres + 0.1 * normal, few
    yield "loose clusters", centres + 0.5 * normal, few
    yield "a spread minority", np.where(few[:, None], 10 * normal, normal), few
    yield "clusters and a far minority", np.where(few[:, None], 3 * normal + 5, centres + 0.1 * normal), few
    yield "few directions", normal * np.exp(-np.arange(d) / 8), few
    yield "unit", (normal + 0.5) / np.linalg.norm(normal + 0.5, axis=1, keepdims=True), few


@pytest.mark.parametrize("name, x, few", list(kinds()), ids=[k[0] for k in kinds()])
def test_recall_in_every_stratum(name, x, few):
    ids, order = np.arange(len(x)), np.random.default_rng(2).permutation(len(x))
    index = ann.BlockIndex(ids, x, ann.Coder(x[order[: ann.SAMPLE]]), 10)
    for stratum in (few, ~few):
        some = np.flatnonzero(stratum)[:60]
        hits = []
        for q, (near, _) in zip(some, index.search(some, x[some])):
            d = ((x - x[q]) ** 2).sum(axis=1)
            d[q] = np.inf
            hits.append(len(set(near.tolist()) & set(np.argsort(d, kind="stable")[:10].tolist())) / 10)
        assert np.mean(hits) >= 0.9, (name, np.mean(hits))


def test_doubles_are_not_rounded_to_floats(spark):
    value = 0.29980468749999  # floor(1024 * value) is 306, that of the nearest float 307
    rows = [(100, [1.0, 0.0]), (1, [value, 0.0]), (2, [1e300, 1.0]), (3, [1e39, 0.0])]
    x = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert [(r.vec_id, r.score) for r in impact_index.top_k(x.where("vec_id < 2 or vec_id = 100")).collect()] == [(1, 1024 * 306)]
    near = {r.vec_id: r.score for r in ann.nearest(x).collect()}
    assert near == {1: 1.0 - value, 2: 1e300, 3: 1e39}


def test_each_length_is_searched_by_itself(spark, monkeypatch):
    monkeypatch.setattr(ann, "CODED", 1)
    rows = [(i, [float(i % 7), 1.0]) for i in range(100, 160)] + [(i, [float(i % 5), 1.0, 2.0]) for i in range(200, 220)] + [(300, [1.0])]
    for f in (ann.nearest, impact_index.top_k):
        got = f(table(spark, rows), k=1000).groupBy("query_id").agg(F.count("*").alias("n"), F.min("vec_id").alias("a"), F.max("vec_id").alias("b")).collect()
        assert sorted(map(tuple, got)) == [(100, 59, 101, 159), (200, 19, 201, 219)]


def test_proof_on_vectors_of_all_kinds():
    for name, x, _ in kinds(3000, 20):
        x = np.vstack([x, np.repeat(x[:1], 200, axis=0), np.zeros((5, 20))])  # ties and zeros
        rows, ids = impact_index.integers(x), np.arange(len(x))
        for k in (1, 10, 400):
            some = np.array([0, 7, 2999, 3100, 3204])
            for q, (near, score) in zip(some, impact_index.Index(ids, rows, k).search(some, x[some])):
                s = (rows @ rows[q]).astype(np.int64)
                s[q] = -(2**62)
                want = np.lexsort((ids, -s))[:k]
                assert near.tolist() == want.tolist() and score.tolist() == s[want].tolist(), (name, k, q)


def test_a_sample_of_rows_that_are_mostly_alike(spark):
    rows = [(7, [1.0, 2.0])] * 3000 + [(i, [float(i), 1.0]) for i in range(500)]
    x = ann.vectors.usable(table(spark, rows), "vec_id", "embedding", False)
    got = ann.sample_of(x, 3500, 64)
    assert got.shape == (64, 2) and len(np.unique(got, axis=0)) == 64


def test_ids_that_are_no_integers_are_refused(spark):
    x = spark.createDataFrame([("a", [1.0])], "vec_id string, embedding array<float>")
    for f in (ann.nearest, impact_index.top_k):
        with pytest.raises(TypeError, match="vec_id must be an integer column"):
            f(x)
