import random

from palimspark.llm import mixing
from pyspark.sql import functions as F


def allot(sizes, weights, total, most):
    """Targets in proportion to weights; those above most * size are set to it, and the rest is shared again."""
    targets, free, left = [0.0] * len(sizes), [i for i, s in enumerate(sizes) if s > 0], float(total)
    while free:
        weight = sum(weights[i] for i in free)
        over = [i for i in free if left * weights[i] / weight > most * sizes[i]]
        for i in over or free:
            targets[i] = most * sizes[i] if over else left * weights[i] / weight
        gone = set(over)
        left, free = float(total) - sum(targets), [i for i in free if i not in gone] if over else []
    return targets


def planned(spark, sizes, share=1.5):
    x = spark.createDataFrame([(f"s{i:06d}", n) for i, n in enumerate(sizes)], "source string, source_size long")
    return [r.target for r in mixing.plan(x, share=share).orderBy("source").collect()]


def test_allotment(spark):
    assert allot([100, 100, 100], [5, 2, 1], 450, 2) == [200, 500 / 3, 250 / 3]
    rng = random.Random(2)
    for sizes in ([], [0, 10], [10, 1000, 50, 7], [rng.choice([0, 1, 5, 900, 10**6]) for _ in range(200)]):
        want = allot(sizes, [(5, 2, 1)[i % 3] for i in range(len(sizes))], 1.5 * sum(sizes), 2)
        got = planned(spark, sizes)
        assert all(abs(a - b) <= 1e-9 * max(1, b) for a, b in zip(got, want)) and len(got) == len(want)
    assert planned(spark, [3, 4], share=2.0) == [6.0, 8.0]


def test_more_sources_than_the_driver_would_take(spark):
    """100,001 sources, numbered and allotted in tables."""
    x = spark.range(100_001).selectExpr("concat('s', lpad(id, 6, '0')) as source", "id % 50 as source_size")
    got = [r.target for r in mixing.plan(x).orderBy("source").collect()]
    want = allot([i % 50 for i in range(100_001)], [(5, 2, 1)[i % 3] for i in range(100_001)], 1.5 * sum(i % 50 for i in range(100_001)), 2)
    assert all(abs(a - b) <= 1e-9 * max(1, b) for a, b in zip(got, want))


def test_rows_without_an_id_are_spread(spark):
    docs = spark.createDataFrame([(None, "w w", None, "s", 1)] * 4000 + [(i, "w w w", None, "s", 1) for i in range(100)], "doc_id long, text string, lang string, source string, n_chars long")
    got = mixing.mix(docs, rows_per_block=50).collect()
    assert abs(sum(r.taken for r in got) - got[0].target) <= 6 and len(got) == 4100 and got[0].target == 1.5 * 8300
    again = mixing.mix(docs, rows_per_block=10**6).collect()
    assert sorted((str(r.doc_id), r.copies) for r in got) == sorted((str(r.doc_id), r.copies) for r in again)


def test_clashing_carried_names(spark):
    docs = spark.createDataFrame([(1, "w w", None, "s", 7, 8)], "doc_id long, text string, lang string, source string, size long, block long")
    assert mixing.mix(docs, carry=("size", "block")).columns == ["doc_id", "source", "size", "source_size", "target", "copies", "taken", "carry_size", "block"]


def rows(n=3000):
    rng = random.Random(1)
    return [(i, "w " * rng.choice([0, 1, 10, 100, 300]), None, rng.choice(["big", "big", "mid", "x", None, ""]), 1) for i in range(n)]


def test_taken_words_come_near_targets(spark):
    docs = spark.createDataFrame(rows(), "doc_id long, text string, lang string, source string, n_chars long")
    got = mixing.mix(docs, rows_per_block=100).collect()
    assert len(got) == 3000
    by = {}
    for r in got:
        assert r.size == len((rows_by[r.doc_id] or "").split()) and 0 <= r.taken <= 2 * r.size and r.taken == r.copies * r.size
        by.setdefault(r.source, []).append(r)
    for own in by.values():
        assert own[0].source_size == sum(r.size for r in own)
        assert abs(sum(r.taken for r in own) - own[0].target) <= max(600, 0.02 * own[0].target)
    again = mixing.mix(docs, rows_per_block=100_000).collect()
    assert sorted((r.doc_id, r.copies) for r in got) == sorted((r.doc_id, r.copies) for r in again)


rows_by = {r[0]: r[1] for r in rows()}


def test_a_boundary_crossed_is_a_copy(spark):
    """Against a plain walk over one source in the stated order."""
    import hashlib
    import math

    docs = spark.createDataFrame([(i, "w " * (i % 7), "s", "s", 1) for i in range(200)] + [(1000 + i, "w w", "t", "t", 1) for i in range(50)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r for r in mixing.mix(docs).where("source = 's'").collect()}
    order = sorted(got, key=lambda d: (int(math.sqrt(got[d].size)), hashlib.md5(str(d).encode()).hexdigest()))
    shift = int(hashlib.md5(b"7:=s").hexdigest()[:8], 16) / 2**32
    each = got[0].target / got[0].source_size
    for i, d in enumerate(order):
        assert got[d].copies == math.floor((i + 1) * each + shift) - math.floor(i * each + shift)


def test_messy_rows_and_empty_tables(spark, docs, clashing, empty):
    for table in (docs, clashing):
        got = mixing.mix(table).collect()
        assert len(got) == docs.count() and all(r.size == 0 and r.taken == 0 for r in got if r.doc_id in (4, 5, 6))
        assert {r.source for r in got} == {"a", "b", "c", "", None}
    assert mixing.mix(empty).collect() == []
    carried = mixing.mix(clashing.withColumn("row", F.struct(*clashing.columns)), carry=("row",)).select("row.*")
    assert carried.columns == clashing.columns and carried.count() == docs.count()
