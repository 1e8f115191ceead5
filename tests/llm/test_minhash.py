import random
from collections import defaultdict

import numpy as np
import pytest
from conftest import WORD
from palimspark.llm import minhash


def shingles(text):
    words = WORD.findall((text or "").translate({i: i + 32 for i in range(65, 91)}))
    return set(zip(words, words[1:])) if len(words) > 1 else {tuple(words)} if words else set()


def brute(rows):
    sets = defaultdict(list)
    for doc, text in rows:
        sets[doc].append(shingles(text))
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if any(s and t and 100 * len(s & t) >= 75 * len(s | t) for s in sets[a] for t in sets[b]):
                p, q = sorted((root(a), root(b)))
                parent[q] = p
    return {d: root(d) for d in ids}


def corpus(seed, n=220):
    rng = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(30)]
    base = [[rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 5, 30, 80]))] for _ in range(25)]
    rows = []
    for i in range(n):
        words = list(rng.choice(base))
        for _ in range(rng.randrange(5)):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        if rng.random() < 0.3:
            words = words[: len(words) // 2] + passage + words[len(words) // 2 :]
        rows.append((i, " ".join(w.upper() if rng.random() < 0.1 else w for w in words)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_components_are_those_of_brute_force(spark, seed):
    rows = corpus(seed)
    got = {r.doc_id: r for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute(rows)
    assert {d: r.component_id for d, r in got.items()} == want
    assert all(got[d].n_shingles == len(shingles(t)) and got[d].kept == (want[d] == d) for d, t in rows)


def test_messy_rows(spark, docs, clashing):
    for table in (docs, clashing):
        rows = minhash.near_duplicates(table).collect()
        assert len(rows) == docs.count()
        comp = {r.doc_id: r.component_id for r in rows}
        assert comp[1] == comp[2] == comp[3] == 1 and comp[7] == comp[8] == 7
        assert all(comp[i] == i for i in (4, 5, 6, 9, 10, 11)) and comp[None] is None
        assert {r.n_shingles for r in rows if r.doc_id in (4, 5, 6)} == {0}


def test_empty_table(spark, empty):
    assert minhash.near_duplicates(empty).collect() == []


def test_large_buckets_are_split(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 8)
    rows = corpus(5, 150)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (50, 50)], "a long, b long")
    got = {r.node: r.comp for r in minhash.components(edges).collect()}
    assert all(got[i] == 0 for i in range(1, 41)) and got[101] == 100


def test_estimate_is_near_the_truth(spark):
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    packed, _ = minhash.sketch([x[:2000], x[500:2500]])
    df = spark.createDataFrame([([int(v) for v in packed.view(np.int64)[0]], [int(v) for v in packed.view(np.int64)[1]])], "a array<long>, b array<long>")
    assert abs(df.select(minhash.estimate(df.a, df.b)).first()[0] - 0.6) < 0.15


A, B = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))


def test_texts_of_one_id_are_one_document(spark):
    rows = [(1, A), (2, A), (2, B), (3, "c d e"), (4, B + " z"), (2, ""), (2, B)]
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, 39, 1, True), (2, 0, 2, True), (2, 39, 1, False), (2, 39, 1, False), (2, 39, 1, False), (3, 2, 3, True), (4, 40, 1, False)]


def test_ids_that_are_no_integers_are_refused(spark):
    with pytest.raises(TypeError, match="doc_id must be an integer column"):
        minhash.near_duplicates(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


@pytest.mark.parametrize("few, most", [(0, 1 << 30), (0, 1)])
def test_documents_found_by_bitmap_and_by_join(spark, monkeypatch, few, most):
    monkeypatch.setattr(minhash, "FEW_IDS", few)
    monkeypatch.setattr(minhash, "MOST_BITS", most)
    monkeypatch.setattr(minhash, "PARTNERS", 2)
    rows = corpus(7, 120)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


def test_a_passage_that_many_documents_share(spark, monkeypatch):
    """Documents that share half of their text fill buckets beyond BLOCK; links between them are all found, and no others."""
    monkeypatch.setattr(minhash, "BLOCK", 16)
    rng = random.Random(3)
    passage = " ".join(f"p{i}" for i in range(30))
    rows = []
    for i in range(60):
        own = " ".join(f"u{i}x{j}" for j in range(25))
        rows += [(3 * i, passage + " " + own), (3 * i + 1, passage + " " + own + f" end{i}"), (3 * i + 2, " ".join(rng.choice(["q", "r", "s"]) + str(j) for j in range(20)))]
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


def hashed(texts):
    data = [t.encode() for t in texts]
    return minhash.shingle_sets(np.frombuffer(b"".join(data), np.uint8), np.concatenate([[0], np.cumsum([len(d) for d in data])]))


def one_band_in_common():
    """Texts (two others, a, b): a and b are at 75 % or more and have one band in common, which the others have too, without being near anything."""
    words = [f"w{i}" for i in range(100)]
    a = " ".join(words)
    (own,) = hashed([a])
    for seed in range(20):
        rng, texts = random.Random(seed), []
        for k in range(2000):
            changed = rng.sample(range(2, 98, 2), 7)
            texts.append(" ".join(f"x{seed}y{k}z{i}" if i in changed else w for i, w in enumerate(words)))
        keys = minhash.sketch(hashed([a, *texts]))[1]
        found = np.flatnonzero((keys[1:] == keys[0]).sum(axis=1) == 1)
        if len(found):
            break
    b, band = texts[found[0]], int(np.flatnonzero(keys[1 + found[0]] == keys[0])[0])
    pairs = {int(s[0]): f"{p} {q}" for p, q, s in zip(words, words[1:], hashed([f"{p} {q}" for p, q in zip(words, words[1:])]))}
    least = [pairs[int(own[np.argmin((own * minhash._A[j] + minhash._B[j]) >> np.uint64(32))])] for j in range(band * minhash.ROWS, (band + 1) * minhash.ROWS)]
    others = [t for k in range(400) for t in ["".join(f"{p} o{k}p{i} " for i, p in enumerate(least))] if minhash.sketch(hashed([t]))[1][0, band] == keys[0, band]][:2]
    return [*others, a, b]


@pytest.mark.parametrize("block", [2, 2048])
def test_a_pair_with_one_band_in_common_in_a_large_bucket(spark, monkeypatch, block):
    """Both are compared whatever the size of their bucket; the two before them take its stars."""
    monkeypatch.setattr(minhash, "BLOCK", block)
    rows = list(enumerate(one_band_in_common()))
    want = brute(rows)
    assert want == {0: 0, 1: 1, 2: 2, 3: 2}
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


@pytest.mark.parametrize("percent", [50, 75, 100])
def test_prefixes_of_near_sets_meet(spark, percent):
    rng = np.random.default_rng(percent)
    sets = []
    for _ in range(60):
        base = rng.integers(0, 2**63, rng.integers(1, 60), dtype=np.uint64)
        sets += [np.unique(base), np.unique(np.concatenate([base[rng.integers(0, 3) :], rng.integers(0, 2**63, rng.integers(0, 20), dtype=np.uint64)]))]
    df = spark.createDataFrame([(i, s.tobytes()) for i, s in enumerate(sets)] + [(999, b"")], "node long, hashes binary")
    kept = defaultdict(set)
    for r in minhash._prefixes(df, percent).collect():
        kept[r.node].add(r.shingle)
    near = [(i, j) for i in range(120) for j in range(i) if 100 * len(np.intersect1d(sets[i], sets[j])) >= percent * len(np.union1d(sets[i], sets[j])) > 0]
    assert len(near) > 3 and all(kept[i] & kept[j] for i, j in near)
    assert all(len(kept[i]) == len(s) - -(-percent * len(s) // 100) + 1 for i, s in enumerate(sets) if len(s)) and not kept[999]


def test_rounds_of_components_broadcast_nothing(spark, monkeypatch):
    """Each small table that a round broadcasts is built in the driver's memory; a plan has them at no size."""
    plans, write = [], minhash.cut_at
    monkeypatch.setattr(minhash, "cut_at", lambda df, name: (plans.append(df._jdf.queryExecution().executedPlan().toString()), write(df, name))[1])
    got = {r.node: r.comp for r in minhash.components(spark.createDataFrame([(1, 2), (2, 3)], "a long, b long")).collect()}
    assert got == {2: 1, 3: 1} and len(plans) > 2
    assert not any("Broadcast" in p for p in plans)
