import random
import zlib

import numpy as np
from palimspark.llm import quality, toxicity

GOOD = "river stone field morning quiet water garden walk letter window".split()


def labelled(spark, kind, n=500):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        words = [rng.choice(GOOD) + rng.choice(["", "s", "ly"]) for _ in range(rng.randrange(20, 60))]
        if bad and kind == "quality":
            words = [w.upper() + "!!" for w in words]
        if bad and kind == "toxic":
            words[3:3] = [rng.choice(["idiot", "id1ot", "i d i o t", "scum", "$cum", "scuuuum"]) for _ in range(2)]
        rows.append((i, " ".join(words)))
        labels.append((i, int(not bad) if kind == "quality" else 1, int(bad)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def accuracy(got, labels, column):
    want = {r.doc_id: r[column] for r in labels.collect()}
    held = [r for r in got if r.held_out]
    assert held
    return sum(r.predicted == want[r.doc_id] for r in held) / len(held)


def test_quality_learns(spark):
    docs, labels = labelled(spark, "quality")
    got = quality.score(docs, quality.fit(docs, labels)).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert accuracy(got, labels, "quality") >= 0.98
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)


def test_toxicity_learns_and_restores(spark):
    docs, labels = labelled(spark, "toxic")
    got = toxicity.score(docs, toxicity.fit(docs, labels), 5, 0).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert accuracy(got, labels, "toxic") >= 0.97


def test_held_out_labels_are_not_used(spark):
    from pyspark.sql import functions as F

    docs, labels = labelled(spark, "quality", 120)
    a = quality.fit(docs, labels)
    other = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    b = quality.fit(docs, other)
    assert np.array_equal(a.weights, b.weights) and a.bias == b.bias


def test_messy_rows_and_empty_tables(spark, docs, clashing, empty):
    labels = spark.createDataFrame([(1, 1, 0), (2, None, None), (None, 1, 1), (3, 0, 1), (3, 0, 1), (99, 1, 1)], "doc_id long, quality int, toxic int")
    none = labels.limit(0)
    for module in (quality, toxicity):
        for some in (labels, none):
            scorer = module.fit(clashing, some)
            rows = module.score(clashing, scorer).collect()
            assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
            assert len({r.score for r in rows if r.doc_id in (4, 5, 6)}) == 1
            assert [r.held_out for r in rows if r.doc_id is None] == [False]
        assert module.fit(empty, none) is not None
        assert module.score(empty, scorer).collect() == []
        if some is none:
            assert all(r.score == 0.5 for r in rows)
    # nothing learned: all stay, at any threshold
    assert toxicity.keep_clean(clashing, scorer).columns == clashing.columns
    assert toxicity.keep_clean(clashing, scorer).count() == docs.count()


def channel():
    counts = np.zeros(27**3, np.int64)
    text = " ".join(GOOD + ["idiot", "scum", "loser", "worthless"]) * 50
    c = toxicity._CODE[np.frombuffer(("  " + text + "  ").encode(), np.uint8)]
    counts += np.bincount(c[:-2] * 729 + c[1:-1] * 27 + c[2:], minlength=27**3)
    return toxicity.Channel(counts)


def test_lattice_decoding():
    r = toxicity.Restorer(channel())
    for token, word in (("1d10t", "idiot"), ("idiooot", "idiot"), ("$cum!", "scum"), ("w-o-r-t-h-l-e-s-s", "worthless"), ("River,", "river"), ("l0ser", "loser")):
        assert r.word(token) == word
    assert r.channel.close_up(list("scum")) == ["scum"]


def test_every_word_of_a_token_counts():
    r = toxicity.Restorer(channel())
    has = lambda text, word: toxicity.word_features(word) & (toxicity.DIM - 1) in r.features(text)
    long = ",".join(GOOD * 20 + ["idiot"])
    for text in ("you.are.an.idiot", "stupid/idiot", "well,idiot", "word—idiot", "word—1d10t!", "well!idiot", "x|idiot", "river...idiot", long, "w-o-r-t-h-l-e-s-s/idiot"):
        assert has(text, "idiot") and has("quiet " + text + " water", "idiot"), text
    assert has("i-d-i-o-t", "idiot") and has("i d i o t", "idiot")
    assert all(has("s c u", w) for w in r.channel.close_up(list("scu")))
    assert not has("quiet water", "idiot")
    a, b = "x" * 80 + "y", "x" * 80 + "z"
    assert not has(a, b)


def test_quality_hashes_whole_tokens():
    feature = lambda text: quality.features([text])[0].tolist()
    assert feature("x" * 80 + "y") != feature("x" * 80 + "z")
    assert feature("x" * 80 + "y") == feature("x" * 80 + "y")


def test_viterbi_finds_the_best_path():
    ch = channel()
    steps = [[(9, 0.0, "i"), (12, -0.5, "l")], [(4, 0.0, "d")], [(9, -1.0, "i"), (12, -1.0, "l"), (-1, -2.0, "")], [(15, 0.0, "o")]]
    best = None

    def walk(k, a, b, score, text):
        nonlocal best
        if k == len(steps):
            score += ch.log[a][b][0]
            best = max(best or (-1e9, ""), (score, text))
            return
        for code, p, t in steps[k]:
            if code < 0:
                walk(k + 1, a, b, score + p, text + t)
            else:
                walk(k + 1, b, code, score + p + ch.log[a][b][code], text + t)

    walk(0, 0, 0, 0.0, "")
    assert ch.decode(steps) == best[1]


def test_ftrl_separates():
    rng = np.random.default_rng(1)
    rows = []
    for i in range(400):
        y = i % 2
        f = np.concatenate([[0], rng.choice(np.arange(100, 200), 5, replace=False), [10 + y]])
        rows.append((f, np.ones(len(f)), y))
    s = quality.ftrl(rows)
    assert s.weights[11] > 0 > s.weights[10]


def test_labels_of_other_ids_take_no_place_in_the_sample(spark):
    docs, labels = labelled(spark, "quality", 160)
    foreign = spark.range(10**6, 10**6 + 30_000).selectExpr("id as doc_id", "1 as quality", "0 as toxic")
    a, b = quality.fit(docs, labels), quality.fit(docs, labels.union(foreign))
    assert np.array_equal(a.weights, b.weights) and np.any(a.weights)


def test_ids_may_be_text(spark):
    docs, labels = labelled(spark, "toxic", 160)
    text = docs.selectExpr("concat('x', doc_id) as doc_id", "text"), labels.selectExpr("concat('x', doc_id) as doc_id", "quality", "toxic")
    assert {r.doc_id for r in toxicity.score(text[0], toxicity.fit(*text)).collect()} == {f"x{i}" for i in range(160)}


def test_one_class_alone_is_nothing_learned(spark):
    docs, labels = labelled(spark, "toxic", 40)
    every = labels.selectExpr("doc_id", "quality", "1 as toxic")
    assert toxicity.keep_clean(docs, toxicity.fit(docs, every)).count() == 40


def test_quality_is_that_of_plain_loops(spark):
    """Features, updates and scores again, a token and a coordinate at a time."""
    import math
    from collections import Counter

    docs, labels = labelled(spark, "quality", 90)
    scorer = quality.fit(docs, labels)
    y = {r.doc_id: r.quality for r in labels.collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    texts |= {1000: "", 1001: "word word Word WORD !!! !!!", 1002: "x" * 200}

    def code(token):
        return (zlib.crc32(token.encode()) & 0x7FFFFFFE) | (len(token) > 1 and token.isupper())

    def slot(x):
        return (((x * 0x9E3779B1) & 0xFFFFFFFF) >> 11) % (quality.DIM - 16) + 16

    def vector(text):
        ids = [code(t) for t in quality.TOKEN.findall(text)]
        own = [slot(i >> 1) for i in ids] + [2 for i in ids if i & 1]
        own += [1 if a == b else slot((a * 31 + b) & 0xFFFFFFFF) for a, b in zip(ids, ids[1:])]
        return {f: n * quality.SCALE / len(own) for f, n in Counter(own).items()}

    order = [r.id for r in spark.createDataFrame([(str(i),) for i in y], "id string").selectExpr("id", "xxhash64(id) as h").orderBy("h").collect()]
    z, n = Counter(), Counter()

    def weight(f):
        return 0.0 if abs(z[f]) <= 1e-3 else -(z[f] - math.copysign(1e-3, z[f])) / (1 + math.sqrt(n[f]) + 1e-4)

    train = [({0: 1.0} | vector(texts[int(i)]), y[int(i)]) for i in order if zlib.crc32(i.encode()) % 3 != 1]
    for _ in range(quality.PASSES):
        for v, label in train:
            w = {f: weight(f) for f in v}
            g = 1 / (1 + math.exp(-sum(w[f] * x for f, x in v.items()))) - label
            for f, x in v.items():
                z[f] += g * x - (math.sqrt(n[f] + (g * x) ** 2) - math.sqrt(n[f])) * w[f]
                n[f] += (g * x) ** 2
    want = {i: 1 / (1 + math.exp(-weight(0) - sum(weight(f) * x for f, x in vector(t).items()))) for i, t in texts.items()}
    every = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r for r in quality.score(every, scorer).collect()}
    assert all(abs(got[i].score - want[i]) < 1e-4 and got[i].predicted == (got[i].score >= 0.5) for i in texts)


def test_toxicity_scores_are_those_of_plain_sums(spark):
    """Scores of whole texts against restoring each token alone, without memo, batches or packed features."""
    import math

    docs, labels = labelled(spark, "toxic", 160)
    scorer = toxicity.fit(docs, labels)
    some = docs.limit(40).collect()
    texts = {r.doc_id: r.text for r in some} | {2000: "", 2001: "you.are.an.id1ot", 2002: "i d i o t", 2003: "river " * 4000 + "scum", 2004: "s" + "c" * 90 + "um", 2005: "a b"}
    channel = toxicity.Channel(scorer.counts)

    def plain(text):
        r = toxicity.Restorer(channel)
        tokens = text.split()
        packed = [f for t in tokens for f in [toxicity.word_features(r.word(t)), *r.more(t)]]
        single = [len(t.strip(toxicity.EDGE) or t) == 1 for t in tokens]
        i = 0
        while i < len(tokens):
            j = i
            while j < len(tokens) and single[j]:
                j += 1
            if j - i >= toxicity.RUN:
                packed += [toxicity.word_features(w) for w in channel.close_up([(t.strip(toxicity.EDGE) or t).lower()[:1] for t in tokens[i:j]])]
            i = max(j, i + 1)
        own = {f for p in packed for f in (p & (toxicity.DIM - 1), p >> toxicity.BITS & (toxicity.DIM - 1))}
        return 1 / (1 + math.exp(-scorer.bias - sum(float(scorer.weights[f]) for f in own)))

    every = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for r in toxicity.score(every, scorer).collect():
        assert abs(r.score - plain(texts[r.doc_id])) < 1e-5, texts[r.doc_id][:80]
