import random
import re

import corpus_pipeline
from palimspark.llm import minhash, toxicity
from test_minhash import brute, one_band_in_common


def data(spark, folder, n=240):
    rng = random.Random(8)
    good = "river stone field morning quiet water garden walk letter window paper road lamp table".split()
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(good) + rng.choice(["", "s", "ly", "ing"]) for _ in range(rng.randrange(30, 60))]
        bad = i % 6 == 0
        if bad:
            words[2:2] = ["idiot", "scum"]
        if i % 10 == 3:
            words[5:5] = ["token", "=", "'24be64439e3e49cf46b2d7c90f3602a3d0b907ff'"]
        rows.append((i, " ".join(words), "en", f"s{i % 3}", 1))
        labels.append((i, 1, int(bad)))
    rows += [(1000 + i, rows[i][1], "en", "s0", 1) for i in range(1, 40, 2)] + [(5000, None, None, None, None), (5001, "", "en", "s1", 0), (None, "one two", "en", "s1", 7), rows[7]]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return rows


def test_each_stage_does_its_part(spark, tmp_path):
    d = str(tmp_path)
    rows = data(spark, d)
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "secrets", "mixing", "bpe"]

    def step(i, x):
        y = corpus_pipeline.STAGES[i][1](spark, x, d)
        y.write.parquet(f"{d}/stage{i}")
        return spark.read.parquet(f"{d}/stage{i}")

    clean = step(0, docs)
    assert clean.columns == columns
    scores = {r.doc_id: r.predicted for r in toxicity.score(docs, toxicity.fit(docs, spark.read.parquet(f"{d}/labels.parquet"))).collect()}
    assert sorted(str(r.doc_id) for r in clean.collect()) == sorted(str(r[0]) for r in rows if not scores[r[0]])
    assert clean.where("text like '%idiot%'").count() == 0

    single = step(1, clean)
    before = clean.collect()
    want = brute({(r.doc_id, r.text) for r in before if r.doc_id is not None})
    assert single.columns == columns
    assert sorted(r.doc_id for r in single.collect() if r.doc_id is not None) == sorted(x for x in want if want[x] == x)
    assert single.where("doc_id is null").count() == 1

    quiet = step(2, single)
    assert quiet.columns == columns and quiet.count() == single.count()
    assert quiet.where("text like '%24be64439e3e%'").count() == 0 and quiet.where("text like '%[SECRET]%'").count() > 5
    assert quiet.where("text is not null and n_chars != length(text)").count() == 0

    blend = step(3, quiet)
    assert blend.columns == columns
    known = {r.doc_id: r.text for r in quiet.collect()}
    taken = blend.collect()
    assert all(known[r.doc_id] == r.text for r in taken)
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert abs(sum(words(r.text) for r in taken) - 1.5 * sum(words(t) for t in known.values())) < 400

    coded = step(4, blend)
    assert coded.count() == len(taken) and {"n_tokens", "ids_sha256"} <= set(coded.columns)
    run = corpus_pipeline.run(spark, d)
    assert sorted((str(r.doc_id), r.ids_sha256) for r in run.collect()) == sorted((str(r.doc_id), r.ids_sha256) for r in coded.collect())


def test_empty_documents(spark, tmp_path):
    d = str(tmp_path)
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    assert corpus_pipeline.run(spark, d).collect() == []
    assert minhash.PERCENT == 75


def small(spark, folder, rows, labels=(), extra=""):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long" + extra).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return spark.read.parquet(f"{folder}/documents.parquet")


def test_one_id_with_two_texts_and_no_labels(spark, tmp_path):
    """No text is lost: without labels all documents stay, and of the copies of a text one."""
    x, y, z = (" ".join(f"{w}{i}" for i in range(30)) for w in "xyz")
    rows = [(1, x, "en", "s", 1), (2, x, "en", "s", 1), (2, y, "en", "s", 1), (3, z, "en", "s", 1)]
    docs = small(spark, str(tmp_path), rows)
    assert corpus_pipeline.toxic_out(spark, docs, str(tmp_path)).count() == 4
    got = corpus_pipeline.near_duplicates_out(spark, docs, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.text) for r in got) == [(1, x), (2, y), (3, z)]
    taken = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert taken == {1, 2, 3}


def test_rows_of_all_kinds_in_every_stage(spark, tmp_path):
    """Copies without an id, a map and an array among the columns, clashing names, a very long text."""
    long = "w" * 300_000 + " token=abcdef123456 " + "v " * 50_000
    extra = ", row map<string,int>, score array<double>, size string, key string, block int, copies int"
    own = ({"a": 1}, [1.0], "big", "k", 3, 4)
    rows = [(None, "one two three four", "en", "s", 1, *own)] * 3 + [(7, "one two three four", "en", None, 1, *own), (8, long, None, "t", 1, *own), (9, None, "en", "t", 0, *[None] * 6), (10, "", "en", "t", 0, *own)]
    docs = small(spark, str(tmp_path), rows, [(7, 1, 0), (8, 1, 1)], extra)
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if i < 4:
            assert out.schema.simpleString() == docs.schema.simpleString()
        out.write.parquet(f"{tmp_path}/s{i}")
        docs = spark.read.parquet(f"{tmp_path}/s{i}")
        if i == 1:
            assert sorted((r.doc_id, r.text) for r in docs.where("text != ''").collect()) == [(7, "one two three four"), (8, long)] and docs.count() == 4
        if i == 2:
            assert docs.where("text like '%[SECRET]%'").count() == 1
    assert docs.where("doc_id = 8").count() >= 1


def test_near_copies_in_a_large_bucket(spark, tmp_path, monkeypatch):
    """The stage finds near copies that only a bucket of more than BLOCK rows holds, with ids and without."""
    monkeypatch.setattr(minhash, "BLOCK", 2)
    texts = one_band_in_common()
    for i, ids in enumerate([(0, 1, 2, 3), (0, 1, 2, None)]):
        docs = small(spark, f"{tmp_path}/{i}", [(d, t, "en", "s", 1) for d, t in zip(ids, texts)])
        got = corpus_pipeline.near_duplicates_out(spark, docs, f"{tmp_path}/{i}").collect()
        assert sorted((r.doc_id, r.text) for r in got) == list(enumerate(texts[:3]))
