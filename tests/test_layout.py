import difflib
import itertools
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from palimspark import queries
from palimspark.functions import text as text_fns
from palimspark.functions import times
from palimspark.operators import analytics, compress, delta, joins, layout, retrieve, solvers
from palimspark.plans import blocks


def pages(spark, texts):
    rows = [(p, i, 10 * p + i, t, len(t)) for p, own in texts.items() for i, t in enumerate(own)]
    return spark.createDataFrame(rows, "page_id long, idx int, revid long, text string, size long").withColumn("ts", F.timestamp_seconds(F.col("revid") * 3600))


def by_sizes(spark, *sizes):
    return pages(spark, {p: ["x" * s for s in own] for p, own in enumerate(sizes)})


def parts_of(spark, sizes, budget):
    x = by_sizes(spark, sizes)
    p = layout.partition(x, layout.choose(x, budget))
    lists = layout.part_lists(p).first().partitions
    c = layout.costs(p).first()
    return lists, c.space_cost, c.time_cost, c.orig_size


def test_worked_examples(spark):
    assert parts_of(spark, [1, 2, 8], 9) == ([[0, 1], [2]], 10, 4, 11)
    assert parts_of(spark, [1, 2, 8], 17) == ([[0, 1, 2]], 8, 11, 11)
    assert parts_of(spark, [1, 2, 3], 9)[0] == [[0, 1], [2]]
    assert parts_of(spark, [10, 10, 10], None) == ([[0], [1], [2]], 30, 3, 30)
    assert parts_of(spark, [4], None)[0] == [[0]]


def test_features(spark):
    t = layout.transitions(by_sizes(spark, [1, 2, 8])).orderBy("idx").collect()
    assert [(r.diff, r.value, r.weight) for r in t] == [(2, 1, 3), (12, 10, 14)]


def test_knapsack_example():
    for f in (solvers.exact, solvers.greedy, solvers.scaled, solvers.sparse):
        assert f([5, 4, 3], [3, 2, 2], 4) == [1, 2]
    assert solvers.scaled([2, 1, 1], [10, 1, 1], 12) == [0, 1, 2]
    assert solvers.sparse([3, 5, 2, 1], [4, 2, 2, 100], 6) == [0, 1]
    assert solvers.exact([1], [1], 0) == []
    with pytest.raises(ValueError):
        solvers.exact([1] * 2000, [10**6] * 2000, 10**9)
    assert solvers.runs(4, {1, 3}) == [[0, 1], [2, 3]]


def test_solvers_against_all_subsets():
    rng = random.Random(1)
    for _ in range(150):
        n = rng.randrange(1, 10)
        v, w = [rng.randrange(1, 50) for _ in range(n)], [rng.randrange(1, 30) for _ in range(n)]
        cap = rng.randrange(1, sum(w) + 5)
        best = max(sum(v[i] for i in s) for k in range(n + 1) for s in itertools.combinations(range(n), k) if sum(w[i] for i in s) <= cap)
        value = lambda got: sum(v[i] for i in got)
        for got in (solvers.exact(v, w, cap), solvers.greedy(v, w, cap), solvers.scaled(v, w, cap, 0.1), solvers.sparse(v, w, cap), solvers.heuristic(v, w, cap)):
            assert sum(w[i] for i in got) <= cap and got == sorted(set(got))
        assert value(solvers.exact(v, w, cap)) == best == value(solvers.sparse(v, w, cap))
        assert value(solvers.scaled(v, w, cap, 0.1)) >= 0.9 * best
        assert value(solvers.greedy(v, w, cap)) >= 0.5 * best


def test_exact_takes_any_number_of_items(monkeypatch):
    rng = random.Random(6)
    n = 130_000
    v, w = [rng.randrange(1, 50) for _ in range(n)], [rng.randrange(1000, 3000) for _ in range(n)]
    v[77_777], w[77_777], v[100_001], w[100_001] = 900, 1500, 800, 2500
    assert solvers.exact(v, w, 4000) == [77_777, 100_001]
    assert solvers.exact([9] * 2000 + [1, 2], [10**9] * 2000 + [1, 3], 10**6) == [2000, 2001]
    for _ in range(100):
        n = rng.randrange(1, 40)
        v, w = [rng.randrange(1, 8) for _ in range(n)], [rng.randrange(0, 12) for _ in range(n)]
        cap = rng.randrange(1, 100)
        whole = solvers.exact(v, w, cap)
        with monkeypatch.context() as m:
            m.setattr(solvers, "MOST_CELLS", rng.choice([1, 50, 300]))
            assert solvers.exact(v, w, cap) == whole


def test_scaled_keeps_its_bound_on_large_pages(monkeypatch):
    big = 10**7
    v, w = [big + 3, big, big] + [1] * 6000, [big + 1, big, big] + [2 * big] * 6000
    for strategy in ("fptas", "auto"):
        got = solvers.heuristic(v, w, 2 * big, strategy)
        assert sum(w[i] for i in got) <= 2 * big and sum(v[i] for i in got) >= 0.9 * 2 * big
    rng = random.Random(5)
    for most in (1, 200, 5000):
        for _ in range(60):
            n, high = rng.randrange(1, 60), rng.choice([3, 40, 10**6])
            v, w = [rng.randrange(1, high) ** rng.choice([1, 2]) for _ in range(n)], [rng.randrange(1, 50) for _ in range(n)]
            cap = rng.randrange(1, 400)
            best = sum(v[i] for i in solvers.exact(v, w, cap))
            for eps in (0.05, 0.1, 0.5):
                with monkeypatch.context() as m:
                    m.setattr(solvers, "MOST_CELLS", most)
                    got = solvers.scaled(v, w, cap, eps)
                assert sum(w[i] for i in got) <= cap and sum(v[i] for i in got) >= (1 - eps) * best and got == sorted(set(got))


def test_partition_is_one_of_all(spark):
    x = by_sizes(spark, [3, 9, 2, 7, 7], [5, 1, 30])
    every = {(r.page_id, r.space, r.time) for r in layout.enumerate_partitions(x).collect()}
    assert layout.enumerate_partitions(x).count() == 16 + 4
    for r in layout.costs(layout.partition(x, layout.choose(x, 40))).collect():
        assert (r.page_id, r.space_cost, r.time_cost) in every


ODD = ["", "a", "one\ntwo\n", "one\r\ntwo\x0bthree\x85four five", "? hint\n- minus\n+ plus\n  two blanks", "no end", "\n\n\n", "é\U0001f600\n", "one\ntwo\n"]


def test_round_trip_of_odd_texts(spark):
    rng = random.Random(2)
    texts = {1: ODD, 2: ["only"], 3: [rng.choice(ODD) + rng.choice(ODD) for _ in range(30)]}
    x = pages(spark, texts)
    rows = compress.compress(x, time_budget=10_000_000)
    assert rows.where("not is_anchor").count() > 5
    for back in (rows, compress.explode(compress.artifacts(rows))):
        got = {(r.page_id, r.idx): r.text for r in compress.decompress(back).collect()}
        assert got == {(p, i): t for p, own in texts.items() for i, t in enumerate(own)}
    times_back = compress.explode(compress.artifacts(rows)).where("page_id = 1 and idx = 2").first()
    assert times_back.ts is not None and times_back.revid == 12


def test_other_deltas():
    rng = random.Random(3)
    for _ in range(200):
        a, b = ("".join(rng.choice("ab \n-é") for _ in range(rng.randrange(20))) for _ in range(2))
        assert delta.apply_chars(a, delta.char_delta(a, b)) == b
    assert delta.word_delta("a b c", "a x c") == "+1 -1 x +1"
    assert delta.word_delta("a", "7 a-b\nc") == '-1 "7" a^b`c'


def test_retrieval(spark):
    rows = compress.compress(pages(spark, {1: ["a", "ab", "abc"], 2: ["q"]}), time_budget=100)
    one = rows.where("page_id = 1")
    text = lambda df, by="idx": [r.text for r in df.orderBy(by).collect()]
    assert text(retrieve.by_range(one, 1, 1)) == ["ab", "abc"]
    assert text(retrieve.half_open(one, 1, 1)) == ["ab"]
    assert text(retrieve.half_open(one, -1, 2)) == text(retrieve.half_open(one, 0, 0)) == []
    assert text(retrieve.half_open(one, 1, 50)) == ["ab", "abc"]
    assert text(retrieve.by_indices(one, [2, 0, 2]), "pos") == ["abc", "a", "abc"] and text(retrieve.by_indices(one, []), "pos") == []
    with pytest.raises(ValueError):
        retrieve.by_range(one, 0, -1)
    with pytest.raises(ValueError):
        retrieve.checked_range(rows, 1, 9, 1)
    ask = retrieve.request(spark, [12, 10, 12, 77])
    assert text(retrieve.by_revid(one, ask), "pos") == ["abc", "a", "abc"]
    assert [r.revid for r in retrieve.missing_revids(one, ask).collect()] == [77]
    with pytest.raises(KeyError):
        retrieve.by_revid(one, ask, "error")
    assert text(retrieve.by_instance(rows.where("page_id = 1"), 3, 1), "instance") == ["abc"]
    assert retrieve.random_accesses(rows, 2, 5).collect() == retrieve.random_accesses(rows, 2, 5).collect()


def test_an_id_twice_in_a_page_gives_the_later(spark):
    x = pages(spark, {1: ["a", "b"]}).withColumn("revid", F.lit(5).cast("long"))
    assert retrieve.by_revid(compress.compress(x), retrieve.request(spark, [5])).first().text == "b"


def test_time_bounds(spark):
    x = spark.createDataFrame([("2024-01-01T00:00Z",), ("2024-01-01T23:59:59Z",), ("2024-01-01T23:59:59.5Z",), ("2024-01-02T01:00:00+02:00",), ("",), ("x",)], "s string")
    x = x.withColumn("ts", times.iso_to_ts(F.col("s")))
    pick = lambda **k: [r.s for r in x.where(retrieve.time_bounds(k.get("start"), k.get("end"), k.get("inclusive", True))).orderBy("ts").collect()]
    assert pick(end="2024-01-01", start="2024-01-01") == ["2024-01-01T00:00Z", "2024-01-02T01:00:00+02:00", "2024-01-01T23:59:59Z"]
    assert pick(start="2024-01-01", inclusive=False) == ["2024-01-02T01:00:00+02:00", "2024-01-01T23:59:59Z", "2024-01-01T23:59:59.5Z"]
    assert len(pick()) == 4


def test_blocks_don_t_change_results(spark):
    x = by_sizes(spark, list(range(50)), [7])
    a = blocks.previous(x, "size", "p", block=7).orderBy("page_id", "idx").select("p").collect()
    assert [r.p for r in a] == [None, *range(49), None]
    s = blocks.running(x, F.col("size"), "t", block=7).orderBy("page_id", "idx").collect()
    assert [r.t for r in s] == [*itertools.accumulate(range(50)), 7]
    m = blocks.running(x, F.when(F.col("idx") % 9 == 0, F.col("idx")), "t", "max", block=4).where("page_id = 0").orderBy("idx").collect()
    assert [r.t for r in m] == [i // 9 * 9 for i in range(50)]
    n = blocks.number(spark.createDataFrame([(1, k) for k in (5, 100, 7, 250, 90)], "page_id long, k long"), "page_id", "k", width=50)
    assert sorted((r.k, r.idx) for r in n.collect()) == [(5, 0), (7, 1), (90, 2), (100, 3), (250, 4)]


def test_reports(spark):
    x = by_sizes(spark, [1, 2, 8], [0, 0], [4])
    p = analytics.page_summary(layout.partition_all(x))
    rows = {r.page_id: r for r in p.collect()}
    assert rows[1].compression_ratio is None and rows[0].max_chain_len == 3 and rows[2].anchor_density == 1
    total = analytics.corpus_aggregate(p).first()
    assert total.artifacts == 3 and total.median_ratio == (8 / 11 + 1) / 2
    assert analytics.corpus_aggregate(p.limit(0)).collect() == []
    art = compress.artifacts(compress.compress(x))
    told = analytics.summarize_artifacts(art).orderBy("page_id").collect()
    bare = art.withColumn("meta", F.col("meta").withField("space_cost", F.lit(None).cast("long")).withField("time_cost", F.lit(None).cast("long")).withField("orig_size", F.lit(None).cast("long")))
    again = analytics.summarize_artifacts(bare).orderBy("page_id").collect()
    assert [(r.space_cost, r.time_cost, r.orig_size) for r in told] == [(r.space_cost, r.time_cost, r.orig_size) for r in again]
    assert analytics.manifest(analytics.summarize_artifacts(art), "f", 1.23456).first().compress_seconds == 1.235
    h = analytics.histogram(spark.createDataFrame([(1,), (2,), (3,), (None,)], "v int"), "v", 2).orderBy("bin").collect()
    assert [(r.bin, r.n) for r in h] == [(0, 1), (1, 2)]


def test_ranges(spark, monkeypatch):
    ids = spark.createDataFrame([(1,), (15,), (3_000_000,), (99,)], "page_id long")
    ranges = spark.createDataFrame([("b", 10, 20), ("a", 0, 18), ("c", 50, 5_000_000)], "path string, lo long, hi long")

    def all_three():
        return (
            sorted((r.page_id, r.path) for r in joins.covering(ids, ranges).collect()),
            sorted((r.page_id, r.path) for r in joins.first_covering(ids, ranges, ["path"]).collect()),
            sorted((r.page_id, tuple(r.names)) for r in joins.all_covering(ids, ranges.where("path != 'c'"), "path").collect()),
        )

    a = all_three()
    monkeypatch.setattr(joins, "CELL", 7)
    assert a == all_three()
    assert a[1] == [(1, "a"), (15, "a"), (99, "c"), (3_000_000, "c")] and (99, ()) in a[2]


def test_text_functions(spark):
    x = spark.createDataFrame([('A b. "a" B',), (None,)], "text string")
    assert {r.word: r.n for r in text_fns.word_counts(x).collect()} == {"a": 2, "b": 2}
    assert text_fns.id_list("1, x,3,,") == [1, 3]
    with pytest.raises(ValueError):
        text_fns.id_list("1,x", strict=True)
    row = spark.createDataFrame([("<a><b>", "see http://x.org/a?b=1 and me@x.org", "-12")], "t string, s string, n string").select(
        text_fns.tags(F.col("t")).alias("t"), text_fns.urls(F.col("s")).alias("u"), text_fns.emails(F.col("s")).alias("e"), text_fns.is_number(F.col("n")).alias("n")
    )
    assert row.first() == (["<a", "b>"], ["http://x.org/a?b=1"], ["me@x.org"], True)


def test_streaming_append(spark, tmp_path):
    from palimspark.streaming.append import append

    src = str(tmp_path / "in")
    texts = ["a", "ab" * 5, "", "x\ny\n" * 9]
    for i, t in enumerate(texts):
        spark.createDataFrame([(1, i, t), (2, i, t)], "page_id long, revid long, text string").coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema("page_id long, revid long, text string").option("maxFilesPerTrigger", 1).parquet(src)
    q = append(stream).writeStream.format("memory").queryName("appended").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    rows = spark.sql("select *, coalesce(base_text, array_join(transform(filter(patch, x -> substr(x,1,2) in ('  ','+ ')), x -> substr(x,3)), '')) as text from appended where not late")
    got = sorted((r.page_id, r.revid, r.text) for r in rows.collect())
    on_time = [(p, r) for p, r, _ in got]
    assert len(on_time) == len(set(on_time)) and all(t == texts[r] for _, r, t in got)


def test_names_in_lines_in_several_passes(spark):
    names = spark.createDataFrame([(f"n{i}x", i) for i in range(300)] + [("water", 1), ("", 2), (None, 3), ("water", 4)], "name string, extra int")
    lines = spark.createDataFrame([(1, "by n7x water n7x"), (2, None), (3, ""), (3, "n299x"), (3, "n299x")], "line_id int, line string")
    got = joins.named_in(names, lines, "name", "line", at_once=50).collect()
    want = [(i, n, e) for i, t in [(1, "by n7x water n7x"), (3, ""), (3, "n299x"), (3, "n299x")] for n, e in [*((f"n{k}x", k) for k in range(300)), ("water", 1), ("", 2), ("water", 4)] if n in t]
    assert sorted((r.line_id, r["name"], r.extra) for r in got) == sorted(want)


def test_character_deltas_of_long_texts():
    rng = random.Random(4)
    for _ in range(300):
        a = "".join(rng.choice("ab\n") for _ in range(rng.randrange(30)))
        b = "".join(rng.choice("ab\n") for _ in range(rng.randrange(30))) if rng.random() < 0.5 else a[: len(a) // 2] + "x" + a[len(a) // 2 :]
        assert delta.apply_chars(a, delta.char_delta(a, b)) == b
    long = "".join(f"line {i} of many\n" for i in range(6000))
    changed = long.replace("line 3000 of", "row 3000 off") + "end"
    patch = delta.char_delta(long, changed)
    assert delta.apply_chars(long, patch) == changed and len(patch) < 100


def test_character_steps_are_difflibs_without_its_time():
    rng = random.Random(5)
    for _ in range(400):
        x, y = ("".join(rng.choice(rng.choice(["ab", "abc d", "é\U0001f600a"])) for _ in range(rng.randrange(40))) for _ in range(2))
        blocks = difflib.SequenceMatcher(None, x, y, autojunk=False).get_matching_blocks()
        assert delta._common(x, y) == [tuple(m) for m in blocks[:-1]]
    x, y = ("".join("a" * i + end for i in range(64)) for end in "bc")
    began = time.process_time()
    assert delta.apply_chars(x, delta.char_delta(x, y)) == y
    assert time.process_time() - began < 2  # 15 s with difflib


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="the tables aren't here")
def test_character_deltas_are_made_once(spark):
    plan = queries.char_patch_roundtrip(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_tables_of_revisions_are_not_broadcast(spark):
    """Small ones neither: what Spark takes for small can have millions of rows."""
    x = pages(spark, {1: ["a", "ab", "abc"], 2: ["q"]})
    parts = layout.partition(x, layout.choose(x, 100))
    deltas = compress.as_deltas(x, parts, F.col("idx") > 0)
    numbered = blocks.number(x.drop("idx"), "page_id", "revid")
    for df in (numbered, layout.choose(x, 1), parts, deltas, delta.with_delta(x), compress.artifacts(deltas), analytics.page_summary(parts)):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
    plan = lambda q: q(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    if os.path.isdir("/root/testdata/sf0.001"):
        assert "Broadcast" not in plan(queries.retrieve_time) + plan(queries.retrieve_time_exclusive) + plan(queries.char_patch_roundtrip)


def test_pages_that_go_on_over_batches(spark):
    """The choice doesn't depend on how a task's rows are batched."""
    rng = random.Random(9)
    x = by_sizes(spark, *[[rng.randrange(1, 400) for _ in range(rng.choice([1, 3, 40]))] for _ in range(40)])
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, got = spark.conf.get(name), []
    for rows in ("1", "7", before):
        spark.conf.set(name, rows)
        got.append(sorted(map(tuple, layout.choose(x, 900, "sparse").collect())))
    spark.conf.set(name, before)
    assert got[0] == got[1] == got[2] and got[0]


def test_random_access_and_meta(spark):
    x = pages(spark, {1: [f"text {i}" for i in range(9)], 2: ["a", "b"]})
    rows = compress.as_deltas(x, layout.fixed_interval(x.drop("text"), 4))
    assert [(r.page_id, r.full_instance, r.text) for r in retrieve.by_period(rows, 7, 4).collect()] == [(1, 5, "text 6")]
    assert [r.text for r in retrieve.access(rows, 8).collect()] == ["text 8"]
    only = compress.as_deltas(x, layout.fixed_interval(x.drop("text"), 4), F.col("idx") == 6)
    assert [r.text for r in retrieve.access(only, 6).collect()] == ["text 6"] and only.count() == 1
    nested = compress.artifacts(rows)
    assert retrieve.check_meta(nested, "revids").count() == 2
    with pytest.raises(KeyError):
        retrieve.check_meta(nested, "nothing")
