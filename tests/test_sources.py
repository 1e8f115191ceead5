import bz2
import io
import json

import pytest

from palimspark import cli
from palimspark.operators import compress, retrieve
from palimspark.plans import sweep
from palimspark.sources import api, dumps, store



def _page(title, ns, page, *revisions):
    return f"<page><title>{title}</title><ns>{ns}</ns><id>{page}</id>{''.join(revisions)}</page>"


def _revision(number, stamp, text, who=""):
    return f"<revision><id>{number}</id><timestamp>{stamp}</timestamp>{who}{text}</revision>"


SPACE = "http://www.mediawiki.org" + "/xml/export-0.10/"
XML = (
    f'<mediawiki version="0.10" xmlns="{SPACE}">'
    + _page(
        "Fen", 0, 11,
        _revision(1, "2024-01-01T00:00:00Z", '<text bytes="5">reeds</text>', "<contributor><username>A</username></contributor>"),
        _revision(2, "2024-01-02T00:00:00Z", '<text bytes="30"> reeds and\n more reeds in water </text>'),
        _revision(3, "", "<text/>"),
    )
    + _page("Moor", 1, 12, _revision(9, "2024-02-01T00:00Z", "<text>peat</text>"))
    + "</mediawiki>"
)


@pytest.fixture(scope="module")
def dump(tmp_path_factory):
    d = tmp_path_factory.mktemp("dumps")
    (d / "x-pages-meta-history1.xml-p1p50.bz2").write_bytes(bz2.compress(XML.encode()))
    (d / "readme.bz2").write_bytes(bz2.compress(b"no range"))
    return d


def test_xml_scan(spark, dump):
    path = str(dump / "x-pages-meta-history1.xml-p1p50.bz2")
    rows = dumps.revisions(dumps.xml_pages(spark, path), [11]).orderBy("idx").collect()
    assert [(r.idx, r.revid, r.text, r.size) for r in rows] == [(0, 1, "reeds", 5), (1, 2, " reeds and\n more reeds in water ", 32), (2, 3, "", 0)]
    assert rows[2].ts is None and rows[0].contributor == "A"
    assert dumps.history(spark, path, title="Moor").first().ts is not None
    assert dumps.history(spark, path, title="Moor", page_id=11).count() == 0
    assert dumps.revisions(dumps.xml_pages(spark, path), limit_per_page=1).count() == 2
    assert dumps.history(spark, path, limit=2).count() == 2
    assert dumps.page_index(spark, path, [1]).select("page_id").first()[0] == 12
    assert [r.size for r in dumps.legacy_sizes(dumps.xml_pages(spark, path)).orderBy("page_id", "idx").collect()] == [5, 30, 0, 4]
    with pytest.raises(ValueError):
        dumps.xml_pages(spark, "a.7z")


def test_parquet_twin(spark, dump, tmp_path):
    out = str(tmp_path / "pages")
    assert dumps.to_parquet(spark, str(dump / "*.xml-p1p50.bz2"), out) == 2
    assert dumps.read_page(spark, out, 12).first().text == "peat"


def test_range_index(spark, dump, tmp_path):
    index = dumps.index_dir(spark, str(dump))
    assert [(r.lo, r.hi) for r in index.collect()] == [(1, 50)]
    dumps.save_index(index, str(tmp_path / "index"))
    assert dumps.load_index(spark, str(tmp_path / "index")).count() == 1


def test_listings(spark):
    names = ["wiki-20240101-pages-meta-history2.xml-p100p200.bz2", "wiki-20240101-pages-meta-history1.xml-p1p99.7z"]
    status = json.dumps({"jobs": {"metahistorybz2dump": {"files": {n: {"url": "/" + n} for n in names}}, "other": {"files": {"pages-meta-history9.xml-p1p2.bz2": {"url": "x"}}}}})
    html = "".join(f'<a href="{n}">{n}</a>' for n in names)
    for answers in ({"http://d/20240101/dumpstatus.json": status}, {"http://d/20240101/": html}, {"http://d/latest/": html}):
        got = dumps.list_parts(spark, "http://d/20240101", answers.get).collect()
        assert [(r.part, r.start, r.end, r.ext) for r in got] == [(1, 1, 99, "7z"), (2, 100, 200, "bz2")]
    with pytest.raises(LookupError):
        dumps.list_parts(spark, "http://d/x", lambda url: None)


def test_download_once(tmp_path):
    calls = []

    def opener(url):
        calls.append(url)
        return io.BytesIO(b"abc")

    assert dumps.download("http://d/f.bz2", str(tmp_path), opener) == dumps.download("http://d/f.bz2", str(tmp_path), opener)
    assert len(calls) == 1


def _answers():
    rev = lambda i: {"revid": i, "timestamp": f"2024-01-0{i}T00:00:00Z", "slots": {"main": {"content": "x" * i}}}
    page = lambda *r: {"query": {"pages": [{"pageid": 5, "title": "T", "revisions": list(r)}]}}
    return [page(rev(1), rev(2)) | {"continue": {"rvcontinue": "2"}}, page(rev(3))]


def test_api_walk_and_resolve(spark, tmp_path):
    rows = list(api.walk("T", 10, (lambda it: lambda ask: next(it))(iter(_answers()))))
    assert [r[3] for r in rows] == [1, 2, 3] and rows[2][5] == "xxx"
    assert len(list(api.walk("T", 2, (lambda it: lambda ask: next(it))(iter(_answers()))))) == 2
    with pytest.raises(ValueError):
        list(api.walk("N", 2, lambda ask: {"query": {"pages": [{"title": "N", "missing": True}]}}))
    assert api.resolve(["a", "b"], lambda ask: {"query": {"pages": [{"title": "A", "pageid": 1}, {"title": "B", "missing": True}]}}) == {"A": 1}
    path = tmp_path / "recorded.json"
    path.write_text(json.dumps({"T": _answers()}))
    assert [r.revid for r in api.load(spark, ["T"], recorded=str(path)).orderBy("idx").collect()] == [1, 2, 3]


def test_knolml_round_trip(spark, dump, tmp_path):
    x = dumps.revisions(dumps.xml_pages(spark, str(dump / "*.xml-p1p50.bz2")), [11])
    dumps.write_knolml(x, str(tmp_path / "k"))
    got = dumps.knolml_accessors(dumps.knolml(spark, str(tmp_path / "k"))).orderBy("id").collect()
    assert [(r.revid, r.text) for r in got] == [(1, "reeds"), (2, " reeds and\n more reeds in water "), (3, "")]
    assert got[0].created is not None and got[0].is_closed is False and got[0].is_question is None


def test_sweep_resume_and_cli(spark, dump, tmp_path):
    out = str(tmp_path / "out")
    rows = sweep.sweep(spark, str(dump), [11, 12, 99], out, time_budget=1000).collect()
    assert sorted(r.page_id for r in rows) == [11, 12] and all(not r.skipped and r.error is None for r in rows)
    again = sweep.sweep(spark, str(dump), [11, 12], out).collect()
    assert all(r.skipped for r in again)
    path = f"{out}/page_11.comp.gz"
    long = compress.explode(store.load(spark, path))
    assert [r.text for r in retrieve.by_range(long, 0, 9).orderBy("idx").collect()] == ["reeds", " reeds and\n more reeds in water ", ""]
    assert long.select("is_anchor").where("not is_anchor").count() >= 1
    said = io.StringIO()
    assert cli.run(["retrieve", "--in", path, "--start", "0", "--length", "0", "--print"], spark, said) == 0
    assert said.getvalue() == "reeds\n"
    said = io.StringIO()
    cli.run(["retrieve-by-id", "--in", path, "--ids", "3,1", "--print"], spark, said)
    assert said.getvalue() == "\nreeds\n"
    said = io.StringIO()
    cli.run(["retrieve-by-time", "--in", path, "--start-ts", "2024-01-02", "--end-ts", "2024-01-02"], spark, said)
    assert said.getvalue().startswith("1\t")
    said = io.StringIO()
    cli.run(["analyze-comp", "--in-dir", out, "--out-csv", str(tmp_path / "csv"), "--plots-dir", str(tmp_path / "plots")], spark, said)
    assert "artifacts: 2" in said.getvalue()
    cli.run(["compress-from-dump-dir", "--dump-dir", str(dump), "--page-ids", "11", "--out-dir", out, "--force"], spark, said)
    assert json.load(open(f"{out}/manifest.json"))[0]["page_id"] == 11
    xml = str(dump / "x-pages-meta-history1.xml-p1p50.bz2")
    assert cli.run(["compress-xml", "--xml", xml, "--title", "Moor", "--out", str(tmp_path / "moor.gz")], spark, said) == 0
    assert cli.run(["compress-xml", "--xml", xml, "--title", "None", "--out", str(tmp_path / "n.gz")], spark, said) == 1
    assert cli.run(["build-index", "--file", xml, "--index", str(tmp_path / "idx")], spark, said) == 0


def test_a_page_in_overlapping_files_counts_once(spark, tmp_path):
    d, out = tmp_path / "two files", str(tmp_path / "out")
    d.mkdir()

    def write(name, *pages):
        (d / name).write_bytes(bz2.compress(f'<mediawiki xmlns="{SPACE}">{"".join(pages)}</mediawiki>'.encode()))

    revs = [_revision(i, f"2024-01-0{i}T00:00:00Z", f"<text>{'x' * i}</text>") for i in (1, 2, 3)]
    other = [_revision(i, f"2024-02-0{i}T00:00:00Z", f"<text>{'y' * i}</text>") for i in (4, 5, 6, 7)]
    # 5 is twice in its own file, 7 in both with more revisions in the other, 8 only in the file it isn't assigned to
    write("a-p1p10.bz2", _page("Five", 0, 5, *revs[:2]), _page("Five", 0, 5, *revs), _page("Seven", 0, 7, *revs))
    write("b-p6p20.bz2", _page("Five", 0, 5, *other), _page("Seven", 0, 7, *other), _page("Eight", 0, 8, *revs), _page("Twelve", 0, 12, *revs))
    rows = {r.page_id: r for r in sweep.sweep(spark, str(d), [5, 7, 8, 12], out, time_budget=1000).collect()}
    assert sorted(rows) == [5, 7, 8, 12] and all(r.error is None for r in rows.values())
    assert {p: r.source_file[-11:-4] for p, r in rows.items()} == {5: "a-p1p10", 7: "a-p1p10", 8: "b-p6p20", 12: "b-p6p20"}
    for page in (5, 7, 8, 12):
        long = compress.explode(store.load(spark, f"{out}/page_{page}.comp.gz"))
        assert [r.text for r in retrieve.by_range(long, 0, 9).orderBy("idx").collect()] == ["x", "xx", "xxx"]
    both = [str(d / "a-p1p10.bz2"), str(d / "b-p6p20.bz2")]
    got = dumps.revisions(dumps.xml_pages(spark, both), [5, 7]).collect()
    assert sorted((r.page_id, r.idx, r.revid) for r in got) == [(p, i, i + 4) for p in (5, 7) for i in range(4)]


def test_a_page_that_cannot_be_written_is_a_row(spark, tmp_path):
    d, out = tmp_path / "dumps", tmp_path / "out"
    d.mkdir()
    (out / "page_5.comp.gz" / "in the way").mkdir(parents=True)
    revs = [_revision(i, f"2024-01-0{i}T00:00:00Z", f"<text>{'x' * i}</text>") for i in (1, 2)]
    for name, page in (("a-p1p5.bz2", 5), ("b-p6p20.bz2", 6)):
        (d / name).write_bytes(bz2.compress(f'<mediawiki xmlns="{SPACE}">{_page("P", 0, page, *revs)}</mediawiki>'.encode()))
    rows = {r.page_id: r for r in sweep.sweep(spark, str(d), [5, 6], str(out), time_budget=1000, force=True).collect()}
    assert rows[5].error and rows[6].error is None and rows[5].revisions == 2
    store.write_manifest(spark.createDataFrame([(r.page_id, r.error) for r in rows.values()], "page_id long, error string"), str(tmp_path / "m"), {"dump": "d"})
    told = json.loads((tmp_path / "m.json").read_text())
    assert told["count"] == 2 and {i["page_id"] for i in told["items"]} == {5, 6}


def test_manifest_without_rows(spark, tmp_path):
    store.write_manifest(spark.createDataFrame([], "b int, a int"), str(tmp_path / "m"), {"dump": "d"})
    assert (tmp_path / "m.csv").read_text().strip() == "a,b"
    assert json.loads((tmp_path / "m.json").read_text()) == {"dump": "d", "count": 0, "items": []}


def test_file_names():
    assert store.file_name(3, "x") == "page_3.comp.gz"
    assert store.file_name(None, "a/b") == "a_b.comp.gz"
