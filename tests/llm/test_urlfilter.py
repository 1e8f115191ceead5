import random

from palimspark.llm import urlfilter

SCHEMA = "page_id long, url string, html string, key string, rule string, host string, path string"


def by_hand(url, rules, default="allow"):
    head, sep, rest = (url or "").partition("://")
    host = path = ""
    if sep:
        end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
        rest = rest[end:]
        path = rest[: min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])]
    fits = [(-len(h) - len(p), -len(h), a, h + p) for a, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = min(fits, default=None)
    return (host, path, best[3], best[2]) if best else (host, path, None, default)


def urls(n=600):
    rng = random.Random(4)
    out = [None, "", "no scheme", "http://", "://x.com/", "http://COM/", "HTTP://Example.COM/en/a?b#c", "http://example.com?x/en/", "http://a\n.com/b", "x" * 100_000, "http://h.com/" + "p/" * 50_000, "http://a://b.com/", "http://.com/", "http://com./", "http://É.com/"]
    for _ in range(n):
        host = ".".join(rng.choice(["www", "blog", "example", "a", "com", "net", "org", "es"]) for _ in range(rng.randrange(1, 5)))
        out.append(f"http{rng.choice(['', 's'])}://{host}{rng.choice(['', '/', '/en/', '/en/x', '/es/', '/fr/y', '/EN/'])}{rng.choice(['', '?q=/en/', '#t'])}")
    return out


def table(spark, some):
    return spark.createDataFrame([(i, u, None, None, None, None, None) for i, u in enumerate(some)], SCHEMA)


def check(spark, rules, **more):
    some = urls()
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.filter_urls(table(spark, some), rules, **more).collect()}
    assert got == {i: by_hand(u, rules) for i, u in enumerate(some)}


def test_the_rules_of_the_query(spark):
    check(spark, urlfilter.RULES)


def test_many_nested_rules_broadcast_and_as_a_table(spark):
    rng = random.Random(9)
    parts = ["www", "blog", "example", "a", "com", "net", "org", "es"]
    rules = tuple({(".".join(rng.choice(parts) for _ in range(rng.randrange(1, 4))), rng.choice(["/", "", "/en/", "/es/", "/fr/"])): None for _ in range(150)})
    rules = tuple((rng.choice(["allow", "block"]), h, p) for h, p in rules)
    check(spark, rules)
    check(spark, rules, max_rules=10)


def test_rules_as_a_table(spark):
    x = spark.createDataFrame(list(urlfilter.RULES) + [("block", None, "/")], "action string, host string, path string")
    some = urls(50)
    a = sorted(map(str, urlfilter.filter_urls(table(spark, some), x).collect()))
    assert a == sorted(map(str, urlfilter.filter_urls(table(spark, some)).collect()))


def test_repeated_rows_null_ids_and_empty_tables(spark):
    rows = [(None, "http://x.com/", None, None, None, None, None)] * 3
    assert urlfilter.filter_urls(spark.createDataFrame(rows, SCHEMA)).count() == 3
    assert urlfilter.filter_urls(spark.createDataFrame([], SCHEMA)).collect() == []
    assert urlfilter.filter_urls(spark.createDataFrame(rows, SCHEMA), ()).first().verdict == "allow"


def test_more_rules_than_are_broadcast(spark):
    """50,001 nested rules go through the sorted stream."""
    rng = random.Random(6)
    parts = ["www", "blog", "example", "a", "com", "net", "org", "es"]
    rules = {("com", "/en/x" + "y" * i): "block" for i in range(40)} | {(f"h{i}.{rng.choice(parts)}.{rng.choice(parts)}", f"/{i % 7}"): "allow" for i in range(50_001)}
    rules |= {(".".join(rng.choice(parts) for _ in range(rng.randrange(1, 5))), rng.choice(["/", "", "/en/", "/es/"])): rng.choice(["allow", "block"]) for _ in range(300)}
    rules = [(a, h, p) for (h, p), a in rules.items()]
    table_of = spark.createDataFrame(rules, "action string, host string, path string")
    some = urls(300) + [f"http://x.h{i}.com.net/{i % 7}z" for i in range(0, 3000, 10)]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.filter_urls(table(spark, some), table_of).collect()}
    small = [r for r in rules if not r[1].startswith("h")] + [r for r in rules if r[1].startswith("h") and int(r[1][1:].split(".")[0]) < 3000]
    assert got == {i: by_hand(u, small) for i, u in enumerate(some)}
