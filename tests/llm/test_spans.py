import hashlib
import itertools
import random
import re

import numpy as np
from palimspark.llm import pii, secrets_crf

ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""


def secrets_by_hand(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(ASSIGN, text) if len(m.group(2)) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m.group()) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m.group()) >= 24]
    return [(s, secrets_crf.KINDS[k], e) for s, k, e in sorted(out)]


def test_base_secrets_are_those_of_the_patterns():
    rng = random.Random(1)
    bits = ["password", "Token", "apiKEY", "api_key", "\u017fecret", "secret", ":", "=", " ", '"', "'", "abc123", "AKIA", "ABCDEFGH12345678", "deadbeef01", "\n", "é", "x", "-"]
    for _ in range(4000):
        t = "".join(rng.choice(bits) for _ in range(rng.randrange(1, 14)))
        assert secrets_crf.base_spans(t) == secrets_by_hand(t), repr(t)


def some_model():
    windows = [w for i in range(150) for w in secrets_crf._windows(f"the quiet river runs past {i} old stones and a garden where nobody walks " + ("token = 'a8f3k2m9x7q1w5z'" if i % 3 else ""), i)]
    x, y, f = (np.array([w[k] for w in windows]) for k in range(3))
    return secrets_crf.train(x, y, f)


MODEL = some_model()


def test_pruned_viterbi_is_the_best_tagging():
    rng = np.random.default_rng(0)
    m = MODEL
    for n in (1, 2, 5, 8):
        for _ in range(20):
            lead = rng.normal(-1, 3, (n, 2))
            full = np.hstack([np.zeros((n, 1)), lead])

            def value(tags):
                chain = (0, *tags, 0)
                return sum(full[i, t] for i, t in enumerate(tags)) + sum(m.trans[a, b] for a, b in zip(chain, chain[1:]))

            best = max(itertools.product(range(3), repeat=n), key=value)
            assert abs(value(best) - value(m.viterbi(lead))) < 1e-9
            closed = (lead <= -np.array(m.reach)).all(axis=1)
            assert all(best[i] == 0 for i in np.flatnonzero(closed))  # what pruning skips is outside


def test_field_finds_secrets_by_context():
    found = [secrets_crf.crf_spans([f"walk past the stones token = '{s}' and home"], MODEL)[0] for s in ("zz81kq02mm4x7p1", "b7d91mxk20qz8w3v")]
    assert all(found) and secrets_crf.crf_spans(["the quiet river runs past old stones", "", " "], MODEL) == [[], [], []]


def test_gradient_is_that_of_the_likelihood():
    """One tiny window: the fitted field gives its tags more than any other tagging."""
    x, y = np.array([[1, 2, 3]]), np.array([[0, 1, 2]])
    m = secrets_crf.train(x, y, np.zeros(1, int), epochs=80)

    def value(tags):
        e = m.own[x[0]] + m.file[0]
        e[1:] += m.prev[x[0, :-1]]
        e[2:] += m.prev2[x[0, :-2]]
        e[:-1] += m.nxt[x[0, 1:]]
        return sum(e[i, t] for i, t in enumerate(tags)) + sum(m.trans[a, b] for a, b in zip(tags, tags[1:]))

    every = {t: value(t) for t in itertools.product(range(3), repeat=3)}
    p = np.exp(every[(0, 1, 2)] - np.logaddexp.reduce(list(every.values())))
    assert p > 0.9


def test_secrets_messy_rows(spark, docs, clashing, empty):
    for table in (docs, clashing):
        got = secrets_crf.find(table, MODEL).collect()
        assert len(got) == docs.count()
        assert {r.base_sha256 for r in got if r.doc_id in (4, 5, 6)} == {hashlib.sha256(b"").hexdigest()}
    assert secrets_crf.find(empty).collect() == []
    x = spark.createDataFrame([(1, 'so token="abcdef123456" ends', "s")], "doc_id long, text string, source string")
    r = secrets_crf.find(x, MODEL).first()
    assert (r.n_assign, r.spans.split(",")[0]) == (1, "assign:3:22")
    assert r.base_sha256 == hashlib.sha256(b"assign:3:22").hexdigest()
    assert secrets_crf.redact(x, MODEL).first().text == 'so [SECRET]" ends'
    out = secrets_crf.redact(clashing, MODEL)
    assert out.columns == clashing.columns and out.where("text is null").count() == 1


def pii_by_hand(t):
    digits = lambda s: "".join(c for c in s if c in "0123456789")

    def luhn(d):
        return sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0

    out = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m.group().split("."))]
    out += [(2, *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 13 <= len(digits(m.group())) <= 19 and luhn(digits(m.group()))]
    out += [(3, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m.group())) <= 15]
    return out


def test_base_pii_is_that_of_the_patterns():
    rng = random.Random(3)
    bits = list("aB@..--+ 0123459%_()é\n@.") + ["4111 1111 1111 1111", "10.0.0.1", "a@b.co", "+1 (555) 010-9999", "999999999999999999999"]
    for _ in range(15000):
        t = "".join(rng.choice(bits) for _ in range(rng.choice([5, 20, 40])))
        assert pii.base_spans(t) == pii_by_hand(t), repr(t)


def test_long_runs_take_linear_time():
    for t in ("a" * 200_000, "1" * 200_000, "1.2." * 50_000, "+1 " * 50_000, "a@" * 100_000, "1 " * 100_000):
        pii.base_spans(t)
        pii.loose_spans(t)


def test_em_finds_the_reliable_labeler():
    rng = np.random.default_rng(1)
    truth = rng.integers(0, 2, 4000)
    vote = np.full((4000, pii.LABELERS), pii.NONE)
    for j, right in ((0, 0.95), (1, 0.9), (2, 0.6)):
        vote[:, j] = np.where(rng.random(4000) < right, truth, 1 - truth)
    p, like, _ = pii.em(np.zeros(4000, int), vote, np.ones(4000))
    assert ((p > 0.5) == truth).mean() > 0.93
    assert like[0, 0, 1, 1] > like[0, 2, 1, 1] + 0.2


def test_pii_messy_rows_and_added_spans(spark, docs, clashing, empty):
    for table in (docs, clashing):
        got = pii.find(table).collect()
        assert len(got) == docs.count() and all(r.spans == "" for r in got if r.doc_id in (4, 5, 6))
    assert pii.find(empty).collect() == []
    texts = ["write to ann@mail.example.com or ann at mail dot com", "call (415) 555-2671 or +1 (415) 555-2671", "card 4111 1111 1111 1111 ssn 219-09-9999", "host 192.0.2.1 iban DE89 3704 0044 0532 0130 00"] * 5
    x = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = {r.doc_id: r for r in pii.find(x).collect()}
    assert [rows[0].n_email, rows[1].n_phone, rows[2].n_card, rows[3].n_ip] == [1, 1, 1, 1]
    base = "email:9:29"
    assert rows[0].spans.split(",")[0] == base and rows[0].base_sha256 == hashlib.sha256(base.encode()).hexdigest()
    added = {s.split(":")[0] for r in rows.values() for s in r.spans.split(",")} - set(pii.KINDS[:4])
    assert {"local_phone", "ssn"} <= added


def iban(rng, good=True):
    body = "".join(rng.choice("0123456789") for _ in range(18))
    check = 98 - int("".join(str(int(c, 36)) for c in body + "DE00")) % 97
    s = f"DE{check if good else (check % 97) + 2:02d}{body}"
    if good != (int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1):
        return iban(rng, good)
    return " ".join(s[i : i + 4] for i in range(0, len(s), 4))


def planted(n=600):
    """Texts, and (kind, start, end) of the loose spans that are personal data; others look like them and aren't."""
    rng = random.Random(12)
    words = "the river ran past old stones while nobody spoke of it and a letter lay on the table near the window".split()
    digits = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    true = {
        "at_email": lambda: f"{rng.choice(['ann', 'b.lee', 'kim'])}{digits(2)} {rng.choice(['at', '(at)', '[at]'])} {rng.choice(['mail', 'post-box'])} {rng.choice(['dot', '(dot)'])} {rng.choice(['com', 'org', 'net'])}",
        "local_phone": lambda: f"({rng.randint(200, 999)}) {rng.randint(212, 999)}-{digits(4)}",
        "ssn": lambda: f"{rng.randint(100, 665):03d}-{rng.randint(10, 99)}-{rng.randint(1000, 9999)}",
        "iban": lambda: iban(rng),
    }
    false = {
        "ssn": lambda: rng.choice(["000", "666", "987"]) + f"-{digits(2)}-{digits(4)}",
        "iban": lambda: iban(rng, False),
        "loose_card": lambda: "order no. " + "7" + digits(14) + "1",
    }
    cue = {"at_email": "write to", "local_phone": "call", "ssn": "my ssn", "iban": "bank account"}
    texts, spans = [], []
    for i in range(n):
        head = " ".join(rng.choice(words) for _ in range(rng.randrange(4, 20))) + " "
        if i % 3:
            kind = rng.choice(sorted(true))
            head += (cue[kind] + " " if rng.random() < 0.6 else "")
            value = true[kind]()
            spans.append({(kind, len(head), len(head) + len(value))})
        else:
            value = false[rng.choice(sorted(false))]()
            spans.append(set())
        texts.append(head + value + " " + " ".join(rng.choice(words) for _ in range(8)) + rng.choice(["", " and ann@mail.example.com", " 4111 1111 1111 1111", " +1 (415) 555-2671"]))
    return texts, spans


def test_precision_and_recall_of_added_spans(spark):
    texts, want = planted()
    x = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: {(k, int(a), int(b)) for k, a, b in (s.split(":") for s in r.spans.split(",") if s) if k not in pii.KINDS[:4]} for r in pii.find(x).collect()}
    for kind in ("at_email", "local_phone", "ssn", "iban"):
        found = {(i, s) for i, own in got.items() for s in own if s[0] == kind}
        true = {(i, s) for i, own in enumerate(want) for s in own if s[0] == kind}
        assert len(found & true) >= 0.9 * len(true) and len(found & true) >= 0.95 * len(found), (kind, len(found), len(true), len(found & true))


def test_an_address_is_taken_whole():
    for t in ("mail " + "a" * 100 + " (at) example (dot) com now", "ann dot lee at mail (dot) example dot com", "john.d [at] " + "b" * 80 + " [dot] co [dot] uk"):
        (a, b), = pii.at_emails(t)
        assert t[a:b] == t.removeprefix("mail ").removesuffix(" now")
    assert pii.at_emails("we met at home dot 3 and at x dot y") == []
    for t in ("a dot " * 100_000, "a at " * 100_000, "a at b dot " * 50_000, "." * 200_000 + " at b dot com"):
        pii.at_emails(t)


def test_final_spans_are_those_of_a_plain_run(spark):
    """The whole operator again, a text at a time in plain Python: candidates, votes, expectation-maximisation, classifier."""
    texts, _ = planted(150)
    rows = [(t, k, a, b) for t in texts for k, a, b in [*pii_by_hand(t), *pii.loose_spans(t)]]
    votes = [pii.votes(*r) for r in rows]
    first = [[[0.4, 0.1, 0.5], [0.1, 0.4, 0.5]] for _ in range(pii.LABELERS)]
    first[pii.CHECK] = [[0.57, 0.03, 0.4], [0.03, 0.57, 0.4]]
    like, share = {k: [[list(v) for v in one] for one in first] for k in range(len(pii.KINDS))}, [0.5] * len(pii.KINDS)
    for _ in range(50):
        p = []
        for (_, k, _, _), v in zip(rows, votes):
            good, bad = share[k], 1 - share[k]
            for j in range(pii.LABELERS):
                bad, good = bad * like[k][j][0][v[j]], good * like[k][j][1][v[j]]
            p.append(good / (good + bad))
        for k, j, y in itertools.product(like, range(pii.LABELERS), (0, 1)):
            sums = [10 * first[j][y][u] for u in range(3)]
            for (_, kind, _, _), v, q in zip(rows, votes, p):
                if kind == k:
                    sums[v[j]] += q if y else 1 - q
            like[k][j][y] = [s / sum(sums) for s in sums]
        for k in range(len(pii.KINDS)):
            own = [q for q, r in zip(p, rows) if r[1] == k]
            share[k] = (sum(own) + 1) / (len(own) + 2)
    kinds, feats, vote = np.array([r[1] for r in rows]), np.array([pii.span_features(*r) for r in rows]), np.array(votes)
    x = pii.design(kinds, feats, vote)
    w = np.zeros(x.shape[1])
    for _ in range(25):
        q = 1 / (1 + np.exp(-(x @ w)))
        w += np.linalg.solve(x.T @ (x * (q * (1 - q))[:, None]) + np.eye(len(w)), x.T @ (np.array(p) - q) - w)
    want = {}
    for (t, k, a, b), z in zip(rows, x @ w):
        taken = [(s, e) for _, s, e in pii_by_hand(t)]
        if k < 4 or z > 0 and all(b <= s or a >= e for s, e in taken):
            want.setdefault(t, []).append(f"{pii.KINDS[k]}:{a}:{b}")
    got = pii.find(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")).collect()
    for r in got:
        assert r.spans == ",".join(want.get(texts[r.doc_id], [])), texts[r.doc_id]


def test_secret_spans_are_those_of_whole_chains(spark):
    """find() against Viterbi over each whole document, without pruning, batches or memo."""
    rng = random.Random(5)
    words = "the quiet river runs past old stones and a garden where nobody walks token key = : ' auth".split()
    texts = []
    for _ in range(120):
        w = [rng.choice(words) for _ in range(rng.randrange(0, 40))]
        if rng.random() < 0.6:
            w.insert(rng.randrange(len(w) + 1), rng.choice(["zz81kq02mm4x7p1", "AKIA" + "Q7" * 9, "deadbeef" * 4, "token='a8f3k2m9x7q1w5z'", "x9" * 40]))
        texts.append(" ".join(w))
    texts += ["", "y7" * 30_000, "walk " * 3000 + "key = " + "k3" * 12]
    m = MODEL
    x = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.spans for r in secrets_crf.find(x, MODEL).collect()}
    added = 0
    for i, t in enumerate(texts):
        tokens = [k.span() for k in secrets_crf.TOKEN.finditer(t)]
        ids = np.array([secrets_crf.feature(t[a:b]) for a, b in tokens], dtype=int)
        e = m.own[ids] + m.file[secrets_crf.file_feature(ids, len(t))] if len(ids) else np.zeros((0, 3))
        around = np.array([0, 0, *ids, 0], dtype=int)
        e = e + m.prev[around[1:-2]] + m.prev2[around[:-3]] + m.nxt[around[3:]]
        tags, back, score = [], [], m.trans[0] + e[0] if len(ids) else None
        for row in e[1:]:
            step = score[:, None] + m.trans
            back.append(step.argmax(0))
            score = step.max(0) + row
        if len(ids):
            tags = [int((score + m.trans[:, 0]).argmax())]
            for b in reversed(back):
                tags.append(int(b[tags[-1]]))
            tags = tags[::-1]
        found, last = [], -2
        for j, y in enumerate(tags):
            if y == 1 or y == 2 and last != j - 1:
                found.append(list(tokens[j]))
                last = j
            elif y == 2:
                found[-1][1] = tokens[j][1]
                last = j
        base = secrets_by_hand(t)
        more = [(a, "crf", b) for a, b in found if all(b <= s or a >= end for s, _, end in base)]
        added += len(more)
        order = {k: n for n, k in enumerate(secrets_crf.KINDS)}
        assert got[i] == secrets_crf.joined(sorted(base + more, key=lambda s: (s[0], order[s[1]]))), t[:200]
    assert added > 10


def test_tokens_are_hashed_whole():
    for a, b in (("x" * 65 + "y", "x" * 65 + "z"), ("====!", "====?")):
        assert secrets_crf.feature(a) != secrets_crf.feature(b)


def test_a_share_of_a_very_large_table_isnt_nothing(spark):
    """As if the rows were a sample of 10^11: a share of 10^-7 of all hashes is a range, not 0; copies count once."""
    x = spark.range(2000).selectExpr("cast(id % 1500 as string) as text")
    assert secrets_crf.sampled(x, 2000, 100).count() > 50
    assert secrets_crf.sampled(x, 2000, 5000).count() == 1500
    plan = secrets_crf.sampled(x, 10**11, 10_000)._jdf.queryExecution().optimizedPlan().toString()
    assert str(int(-(2**63) + 1e-7 * 2**64)) in plan
    some = {w[2] for w in secrets_crf._windows("password=abcdef123456 " * 200, 3)}
    assert some and len(secrets_crf._windows("password=abcdef123456 " * 200, 3)) == secrets_crf.SECRETS + 2
