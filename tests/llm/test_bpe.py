import hashlib
import random

import public_tokenizers
import pytest
from palimspark.llm import bpe
from tokenizers import Tokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def reference(library, text):
    ids = library.encode(text, add_special_tokens=False).ids
    return " ".join(map(str, ids)), library.decode(ids, skip_special_tokens=False)


def texts():
    rng = random.Random(7)
    points = [*range(0x250), *range(0x300, 0x600), *range(0x1E00, 0x1F00), *range(0x2000, 0x20A0), 0x85, 0x3000, 0xFEFF, 0x1F600, 0x4E00, 0xAC00, 0x130, 0x3A3, 0x1100, 0x1161, 0x11A8]
    for _ in range(1500):
        yield "".join(chr(rng.choice(points)) if rng.random() < 0.5 else rng.choice("abcdeo 'stvrlmd  \n<|>THE09") for _ in range(rng.choice([1, 3, 10, 40])))
    yield from ["", " ", "<|startoftext|>hi<|endoftext|>", "a <|endoftext|> ", "ΑΣ ΑΣΑ", "İ", "</w>", "a" * 3000, "ab" * 2000, "don't they'll WE'VE", "日本語のテキスト"]


def test_ids_and_decoded_text_are_the_librarys(library):
    enc = bpe.Encoder(PATH)
    for t in texts():
        assert enc.encode(t) == reference(library, t), repr(t)


def test_memo_that_overflows_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(bpe, "MEMO_ENTRIES", 3)
    enc = bpe.Encoder(PATH)
    t = "some words that come again and some that do not come again"
    assert enc.encode(t) == enc.encode(t) == reference(library, t)


def test_words_that_come_again_stay_in_a_full_memo(library, monkeypatch):
    """One text has more words than the memo; those of every line are encoded once, and the memo keeps its bound."""
    monkeypatch.setattr(bpe, "MEMO_ENTRIES", 50)
    enc, asked, word_ids = bpe.Encoder(PATH), [], bpe.Encoder.word_ids
    monkeypatch.setattr(bpe.Encoder, "word_ids", lambda self, word: (asked.append(word), word_ids(self, word))[1])
    often = ["river", "qanzu", "water", "zé", "x" * bpe.LONG_WORD]
    lines = [" ".join(often + ["".join(chr(97 + int(c)) for c in f"{i:04}{k}") for k in range(9)]) for i in range(60)]
    for t in [*lines, " ".join(lines)]:
        assert enc.encode(t) == reference(library, t)
        assert len(enc.memo) <= 50 and len(enc.memo.before) <= 50 and len(enc.safe) <= 50
    assert all(asked.count(w) == 1 for w in often)
    assert enc.encode("y" * 49) == reference(library, "y" * 49) and "y" * 49 not in enc.memo


def test_merges_by_hand_agree_with_prefixes():
    """Plain lowest-rank merging, word by word."""
    enc = bpe.Encoder(PATH)
    by_name = {n: i for i, n in enc.names.items()}
    rng = random.Random(2)
    for _ in range(300):
        word = "".join(rng.choice("thinaeros") for _ in range(rng.randrange(1, 14)))
        parts = [by_name[c] for c in word[:-1]] + [by_name[word[-1] + "</w>"]]
        while True:
            best = min(((enc.pair.get((a, b), 1 << 40), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))), default=(1 << 40, 0))
            if best[0] == 1 << 40:
                break
            i = best[1]
            parts[i : i + 2] = [by_name[enc.names[parts[i]] + enc.names[parts[i + 1]]]]
        assert enc.word_ids(word) == parts


def test_other_kinds_of_files_are_refused():
    with pytest.raises((ValueError, KeyError)):
        bpe.Encoder(public_tokenizers.path("byte_bpe_50k.json"))


def test_messy_rows_and_empty_tables(spark, library, docs, clashing, empty):
    for table in (docs, clashing):
        got = bpe.encode(table, PATH).collect()
        assert len(got) == docs.count()
        text = {r.doc_id: r.text or "" for r in docs.collect()}
        for r in got:
            ids, decoded = reference(library, text[r.doc_id])
            assert r.ids_sha256 == hashlib.sha256(ids.encode()).hexdigest() and r.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()
            assert r.n_tokens == len(ids.split()) == len(r.ids) and r.decoded == decoded
    assert bpe.encode(empty, PATH).collect() == []
