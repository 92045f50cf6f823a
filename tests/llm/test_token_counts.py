"""The transducer and the composed chunk maps against the tokenizer library."""

import random

import pytest

from gradewright.llm import token_counts
from gradewright.llm.tokens import default_path

SIGNS = "aAbzéÉßÇñ ı İ ſ ŉ Ł ż ķ\n\t.,!?*'sSdtmllrve0123456789|<>$#-_́​  Σσς漢😀\x1c\x85\xa0²½"


def texts():
    random.seed(5)
    made = ["".join(random.choice(SIGNS) for _ in range(random.randint(0, 40))) for _ in range(1500)]
    made += ["<|endoftext|>x<|startoftext|>", "it's we're they'll 'sx 're 'r ''s '' 'v 'lx", "a" * 1000, "haha" * 300, "." * 500, "😂" * 100]
    return [*made, "x<|endoftext|", "漢字" * 200, "", "a" * 37 + "é" * 5 + "b" * 90, "word " * 3000, "각" * 50]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(default_path())


@pytest.fixture(scope="module")
def machine():
    return token_counts.Transducer(default_path())


def test_transducer_equals_the_library(machine, library):
    for text in texts():
        want = len(library.encode(text, add_special_tokens=False).ids)
        assert machine.count(text.encode()) == want, text[:60]
        assert machine.chunk(machine.start, text, True)[1] == want, text[:60]


def test_any_cut_gives_the_same_count(machine, library):
    for text in ["we're theyʼll 12.5 haha'sx", "aaaaaaaaaaaaaaaaaaa", "...''!!'t", "ǅé́x漢字 😂😂"]:
        want = len(library.encode(text, add_special_tokens=False).ids)
        for k in range(len(text)):
            if token_counts._parts(text[k]):
                state, n = machine.chunk(machine.start, text[:k], False)
                assert n + machine.chunk(machine.named(state.name()), text[k:], True)[1] == want, (text, k)


def test_bounded_memories_forget_without_harm(library, monkeypatch):
    for name in ("KEPT_STATES", "KEPT_PAIRS", "KEPT_WORDS"):
        monkeypatch.setattr(token_counts, name, 5)
    small = token_counts.Transducer(default_path())
    for text in texts()[::10]:
        assert small.count(text.encode()) == len(library.encode(text, add_special_tokens=False).ids)


def test_cuts_hold_the_text_and_keep_special_strings_whole(machine):
    for text in ["ab<|endoftext|>" * 40, "x" + "́" * 300, "one two three " * 30]:
        for size in (7, 16, 50):
            bounds = list(token_counts.cuts(text, machine.special, machine.reach, size))
            assert "".join(text[a:b] for a, b in bounds) == text
            assert sum(len(machine.special.findall(text[a:b])) for a, b in bounds) == len(machine.special.findall(text))


@pytest.mark.parametrize(("size", "fan"), [(16, 2), (300, 64), (1 << 16, 64)])
def test_counts_equal_the_library(spark, library, size, fan):
    rows = [(k if k % 7 else None, t) for k, t in enumerate(texts())] + [(5, None), (6, "twice"), (6, "twice")]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n long, key string")
    got = token_counts.token_counts(df, default_path(), limit=100, size=size, fan=fan)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    want = []
    for i, t in rows:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        want.append((i, len((t or "").encode()), n, n > 100))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert token_counts.token_counts(df.limit(0), default_path()).count() == 0


def test_maps_without_the_entry_state_are_read_again(spark, library, monkeypatch):
    monkeypatch.setattr(token_counts.Transducer, "guesses", lambda self, before: [self.start])
    rows = [(1, "ab" * 100), (2, "haha" * 60), (3, "plain words " * 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in token_counts.token_counts(df, default_path(), size=64, fan=2).collect()}
    assert got == {i: len(library.encode(t, add_special_tokens=False).ids) for i, t in rows}
