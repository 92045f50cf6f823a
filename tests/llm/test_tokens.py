"""Tokenizer batches, token files, packing and SentencePiece against the libraries and brute force."""

import collections
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from gradewright.llm import binary_output, packing, sentencepiece_scan, tokens
from gradewright.session import scratch_dir

ROWS = [
    (3, "Hello, World! It's 12 o'clock.\nÉté naïve"), (1, ""), (2, None), (None, "no id"), (7, "  spaces \t and\n\nlines "),
    (7, "  spaces \t and\n\nlines "), (9, "<|endoftext|> 漢字 x́ ǅ"), (8, "word " * 5000), (4, "aaaa" * 2000),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "clash", 1) for i, t in ROWS], "doc_id long, text string, piece string, _hash int")


@pytest.fixture(scope="module")
def encoder():
    return tokens.BatchEncoder(tokens.default_path())


def ids(encoder, text):
    return encoder.whole.encode(text or "", add_special_tokens=False).ids


def test_batches_equal_the_tokenizer(encoder):
    random.seed(5)
    signs = "aAbzéÉßÇñ ı İ ſ ŉ Ł ż ķ\n\t.,!?*'sSdtmll0123456789|<>$#-_́​  Σσς漢😀"
    texts = ["".join(random.choice(signs) for _ in range(random.randint(0, 30))) for _ in range(2000)] + [t or "" for _, t in ROWS]
    found, offsets = encoder.encode(pa.array(texts), 1)
    for a, b, text in zip(offsets, offsets[1:], texts):
        assert found[a:b].tolist() == [*ids(encoder, text), 1], text


def test_memory_of_words_may_start_anew(encoder, monkeypatch):
    monkeypatch.setattr(tokens, "MEMORY", 3)
    for text in ("one two three four", "five six one", "one two"):
        assert encoder.encode(pa.array([text]))[0].tolist() == ids(encoder, text)


def test_slices_keep_all_rows():
    batch = pa.RecordBatch.from_pydict({"text": pa.array(["a" * n for n in (5, 50, 0, 3, 3, 90, 1)])})
    parts = list(tokens.slices(batch, most=10))
    assert [t for p in parts for t in p["text"].to_pylist()] == batch["text"].to_pylist() and len(parts) > 3


def test_token_files_round_trip(spark, docs, encoder):
    path = scratch_dir(spark, "token-files")
    manifest = binary_output.write_parts(docs, path, tokens.default_path(), parts=3)
    got = sorted(map(tuple, binary_output.read_documents(spark, path, manifest).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == [None, 1, 2, 3, 4, 7, 7, 8, 9]
    start, texts = 0, collections.defaultdict(list)
    for i, t in ROWS:
        texts[i].append([*ids(encoder, t), 1])
    for doc_id, at, n, crc in got:
        want = texts[doc_id][0]
        assert (at, n, crc) == (start, len(want), zlib.crc32(np.array(want, "<u4").tobytes()))
        start += n


def test_token_files_of_an_empty_table(spark, docs):
    path = scratch_dir(spark, "token-files")
    manifest = binary_output.write_parts(docs.limit(0), path, tokens.default_path())
    assert manifest == [] and binary_output.read_documents(spark, path, manifest).count() == 0


def test_packing_keeps_every_piece(spark, docs, encoder):
    cut = packing.pieces(docs, tokens.default_path(), capacity=64)
    got = packing.pack(cut, capacity=64, per_task=100).collect()
    want = collections.Counter()
    for i, t in ROWS:
        whole = [*ids(encoder, t), 0]
        for k, s in enumerate(range(0, len(whole), 64)):
            want[i, k, s, len(whole[s : s + 64]), zlib.crc32(np.array(whole[s : s + 64], "<u4").tobytes())] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    places = collections.defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
    for held in places.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.pack(packing.pieces(docs.limit(0), tokens.default_path())).count() == 0


def test_sum_of_squares_is_greedy_and_close_to_the_bound():
    def cost(gaps):
        return sum(n * n for n in collections.Counter(g for g in gaps if g).values())

    random.seed(1)
    lengths = [random.randint(1, 20) for _ in range(200)]
    number, offset = packing.sum_of_squares(np.array(lengths), 20)
    gaps: list[int] = []
    for length, k, at in zip(lengths, number, offset):
        before = [g for g in gaps]
        options = [cost(gaps[:j] + [g - length] + gaps[j + 1 :]) for j, g in enumerate(gaps) if g >= length] or [cost([*gaps, 20 - length])]
        if k == len(gaps):
            gaps.append(20)
        assert 20 - gaps[k] == at
        gaps[k] -= length
        assert cost(gaps) == min(options), before
    random.seed(2)
    lengths = np.sort(np.array([random.randint(1, 2048) for _ in range(20_000)]))[::-1]
    used = packing.sum_of_squares(lengths)[0].max() + 1
    assert used <= 1.01 * -(-lengths.sum() // 2048)


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=sentencepiece_scan.default_path())


@pytest.mark.parametrize("size", [40, 16_384])
def test_sentencepiece_equals_the_library(spark, docs, library, size):
    random.seed(3)
    signs = "aabbeeioutnrs   \n.,!019éÉ漢字😀▁ß\x00"
    made = ["".join(random.choice(signs) for _ in range(random.randint(0, 300))) for _ in range(40)]
    made += [t.replace(" ", "") for t in made[:10]] + ["ab" * 3000, " " * 100 + "x"]
    more = spark.createDataFrame([(100 + k, t) for k, t in enumerate(made)], "doc_id long, text string")
    path = sentencepiece_scan.default_path()
    texts = {**dict(ROWS), **{100 + k: t for k, t in enumerate(made)}}
    got = sentencepiece_scan.decoded(sentencepiece_scan.encoded(docs.select("doc_id", "text").union(more), path, size), path).collect()
    assert len(got) == len(ROWS) + len(made)
    for r in got:
        text = texts[r.doc_id] or ""
        want = library.encode(text)
        assert (r.n_tokens, r.ids_crc32) == (len(want), zlib.crc32(np.array(want, "<u4").tobytes())), text[:80]
        assert r.text == library.decode(want)
        assert r.n_chunks == max(1, -(-(len(text) + bool(text)) // size))


def test_scan_of_many_levels(spark, library, monkeypatch):
    monkeypatch.setattr(sentencepiece_scan, "FAN", 3)
    path, text = sentencepiece_scan.default_path(), "internationalization of words" * 80
    df = spark.createDataFrame([(1, text), (2, text.replace(" ", ""))], "doc_id long, text string")
    got = {r.doc_id: r.ids for r in sentencepiece_scan.encoded(df, path, 64).collect()}
    for k, t in ((1, text), (2, text.replace(" ", ""))):
        assert np.frombuffer(bytes(got[k]), "<u4").tolist() == library.encode(t)
    assert sentencepiece_scan.encoded(df.limit(0), path, 64).count() == 0


def test_sentencepiece_merges_a_word_once_in_a_run_of_rows(library, monkeypatch):
    model = sentencepiece_scan.Model(sentencepiece_scan.default_path())
    many = [f"w{k} Straße{k % 7}  ☃{k % 5}日本 ▁x{'ab' * 40} \U0001f600" for k in range(300)]
    texts = ["", " ", "a ", " a", "  two  spaces ", "▁ ▁", "\t\n x", "퟿é", *many, *many]
    seen: list[int] = []
    merged = model.merged_words
    monkeypatch.setattr(model, "merged_words", lambda words: seen.append(len(words)) or merged(words))
    got = model.encode_words(pa.array([sentencepiece_scan.normalised(t) for t in texts]))
    ids = [np.frombuffer(g, "<u4") for g in got]
    assert [i.tolist() for i in ids] == [library.encode(t) for t in texts]
    assert [model.decode(i) for i in ids] == [library.decode(i.tolist()) for i in ids]
    assert len(seen) == 1 and seen[0] < 700
