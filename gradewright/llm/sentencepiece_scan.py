"""Operator 1: SentencePiece encoding and decoding by a max-plus parallel scan over chunks.

The model file is of the BPE kind with byte fallback. Its encoding of a text is the one path through the lattice of
vocabulary pieces on which every two neighbours are the encoding of their own concatenation. That makes it a best
path: a step from piece ``p`` to piece ``t`` weighs 0 if ``encode(p + t)`` is ``[p, t]`` and minus infinity otherwise,
and from a given state at most one path of weight 0 reaches any position. Ids equal the library's.

A document longer than ``CHUNK`` characters is split at fixed places, wherever they fall. The state at a boundary is
the piece that covers the character before it. Each chunk gives the matrix of path weights from the states at its
left to those at its right; matrices are combined associatively in groups of ``FAN`` per document, level by level
(up), the best states at inner boundaries are chosen level by level (down), and every chunk is traced back by itself
from its two states. Only the matrices of one group meet in one task. Other documents are one chunk.

Pieces never hold a space sign behind another sign, so words are independent: the distinct words of a run of rows are
merged together, one merge of every word at a time, and only a word cut by a boundary is walked for each state.

Edge cases: a null or empty text has no ids and decodes to the empty text; signs outside the vocabulary become
bytes; the space sign of the model in a text decodes to a space, as the library has it; a null doc_id is carried;
rows that are equal give equal rows; an empty table gives no row.
"""

from __future__ import annotations

import functools
import struct
import sys
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import documents, query, table, written
from .tokens import gathered, runs, slices

CHUNK = 16_384
FAN = 64
MEMORY = 150_000  # pairs of pieces that a worker remembers
SHORT = 48  # characters of a word that is merged rather than walked
NEVER = float("-inf")
SPACE = "▁"
ROWS_AT_ONCE = 256
BYTES_AT_ONCE = 4 << 20  # of texts in a run of rows; their distinct words are merged together
WORDS_AT_ONCE = 20_000
IDS_AT_ONCE = 1 << 16
MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)  # odd multipliers of hashes

State = tuple[int, int]  # start and end of a piece, relative to a boundary


def _slot(keys: np.ndarray, bits: int, table: int) -> np.ndarray:
    return (keys.astype("u8") * np.uint64(MIX[table % len(MIX)]) >> np.uint64(64 - bits)).astype("i8")


class Model:
    """A model file as a table of pieces, and the weights of steps between them."""

    def __init__(self, path: str):
        import sentencepiece

        processor = sentencepiece.SentencePieceProcessor(model_file=path)
        size = processor.get_piece_size()
        plain = [i for i in range(size) if not (processor.is_control(i) or processor.is_unknown(i) or processor.is_byte(i))]
        self.number = {processor.id_to_piece(i): i for i in plain}
        self.score = {processor.id_to_piece(i): processor.get_score(i) for i in plain}
        self.longest = max(map(len, self.number))
        self.beginnings = {p[:k] for p in self.number for k in range(1, len(p) + 1)}
        self.bytes = [processor.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if any(SPACE in p.lstrip(SPACE) for p in self.number):
            raise ValueError("a piece holds a space sign behind another sign: words are not independent")
        if processor.encode(" a  b") != processor.encode(f"{SPACE}a{SPACE}{SPACE}b"):
            raise ValueError("the model normalises spaces")
        shown = [b""] * size
        for piece, i in self.number.items():
            shown[i] = piece.replace(SPACE, " ").encode()
        for b, i in enumerate(self.bytes):
            shown[i] = bytes([b])
        self.shown, self.shown_n = np.frombuffer(b"".join(shown), "u1"), np.array([len(x) for x in shown], "i8")
        self.shown_at = np.cumsum(self.shown_n) - self.shown_n
        self.pairs: dict[tuple[str, str], bool] = {}
        self._tables()

    def _tables(self) -> None:
        """The merges as arrays. A symbol is a piece's place in ``number``, or ``size`` and a code point if it is no piece."""
        names, size = list(self.number), len(self.number)
        place = dict(zip(names, range(size)))
        self.size, self.width = size, size + sys.maxunicode + 1
        self.signs = np.arange(size, self.width, dtype="i4")
        for name, at in place.items():
            if len(name) == 1:
                self.signs[ord(name)] = at
        known = lambda part: place.get(part, size + ord(part) if len(part) == 1 else None)
        pairs = [(known(name[:k]), known(name[k:]), at) for name, at in place.items() for k in range(1, len(name))]
        left, right, made = np.array([p for p in pairs if None not in p], "i8").reshape(-1, 3).T
        self.signs[ord(" ")] = self.signs[ord(SPACE)]
        # hash tables of places in ``keys``; a key that another has taken the slot of is in the next, smaller one
        self.keys, self.made, self.slots = np.append(left * self.width + right, -1), np.append(made, -1).astype("i4"), []
        left_out = np.arange(len(left))
        while len(left_out):
            bits = max(8, len(left_out).bit_length() + 4)
            slots, at = np.full(1 << bits, len(left), "i4"), _slot(self.keys[left_out], bits, len(self.slots))
            slots[at] = left_out
            left_out = left_out[slots[at] != left_out]
            self.slots.append((bits, slots))
        self.scores = np.array([*self.score.values(), NEVER])
        self.numbers = np.array([*self.number.values()], "u4")

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The symbol that two neighbours merge to; -1, whose score is minus infinity, if none."""
        keys = left.astype("i8") * self.width + right
        made, rest = np.full(keys.shape, -1, "i4"), None
        for k, (bits, slots) in enumerate(self.slots):
            some = keys if rest is None else keys[rest]
            at = slots[_slot(some, bits, k)]
            hit = self.keys[at] == some
            found = np.where(hit, self.made[at], np.int32(-1))
            if rest is None:
                made = found
            else:
                made[rest] = found
            other = ~hit & (at < len(self.keys) - 1)
            rest = np.nonzero(other) if rest is None else tuple(r[other] for r in rest)
            if not len(rest[0]):
                break
        return made

    def _merged_alike(self, parts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Words of one length, a row of symbols each, as :meth:`merged` has them: the places of the words that are
        done and their symbols. All words that are not done take their next merge at once, so their rows stay of one length."""
        place = np.arange(len(parts))
        fits = self._pairs(parts[:, :-1], parts[:, 1:])
        while True:
            at = self.scores[fits].argmax(axis=1) if fits.shape[1] else np.zeros(len(place), "i8")  # the leftmost of equals
            row = np.arange(len(place))
            go = fits[row, at] >= 0 if fits.shape[1] else np.zeros(len(place), bool)
            yield place[~go], parts[~go]
            if not go.any():
                return
            place, parts, fits, at, row = place[go], parts[go], fits[go], at[go], row[: go.sum()]
            parts[row, at] = fits[row, at]
            parts = parts[np.arange(parts.shape[1]) != at[:, None] + 1].reshape(len(place), parts.shape[1] - 1)
            fits = fits[np.arange(fits.shape[1]) != at[:, None]].reshape(len(place), fits.shape[1] - 1)
            behind, before = at < fits.shape[1], at > 0
            fits[row[behind], at[behind]] = self._pairs(parts[row[behind], at[behind]], parts[row[behind], at[behind] + 1])
            fits[row[before], at[before] - 1] = self._pairs(parts[row[before], at[before] - 1], parts[row[before], at[before]])

    def merged_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of distinct whole words, one after the other, with each word's start among them and its number."""
        # a whole word has no state at its left, so the best path is what merging gives; long ones are walked
        lengths = pc.utf8_length(words).to_numpy().astype("i8")
        signs = np.frombuffer("".join(words.to_pylist()).encode("utf-32-le"), "<u4")
        symbols, begins = self.signs[signs], np.cumsum(lengths) - lengths
        starts, counts, found, done = np.zeros(len(words), "i8"), np.zeros(len(words), "i8"), [], 0

        def add(at: np.ndarray, ids: np.ndarray, n: np.ndarray) -> None:
            nonlocal done
            starts[at], counts[at] = done + np.cumsum(n) - n, n
            found.append(ids)
            done += len(ids)

        for length in np.unique(lengths).tolist():
            alike = np.flatnonzero(lengths == length)
            if length > SHORT:
                for at in alike.tolist():
                    ids = self.ids(self.trace(words[at].as_py().replace(" ", SPACE), 0, None, length))
                    add(np.array([at]), np.frombuffer(ids, "<u4"), np.array([len(ids) // 4]))
                continue
            for k in range(0, len(alike), WORDS_AT_ONCE):
                some = alike[k : k + WORDS_AT_ONCE]
                for place, parts in self._merged_alike(symbols[begins[some][:, None] + np.arange(length)]):
                    add(some[place], *self._numbers(parts))
        return np.concatenate([np.zeros(0, "u4"), *found]), starts, counts

    def _numbers(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of rows of symbols and how many each row has; signs outside the vocabulary as their bytes."""
        strange = parts >= self.size
        if not strange.any():
            return self.numbers[parts].ravel(), np.full(len(parts), parts.shape[1], "i8")
        others, which = np.unique(parts[strange], return_inverse=True)
        spelt = [np.array([self.bytes[b] for b in chr(x - self.size).encode()], "u4") for x in others.tolist()]
        sizes = np.array([len(x) for x in spelt], "i8")
        n, at = np.ones(parts.shape, "i8"), parts.astype("i8")
        n[strange], at[strange] = sizes[which], len(self.numbers) + (np.cumsum(sizes) - sizes)[which]
        return gathered(np.concatenate([self.numbers, *spelt]), at.ravel(), n.ravel()), n.sum(axis=1)

    def merged(self, text: str) -> list[str]:
        """Pieces of a short text by merging: the best pair first, the leftmost of equals."""
        parts, score = list(text), self.score.get
        scores = [score(a + b, NEVER) for a, b in zip(parts, parts[1:])]
        while scores:
            best = max(scores)
            if best == NEVER:
                break
            at = scores.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del scores[at]
            if at < len(scores):
                scores[at] = score(parts[at] + parts[at + 1], NEVER)
            if at:
                scores[at - 1] = score(parts[at - 1] + parts[at], NEVER)
        return parts

    def step(self, before: str, piece: str) -> bool:
        """Whether the step weighs 0."""
        key = (before, piece)
        found = self.pairs.get(key)
        if found is None:
            found = self.merged(before + piece) == [before, piece]
            if len(self.pairs) >= MEMORY:
                self.pairs.clear()
            self.pairs[key] = found
        return found

    def walk(self, text: str, start: int, before: str | None, stop: int, goal: int = -1) -> dict[int, int]:
        """Ends of all pieces on paths of weight 0 from ``start`` up to the first end at or behind ``stop``, with
        their starts. The paths from one state to one end are one, so a start per end is the whole lattice, and the
        walk may end at ``goal`` once it gets there. Long pieces go first."""
        found: dict[int, int] = {}
        waiting, size, number, beginnings, pairs = [start], len(text), self.number, self.beginnings, self.pairs
        while waiting:
            at = waiting.pop()
            if at >= stop and at > start:
                continue
            last = before if at == start else text[found[at] : at]
            for end in range(at + 1, min(at + self.longest, size) + 1):
                piece = text[at:end]
                if piece not in beginnings and end > at + 1:
                    break  # no longer piece begins like this
                if end in found or (piece not in number and end > at + 1):
                    continue
                if last is not None:
                    fits = pairs.get((last, piece))
                    if not (self.step(last, piece) if fits is None else fits):
                        continue
                found[end] = at
                if end == goal:
                    return found
                waiting.append(end)
        return found

    def trace(self, text: str, start: int, before: str | None, stop: int, end: int | None = None) -> list[str]:
        """Pieces of the path of weight 0 from ``start`` to ``end`` (``stop`` unless given)."""
        if stop == start:
            return []
        at = stop if end is None else end
        found = self.walk(text, start, before, stop, at)
        pieces = []
        while at > start:
            pieces.append(text[found[at] : at])
            at = found[at]
        return pieces[::-1]

    def ids(self, pieces: list[str]) -> bytes:
        """Ids as little-endian unsigned 32-bit integers; signs outside the vocabulary as their bytes."""
        found: list[int] = []
        for piece in pieces:
            number = self.number.get(piece)
            if number is not None:
                found.append(number)
            else:
                found += [self.bytes[b] for b in piece.encode()]
        return struct.pack(f"<{len(found)}I", *found)

    def encode_words(self, texts: pa.Array) -> list[bytes]:
        """Ids of the whole words of each text whose spaces are as the model has them, plain or as its sign; a word that
        comes again is merged once."""
        lines = pc.replace_substring(texts.cast(pa.large_string()), SPACE, " ")
        cuts = np.concatenate([[0], np.cumsum(pc.binary_length(lines).to_numpy())])
        data = b"".join(lines.cast(pa.large_binary()).to_pylist())
        space = np.frombuffer(data, "u1") == ord(" ")
        first = space.copy()  # a word begins with its spaces, and with its text
        first[1:] &= ~space[:-1]
        first[cuts[:-1][np.diff(cuts) > 0]] = True
        begins = np.flatnonzero(first)
        offsets = pa.py_buffer(np.append(begins, len(data)).astype("i8"))
        coded = pa.Array.from_buffers(pa.large_string(), len(begins), [None, offsets, pa.py_buffer(data)]).dictionary_encode()
        at = coded.indices.to_numpy()
        ids, starts, counts = self.merged_words(coded.dictionary)
        flat = gathered(ids, starts[at], counts[at]).astype("<u4")
        ends = np.concatenate([[0], np.cumsum(counts[at])])[np.searchsorted(begins, cuts)].tolist()
        return [flat[a:b].tobytes() for a, b in zip(ends, ends[1:])]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; the space that encoding puts in front is taken off."""
        runs = (ids[k : k + IDS_AT_ONCE] for k in range(0, len(ids), IDS_AT_ONCE))
        shown = b"".join(gathered(self.shown, self.shown_at[i], self.shown_n[i]).tobytes() for i in runs)
        return shown.removeprefix(b" ").decode(errors="replace")

    def states(self, text: str, at: int) -> list[State]:
        """All pieces that cover the character before ``at``, by start and end relative to it."""
        return [
            (start - at, end - at)
            for start in range(max(0, at - self.longest), at)
            for end in range(at, min(start + self.longest, len(text)) + 1)
            if text[start:end] in self.number or (start, end) == (at - 1, at)
        ]


@functools.lru_cache(maxsize=2)
def model(path: str) -> Model:
    """One per Python worker and file."""
    return Model(path)


def normalised(text: str) -> str:
    return SPACE + text.replace(" ", SPACE) if text else ""


def _spaced(texts: pa.Array) -> pa.Array:
    """As :func:`normalised`, with plain spaces."""
    texts = texts.cast(pa.large_string())
    led = pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), texts, pa.scalar("", pa.large_string()))
    return pc.if_else(pc.equal(texts, ""), texts, led)


class Chunk:
    """Characters ``left`` to ``right`` of ``text``, which shows as much on either side as a piece may reach over."""

    def __init__(self, piece_model: Model, text: str, left: int, right: int, first: bool, last: bool):
        self.model, self.text, self.left, self.right = piece_model, text, left, right
        self.first, self.last = first, last
        # the first and the last word that begins inside
        head, tail = text.find(SPACE, left + 1, right), text.rfind(SPACE, left + 1, right)
        while head >= 0 and text[head - 1] == SPACE:
            head = text.find(SPACE, head + 1, right)
        while tail > head and text[tail - 1] == SPACE:
            tail -= 1
        self.head, self.tail = (head, tail) if head >= 0 else (None, None)

    def sides(self) -> tuple[list[State | None], list[State | None]]:
        """States at the left and at the right boundary; None stands for the start and the end of the document."""
        ins = [None] if self.first else self.model.states(self.text, self.left)
        outs = [None] if self.last else self.model.states(self.text, self.right)
        return ins, outs

    def _from(self, state: State | None, stop: int) -> tuple[int, str | None]:
        if state is None:
            return self.left, None
        start, end = self.left + state[0], self.left + state[1]
        return end, self.text[start:end]

    def _reached(self, at: int, before: str | None, outs: list[State | None]) -> list[bool]:
        found = self.model.walk(self.text, at, before, self.right)
        ends = [(self.right, None) if o is None else (self.right + o[1], self.right + o[0]) for o in outs]
        return [(at == end and start is None) or (end in found and (start is None or found[end] == start)) for end, start in ends]

    def matrix(self) -> np.ndarray:
        """Weights of the best paths between the states of both sides, as 0 (True) and minus infinity (False)."""
        ins, outs = self.sides()
        if self.head is None:
            return np.array([self._reached(*self._from(s, self.right), outs) for s in ins]).reshape(len(ins), len(outs))
        through = []
        for state in ins:  # a word ends at the first cut inside, so every path goes through it
            at, before = self._from(state, self.head)
            through.append(at == self.head or (at < self.head and self.head in self.model.walk(self.text, at, before, self.head)))
        return np.outer(through, self._reached(self.tail, None, outs)).astype(bool)

    def parts(self, state: State | None, out: State | None) -> tuple[bytes, str, bytes]:
        """The ids of the pieces behind ``state`` up to and with ``out``: those of the cut word in front, the text of
        the whole words, and those of the cut word behind."""
        at, before = self._from(state, self.right)
        end = self.right if out is None else self.right + out[1]
        if self.head is None:
            return self.model.ids(self.model.trace(self.text, at, before, self.right, end)), "", b""
        front = self.model.trace(self.text, at, before, self.head) if at < self.head else []
        behind = self.model.trace(self.text, self.tail, None, self.right, end)
        return self.model.ids(front), self.text[self.head : self.tail], self.model.ids(behind)


CHUNKS = "doc_id long, doc long, at long, n long, text string, left long, right long"


def chunked(docs: DataFrame, path: str, size: int = CHUNK) -> DataFrame:
    """Chunks of normalised texts: ``doc`` numbers the document, ``at`` its chunk, ``n`` its chunks."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reach = model(path).longest
        for batch in (part for whole in batches for part in slices(whole, most=BYTES_AT_ONCE)):
            rows: list[tuple] = []
            for doc_id, text, doc in zip(*(c.to_pylist() for c in batch.columns)):
                line = normalised(text)
                n = max(1, -(-len(line) // size))
                for at in range(n):
                    left, right = at * size, min((at + 1) * size, len(line))
                    begin = max(0, left - reach)
                    rows.append((doc_id, doc, at, n, line[begin : right + reach], left - begin, right - begin))
                    if len(rows) >= ROWS_AT_ONCE:
                        yield _batch(rows)
                        rows = []
            if rows:
                yield _batch(rows)

    return documents(docs).withColumn("doc", F.monotonically_increasing_id()).mapInArrow(cut, CHUNKS)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 4 + [pa.string()] + [pa.int64()] * 2
    names = ["doc_id", "doc", "at", "n", "text", "left", "right"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches in runs of few rows, so that what is made of them stays small."""
    for batch in batches:
        for k in range(0, batch.num_rows, ROWS_AT_ONCE):
            yield batch.slice(k, ROWS_AT_ONCE)


def _chunk(row: dict, path: str, size: int) -> Chunk:
    if size <= 2 * model(path).longest:
        raise ValueError("a chunk must be longer than two pieces")
    return Chunk(model(path), row["text"], row["left"], row["right"], row["at"] == 0, row["at"] == row["n"] - 1)


def _rows(of: dict[str, list], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_pydict(of, schema)


MATRIX = pa.schema([("doc", pa.int64()), ("at", pa.int64()), ("ins", pa.int64()), ("outs", pa.int64()), ("cells", pa.binary())])
CHOICE = pa.schema([("doc", pa.int64()), ("at", pa.int64()), ("i", pa.int64()), ("o", pa.int64())])
_MATRIX, _CHOICE = "doc long, at long, ins long, outs long, cells binary", "doc long, at long, i long, o long"


def _matrices(rows: list[dict]) -> list[np.ndarray]:
    return [np.frombuffer(r["cells"], bool).reshape(r["ins"], r["outs"]) for r in rows]


def combined(level: DataFrame) -> DataFrame:
    """The products of groups of ``FAN`` neighbouring matrices of a document."""

    def product(key: tuple, group: pa.Table) -> pa.Table:
        rows = group.sort_by("at").to_pylist()
        whole = functools.reduce(lambda a, b: a @ b, _matrices(rows))
        return _rows({"doc": [key[0].as_py()], "at": [key[1].as_py()], "ins": [whole.shape[0]], "outs": [whole.shape[1]], "cells": [whole.tobytes()]}, MATRIX)

    return level.withColumn("up", F.floor(F.col("at") / FAN)).groupBy("doc", "up").applyInArrow(product, _MATRIX)


def chosen(level: DataFrame, above: DataFrame) -> DataFrame:
    """States at both sides of each chunk of ``level``, given those of the groups of the level above."""

    def choose(key: tuple, matrices: pa.Table, choice: pa.Table) -> pa.Table:
        rows, (want,) = matrices.sort_by("at").to_pylist(), choice.to_pylist()
        factors = _matrices(rows)
        reach = [np.eye(factors[0].shape[0], dtype=bool)[want["i"]]]
        for m in factors:
            reach.append(reach[-1] @ m)
        path = [want["o"]]
        for m, seen in zip(reversed(factors), reversed(reach[:-1])):
            path.append(int(np.flatnonzero(seen & m[:, path[-1]])[0]))
        path.reverse()
        return _rows({"doc": [r["doc"] for r in rows], "at": [r["at"] for r in rows], "i": path[:-1], "o": path[1:]}, CHOICE)

    left = level.withColumn("up", F.floor(F.col("at") / FAN)).groupBy("doc", "up")
    right = above.withColumnRenamed("at", "up").groupBy("doc", "up")
    return left.cogroup(right).applyInArrow(choose, _CHOICE)


def scanned(chunks: DataFrame, path: str, size: int = CHUNK) -> DataFrame:
    """``chunks`` of long documents with the numbers of their states (``i``, ``o``), by an up and a down sweep."""

    def transfer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_chunk(row, path, size).matrix() for row in batch.to_pylist()]
            of = {"doc": batch["doc"].to_pylist(), "at": batch["at"].to_pylist(), "ins": [m.shape[0] for m in found], "outs": [m.shape[1] for m in found], "cells": [m.tobytes() for m in found]}
            yield from _rows(of, MATRIX).to_batches()

    levels = [written(chunks.mapInArrow(transfer, _MATRIX), "scan-matrices")]
    most = chunks.agg(F.max("n")).first()[0] or 0
    while most > 1:
        levels.append(written(combined(levels[-1]), "scan-products"))
        most = -(-most // FAN)
    picked = levels[-1].select("doc", "at", F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("o"))
    for level in reversed(levels[:-1]):
        picked = written(chosen(level, picked), "scan-choices")
    return chunks.join(picked, ["doc", "at"])


ENCODED = "doc_id long, doc long, at long, n long, ids binary"


def encoded(docs: DataFrame, path: str, size: int = CHUNK) -> DataFrame:
    """doc_id, n_chunks and ``ids`` (little-endian unsigned 32-bit integers) of each whole text."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in runs(batches, BYTES_AT_ONCE):
            ids = pa.array(model(path).encode_words(_spaced(batch["text"])), pa.binary())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(np.ones(len(ids), "i8")), ids], names=["doc_id", "n_chunks", "ids"])

    def traced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in runs(batches, BYTES_AT_ONCE):
            parts = []
            for row in batch.to_pylist():
                part = _chunk(row, path, size)
                ins, outs = part.sides()
                parts.append(part.parts(ins[row["i"]], outs[row["o"]]))
            whole = model(path).encode_words(pa.array([text for _, text, _ in parts], pa.large_string()))
            ids = [front + words + behind for (front, _, behind), words in zip(parts, whole)]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in ("doc_id", "doc", "at", "n")), pa.array(ids, pa.binary())], names=["doc_id", "doc", "at", "n", "ids"])

    texts, in_one = documents(docs), F.length("text") < size  # normalising puts one character in front
    short = texts.where(in_one).mapInArrow(whole, "doc_id long, n_chunks long, ids binary")
    long = written(chunked(texts.where(~in_one), path, size), "scan-chunks")
    spread = long.repartition(max(1, min(long.count() // 32, 10_000)))  # chunks of one document go to many tasks
    parts = scanned(spread, path, size).mapInArrow(traced, ENCODED)
    pieces = F.array_sort(F.collect_list(F.struct("at", "ids")))  # the ids of one text, which is one row itself
    joined = parts.groupBy("doc").agg(F.first("doc_id").alias("doc_id"), F.first("n").alias("n_chunks"), pieces.alias("parts"))
    ids = F.aggregate(F.transform("parts", lambda p: p["ids"]), F.lit(b""), lambda a, b: F.concat(a, b))
    return short.union(joined.select("doc_id", "n_chunks", ids.alias("ids")))


def decoded(ids: DataFrame, path: str) -> DataFrame:
    """doc_id, n_chunks, n_tokens, ids_crc32 and ``text`` of ``ids``."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            raw = batch["ids"].to_pylist()
            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc_id"], batch["n_chunks"], pa.array([len(b) // 4 for b in raw], pa.int64()),
                    pa.array([zlib.crc32(b) for b in raw], pa.int64()),
                    pa.array([model(path).decode(np.frombuffer(b, "<u4")) for b in raw], pa.string()),
                ],
                names=["doc_id", "n_chunks", "n_tokens", "ids_crc32", "text"],
            )

    return ids.mapInArrow(decode, "doc_id long, n_chunks long, n_tokens long, ids_crc32 long, text string")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@query("op1_sentencepiece")
def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text encoded and decoded again: number and digest of its ids, size and digest of the decoded text."""
    path = default_path()
    return decoded(encoded(table(spark, sf_dir, "documents"), path), path).select(
        "doc_id", "n_chunks", "n_tokens", "ids_crc32", F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )
