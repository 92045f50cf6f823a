"""A tokenizer file applied to batches of texts, each distinct word of a batch once.

The file's own steps cut at white space before anything else depends on it, so a text's ids are the ids of its
words in order. A batch's words become a dictionary (Arrow); its entries are encoded together; ids are gathered back
by position (numpy). A bounded memory keeps words from batch to batch. Words of Latin letters with ASCII marks behind them need no normalising but lower case, and go
through the model in one call for thousands; all other words go through the whole tokenizer one by one.
"""

from __future__ import annotations

import functools
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: ASCII marks that the file's word pattern cuts off behind a letter; the apostrophe may join and is not here.
MARKS = '.,!?;:*$%&#|()"'
#: Letters below U+0180 that are their own normal form and have a lower case of one letter.
LATIN = "^[A-Za-zÀ-ÖØ-öø-įıĴ-ľŁ-ňŊ-ž]*$"
#: Byte-level alphabet: bytes that have no visible sign of their own move up, in order.
UNSEEN = [*range(0x21), *range(0x7F, 0xA1), 0xAD]
BYTE_SIGNS = {b: chr(0x100 + k) for k, b in enumerate(UNSEEN) if b != 0x20}
SLICE_BYTES = 16 << 20
MEMORY = 1_000_000
WORDS_PER_CALL = 5_000


def gathered(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The runs ``data[s : s + n]`` one after the other."""
    ends = np.cumsum(lengths)
    return data[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)]


class BatchEncoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        file = json.loads(self.whole.to_str())
        suffix = file["model"]["end_of_word_suffix"]
        file |= {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "added_tokens": []}
        self.words = Tokenizer.from_str(json.dumps(file))
        self.ends = np.zeros(self.whole.get_vocab_size(with_added_tokens=True), bool)
        self.ends[[i for piece, i in file["model"]["vocab"].items() if piece.endswith(suffix)]] = True
        self.dtype = np.dtype("<u2" if len(self.ends) <= 1 << 16 else "<u4")
        self.memory: dict[str, int] = {}
        self.ids, self.counts, self.starts = (np.zeros(0, t) for t in (self.dtype, "i8", "i8"))

    def _units(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of single words, and how many each has: the last id of a word is one that ends words."""
        found = [np.zeros(0, self.dtype)]
        for k in range(0, len(units), WORDS_PER_CALL):
            call = " ".join(units[k : k + WORDS_PER_CALL])
            if not call.isascii():
                call = call.encode().decode("latin-1").translate(BYTE_SIGNS)
            found.append(np.array(self.words.encode_batch_fast([call], add_special_tokens=False)[0].ids, self.dtype))
        ids = np.concatenate(found)
        return ids, np.diff(np.flatnonzero(self.ends[ids]), prepend=-1)

    def _remembered(self, units: list[str]) -> np.ndarray:
        """The numbers of units in the memory, which starts anew once it holds more than ``MEMORY``."""
        if len(self.memory) > MEMORY:
            self.memory, self.ids, self.counts, self.starts = {}, *(np.zeros(0, t) for t in (self.dtype, "i8", "i8"))
        missing = [u for u in units if u not in self.memory]
        if missing:
            missing.sort(key=str.isascii)
            ids, counts = self._units(missing)
            self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(counts) - counts])
            self.ids, self.counts = np.concatenate([self.ids, ids]), np.concatenate([self.counts, counts])
            self.memory.update(zip(missing, range(len(self.memory), len(self.memory) + len(missing))))
        return np.fromiter(map(self.memory.__getitem__, units), np.int64, len(units))

    def _dictionary(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words, and how many each has."""
        base = pc.utf8_rtrim(words, MARKS)
        plain = pc.match_substring_regex(base, LATIN)
        odd = words.filter(pc.invert(plain)).to_pylist()
        size = pc.binary_length(base)
        marked = pc.greater(pc.binary_length(words), size).to_numpy(zero_copy_only=False)
        plain, has_base = plain.to_numpy(zero_copy_only=False), size.to_numpy() > 0
        front = pc.utf8_lower(base.filter(pa.array(plain & has_base))).dictionary_encode()
        behind = words.filter(pa.array(plain & marked)).to_pylist()
        sizes = size.to_numpy()[plain & marked]
        marks = pa.array([w.encode()[n:].decode() for w, n in zip(behind, sizes.tolist())], pa.large_string()).dictionary_encode()
        # all three kinds of parts by number: parts with a front, marks behind one, whole odd words
        numbers = self._remembered(front.dictionary.to_pylist() + marks.dictionary.to_pylist())
        odd_ids = [np.array(self.whole.encode(w, add_special_tokens=False).ids, self.dtype) for w in odd]
        data = np.concatenate([self.ids, *odd_ids])
        counts = np.concatenate([self.counts, np.array([len(x) for x in odd_ids], np.int64)])
        starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(counts[len(self.counts) :]) - counts[len(self.counts) :]])
        parts = np.full((len(words), 2), -1, np.int64)
        parts[plain & has_base, 0] = numbers[front.indices.to_numpy()]
        parts[plain & marked, 1] = numbers[len(front.dictionary) + marks.indices.to_numpy()]
        parts[~plain, 0] = len(self.counts) + np.arange(len(odd))
        per_part = np.where(parts >= 0, counts[parts], 0) if len(counts) else np.zeros(parts.shape, np.int64)
        at = parts[parts >= 0]
        return gathered(data, starts[at], counts[at]), per_part.sum(axis=1)

    def encode(self, texts: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids of whole texts in one array, ``end`` behind each if given, and the ``n + 1`` offsets of the texts."""
        split = pc.split_pattern(pc.replace_substring(texts.cast(pa.large_string()), "\n", " "), " ")
        coded = split.flatten().dictionary_encode()
        ids, counts = self._dictionary(coded.dictionary)
        at = coded.indices.to_numpy()
        lengths = counts[at]
        cut = split.offsets.to_numpy()
        ends = np.concatenate([[0], np.cumsum(lengths)])[cut - cut[0]]
        found = gathered(ids, (np.cumsum(counts) - counts)[at], lengths)
        if end is None:
            return found, ends
        return np.insert(found, ends[1:], end), ends + np.arange(len(ends))


def slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """A batch in runs of rows whose texts hold about ``most`` bytes; a longer text is a run of its own."""
    sizes = np.cumsum(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False))
    start = 0
    while start < batch.num_rows:
        before = sizes[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(sizes, before + most, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def runs(batches: Iterator[pa.RecordBatch], most: int, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Rows in runs of about ``most`` bytes of text (less than twice that, or one text), over the borders of batches."""
    waiting, held = [], 0
    for batch in (part for whole in batches for part in slices(whole, column, most)):
        waiting.append(batch)
        held += batch.column(column).nbytes
        if held >= most:
            yield pa.concat_batches(waiting)
            waiting, held = [], 0
    if waiting:
        yield pa.concat_batches(waiting)


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> BatchEncoder:
    """One per Python worker and file, kept between tasks."""
    return BatchEncoder(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
