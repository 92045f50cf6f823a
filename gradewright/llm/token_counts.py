"""Operator 13: token counts by a compiled finite-state transducer, chunk by chunk.

The tokenizer file is compiled into a deterministic transducer over the characters of a normalised text. Its states say
where in the file's word pattern a text stands (between words, in a run of letters, in a run of other signs, behind an
apostrophe) and, inside a word, what byte-pair encoding has to know: for each suffix of the word that may still grow into a
longer token, the last token of the encoding up to where that suffix starts, and how many tokens fewer that is. A
prefix's encoding is that of a shorter prefix and one more token, the one that stays apart from the token before it,
so the next state follows from these alone. Each transition is annotated with the tokens it adds (a count may also fall, when two tokens merge).
States and transitions are compiled when first met and kept, within a bound; the way from a blank to the next is
kept as one transition for each word.

Long texts are cut into chunks, read in parallel. A chunk's state map gives for entry states the exit state and the
tokens between. Behind a blank the entry can only be the start, so that is where chunks are cut if they have one. A chunk
without any blank is cut inside a word; its map has the states that the text before the cut leads to from several starts.
Maps of neighbouring chunks compose, which is associative: ``FAN`` neighbours become one map, level by level, in
groups of bounded size. If a chunk is entered by a state that its map lacks, it is read again from that state
and the maps are composed anew, until none is missing; so counts are exact whatever the guesses were.

Edge cases: a null or empty text has 0 tokens; the file's special strings count one token wherever they stand; rows
that share a doc_id, or are equal, each get a row; an empty table gives no row. Other columns are not read.
"""

from __future__ import annotations

import functools
import gc
import json
import os
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import documents, query, table, written
from .tokens import default_path, slices

CHUNK = 1 << 16  # characters
FAN = 64
LIMIT = 2_048
KEPT_WORDS = 300_000
KEPT_STATES = 200_000
KEPT_PAIRS = 500_000
GUESS = 192  # characters before a cut inside a word
BLANKS = " \t\n\v\f\r"
BLANK = re.compile("[ \t-\r]")
#: Texts of letters below U+0180 that are their own normal form and have a lower case of one letter, and of ASCII.
PLAIN = re.compile("[\x00-\x7fÀ-ÖØ-öø-įıĴ-ľŁ-ňŊ-ž]*")
WORD_START = ((None, 0),)
NEVER = 1 << 60
MARKS = '.,!?;:*$%&#|()"'  # ASCII signs that are neither letters nor digits; the apostrophe may join
MAP = "key long, chunk long, entry string, exit string, n long, stuck_chunk long, stuck_state string"
CHUNKS = "key long, doc_id long, n_bytes long, chunk long, n_chunks long, n long, fresh boolean, last boolean, before string, text string"


@functools.cache
def _seconds() -> frozenset[int]:
    """Characters that normalising may join to the one before them."""
    found = {*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)}  # Hangul vowels and finals
    for point in range(0x110000):
        parts = unicodedata.decomposition(chr(point)).split()
        if len(parts) == 2 and not parts[0].startswith("<"):
            found.add(int(parts[1], 16))
    return frozenset(found)


def _parts(character: str) -> bool:
    """Whether a text may be cut before this character without changing how either side is normalised."""
    return character < "\x80" or (unicodedata.combining(character) == 0 and ord(character) not in _seconds())


class State:
    """A state of the transducer: the word pattern's mode, the last sign of a word, which is not yet fed, the suffix of
    the fed signs that may still grow, and for each place in it from which it may: (token before it, tokens fewer)."""

    __slots__ = ("parts", "arcs")

    def __init__(self, parts: tuple):
        self.parts = parts
        self.arcs: dict[str, tuple[State, int]] = {}

    def name(self) -> str:
        return json.dumps(self.parts)


class Transducer:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        library = Tokenizer.from_file(path)
        file = json.loads(library.to_str())
        model = file["model"]
        self.normalise, self.words_of = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        self.ranks = {tuple(pair): rank for rank, pair in enumerate(model["merges"])}
        self.merge_of = {a + b: ((a, b), rank) for (a, b), rank in self.ranks.items()}
        self.edges: tuple[dict, dict] = ({}, {})
        self.end = model["end_of_word_suffix"]
        self.vocabulary = frozenset(model["vocab"])
        self.prefixes = frozenset(t[:k] for t in (v.removesuffix(self.end) for v in model["vocab"]) for k in range(len(t)))
        specials = [t["content"] for t in file["added_tokens"]]
        self.special, self.reach = re.compile("|".join(map(re.escape, specials)) or "(?!)"), max(map(len, specials), default=0)
        self.specials_start_so = all("<" in special for special in specials)
        signs = ByteLevel(add_prefix_space=False, use_regex=False)
        self.signs_of = functools.lru_cache(100_000)(lambda c: signs.pre_tokenize_str(c)[0][0])
        self.kind = functools.lru_cache(100_000)(self._kind)
        self.pairs: dict[tuple[str | None, str], bool] = {}
        self._forget()
        self.counts: dict[bytes, int] = {}
        self.older: dict[bytes, int] = {}
        self.cores: dict[str, int] = {}
        self.older_cores: dict[str, int] = {}
        self.marks = functools.lru_cache(10_000)(lambda marks: self._word(marks))

    def _forget(self) -> None:
        self.states = self.start = None
        gc.collect()  # states point to each other
        self.start, self.nodes = State(("start", "", "", WORD_START)), {}
        self.states = {self.start.parts: self.start}

    def _kind(self, character: str) -> str:
        """What the word pattern takes a normalised character for."""
        if len(self.words_of("a" + character)) == 1 and not character.isspace():
            return "letter"
        if character.isspace() and not self.words_of(character):
            return "blank"
        return "other" if len(self.words_of("!" + character)) == 1 else "digit"

    def state(self, mode: str, held: str = "", suffix: str = "", places: tuple = WORD_START) -> State:
        """The one state object of these parts; beyond the bound the compiled ones are forgotten."""
        parts = (mode, held, suffix, places)
        known = self.states.get(parts)
        if known is None:
            if len(self.states) > KEPT_STATES:
                self._forget()
                if mode == "start":
                    return self.start
            known = self.states[parts] = State(parts)
        return known

    def named(self, name: str) -> State:
        mode, held, suffix, places = json.loads(name)
        return self.state(mode, held, suffix, tuple(map(tuple, places)))

    def apart(self, left: str | None, right: str) -> bool:
        """Whether two tokens side by side are the encoding of their signs (for no left one: whether one token is)."""
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) > KEPT_PAIRS:
                self.pairs.clear()
            if left is None:
                signs = list(right.removesuffix(self.end))
                if right.endswith(self.end):
                    signs[-1] += self.end
                known = self._merged(signs) == [right]
            else:
                known = self.apart(None, right) and self._never_meet(left, right)
            self.pairs[left, right] = known
        return known

    def _edge(self, token: str, side: int) -> list[tuple[str, int]]:
        """The parts of a token that stand at its left (0) or right (1) edge while it is merged, smallest first, each
        with the rank of the merge that ends it."""
        known = self.edges[side].get(token)
        if known is None:
            known, part, rank = [], token, NEVER
            while True:
                known.append((part, rank))
                if part not in self.merge_of:
                    break
                two, rank = self.merge_of[part]
                part = two[side]
            self.edges[side][token] = known = known[::-1]
        return known

    def _never_meet(self, left: str, right: str) -> bool:
        """Whether no merge over the border between two tokens comes before the parts at it have grown on."""
        ours, theirs, i, j = self._edge(left, 1), self._edge(right, 0), 0, 0
        while True:
            (a, a_ends), (b, b_ends) = ours[i], theirs[j]
            across = self.ranks.get((a, b), NEVER)
            if across < a_ends and across <= b_ends and across < NEVER:  # of equal merges the left one comes first
                return False
            if a_ends == b_ends == NEVER:
                return True
            if a_ends <= b_ends:
                i += 1
            else:
                j += 1

    def _merged(self, parts: list[str]) -> list[str]:
        while len(parts) > 1:
            best = min(zip(parts, parts[1:]), key=lambda p: self.ranks.get(p, len(self.ranks)))
            if best not in self.ranks:
                break
            joined, k = [], 0
            while k < len(parts):
                two = k + 1 < len(parts) and (parts[k], parts[k + 1]) == best
                joined.append(parts[k] + parts[k + 1] if two else parts[k])
                k += 2 if two else 1
            parts = joined
        return parts

    def _node(self, whole: str, last: bool) -> tuple[tuple, tuple, str]:
        """What follows from the last signs of a word alone: the tokens that may end there, longest first, with the place
        each starts from, the places that may still grow, and the signs from the first of these on."""
        starts = [k for k in range(len(whole)) if whole[k:-1] in self.prefixes]  # as kept when the sign before came
        ending = self.end if last else ""
        tokens = tuple((i, whole[k:] + ending) for i, k in enumerate(starts) if whole[k:] + ending in self.vocabulary)
        kept = tuple(i for i, k in enumerate(starts) if whole[k:] in self.prefixes)
        node = self.nodes[whole, last] = (tokens, kept, whole[starts[kept[0]] :] if kept else "")
        return node

    def _fed(self, suffix: str, places: tuple, sign: str, last: bool = False) -> tuple[str, tuple, int]:
        """The suffix and places behind one sign more, and the tokens it adds."""
        pairs, whole = self.pairs, suffix + sign
        tokens, kept, grown = self.nodes.get((whole, last)) or self._node(whole, last)
        for i, token in tokens:  # one of them is the last token
            before, fewer = places[i]
            apart = pairs.get((before, token))
            if self.apart(before, token) if apart is None else apart:
                break
        else:
            raise ValueError(f"no token ends behind {whole!r}")
        added = 1 - fewer
        if last:
            return "", WORD_START, added
        if added:
            return grown, (*[(places[i][0], places[i][1] + added) for i in kept], (token, 0)), added
        return grown, (*[places[i] for i in kept], (token, 0)), added

    def _word(self, signs: str) -> int:
        """Tokens of a whole word."""
        suffix, places, n = "", WORD_START, 0
        for k, sign in enumerate(signs):
            suffix, places, added = self._fed(suffix, places, sign, k == len(signs) - 1)
            n += added
        return n

    def _held(self, mode: str, signs: str, suffix: str = "", places: tuple = WORD_START) -> tuple[State, int]:
        """Feed all signs but the last, which is held until it is known whether the word ends with it."""
        n = 0
        for sign in signs[:-1]:
            suffix, places, added = self._fed(suffix, places, sign)
            n += added
        return self.state(mode, signs[-1], suffix, places), n

    def finish(self, state: State) -> int:
        """The tokens that the end of the text adds."""
        mode, held, suffix, places = state.parts
        if mode == "start":
            return 0
        if mode in ("letter", "other"):
            return self._fed(suffix, places, held, True)[2]
        return self._word("'") + (self._word(held) if mode == "mark+" else 0)

    def _arc(self, state: State, character: str) -> tuple[State, int]:
        kind, (mode, held, suffix, places) = self.kind(character), state.parts
        if mode == "start":
            signs = self.signs_of(character)
            if kind == "blank":
                return self.start, 0
            if kind == "digit":
                return self.start, self._word(signs)
            return (self.state("mark"), 0) if character == "'" else self._held(kind, signs)
        if mode == kind:
            return self._held(kind, held + self.signs_of(character), suffix, places)
        if mode == "mark":  # an apostrophe that starts a word
            if character in "stmd":
                return self.start, self._word("'" + character)
            if character in "rvl":
                return self.state("mark+", character), 0
            if kind == "other":
                return self._held(kind, "'" + self.signs_of(character))
        if mode == "mark+":
            if character == ("l" if held == "l" else "e"):
                return self.start, self._word("'" + held + character)
            n = self._word("'")
            next_state, more = self._held("letter", held)
            last_state, rest = self.step(next_state, character)
            return last_state, n + more + rest
        n = self.finish(state)
        next_state, more = self.step(self.start, character)
        return next_state, n + more

    def step(self, state: State, character: str) -> tuple[State, int]:
        arc = state.arcs.get(character)
        if arc is None:
            arc = state.arcs[character] = self._arc(state, character)
        return arc

    def run(self, state: State, text: str) -> tuple[State, int]:
        """Through a raw text without special strings."""
        n = 0
        for character in text.lower() if PLAIN.fullmatch(text) else self.normalise(text):
            arc = state.arcs.get(character)
            if arc is None:
                arc = state.arcs[character] = self._arc(state, character)
            state, added = arc
            n += added
        return state, n

    def through(self, state: State, text: str) -> tuple[State, int]:
        """Through a raw text without blanks, which may have special strings."""
        n = 0
        if "<" not in text and self.specials_start_so:
            return self.run(state, text)
        for k, part in enumerate(self.special.split(text)):
            if k:
                n, state = n + self.finish(state) + 1, self.start
            state, added = self.run(state, part)
            n += added
        return state, n

    def count(self, text: bytes) -> int:
        """Tokens of a text in UTF-8 from the start to its end."""
        words, counts = text.split(), self.counts
        for word in set(words).difference(counts):
            n = self.older.get(word)
            counts[word] = self._whole(word.decode()) if n is None else n
        total = sum(map(counts.__getitem__, words))
        if len(counts) > KEPT_WORDS:
            self.counts, self.older = {}, counts
        if len(self.cores) > KEPT_WORDS:
            self.cores, self.older_cores = {}, self.cores
        return total

    def _whole(self, word: str) -> int:
        """Tokens between two blanks. Marks behind a letter or digit are a word of their own, so what stands before
        them is kept as a transition too, in lower case."""
        if PLAIN.fullmatch(word) and "<" not in word:
            word = word.lower()
            core = word.rstrip(MARKS)
            if core and core[-1].isalnum():
                n = self.cores.get(core)
                if n is None:
                    n = self.older_cores.get(core)
                    if n is None:
                        state, n = self.run(self.start, core)
                        n += self.finish(state)
                    self.cores[core] = n
                return n + (self.marks(word[len(core) :]) if len(core) < len(word) else 0)
        state, n = self.through(self.start, word)
        return n + self.finish(state)

    def chunk(self, state: State, text: str, last: bool) -> tuple[State, int]:
        """Through one chunk; the last one of a text ends it."""
        first = BLANK.search(text)
        if first is None:
            state, n = self.through(state, text)
        else:
            tail = max(text.rfind(b) for b in BLANKS)
            state, n = self.through(state, text[: first.start()])
            n += self.finish(state) + self.count(text[first.start() : tail].encode())
            state, added = self.through(self.start, text[tail + 1 :])
            n += added
        return (self.start, n + self.finish(state)) if last else (state, n)

    def guesses(self, before: str) -> list[State]:
        """States that the text before a cut leads to, from some places in it on."""
        before = self.special.split(before)[-1]
        starts = range(min(len(before), GUESS // 4) + 1)
        return list({s.name(): s for s in (self.run(self.start, before[k:])[0] for k in starts)}.values())


def cuts(text: str, special: re.Pattern, reach: int, size: int) -> Iterator[tuple[int, int]]:
    """Bounds of chunks: behind the last blank that fits, else where neither a special string (of at most ``reach``
    characters) nor a normal form is cut."""
    start = 0
    while len(text) - start > size:
        stop = max(text.rfind(b, start, start + size) for b in BLANKS) + 1
        if stop <= start:
            stop = start + size
            inside = [m for m in special.finditer(text, max(start, stop - reach), stop + reach) if m.start() < stop < m.end()]
            stop = inside[0].end() if inside else stop
            while stop < len(text) and not _parts(text[stop]):
                stop += 1
        yield start, stop
        start = stop
    if start < len(text) or not text:
        yield start, len(text)


@functools.lru_cache(maxsize=2)
def transducer(path: str) -> Transducer:
    """One per Python worker and file, kept between tasks."""
    return Transducer(path)


def chunks(docs: DataFrame, path: str, size: int = CHUNK) -> DataFrame:
    """One row per chunk; texts of one chunk are counted at once (``n``) and not handed on."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # it would go through all compiled states time and again; what is forgotten is collected then
        try:
            yield from rows_of(batches)
        finally:
            gc.enable()

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, key = transducer(path), TaskContext.get().partitionId() << 40
        names = [c.split()[0] for c in CHUNKS.split(", ")]
        types = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
        schema = pa.schema([(n, types[c.split()[1]]) for n, c in zip(names, CHUNKS.split(", "))])
        for batch in (part for whole in batches for part in slices(whole)):
            rows = []
            for doc_id, raw in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                key += 1
                if len(raw) <= size:
                    rows.append((key, doc_id, len(raw), 0, 1, machine.count(raw), True, True, None, None))
                    continue
                text = raw.decode()
                bounds = list(cuts(text, machine.special, machine.reach, size))
                for k, (a, b) in enumerate(bounds):
                    fresh = a == 0 or text[a - 1] in BLANKS
                    before = None if fresh else text[max(0, a - GUESS) : a]
                    rows.append((key, doc_id, len(raw), k, len(bounds), None, fresh, b == len(text), before, text[a:b]))
                    if len(rows) >= 256:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
                        rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    return documents(docs).mapInArrow(cut, CHUNKS)


def _mapped(found: DataFrame, path: str) -> DataFrame:
    """State maps of chunks; with a column ``entry`` of that state alone, else of the start or of the guesses."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        machine = transducer(path)
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                if r.entry is not None:
                    entries = [machine.named(r.entry)]
                else:
                    entries = [machine.start] if r.fresh else machine.guesses(r.before)
                for entry in entries:
                    name = entry.name()
                    leaving, n = machine.chunk(entry, r.text, r.last)
                    rows.append((r.key, r.chunk, name, leaving.name(), n, None, None))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in MAP.split(", ")])

    # texts are dealt one by one, so a batch holds few of them
    return found.select("key", "chunk", "fresh", "last", "before", "text", "entry").mapInPandas(read, MAP)


def _composed(maps: DataFrame, fan: int) -> DataFrame:
    """Maps of ``fan`` neighbours as one; an entry that a later map lacks is stuck there."""

    def compose(group: pd.DataFrame) -> pd.DataFrame:
        steps: dict[int, dict[str, tuple]] = {}
        for r in group.itertuples(index=False):
            steps.setdefault(r.chunk, {})[r.entry] = (r.exit, r.n, r.stuck_chunk, r.stuck_state)
        order = sorted(steps)
        rows = []
        for entry in steps[order[0]]:
            state, total, stuck = entry, 0, (None, None)
            for k in order:
                if state not in steps[k]:
                    stuck = (group["first"].iloc[0] if k == order[0] else int(group.loc[group["chunk"] == k, "first"].iloc[0]), state)
                    break
                state, n, *where = steps[k][state]
                total += n
                if where[1] is not None:
                    stuck = (int(where[0]), where[1])
                    break
            rows.append((group["key"].iloc[0], order[0] // fan, entry, state, total, *stuck, group["first"].min()))
        return pd.DataFrame(rows, columns=[*(c.split()[0] for c in MAP.split(", ")), "first"])

    above = maps.groupBy("key", F.floor(F.col("chunk") / fan).alias("_up"))
    return above.applyInPandas(compose, f"{MAP}, first long")


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT, size: int = CHUNK, fan: int = FAN) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row of ``docs``."""
    found = written(chunks(docs, path, size), "token-chunks")
    short = found.where("n is not null").select("doc_id", "n_bytes", F.col("n").alias("n_tokens"))
    long = found.where("n is null")
    most = long.agg(F.max("n_chunks")).first()[0] or 0
    sums = short
    if most:
        dealt = long.withColumn("entry", F.lit(None).cast("string")).repartition("key", "chunk")
        maps = written(_mapped(dealt, path), "token-maps")
        while True:
            level, k = maps.withColumn("first", F.col("chunk")), most
            while k > 1:
                level, k = written(_composed(level, fan), "token-scan"), -(-k // fan)
            stuck = level.where("stuck_state is not null").select(
                "key", F.col("stuck_chunk").alias("chunk"), F.col("stuck_state").alias("entry")
            )
            if stuck.isEmpty():
                break
            again = long.join(stuck, ["key", "chunk"]).repartition("key", "chunk")
            maps = maps.union(written(_mapped(again, path), "token-maps"))
        heads = long.where("chunk = 0").select("key", "doc_id", "n_bytes")
        sums = short.unionByName(heads.join(level.select("key", F.col("n").alias("n_tokens")), "key").drop("key"))
    return sums.withColumn("over_limit", F.col("n_tokens") > limit)


@query("op13_token_counts")
def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), default_path())
