"""Operator 3: personal data by fixed shapes, and more of it by bootstrapped contexts.

Base spans are the leftmost non-overlapping matches of four shapes. They are the seeds: the words around a span
induce lexical patterns (two words before; one before and one after; one before). Candidates are other spans that
look like an identifier of some kind. Patterns and instances (distinct values) form a graph, one edge per distinct
pair, on which Spark iterates: a pattern's score for a kind is the share of its instances that are of that kind,
smoothed, with a least number of distinct supporters; a candidate's confidence is one minus the product of what its
trusted patterns leave open. Candidates above the threshold are found identifiers wherever they occur. Nothing of
the graph reaches the driver.

Edge cases: a null or empty text has no spans and the digest of the empty string; spans of different kinds may
overlap; a base match that fails its check (address part over 255, wrong number of digits, bad check digit) is
dropped without another try inside it; found spans never overlap base spans; rows that are equal in doc_id and text
get equal results; a null doc_id is a value like any other; an empty table gives no row. All scans are linear in the
text: runs are matched whole, never from each of their positions.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from operator import or_

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import documents, fresh, query, row_key, table, written

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)
SETTLED = 1e-3  # the change of a candidate's confidence that ends the rounds
SUPPORT = 3  # distinct instances that a trusted pattern has at least
SMOOTHING = 1.0
TRUST, ACCEPT = 0.5, 0.8
BROADCAST_ROWS = 100_000
CONTEXT = 64  # characters on either side in which the words of a context are looked for

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL_BACK = re.compile(r"[A-Za-z0-9._%+-]*")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])+")
PLUS = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
AT = re.compile(r"@|[\[(] ?at ?[\])]", re.IGNORECASE)
GROUPED = re.compile(r"[0-9][0-9().\x20/-]*")
BOUNDS = (re.compile(r"/"), re.compile(r"\x20{2,}"))
GROUP = re.compile(r"[0-9]+")
UNBROKEN = re.compile(r"[^\x20]+")
GAP = 3  # most characters between two groups of digits of one number
COLONS = re.compile(r"[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){3,7}")
WORD = re.compile(r"[^\s]+")
STRIP = ".,;!?\"'"


def luhn(digits: str) -> bool:
    total = 0
    for k, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + k % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    at, end = text.find("@"), 0
    while at >= 0:
        if at >= end:
            local = LOCAL_BACK.match(text[end:at][::-1])
            domain = DOMAIN.match(text, at + 1)
            if local.end() and domain:
                yield at - local.end(), domain.end()
                end = domain.end()
            else:
                end = at + 1  # no local part holds this sign
        at = text.find("@", at + 1)


def addresses(text: str) -> Iterator[tuple[int, int]]:
    for run in DOTTED.finditer(text):
        parts = run[0].split(".")
        start = run.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            end = start + sum(map(len, four)) + 3
            if all(len(p := x.lstrip("0")) <= 3 and int(p or "0") <= 255 for x in four):
                yield start, end
            start = end + 1


def cards(text: str) -> Iterator[tuple[int, int]]:
    for run in DIGITS.finditer(text):
        if 14 <= run.end() - run.start() <= 37:
            digits = run[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                yield run.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    for run in PLUS.finditer(text):
        if 10 <= sum(c.isdigit() for c in run[0]) <= 15:
            yield run.span()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of all base spans, in order."""
    found: list[tuple[int, int, int]] = []
    for kind, search in ((EMAIL, emails), (IP, addresses), (CARD, cards), (PHONE, phones)):
        found += [(start, kind, end) for start, end in search(text)]
    return sorted(found)


def _kinds(digits: int) -> int:
    return (7 <= digits <= 15) << PHONE | (12 <= digits <= 19) << CARD


def _dealt(sizes: list[int]) -> list[int]:
    """How many groups of digits make each number: the largest repeated unit of 7 to 19 digits, else 10 digits or more."""
    for unit in range(min(len(sizes) // 2, 19), 0, -1):
        if len(sizes) % unit == 0 and _kinds(sum(sizes[:unit])) and sizes == sizes[:unit] * (len(sizes) // unit):
            return [unit] * (len(sizes) // unit)
    found, held, digits = [], 0, 0
    for size in sizes:
        if held and digits + size > 19:
            found.append(held)
            held = digits = 0
        held, digits = held + 1, digits + size
        if digits >= 10:
            found.append(held)
            held = digits = 0
    return [*found, held] if held else found


def numbers(text: str, start: int, end: int) -> Iterator[tuple[int, int, int]]:
    """(start, end, kinds) of the numbers in a run of digits and marks.

    A run with too many digits or characters for one number is cut at slashes, at several blanks, at single blanks and
    at last at bounds of digit groups; at slashes and several blanks also where each part is a number of its own.
    """
    groups = [m.span() for m in GROUP.finditer(text, start, end)]
    if not groups:
        return
    start, end = groups[0][0], groups[-1][1]
    digits = sum(b - a for a, b in groups)
    fits = digits <= 19 and end - start <= 64
    if fits and not _kinds(digits):
        return
    for bound in BOUNDS:
        cuts = [m.span() for m in bound.finditer(text, start, end)]
        parts = list(zip([start, *[b for _, b in cuts]], [*[a for a, _ in cuts], end]))
        if cuts and (not fits or all(sum(c.isdigit() for c in text[a:b]) >= 7 for a, b in parts)):
            for a, b in parts:
                yield from numbers(text, a, b)
            return
    if fits:
        yield start, end, _kinds(digits)
        return
    words = [(m.start(), m.end()) for m in UNBROKEN.finditer(text, start, end)]
    if len(words) > 1 and all(sum(c.isdigit() for c in text[a:b]) >= 7 for a, b in words):
        for a, b in words:
            yield from numbers(text, a, b)
        return
    near: list[list[tuple[int, int]]] = []
    for group in groups:
        if not near or group[0] - near[-1][-1][1] > GAP:
            near.append([])
        near[-1].append(group)
    for some in near:
        at = 0
        sizes = [b - a for a, b in some]
        for n in _dealt(sizes) if sum(sizes) > 19 else [len(sizes)]:
            if kinds := _kinds(sum(sizes[at : at + n])):
                yield some[at][0], some[at + n - 1][1], kinds
            at += n


def candidate_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, end, kinds as a bit set) of what looks like an identifier outside the base spans."""
    found: list[tuple[int, int, int]] = []
    taken = sorted((s, e) for s, _, e in base)
    k = 0
    for run in GROUPED.finditer(text):
        at, stop = run.span()
        while k < len(taken) and taken[k][1] <= at:
            k += 1
        j = k
        while j < len(taken) and taken[j][0] < stop:  # base spans are cut out of the run
            found += numbers(text, at, taken[j][0])
            at = max(at, taken[j][1])
            j += 1
        found += numbers(text, at, stop)
        k = max(k, j - 1)
    if ":" in text:
        found += [(m.start(), m.end(), 1 << IP) for m in COLONS.finditer(text) if sum(c.isalnum() for c in m[0]) >= 4]
    past = 0  # no local part reaches over the mark before
    for mark in AT.finditer(text):
        start, end = mark.span()
        start -= start > past and text[start - 1] == " "
        end += text[end : end + 1] == " "
        before = LOCAL_BACK.match(text[past:start][::-1]).end()
        after = LOCAL_BACK.match(text, end).end() - end
        past = mark.end()
        if before and after:
            found.append((start - before, end + after, 1 << EMAIL))
    if not found:
        return []
    free: list[tuple[int, int, int]] = []
    k = last = 0  # base spans before k begin left of the candidate's end; last is the furthest of their ends
    for start, end, kinds in sorted(found):
        while k < len(taken) and taken[k][0] < end:
            last = max(last, taken[k][1])
            k += 1
        if last <= start and (not free or free[-1][1] <= start):
            free.append((start, end, kinds))
    return free


def patterns(text: str, start: int, end: int) -> list[str]:
    """The contexts of a span: the words beside it, in lower case and without marks at their ends."""
    left = [w.lower().strip(STRIP) for w in WORD.findall(text[max(0, start - CONTEXT) : start])[-2:]]
    right = [w.lower().strip(STRIP) for w in WORD.findall(text[end : end + CONTEXT])[:1]]
    found = []
    if len(left) == 2:
        found.append(f"{left[0]} {left[1]} _")
    if left and right:
        found.append(f"{left[-1]} _ {right[0]}")
    if left:
        found.append(f"{left[-1]} _")
    return found


SPAN = pa.struct([("start", pa.int64()), ("kind", pa.int64()), ("end", pa.int64())])
SEEN = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("seed", pa.int64()), ("kinds", pa.int64()), ("value", pa.string()), ("patterns", pa.list_(pa.string()))])
SCANNED = (
    "doc_id long, _key binary, base array<struct<start: long, kind: long, end: long>>, "
    "seen array<struct<start: long, end: long, seed: long, kinds: long, value: string, patterns: array<string>>>"
)


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and ``_key``, which tells rows apart by doc_id and text however often they are read."""
    rows = documents(docs)
    return rows.withColumn("_key", row_key(rows))


def scanned(docs: DataFrame) -> DataFrame:
    """Base spans of each document, and every seed or candidate seen in it with its contexts."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_base, all_seen = [], []
            for text in batch.column(1).to_pylist():
                base = base_spans(text)
                found = [(s, e, k, 1 << k) for s, k, e in base]
                found += [(s, e, None, kinds) for s, e, kinds in candidate_spans(text, base)]
                all_base.append([{"start": s, "kind": k, "end": e} for s, k, e in base])
                all_seen.append([
                    {"start": s, "end": e, "seed": seed, "kinds": kinds, "value": text[s:e].lower(), "patterns": patterns(text, s, e)}
                    for s, e, seed, kinds in found
                ])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(all_base, pa.list_(SPAN)), pa.array(all_seen, pa.list_(SEEN))],
                names=["doc_id", "_key", "base", "seen"],
            )

    return keyed(docs).mapInArrow(scan, SCANNED)


def discovered(seen: DataFrame, support: int = SUPPORT, trust: float = TRUST, accept: float = ACCEPT) -> DataFrame:
    """``value`` and ``kind`` of the candidates that trusted contexts make identifiers.

    Confidences only grow from round to round; rounds end when no acceptance changes and none moves by ``SETTLED``.
    """
    edges = written(
        seen.select("value", "seed", "kinds", F.explode("patterns").alias("pattern")).groupBy("pattern", "value").agg(
            F.max("seed").alias("seed"), F.bit_or("kinds").alias("kinds")
        ),
        "pii-edges",
    )
    none = [F.lit(0.0).alias(f"c{k}") for k in range(4)]
    believed = edges.where("seed is null").select("value").distinct().select("value", *none)
    best = F.greatest("c0", "c1", "c2", "c3")
    moving = True
    while moving:
        held = edges.join(believed, "value", "left")
        mass = [F.sum(F.when(F.col("seed") == k, 1.0).otherwise(F.coalesce(f"c{k}", F.lit(0.0)))) for k in range(4)]
        scored = held.groupBy("pattern").agg(*[m.alias(f"m{k}") for k, m in enumerate(mass)], F.count(F.lit(1)).alias("n"))
        trusted = scored.select("pattern", *[
            F.when((F.col(f"m{k}") >= support) & (F.col(f"m{k}") / (F.col("n") + SMOOTHING) >= trust), F.col(f"m{k}") / (F.col("n") + SMOOTHING))
            .otherwise(0.0).alias(f"s{k}")
            for k in range(4)
        ]).where("s0 + s1 + s2 + s3 > 0")
        open_ = edges.where("seed is null").join(trusted, "pattern").groupBy("value").agg(*[
            (1 - F.exp(F.sum(F.when(F.col("kinds").bitwiseAND(1 << k) > 0, F.log1p(-F.col(f"s{k}"))).otherwise(0.0)))).alias(f"c{k}")
            for k in range(4)
        ])
        before, believed = believed, written(open_, "pii-believed")
        was = before.select("value", *[F.col(f"c{k}").alias(f"b{k}") for k in range(4)])
        old = [F.coalesce(f"b{k}", F.lit(0.0)) for k in range(4)]
        moves = [F.abs(F.col(f"c{k}") - b) > SETTLED for k, b in enumerate(old)] + [(F.col(f"c{k}") >= accept) != (b >= accept) for k, b in enumerate(old)]
        moving = not believed.join(was, "value", "left").where(reduce(or_, moves)).isEmpty()
    kind = F.coalesce(*[F.when(F.col(f"c{k}") == best, k) for k in range(4)]).cast("long")
    return believed.where(best >= accept).select("value", kind.alias("kind"))


def found_spans(scan: DataFrame) -> DataFrame:
    """``_key`` and ``more``, the found spans of each document that has any."""
    seen = scan.select("_key", F.explode("seen").alias("s")).select("_key", "s.*")
    values = written(discovered(seen), "pii-found")
    return (
        seen.where("seed is null").join(values, "value").groupBy("_key")
        .agg(F.collect_set(F.struct("start", "kind", "end")).alias("more"))  # of one document
    )


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"].cast("int") + 1), s["start"], s["end"])), ","
    )


def _count(kind: int) -> Column:
    """Base spans of a kind."""
    return F.size(F.filter("base", lambda s: s["kind"] == kind))


def personal_data(docs: DataFrame) -> DataFrame:
    """Counts of base spans, their digest, and all spans of each document."""
    scan = written(scanned(docs), "pii-scan")
    rows = scan.drop("seen").join(found_spans(scan), "_key", "left")
    counts = [_count(k).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    more = F.coalesce("more", F.expr("array()").cast("array<struct<start: long, kind: long, end: long>>"))
    return rows.select(
        "doc_id", *counts, F.sha2(_joined(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        _joined(F.array_sort(F.concat("base", more))).alias("spans"), F.size(more).cast("long").alias("n_found"),
    )


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """``text`` with every span, or run of overlapping spans, replaced by its first kind in angle brackets."""
    parts, at = [], 0
    for start, kind, end in spans:
        if start >= at:
            parts += [text[at:start], f"<{KINDS[kind].upper()}>"]
        at = max(at, end)
    return "".join([*parts, text[at:]])


def redacted(docs: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``docs`` with all columns, spans masked in ``text`` and ``n_chars`` counted anew; null texts stay null."""
    found = written(found_spans(written(scanned(docs), "pii-scan")), "pii-spans")
    # found spans are few beside the texts: sent to the scan if counted so, else both sides are shuffled
    key, more = fresh(docs, "_key"), fresh(docs, "_more")
    small = found.select(F.col("_key").alias(key), F.col("more").alias(more))
    if found.limit(broadcast_rows + 1).count() <= broadcast_rows:
        small = F.broadcast(small)
    rows = docs.withColumn(key, row_key(docs)).join(small, key, "left").select(*[F.col(f"`{c}`") for c in docs.columns], more)
    names = docs.columns
    at, more_at = names.index("text"), len(names)

    def mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, more in zip(batch.column(at).to_pylist(), batch.column(more_at).to_pylist()):
                spans = [] if text is None else sorted(base_spans(text) + [(m["start"], m["kind"], m["end"]) for m in more or []])
                texts.append(masked(text, spans) if spans else text)
            columns = batch.columns
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns[:more_at] + columns[more_at + 1 :], names=names)

    done = rows.mapInArrow(mask, docs.schema)
    return done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else done


@query("op3_personal_data")
def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"))
