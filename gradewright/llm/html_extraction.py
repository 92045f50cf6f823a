"""Operator 8: main text of web pages by a linear-chain conditional random field over leaf blocks.

A page becomes its leaf blocks: runs of text between block-level tags, each with the tags and names (class, id, role)
of its ancestors. A block's features are those and a few of its text. A linear-chain model over the labels
boilerplate and content scores each block and each pair of neighbours; Viterbi decodes a page. Scripts, styles,
forms' controls and the head never become blocks.

Training: pages whose own markup says where the article is label themselves. A page with exactly one ``article`` or
``main`` element (or ``itemprop=articleBody``) is a labelled page: blocks in it are content unless they are in a part
that names itself as something else (navigation, header or footer of a page, aside, advert, form, comments, notice).
``TRAINING_PAGES`` different labelled pages, chosen by a hash of their html, train the model (a documented bound; labelled rows
only fit weights, every page is decoded). For half of them, by the same hash, the marks of the article itself are
hidden, so that the model also learns from text and neighbours and works on pages without such marks. Built-in
examples of each kind of part are always added, so that parts that no page of the corpus has are known. Training
follows the gradient of the labels' log-likelihood (forward-backward), with steps that shrink per weight.

Edge cases: a null or empty page has the empty text; a page without content blocks too; unclosed and stray tags
are allowed; very long pages are read in one pass; null ids and urls are carried; repeated rows each give a row; an
empty table gives no row.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import query, ship, table

TRAINING_PAGES = 400
EPOCHS = 10
STEP, DECAY = 0.5, 1e-4
#: Elements that start and end a block of text.
BLOCKS = frozenset(
    "address article aside blockquote body br button center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead "
    "tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Elements whose text is no part of a page's text.
SILENT = frozenset("head script style noscript template textarea select button svg iframe object canvas title option".split())
#: An open element that a new one of the named kind closes.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: What ends a paragraph that was left open.
ENDS_P = BLOCKS - {"br", "body", "html", "button", "option"}
ARTICLE = {"article", "main", "itemprop=articlebody", "role=main"}
#: Parts inside or beside an article that name themselves as something else.
OTHER_TAGS = {"nav", "aside", "footer", "form", "dialog", "menu"}
OTHER_WORDS = frozenset(
    "ad ads adv advert advertisement advertising banner breadcrumb breadcrumbs byline comment comments consent cookie cookies "
    "copyright disclaimer discussion footer gdpr header login masthead menu modal nav navbar navigation newsletter notice "
    "pagination pager popup promo promoted recommended related replies reply respond share sharing sidebar signup skip social "
    "sponsor sponsored subscribe tags toolbar topbar widget".split()
)
OWN_WORDS = frozenset("article body content entry main post story text".split())
WORDS = re.compile(r"[a-z]+")
SPACE = re.compile(r"\s+")


@dataclass
class Block:
    """One leaf block: its text, the tags around it from the outside in, the names they carry, and how much is linked."""

    text: str
    tags: tuple[str, ...]
    names: tuple[frozenset[str], ...]
    linked: int = 0


@dataclass
class _Open:
    tag: str
    names: frozenset[str]


class Leaves(HTMLParser):
    """Collects the leaf blocks of one page."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[_Open] = []
        self.blocks: list[Block] = []
        self.parts: list[str] = []
        self.linked = self.silent = self.links = 0

    def flush(self) -> None:
        text = SPACE.sub(" ", "".join(self.parts)).strip()
        if text:
            tags, names = tuple(o.tag for o in self.stack), tuple(o.names for o in self.stack)
            self.blocks.append(Block(text, tags, names, self.linked))
        self.parts, self.linked = [], 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "body" and self.silent:
            self._leave("head")
        if tag in ENDS_P and not self.silent:
            self._leave("p", until=BLOCKS - {"p"})
        for other in CLOSES.get(tag, ()):
            self._leave(other, until={"ul", "ol", "dl", "table", "menu", "select"})
        if tag in BLOCKS:
            self.flush()
        if tag in VOID:
            return
        names: set[str] = set()
        for key, value in attrs:
            value = (value or "").lower()
            if key in ("class", "id", "role", "aria-label"):
                names.update(WORDS.findall(value))
            if key in ("role", "itemprop"):
                names.add(f"{key}={value}")
            if key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and "display:none" in value.replace(" ", "")):
                names.add("=hidden")
        self.stack.append(_Open(tag, frozenset(names)))
        self.silent += tag in SILENT
        self.links += tag == "a"

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self.flush()
        self._leave(tag)

    def _leave(self, tag: str, until: Iterable[str] = ()) -> None:
        """Close the innermost open ``tag`` and all inside it; nothing if there is none before ``until``."""
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k].tag == tag:
                if any(o.tag in BLOCKS for o in self.stack[k:]):
                    self.flush()
                for o in self.stack[k:]:
                    self.silent -= o.tag in SILENT
                    self.links -= o.tag == "a"
                del self.stack[k:]
                return
            if self.stack[k].tag in until:
                return

    def handle_data(self, data: str) -> None:
        if not self.silent:
            self.parts.append(data)
            if self.links:
                self.linked += len(data)


def leaf_blocks(html: str) -> list[Block]:
    parser = Leaves()
    parser.feed(html)
    parser.close()
    parser.flush()
    return parser.blocks


def _marked(block: Block) -> int:
    """Place of the outermost element that says it is the article, -1 if there is none."""
    for k, (tag, names) in enumerate(zip(block.tags, block.names)):
        if tag in ARTICLE or names & ARTICLE:
            return k
    return -1


def _other(block: Block, start: int) -> bool:
    """Whether an element from place ``start`` on names itself as something else than the article's text."""
    return any(t in OTHER_TAGS or n & OTHER_WORDS or "=hidden" in n for t, n in zip(block.tags[start:], block.names[start:]))


def own_labels(blocks: list[Block]) -> list[bool] | None:
    """Labels from the page's own marks; None where it has none."""
    places = [_marked(b) for b in blocks]
    if all(p < 0 for p in places):
        return None
    return [p >= 0 and not _other(b, p + 1) and not _other(b, 0) for b, p in zip(blocks, places)]


def features(blocks: list[Block], hide: bool = False) -> list[list[str]]:
    """Names of the features of each block; ``hide`` leaves out the marks of the article itself."""
    found = []
    for k, b in enumerate(blocks):
        words = b.text.count(" ") + 1
        share = b.linked / max(1, len(b.text))
        named = {n for names in b.names for n in names}
        has = {
            "bias", f"words={min(8, words.bit_length())}", f"links={0 if share < 0.2 else 1 if share < 0.6 else 2}",
            f"ends={b.text[-1] in '.!?…:;\"”»'}", f"leaf={b.tags[-1] if b.tags else ''}", f"first={k == 0}", f"last={k == len(blocks) - 1}",
            f"sign={'©' in b.text}",
        }
        has |= {f"in={t}" for t in b.tags if t not in ("html", "body") and not (hide and t in ARTICLE)}
        has |= {f"says={n}" for n in named & (OTHER_WORDS | OWN_WORDS)}
        if named & OWN_WORDS and not named & OTHER_WORDS:
            has.add("own")
        if any(t in OTHER_TAGS for t in b.tags) or named & OTHER_WORDS or "=hidden" in named:
            has.add("other")
        if not hide and _marked(b) >= 0:
            has.add("marked")
            if _other(b, _marked(b) + 1):
                has.add("other-in-marked")
        found.append(sorted(has))
    return found


@dataclass
class Chain:
    """Weights of a linear chain over the labels 0 (boilerplate) and 1 (content)."""

    single: dict[str, float] = field(default_factory=dict)
    pair: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))

    def decode(self, rows: list[list[str]]) -> list[bool]:
        """The best labelling by Viterbi; a block's score counts for content, its negative for boilerplate."""
        best, back = np.zeros(2), []
        for k, row in enumerate(rows):
            s = sum(self.single.get(f, 0.0) for f in row)
            ways = best[:, None] + self.pair if k else np.zeros((2, 2))
            back.append(ways.argmax(axis=0))
            best = ways.max(axis=0) + np.array([-s, s])
        labels, at = [], int(best.argmax())
        for steps in reversed(back):
            labels.append(bool(at))
            at = int(steps[at])
        return labels[::-1]


def marginals(unary: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probability of each label at each block, and the expected number of each pair, by forward and backward sums."""
    n = len(unary)
    forward, backward = np.zeros((n, 2)), np.zeros((n, 2))
    forward[0] = unary[0]
    for k in range(1, n):
        forward[k] = unary[k] + np.logaddexp(forward[k - 1, 0] + pair[0], forward[k - 1, 1] + pair[1])
    for k in range(n - 2, -1, -1):
        ahead = unary[k + 1] + backward[k + 1]
        backward[k] = np.logaddexp(pair[:, 0] + ahead[0], pair[:, 1] + ahead[1])
    whole = np.logaddexp(*forward[-1])
    both = forward[:-1, :, None] + pair + (unary[1:] + backward[1:])[:, None, :] - whole
    return np.exp(forward + backward - whole), np.exp(both).sum(axis=0)


def train(pages: list[tuple[list[list[str]], list[bool]]], epochs: int = EPOCHS) -> Chain:
    """Weights that raise the log-likelihood of the labels, page by page."""
    numbers: dict[str, int] = {}
    coded = [([np.array([numbers.setdefault(f, len(numbers)) for f in row]) for row in rows], np.array(labels, int)) for rows, labels in pages if rows]
    weights, pair = np.zeros(len(numbers)), np.zeros((2, 2))
    seen, pair_seen = np.full(len(numbers), 1e-8), np.full((2, 2), 1e-8)
    for _ in range(epochs):
        for rows, labels in coded:
            scores = np.array([weights[row].sum() for row in rows])
            chance, pairs = marginals(np.stack([-scores, scores], axis=1), pair)
            slope = np.zeros(len(weights))
            for row, error in zip(rows, 2 * (labels - chance[:, 1])):
                slope[row] += error
            slope -= DECAY * weights
            seen += slope**2
            weights += STEP * slope / np.sqrt(seen)
            slope = -pairs - DECAY * pair
            np.add.at(slope, (labels[:-1], labels[1:]), 1.0)
            pair_seen += slope**2
            pair = pair + STEP * slope / np.sqrt(pair_seen)
    return Chain({f: float(weights[k]) for f, k in numbers.items()}, pair)


def examples() -> list[str]:
    """Labelled pages made by rule: an article in each usual wrapping, beside and around each kind of other part."""
    text = "".join(f"<p>Words of a sentence stand here, and {w} more follow it until it ends.</p>" for w in ("two", "ten", "many"))
    long = "<h1>A title of some words</h1>" + text + "<h2>Part</h2><p>Short.</p><ul><li>One item</li><li>Another item of it</li></ul>"
    texts = [long, text, "<p>Word</p>", "<h1>Title</h1>Only these words", "<p>A line<br>and <a href='/y'>a link</a> in it</p><table><tr><td>Cell</table>"]
    own = [("<article>", "</article>"), ("<main>", "</main>"), ('<article><div class="wrap"><div>', "</div></div></article>")]
    own += [(f'<div role="main" class="{w}">', "</div>") for w in sorted(OWN_WORDS)]
    inside = '<p>This part has a sentence of its own, and one more.</p><a href="/x">Link</a> <p>Word</p>'
    other = [f'<div class="{w}">{inside}</div>' for w in sorted(OTHER_WORDS)] + [f"<{t}>{inside}</{t}>" for t in sorted(OTHER_TAGS)]
    pages = [f"<body>{a}{t}{b}</body>" for a, b in own for t in texts]
    for k, part in enumerate(other):
        for shift in range(3):
            (a, b), t = own[(k + 3 * shift) % len(own)], texts[(k + shift) % len(texts)]
            pages += [f"<body>{part}{a}{t}{b}{part}</body>", f"<body>{a}{part}{t}{part}{b}</body>"]
    return pages


def labelled(html: str, hide: bool) -> tuple[list[list[str]], list[bool]] | None:
    blocks = leaf_blocks(html)
    labels = own_labels(blocks)
    return None if labels is None else (features(blocks, hide), labels)


def fit(pages: DataFrame, bound: int = TRAINING_PAGES, epochs: int = EPOCHS) -> Chain:
    """A chain trained on ``bound`` self-labelled pages, chosen by a hash of their html, and the built-in ones."""
    marked = pages.where(F.lower("html").rlike("<(article|main)[\\s>]|itemprop=.?articlebody|role=.?main"))
    hashed = marked.select(F.xxhash64("html").alias("_hash"), "html")
    # equal pages count once; about twice the bound passes the threshold, so that much at most is moved
    different = hashed.agg(F.approx_count_distinct("_hash")).first()[0] or 1
    below = int(min(1.0, 2 * bound / different) * (1 << 32))
    chosen = hashed.where(F.pmod(F.col("_hash"), F.lit(1 << 32)) < below).dropDuplicates(["_hash"]).orderBy("_hash").limit(bound)
    rows = [p for r in chosen.collect() if (p := labelled(r["html"], bool(r["_hash"] & 1)))]
    built = [p for k, html in enumerate(examples()) for hide in (False, True) if (p := labelled(html, hide))]
    return train(built + rows, epochs)


def main_text(html: str | None, chain: Chain) -> str:
    blocks = leaf_blocks(html or "")
    return " ".join(b.text for b, keep in zip(blocks, chain.decode(features(blocks))) if keep)


def extracted(pages: DataFrame, chain: Chain | None = None) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    ship(pages.sparkSession)
    rows = pages.select("page_id", "url", "html")
    chain = chain or fit(rows)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h, chain) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    found = rows.mapInArrow(extract, "page_id long, url string, text string")
    return found.withColumn("n_chars", F.length("text").cast("long"))


@query("op8_main_text")
def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages"))
