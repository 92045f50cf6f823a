"""Quality, language-model scores, personal data and page texts against brute force and held-out labels."""

import collections
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gradewright.llm import html_extraction, lm_scoring, pii, quality

SF = "/root/testdata/sf0.01"


def test_quality_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = quality.classify(docs, labels)
    assert got.count() == docs.count()
    rows = got.where("held_out").join(labels, "doc_id").collect()
    assert np.mean([r.predicted == r.quality for r in rows]) >= 0.97
    kept = quality.accepted(docs, labels)
    assert kept.columns == docs.columns and kept.count() == got.where("predicted = 1").count()


def test_quality_edge_cases(spark):
    docs = spark.createDataFrame([(1, "", 1), (None, None, 2), (3, "x" * 100_000, 3), (3, "Some words.", 4)], "doc_id long, text string, _v int")
    some = spark.createDataFrame([(1, 1), (3, 0), (3, None), (9, 1), (1, 7)], "doc_id long, quality int")
    for labels in (some, some.limit(0), some.where("quality = 1")):
        rows = quality.classify(docs, labels).collect()
        assert len(rows) == 4 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
        assert [r.held_out for r in rows if r.doc_id is None] == [False]
    assert {r.score for r in quality.classify(docs, some.limit(0)).collect()} == {0.5}
    assert quality.classify(docs.limit(0), some).count() == 0 and quality.accepted(docs.limit(0), some).count() == 0


def test_quadratic_discriminant_equals_the_formula():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(50, 3))
    mean, own = x.mean(axis=0), np.cov(x.T)
    factor = np.linalg.cholesky(own)
    g = quality.Gaussian(mean, np.linalg.inv(factor), -np.log(np.diag(factor)).sum())
    want = [-0.5 * (v - mean) @ np.linalg.inv(own) @ (v - mean) - 0.5 * math.log(np.linalg.det(own)) for v in x]
    assert np.allclose(g.log_density(x), want)


SHAPES = [
    re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def brute_spans(text):
    found = []
    for kind, shape in enumerate(SHAPES):
        for m in shape.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == pii.IP and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == pii.CARD and not (14 <= len(digits) <= 19 and pii.luhn(digits)):
                continue
            if kind == pii.PHONE and not 10 <= len(digits) <= 15:
                continue
            found.append((m.start(), kind, m.end()))
    return sorted(found)


PARTS = [
    "a.b@c.d", "a@b.c._x@d.e", "@", "@@", "x@y", "1.2.3.4", "1.2.3.4.5.6.7.8.9", "0001.255.256.1", "4041894974608795", "4041 8949-7460 8795",
    "+1 (988) 555-2485", "+1((((", "+12", "(at)", " [at] ", ".", "-", " ", "é", "12345678901234", "00000000000000", " 212-555-9876 ", "fe80::1:2:3", "\n",
]


def test_base_spans_equal_the_patterns():
    random.seed(1)
    for _ in range(20_000):
        text = "".join(random.choice(PARTS) for _ in range(random.randint(0, 8)))
        base = brute_spans(text)
        assert pii.base_spans(text) == base, text
        for start, end, _ in pii.candidate_spans(text, base):
            assert all(end <= s or start >= e for s, _, e in base), text


def test_spans_of_long_runs_take_linear_time():
    for unit in ("a", "1", "1.", "@a", "+1(", "(at)", "1 ", ":", "a@"):
        pii.candidate_spans(unit * 200_000, pii.base_spans(unit * 200_000))


def test_contexts_find_unseen_identifiers(spark):
    rows = [(i, f"Please call me at +1 (2{i:02d}) 555-{1000 + i} today, thanks") for i in range(8)]
    rows += [(100, "Please call me at 212-555-9876 today, thanks"), (101, "order 212-555-1111 here"), (102, None), (103, ""), (None, "mail a@b.co now")]
    docs = spark.createDataFrame([(*r, 7, "x") for r in rows], "doc_id long, text string, n_chars long, _key string")
    got = {r.doc_id: r for r in pii.personal_data(docs).collect()}
    assert got[100].spans == "phone:18:30" and got[100].n_found == 1 and got[100].n_phone == 0
    assert got[101].spans == "" and got[102].spans == "" and got[None].spans == "email:5:11" and got[0].n_phone == 1
    for few in (100_000, 0):
        masked = {r.doc_id: r for r in pii.redacted(docs, few).collect()}
        assert masked[100].text == "Please call me at <PHONE> today, thanks" and masked[100].n_chars == 39 and masked[100]._key == "x"
        assert masked[101].text == rows[9][1] and masked[102].text is None and masked[None].text == "mail <EMAIL> now"
    assert pii.personal_data(docs.limit(0)).count() == 0 and pii.redacted(docs.limit(0)).count() == 0


def test_overlapping_spans_are_masked_once():
    text = "x +4111111111111111 y"
    assert pii.masked(text, [(2, pii.PHONE, 10), (3, pii.CARD, 19)]) == "x <PHONE> y"


STORY = "<p>The council met on Tuesday to discuss the plan, and it was agreed that work begins soon.</p><p>More will follow &amp; soon.</p>"
SAID = "The council met on Tuesday to discuss the plan, and it was agreed that work begins soon. More will follow & soon."


@pytest.fixture(scope="module")
def chain(spark):
    return html_extraction.fit(spark.read.parquet(f"{SF}/pages.parquet"))


@pytest.mark.parametrize("page", [
    "<body><div id=header><a href=/>Home</a> <a href=/a>About us</a></div><div class=content>{}</div><div class=sidebar><ul><li><a href=x>Other</a></ul></div><footer>© Site</footer>",
    "<nav><a href=/>Home</a></nav><main>{}<aside>Ad here now.</aside><section class='comments'><p>Nice article, thanks for it all.</p></section></main>",
    "<div class='cookie-notice'>We use cookies to improve it.</div>{}<form><label>Email</label><input></form>",
    "<head><title>T</title><style>p{{}}</style></head><script>var t='</p>';</script><article>{}<!-- no --></article><div class=ad>Buy</div>",
])
def test_pages_without_and_with_marks(chain, page):
    assert html_extraction.main_text(page.format(STORY), chain) == SAID


def test_pages_of_the_table(spark, chain):
    import html

    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = html_extraction.extracted(pages, chain).collect()
    texts = {r.page_id: r.text for r in got}
    assert len(got) == pages.count() and all(r.n_chars == len(r.text) for r in got)
    for r in pages.collect():
        inside = re.sub(r"</?b>", "", re.search("<article>(.*?)</article>", r.html, re.S)[1])
        parts = (re.sub(r"\s+", " ", html.unescape(p)).strip() for p in re.split(r"</?(?:p|br|h1)[^>]*>", inside))
        assert texts[r.page_id] == " ".join(p for p in parts if p)


def test_page_edge_cases(spark, chain):
    rows = [(1, "u", None), (2, None, ""), (None, "u", "<article><p>Tiny"), (4, "u", "</div></p>no tags but text & more"), (4, "u", "<script>x"), (5, "u", "<p>" * 3000 + "deep")]
    got = html_extraction.extracted(spark.createDataFrame([(*r, "t") for r in rows], "page_id long, url string, html string, text string"), chain).collect()
    assert len(got) == 6 and {r.text for r in got if r.page_id in (1, 2)} == {""} and [r.text for r in got if r.page_id is None] == ["Tiny"]
    assert html_extraction.extracted(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_marginals_equal_enumeration():
    from itertools import product

    rng = np.random.default_rng(1)
    unary, pair = rng.normal(size=(4, 2)), rng.normal(size=(2, 2))
    score = {y: math.exp(sum(unary[k, v] for k, v in enumerate(y)) + sum(pair[a, b] for a, b in zip(y, y[1:]))) for y in product((0, 1), repeat=4)}
    total = sum(score.values())
    chance, pairs = html_extraction.marginals(unary, pair)
    for k in range(4):
        assert chance[k, 1] == pytest.approx(sum(s for y, s in score.items() if y[k]) / total)
    assert pairs[0, 1] == pytest.approx(sum(s * sum((a, b) == (0, 1) for a, b in zip(y, y[1:])) for y, s in score.items()) / total)
    rows = [["a"], ["b"], ["a", "b"], ["c"]]
    chain = html_extraction.Chain({"a": 0.4, "b": -0.7, "c": 0.1}, pair)
    best = max(product((0, 1), repeat=4), key=lambda y: sum((2 * v - 1) * sum(chain.single[f] for f in r) for r, v in zip(rows, y)) + sum(pair[a, b] for a, b in zip(y, y[1:])))
    assert chain.decode(rows) == [bool(v) for v in best]


def test_numbers_side_by_side_are_candidates_of_their_own():
    def shown(text):
        return [text[s:e] for s, e, _ in pii.candidate_spans(text, pii.base_spans(text))]

    assert shown("555-123-4567 / 555-765-4321") == ["555-123-4567", "555-765-4321"]
    assert shown("+1 555 123 4567 / 555 765 4321") == ["555 765 4321"]
    assert shown("555 765 4321 / +1 555 123 4567 / 555 111 2222") == ["555 765 4321", "555 111 2222"]
    assert shown("555-123-4567 555-765-4321 555-111-2222") == ["555-123-4567", "555-765-4321", "555-111-2222"]
    assert shown("555 123 4567 555 765 4321") == ["555 123 4567", "555 765 4321"]
    assert shown("1111 2222 3333 4444 1111 2222 3333 4445") == ["1111 2222 3333 4444", "1111 2222 3333 4445"]
    assert shown("555-123-4567  555-765-4321  5") == ["555-123-4567", "555-765-4321"]
    assert shown("call 212-555-9876, 12/05/2021 or 1" + "0" * 30) == ["212-555-9876", "12/05/2021"]
    long = "a" * 100 + " [at] " + "b" * 90 + ".example"
    assert shown(f"x {long} y") == [long]


def test_discovery_goes_on_until_nothing_changes(spark):
    seen, near = [], lambda k: f"chain{k} _"
    for k in range(12):  # each context is trusted only by what the one before it makes likely
        for n in range(12):
            value = f"v{k}n{n}"
            seen.append((value, pii.PHONE if k == 0 else None, 1 << pii.PHONE, [near(k), near(k + 1)]))
    df = spark.createDataFrame(seen, "value string, seed long, kinds long, patterns array<string>")
    got = {r.value for r in pii.discovered(df, trust=0.3, accept=0.4).collect()}
    assert {f"v{k}n{n}" for k in range(1, 8) for n in range(12)} <= got


@pytest.mark.parametrize("most", [1, 12, 65_536])
def test_word_models_equal_brute_force(spark, most):
    rows = [(1, "one two one  three"), (2, "two two 你好 ñandú"), (3, None), (4, ""), (None, "three one"), (5, "x y " * 50), (5, "x"), (6, "two one"), (6, "two one")]
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (5, None), (6, 1), (None, 1)], "doc_id long, quality int")
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, n int")
    pairs = lambda t: list(zip(["", *(t or "").split()], [*(t or "").split(), ""]))
    size = lambda texts: sum(len((t or "").encode()) + 1 for t in texts)
    good = [t for i, t in rows if i in (1, 6)]
    target, whole = (collections.Counter(x for t in texts for x in pairs(t)) for texts in (good, [t for _, t in rows]))
    scale, p = size(good) / size([t for _, t in rows]), lm_scoring.PRIOR

    def score(i, text):
        own = collections.Counter(pairs(text))
        bits = lambda x: math.log2((whole[x] - own[x]) * scale + p) - math.log2(target[x] - own[x] * (i in (1, 6)) + p)
        return sum(n * bits(x) for x, n in own.items()) / sum(own.values())

    want = sorted((len(pairs(t)), score(i, t)) for i, t in rows)
    got = sorted((r.n_tokens, r.score) for r in lm_scoring.word_cross_entropy(docs, labels, most=most).collect())
    assert [n for n, _ in got] == [n for n, _ in want] and np.allclose([s for _, s in got], [s for _, s in want])
    assert lm_scoring.word_cross_entropy(docs.limit(0), labels).count() == 0
    assert lm_scoring.word_cross_entropy(docs, labels.limit(0)).count() == len(rows)


def test_a_label_alone_changes_little(spark):
    """Good texts with and without a label score alike, since no text meets its own words; other texts score worse."""
    random.seed(8)
    kinds = {"good": [f"g{k}" for k in range(60)], "bad": [f"b{k}" for k in range(60)]}
    texts = [(k, kind, " ".join(random.choice(words) for _ in range(200))) for kind, words in kinds.items() for k in range(1000 * (kind == "bad"), 1000 * (kind == "bad") + 80)]
    docs = spark.createDataFrame([(i, t) for i, _, t in texts] + [(5000, "hot words " * 3000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(kind == "good")) for i, kind, _ in texts if i % 2], "doc_id long, quality int")
    got = {r.doc_id: r.score for r in lm_scoring.word_cross_entropy(docs, labels).collect()}
    mean = lambda kind, odd: np.mean([got[i] for i, k, _ in texts if k == kind and i % 2 == odd])
    assert abs(mean("good", 1) - mean("good", 0)) < 0.1 < 0.5 < mean("bad", 0) - mean("good", 0)
    assert max(got[i] for i, k, _ in texts if k == "good") < min(got[i] for i, k, _ in texts if k == "bad")


def test_word_tables_grow_with_the_input(spark):
    one, two = (" ".join(f"{sign}{k}" for k in range(5000)) for sign in "字語")
    docs = spark.createDataFrame([(1, one), (2, two), (3, one), (4, two)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    got = {r.doc_id: r.score for r in lm_scoring.word_cross_entropy(docs, labels).collect()}
    assert got[3] < 0 < got[4] and got[1] == pytest.approx(got[2]) == pytest.approx(got[4])  # the label of 1 is its own


def test_hot_events_are_few_and_all_others_are_packed(spark, monkeypatch):
    """Each task lists what may be hot in it; what is not goes in a row for each range of events, not one for each event."""
    monkeypatch.setattr(lm_scoring, "SHARE_BYTES", 200)
    random.seed(5)
    texts = [(k, f"all alike {k} {random.random()} " + " ".join(f"w{random.randrange(400)}" for _ in range(30))) for k in range(300)]
    docs = spark.createDataFrame(texts, "_key long, text string").withColumn("_good", F.col("_key") % 2).repartition(3)
    rows = collections.Counter()
    for _, t in texts:
        words = t.split()
        rows.update(set(zip(["", *words], [*words, ""])))
    most = 60
    hot = lm_scoring.hot_events(docs, most)
    heavy = [e for e, n in rows.items() if n * most >= sum(rows.values())]
    assert len(heavy) == 2 <= len(hot) <= 2 * most
    alike = lm_scoring._cells(pa.array(["all alike"]))[0]
    assert np.isin(alike, hot).sum() == 2  # from the edge to "all", and "all alike"
    packs = lm_scoring.packed_events(docs, hot, 4).collect()
    assert len(packs) <= 4 * 3
    held = collections.Counter(e for p in packs for e in np.cumsum(lm_scoring._values(p["_steps"], "<u8"), dtype="u8").tolist())
    kept = lm_scoring.events(docs, hot).groupBy("_event").count().collect()
    assert sorted([*held.values(), *(r["count"] for r in kept)]) == sorted(rows.values())
    assert {int(p["_range"]) for p in packs} == set(range(4))
