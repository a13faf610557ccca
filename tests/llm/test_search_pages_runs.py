"""Ranked search, main text of pages and periodic runs against plain versions, on given, small and awkward tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction
from html import unescape

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsreach.llm import html_text, lexical, periodic
from newsreach.llm.queries import QUERIES
from newsreach.llm.rows import table

AWKWARD = [
    (1, "The cat sat on the mat"), (2, None), (3, ""), (None, "the CAT of no id"), (5, "the cat sat on the mat"), (5, "the cat sat on the mat"),
    (6, "?! ..."), (7, "wort " * 30000), (8, "Ünïcode \U0001f600 cat\twith\nbreaks"), (None, "the CAT of no id"), (9, "a b c " * 9 + "x"),
]


@pytest.fixture(scope="module")
def awkward(spark):
    rows = spark.createDataFrame(AWKWARD, "doc_id long, text string")
    return rows.withColumns({c: F.lit("x") for c in ("doc", "known", "n", "terms", "score", "rank", "key", "query", "runs", "best", "item_id", "html", "url")})


# Ranked search


def plain_terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_search(docs, items, k=10):
    counted = [(doc, Counter(plain_terms(text))) for doc, text in docs]
    lengths = [sum(c.values()) for _, c in counted]
    documents, total = sum(map(bool, lengths)), sum(lengths)
    holding = Counter(term for _, c in counted for term in c)
    weights = {t: math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1))) for t, df in holding.items()}
    out = []
    for item, text in items:
        asked = Counter(plain_terms(text))
        found = []
        for (doc, c), n in zip(counted, lengths):
            m = 25 + (75 * n * documents) // max(total, 1)
            score = sum(r * weights[t] * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t, r in asked.items() if t in c)
            if score > 0:
                found.append((-score, doc is None, doc or 0, doc))
        out += [(item, rank, x[3], -x[0]) for rank, x in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=repr)


def test_ranked_search_equals_scoring_everything(spark, tables, awkward):
    docs, items = table(spark, tables, "documents"), table(spark, tables, "benchmark")
    pairs = [tuple(r) for r in docs.select("doc_id", "text").collect()], [tuple(r) for r in items.select("item_id", "text").collect()]
    want = plain_search(*pairs)
    assert sorted(map(tuple, lexical.ranked_search(docs, items).collect()), key=repr) == want
    assert sorted(map(tuple, lexical.ranked_search(docs, items, wave_chars=1000).collect()), key=repr) == want
    asked = [(1, "the the cat mat"), (1, "wort x"), (2, None), (3, ""), (4, "CAT"), (5, "nothing here"), (None, "a B c")]
    rows = spark.createDataFrame(asked, "item_id long, text string").withColumns({c: F.lit(1) for c in ("key", "score", "doc_id", "rank")})
    assert sorted(map(tuple, lexical.ranked_search(awkward, rows).collect()), key=repr) == plain_search(AWKWARD, asked)
    assert lexical.ranked_search(awkward.limit(0), rows).count() == lexical.ranked_search(awkward, rows.limit(0)).count() == 0
    assert lexical.ranked_search(awkward, rows).dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]


def test_blocks_skip_only_what_cannot_win(monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK", 4)
    rng = np.random.default_rng(3)
    size, visited = 30, 0
    for trial in range(30):
        count = rng.integers(1, 12, 200)
        term = np.concatenate([np.sort(rng.choice(size, c, replace=False)) for c in count])
        value = rng.integers(1, 50, len(term))
        if trial % 2:  # crowds of equal documents
            count, term, value = np.tile(count[:20], 10), np.tile(term[: count[:20].sum()], 10), np.tile(value[: count[:20].sum()], 10)
        queries = [(np.sort(rng.choice(size, 6, replace=False)), rng.integers(0, 9, 6)) for _ in range(5)]
        owner = np.repeat(np.arange(200), count)
        docs = rng.permutation(200)
        asked = [np.unique(np.concatenate([t for t, _ in queries if x in t] or [np.zeros(0, np.int64)])).astype(np.int64) for x in range(size)]
        shard = lexical.Shard(docs, np.ones(200, bool), owner, term, value, asked)
        for terms, weights in queries:
            weight = np.zeros(size, np.int64)
            weight[terms] = weights
            scores = np.bincount(owner, value * weight[term], minlength=200).astype(int)
            best = sorted((-s, d) for s, d in zip(scores.tolist(), docs.tolist()) if s > 0)[:7]
            rows, found = shard.search(terms, weights, 7, 0)
            assert list(zip((-found).tolist(), docs[rows].tolist())) == best
            if len(best) == 7:  # a score to beat that ties with the last keeps it
                rows, found = shard.search(terms, weights, 7, -best[-1][0])
                assert list(zip((-found).tolist(), docs[rows].tolist())) == best
        for term_id, blocks in shard.lists.items():
            visited += len(blocks.ends)
            assert sorted(blocks.rows) == sorted(owner[term == term_id])
            dense = np.zeros((200, size), np.int64)
            dense[owner, term] = value
            starts = [0, *blocks.ends[:-1]]
            for a, b, top in zip(starts, blocks.ends, blocks.summaries):
                assert (dense[blocks.rows[a:b]][:, asked[term_id]].max(axis=0) == top).all()
    assert visited > 500


# Main text


def plain_text(html):
    """For the pages of the given tables, whose article stands in an element of that name."""
    match = re.search(r"<article>(.*?)</article>", html or "", re.S)
    parts = re.split(r"</?(?:p|h1)>", match[1] if match else "")
    texts = [" ".join(unescape(re.sub("<[^>]*>", "", x.replace("<br>", " "))).split()) for x in parts]
    return "\n".join(x for x in texts if x)


def test_main_text_of_the_given_pages(spark):
    pages = table(spark, "/root/testdata/sf0.01", "pages")
    found = {r.page_id: r for r in QUERIES["op12_html_text"](spark, "/root/testdata/sf0.01").collect()}
    rows = pages.collect()
    assert len(found) == len(rows)
    for row in rows:
        want = plain_text(row.html)
        assert (found[row.page_id].text, found[row.page_id].n_chars, found[row.page_id].url) == (want, len(want), row.url)


PROSE = "A paragraph, with commas, that is long enough to be counted as text of the page."
PAGES = {
    # containers without semantic names, and all kinds of things around them
    f"""<body><header><h1>Site</h1><a href=/>Home</a></header><div id=cookie-notice><p>We use cookies, many, many, many cookies on this page.</p></div>
    <div class=wrap><div class="post with-sidebar"><h2>Title</h2><p>{PROSE}<p>Second &amp; last, {PROSE}<ul><li>one<li>two</ul>
    <form><p>{PROSE}</p><input></form><div class=ad><p>{PROSE}</p></div></div><div class=sidebar><p>{PROSE}</p></div>
    <ol id=comments><li>{PROSE}</ol></div><footer>{PROSE}</footer>""": f"Title\n{PROSE}\nSecond & last, {PROSE}\none\ntwo",
    # a short article against a longer text beside it; headings of its own header stay
    f"<article><header><h1>T</h1><span>By me</span></header><p>Short.</p><aside>{PROSE}</aside></article><div>{PROSE}</div>": "T\nShort.",
    # siblings that score as well belong together
    f"<div><section><p>{PROSE}</section><section><p>{PROSE} Again, once more.</section><section><a href=x>{PROSE}</a></section></div>": f"{PROSE}\n{PROSE} Again, once more.",
    # lists of links are menus, single links are text
    f"<div><p>{PROSE} <a href=y>link</a></p><ul><li><a href=a>One</a><li><a href=b>Two</a></ul></div>": f"{PROSE} link",
    # broken markup, raw text, references, white space
    "<p>one <b>two<p>three&nbsp;&lt;4 <script>'</p><p>no'</script>five\n\n six<br>seven<!-- no -->": "one two\nthree <4 five six seven",
    f"<table><tr><td><p>{PROSE}<td>x</table>": PROSE,
    "just text &amp; more": "just text & more", "": "", None: "", "<p>  </p>": "", "<script>never closed": "", "<nav>menu</nav>": "",
}


@pytest.mark.parametrize("html", PAGES, ids=range(len(PAGES)))
def test_main_text_of_made_pages(html):
    assert html_text.main_text(html) == PAGES[html]


def test_main_text_of_awkward_pages(spark):
    deep = "<div>" * 3000 + "<b>" * 3000 + "<p>deep, deep text" * 50
    rows = [(1, "u", PROSE), (1, "u", PROSE), (None, None, None), (2, None, ""), (3, "v", "<a href=\"" * 2000), (4, "w", deep), (5, "x", f"<p>{PROSE * 20000}")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("text", "n_chars", "score")})
    found = {repr((r.page_id, r.url)): (r.text, r.n_chars) for r in html_text.extracted(pages).collect()}
    assert html_text.extracted(pages).count() == len(rows) and html_text.extracted(pages.limit(0)).count() == 0
    assert found["(1, 'u')"] == (PROSE, len(PROSE)) and found["(None, None)"] == found["(2, None)"] == ("", 0)
    assert found["(4, 'w')"][0] == "\n".join(["deep, deep text"] * 50) and found["(5, 'x')"][1] == len(PROSE) * 20000


# Periodic runs


def plain_runs(words):
    """(start, length, period) of all runs by looking at every period."""
    smallest = {}
    for q in range(1, len(words) // 4 + 1):
        t = 0
        while t + q < len(words):
            start = t
            while t + q < len(words) and words[t] == words[t + q]:
                t += 1
            if t + q - start >= max(6, 4 * q):
                smallest.setdefault((start, t + q), q)
            t += 1
    return sorted((s, e - s, q) for (s, e), q in smallest.items())


def plain_digest(doc, text):
    words = [x.decode() for x in (text or "").encode().split()]
    n, h = len(words), zlib.crc32(str(doc).encode()) if doc is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    strongest = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc, len(runs), *strongest, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def test_runs_equal_looking_at_every_period(monkeypatch):
    rng = random.Random(1)
    total = 0
    for _ in range(800):
        texts = []
        for _ in range(rng.randint(1, 6)):
            letters = rng.choice([1, 2, 2, 3, 50])
            words = [b"%d" % rng.randrange(letters) for _ in range(rng.randint(0, rng.choice([5, 40, 150])))]
            if rng.random() < 0.5:  # runs inside runs
                unit = words[: rng.randint(1, 7)] * rng.randint(1, 6) + words[: rng.randint(0, 4)]
                words = words[: rng.randint(0, 9)] + unit * rng.randint(1, 7) + words
            texts.append(words)
        monkeypatch.setattr(periodic, "PIECE", rng.choice([1, 3, 17, 64, 1 << 18]))
        found = periodic.runs_of_texts(texts)
        assert found == [plain_runs(words) for words in texts]
        total += sum(map(len, found))
    assert total > 1000


def test_run_digests_equal_a_plain_version(spark, tables, awkward):
    for rows, name in ((table(spark, tables, "documents"), "documents"), (awkward, None)):
        data = [tuple(r) for r in rows.select("doc_id", "text").collect() if len(r.text or "") < 20000]
        found = QUERIES["op13_periodic_runs"](spark, tables) if name else periodic.run_digests(periodic.periodic_runs(rows, echo=True))
        assert found.count() == rows.count()
        got = Counter(tuple(r) for r in found.collect())
        for row in (plain_digest(*x) for x in data):
            assert got[row] > 0, row
    assert periodic.run_digests(periodic.periodic_runs(awkward.limit(0))).count() == 0
    one = periodic.periodic_runs(awkward).where("doc_id = 7").first()
    assert [tuple(x) for x in one.runs] == [(0, 30000, 1)] and one.collapsed == "wort"


def test_long_texts_of_many_runs_stay_cheap():
    assert periodic.runs_of_texts([[b"a"] * 300_000, [b"a", b"b", b"c"] * 50_000]) == [[(0, 300_000, 1)], [(0, 150_000, 3)]]
    short = ([b"a"] * 6 + [b"b"]) * 3 + [b"c"]
    words = [x for i in range(3000) for x in [*short, b"%d" % i]]
    assert len(periodic.runs_of_texts([words])[0]) == 9000
