"""Repeated runs of a host's pages against brute force; broken and long pages; what goes and what stays."""

import random
import time
from collections import defaultdict

import numpy as np
import pytest

from isoflow.llm import html_extract as he
from isoflow.llm.html_blocks import page_blocks

PAGE = "page_id long, url string, html string"


def texts(spark, rows):
    return {r.page_id: r.text for r in he.extract(spark.createDataFrame(rows, PAGE)).collect()}


def test_mirrors_headings_and_menus(spark):
    body = "<p>a text of its own that stands on four mirrors of one host</p>"
    menu = "<div>home of all</div><div>news of today</div><div>about us here</div>"
    rows = [(i, "http://m.org/x", f"<div>{body}</div>") for i in range(4)]
    rows += [(10 + i, "http://s.org/x", f"{menu}<p>the words of page number {i} are these and no others at all</p><h2>Further reading</h2><p>page {i} ends in few words</p>") for i in range(4)]
    # Pages with an article show that the letter notice of the last is common; their articles do not vote.
    notice, lead = "<p>sign up to our letter now and get the best of it all</p>", "this lead stands in every article of the host and stays"
    rows += [(20 + i, "http://v.org/x", f"<footer>{notice}</footer><article><p>{lead}</p><p>own {i}</p></article>") for i in range(3)]
    rows += [(30, "http://v.org/y", f"<div>{notice}<p>{lead}</p></div>")]
    got = texts(spark, rows)
    assert {got[i] for i in range(4)} == {"a text of its own that stands on four mirrors of one host"}
    for i in range(4):
        assert got[10 + i] == f"the words of page number {i} are these and no others at all\n\nFurther reading\n\npage {i} ends in few words"
        assert got.get(20 + i, f"{lead}\n\nown {i}") == f"{lead}\n\nown {i}"
    assert got[30] == lead


@pytest.mark.parametrize("bound", [10**6, 0])
def test_runs_decide_within_articles(spark, monkeypatch, bound):
    monkeypatch.setattr(he, "BROADCAST_RUNS", bound)
    notice = "become a member today and read all of our texts without adverts"
    rows = [(i, "http://a.org/x", f"<article><h1>{i}</h1><p>text {i} of its own</p><div>{notice}</div><div>a note on page {i} only, told in a div</div><p>{notice}</p></article>") for i in range(3)]
    # A menu and two articles have this one; it stands among words of the page's own.
    part = "<p>x</p><section>in short {} {} and so on</section>"
    more = "read the terms and rules of this host before you write"
    rows += [(20, "http://a.org/y", f"<nav>{more}</nav><article><p>menu</p></article>")]
    rows += [(21 + i, "http://a.org/y", f"<article>{part.format(i, more)}</article>") for i in range(2)]
    # Two pages are too few, and copies of a page are one.
    rows += [(30 + i, "http://b.org/x", f"<article><p>{min(i, 1)}</p><div>{notice}</div></article>") for i in range(5)]
    got = texts(spark, rows)
    assert all(got[i] == f"{i}\n\ntext {i} of its own\n\na note on page {i} only, told in a div\n\n{notice}" for i in range(3))
    assert [got[20 + i] for i in range(3)] == ["menu", "x\n\nin short 0 and so on", "x\n\nin short 1 and so on"]
    assert all(got[30 + i] == f"{min(i, 1)}\n\n{notice}" for i in range(5))


def test_suffix_array_equals_brute_force():
    rng = np.random.default_rng(3)
    for n, kinds in ((0, 1), (1, 1), (7, 1), (60, 2), (200, 3), (300, 40)):
        text = rng.integers(0, kinds, n)
        sa, common = he.suffix_array(text)
        suffixes = [tuple(text[i:]) for i in range(n)]
        assert sa.tolist() == sorted(range(n), key=lambda i: suffixes[i])
        for a, b, c in zip(sa, sa[1:], common[1:]):
            x, y = suffixes[a], suffixes[b]
            assert c == next((k for k, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))
    long = rng.integers(0, 50_000, 120_000)
    sa, common = he.suffix_array(long)
    assert sorted(sa) == list(range(len(long)))
    for k in range(1, len(sa), 97):
        a, b, c = sa[k - 1], sa[k], common[k]
        assert (long[a : a + c] == long[b : b + c]).all() and tuple(long[a : a + c + 1]) < tuple(long[b : b + c + 1])


@pytest.mark.parametrize("part_tokens", [10**6, 150])
def test_runs_equal_brute_force(spark, part_tokens):
    rng = random.Random(7)
    passages = [[rng.randint(1, 30) for _ in range(rng.randint(5, 14))] for _ in range(6)]
    rows = []
    for n in range(60):
        tokens = []
        for _ in range(rng.randint(0, 5)):
            tokens += rng.choice(passages) if rng.random() < 0.6 else [rng.randint(100, 10**6) for _ in range(5)]
            if rng.random() < 0.2:
                tokens.append(0)
        rows.append((rng.choice("ab"), bytes([n % 50]), tokens))
    rows = [(h, c, next(t for g, d, t in rows if (g, d) == (h, c))) for h, c, _ in rows]
    where = defaultdict(set)
    for h, c, t in rows:
        for i in range(len(t) - 7):
            if 0 not in t[i : i + 8]:
                where[h, tuple(t[i : i + 8])].add(c)
    want = {(h, int(he.window_hashes(np.array(w), 8)[0])) for (h, w), cs in where.items() if len(cs) >= 3}
    df = spark.createDataFrame(rows, "host string, content binary, tokens array<int>")
    assert want and {(r.host, r.run) for r in he.boilerplate(df, part_tokens=part_tokens).collect()} == want


def test_broken_and_long_pages():
    for piece in ("<a ", '<a "', '<a b="', '<a b=">" ', "<![CDATA[", "<b></i>", "<b><p>", "<b><p></p>", "<script>", "<!--", "&#9", "<a<", "</", "<li>", "<svg>", "<"):
        began = time.time()
        page_blocks(piece * (300_000 // len(piece)))
        assert time.time() - began < 10
    assert page_blocks("a &#" + "9" * 5000 + "; b < c <b")[1] == [("open", "a � b < c <b")]
    assert page_blocks("<p title='a>b' data=\"x>y\">one</p><svg/>two<svg><p>x</p></svg>")[1] == [("open", "one"), ("open", "two")]
