"""Main text of web pages: a suffix array of each host's page streams, guarded by page structure.

Structure sets the blocks of a page and their places: paragraphs, headings and the like of
an article, other blocks inside an article, chrome (menus, headers, footers, sidebars,
notices, adverts, forms and comments), and open blocks outside both. The tokens of all but
the first of all pages of a host are concatenated, page by page; their suffixes are sorted,
and neighbours with a common prefix of RUN tokens or more from PAGES pages of distinct
content give the repeated runs of the host. Articles keep their paragraphs and lose their
chrome; of their other blocks, and of open blocks where there is no article, the covered
tokens go and the unique runs stay.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .cells import whole_groups
from .common import cut
from .html_blocks import page_blocks

#: A repeated substring has so many tokens at least and stands on so many distinct pages.
RUN, PAGES = 8, 3
#: Tokens sorted in one task; larger hosts are dealt into parts by content.
PART_TOKENS = 1 << 17
#: Repeated runs that are broadcast, 16 bytes each; beyond that they are joined.
BROADCAST_RUNS = 1_000_000


def token_hashes(tokens: list[str], known: dict[str, int]) -> list[int]:
    """A number from 1 to 2^31 - 1 for each token; 0 is left for breaks."""
    out = []
    for t in tokens:
        h = known.get(t)
        if h is None:
            h = xxhash.xxh32_intdigest(t.encode("utf-8", "surrogatepass")) % 0x7FFFFFFF or 1
            if len(known) >= 200_000:
                known.clear()
            known[t] = h
        out.append(h)
    return out


def stream_of(blocks: list[tuple[str, str]], known: dict[str, int]) -> list[int]:
    """Token hashes of ``blocks`` (place, text) but those at "main", with a 0 at breaks.

    Short neighbours of one place, as the entries of a menu, follow each other; a block of
    RUN tokens or more stands alone, so that no run reaches from it into others.
    """
    out, before = [], ""
    for place, text in blocks:
        tokens = text.split(" ")
        kind = place if len(tokens) < RUN else ""
        if out and (kind == "" or kind != before):
            out.append(0)
        before = kind
        if place != "main":
            out += token_hashes(tokens, known)
    return out


def window_hashes(tokens: np.ndarray, run: int) -> np.ndarray:
    """A signed 64-bit hash of each ``run`` tokens in a row."""
    n = max(0, len(tokens) - run + 1)
    h = np.zeros(n, dtype=np.uint64)
    for k in range(run):
        h = (h + tokens[k : k + n].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h.view(np.int64)


def suffix_array(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the suffixes of ``text`` in order, and the common prefix of each with the one before it.

    Ranks by the first 1, 2, 4, .. tokens, each from pairs of the ranks before, until all
    differ; the common prefixes are read off the same ranks from the longest down.
    """
    n = len(text)
    levels = [np.unique(text, return_inverse=True)[1].astype(np.int32)]
    step = 1
    while n and levels[-1].max() < n - 1:
        rank = levels[-1].astype(np.int64)
        after = np.zeros(n, dtype=np.int64)
        after[: n - step] = rank[step:] + 1
        levels.append(np.unique(rank * (n + 1) + after, return_inverse=True)[1].astype(np.int32))
        step *= 2
    sa = np.argsort(levels[-1])
    a, b = sa[:-1], sa[1:]
    common = np.zeros(max(0, n - 1), dtype=np.int64)
    for k in range(len(levels) - 1, -1, -1):
        x, y = a + common, b + common
        # Equal ranks of suffixes that end within the length are one suffix, which cannot be.
        inside = (x + (1 << k) <= n) & (y + (1 << k) <= n)
        same = np.zeros(len(x), dtype=bool)
        same[inside] = levels[k][x[inside]] == levels[k][y[inside]]
        common[same] += 1 << k
    return sa, np.concatenate([np.zeros(min(n, 1), dtype=np.int64), common])


def repeated_runs(streams: list[np.ndarray], run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, pages) of each class of suffixes of ``streams`` that agree in ``run`` tokens, and its least start.

    The streams are concatenated, each break and each end being a symbol of its own, so that no
    prefix crosses one. A class is a stretch of the suffix array whose common prefixes
    are ``run`` or more; it stands on as many pages as it has streams.
    """
    tokens = np.concatenate([np.append(s, 0) for s in streams]).astype(np.int64)
    page = np.repeat(np.arange(len(streams)), [len(s) + 1 for s in streams])
    ends = np.flatnonzero(tokens == 0)
    text = tokens.copy()
    text[ends] = -1 - np.arange(len(ends))
    sa, common = suffix_array(text)
    left = ends[np.searchsorted(ends, sa)] - sa  # tokens before the next break
    of = np.cumsum(common < run) - 1
    ok = left >= run
    sa, of = sa[ok], of[ok]
    if not len(sa):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    pairs = np.unique(of * len(streams) + page[sa])
    classes, pages = np.unique(pairs // len(streams), return_counts=True)
    start = sa[np.searchsorted(of, classes)]
    return window_hashes(tokens, run)[start], pages, start


def boilerplate(streams: DataFrame, run: int = RUN, pages: int = PAGES, part_tokens: int = PART_TOKENS) -> DataFrame:
    """(host, run, n): hashes of the runs that stand on n pages of distinct content of a host, ``pages`` or more.

    ``streams(host, content, tokens array<int>)``, 0 being a break; rows of one host and
    content count once. A host of more than ``part_tokens`` tokens is dealt into parts by
    content, each of which counts all its runs; as a content is in one part only, the
    counts add up.
    """
    sizes = streams.groupBy("host").agg(F.sum(F.size("tokens").cast("long")).alias("n"))
    large = cut(sizes.where(F.col("n") > part_tokens).select("host", F.ceil(F.col("n") / part_tokens).cast("int").alias("parts")))
    rows = streams.join(F.broadcast(large) if large.count() <= 20_000 else large, "host", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("content"), F.col("parts")).cast("int"))
    rows = rows.repartition("host", "part").sortWithinPartitions("host", "part", "content")

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_groups(batches, ["host", "part"]):
            for a, b in zip(starts, [*starts[1:], table.num_rows]):
                group = table.slice(a, b - a)
                content = group.column("content").to_pylist()
                first = [i for i, c in enumerate(content) if i == 0 or c != content[i - 1]]
                lists = group.column("tokens").combine_chunks().take(pa.array(first))
                flat, at = lists.flatten().to_numpy(), np.append(0, np.cumsum(lists.value_lengths().to_numpy()))
                h, n, _ = repeated_runs([flat[x:y] for x, y in zip(at, at[1:])], run)
                if group.column("parts")[0].as_py() == 1:
                    h, n = h[n >= pages], n[n >= pages]
                host = pa.array([group.column("host")[0].as_py()]).take(pa.array(np.zeros(len(h), dtype=np.int64)))
                yield pa.RecordBatch.from_arrays([host, pa.array(h), pa.array(n)], names=["host", "run", "n"])

    found = rows.select("host", "content", "tokens", "parts", "part").mapInArrow(sort, "host string, run long, n long")
    return found.groupBy("host", "run").agg(F.sum("n").alias("n")).where(F.col("n") >= pages)


def host(url):
    """The host of a url, in lower case; null if there is none."""
    return F.lower(F.nullif(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))


def parsed(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """(row, id, url, host, text, places, content, tokens): text is of the article or, without one, of the open blocks.

    places has a letter for each block of the text: m at "main", o at others. tokens are
    the page's stream, null where the task met the same content on the same host before.
    """
    kind = pages.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        met: set[tuple] = set()
        for b in batches:
            texts, places, contents, streams = [], [], [], []
            for h, at in zip(b.column(3), b.column(2).to_pylist()):
                article, blocks = page_blocks(h.as_py())
                kept = [(p, t) for p, t in blocks if p in (("main", "inner") if article else ("open",))]
                text = "\n\n".join(t for _, t in kept)
                content = hashlib.md5(text.encode("utf-8", "surrogatepass")).digest()
                texts.append(text)
                places.append("".join("m" if p == "main" else "o" for p, _ in kept))
                contents.append(content)
                if (at, content) in met:
                    streams.append(None)
                    continue
                if len(met) >= 100_000:
                    met.clear()
                met.add((at, content))
                streams.append(stream_of(blocks, known))
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:3], pa.array(texts, pa.string()), pa.array(places, pa.string()), pa.array(contents, pa.binary()), pa.array(streams, pa.list_(pa.int32()))],
                names=["id", "url", "host", "text", "places", "content", "tokens"],
            )

    url = F.col(url_col).cast("string")
    rows = pages.select(F.col(id_col).alias("id"), url.alias("url"), F.coalesce(host(url), F.lit("")).alias("host"), F.col(html_col).cast("string").alias("html"))
    rows = rows.mapInArrow(run, f"id {kind}, url string, host string, text string, places string, content binary, tokens array<int>")
    # A page is kept as text once; its number is fixed when it is written.
    return cut(rows.withColumn("row", F.monotonically_increasing_id()))


def blocks_of(text: str, places: str) -> list[tuple[str, str]]:
    return [("main" if p == "m" else "open", t) for p, t in zip(places, text.split("\n\n"))]


def occurrences(rows: DataFrame, runs: DataFrame, run: int = RUN) -> DataFrame:
    """(row, at): where ``runs(host, run)`` start in the streams of the texts of ``rows``."""
    sent = None
    if runs.count() <= BROADCAST_RUNS:
        by_host: dict[str, list[int]] = {}
        for r in runs.collect():  # counted above
            by_host.setdefault(r.host, []).append(r.run)
        sent = rows.sparkSession.sparkContext.broadcast({h: np.array(sorted(v), dtype=np.int64) for h, v in by_host.items()})

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for b in batches:
            index, at, found = [], [], []
            for i, (h, t, p) in enumerate(zip(b.column(1).to_pylist(), b.column(2), b.column(3).to_pylist())):
                own = None if sent is None else sent.value.get(h)
                if "o" not in p or (sent is not None and own is None):
                    continue
                w = window_hashes(np.array(stream_of(blocks_of(t.as_py(), p), known), dtype=np.int64), run)
                hit = np.flatnonzero(np.isin(w, own) if own is not None else np.ones(len(w), dtype=bool))
                index.append(np.full(len(hit), i))
                at.append(hit)
                found.append(w[hit])
            if index:
                take = pa.array(np.concatenate(index))
                yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(np.concatenate(at), pa.int32()), pa.array(np.concatenate(found))], names=["row", "host", "at", "run"])

    out = rows.select("row", "host", "text", "places").mapInArrow(find, "row long, host string, at int, run long")
    return (out if sent is not None else out.join(runs, ["host", "run"])).select("row", "at")


def uncovered(text: str, places: str, starts: list[int], run: int = RUN) -> str:
    """``text`` without the tokens of runs at ``starts``; a block shorter than a run goes whole or not at all."""
    blocks = blocks_of(text, places)
    stream = np.array(stream_of(blocks, {}))
    gone = np.zeros(len(stream), dtype=bool)
    for s in starts:
        gone[s : s + run] = True
    gone, out, at = gone[stream != 0], [], 0
    for place, t in blocks:
        tokens = t.split(" ")
        if place != "main":
            g = gone[at : at + len(tokens)]
            at += len(tokens)
            if g.all():
                continue
            if len(tokens) >= run:
                t = " ".join(x for x, y in zip(tokens, g) if not y)
        out.append(t)
    return "\n\n".join(out)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id_col, url_col, text, n_chars) for every row of ``pages``; blocks are joined by an empty line.

    Null and empty pages, and those without article or open text, give an empty text. Pages
    without a host form one host. Repeated ids and rows are all returned; copies of a page
    on one host count as one page, whatever their ids. Character references are decoded,
    white space in a block is one blank.
    """
    rows = parsed(pages, id_col, url_col, html_col)
    runs = cut(boilerplate(rows.where("tokens IS NOT NULL").select("host", "content", "tokens")).select("host", "run"))
    covers = cut(occurrences(rows, runs).groupBy("row").agg(F.collect_set("at").alias("starts")))
    # A row for each page that loses something: few as a rule, dealt out when they are not.
    n = covers.count()
    rows = rows.select("row", "id", "url", "text", "places").join(F.broadcast(covers) if n <= 100_000 else covers, "row", "left")
    kind = pages.schema[id_col].dataType.simpleString()

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t.as_py() if s is None else uncovered(t.as_py(), p, s) for t, p, s in zip(b.column(2), b.column(3).to_pylist(), b.column(4).to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(texts, pa.string())], names=["id", "url", "text"])

    out = rows.select("id", "url", "text", "places", "starts").mapInArrow(remove, f"id {kind}, url string, text string") if n else rows
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", F.length("text").cast("long").alias("n_chars"))
