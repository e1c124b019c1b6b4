"""Secrets by fixed patterns and by what guessing a value would cost.

Values in a credential context (a name such as ``password``, a separator, a run of visible
characters) are cut into words, dates, repeats, keyboard walks and single characters so that
the guesses needed are fewest, by dynamic programming over the places of the value. A value
that costs at least a given number of guesses is a secret; ``password = correcthorse`` is not.
Every row is scanned where it is read, so nothing is shuffled.
"""

from __future__ import annotations

import bisect
import json
import re
from collections.abc import Iterator
from math import inf, log10

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Fixed patterns: the least length of a match, or of its second group for the first one.
BASE = {
    "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 12),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 18),
    "hex": (re.compile(r"[0-9a-f]{16,}"), 16),  # runs are taken whole, so shorter ones need not be matched
}
#: Names that announce a value, and the value: visible characters up to a quote, a comma or a closing bracket.
CONTEXT = re.compile(
    r"""(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|credentials?|api[_-]?key|(?:access|private|secret|auth|session)[_-]?key|authori[sz]ation|bearer)["']?\x20*(?:=>|[:=]|\x20is\x20|\x20bearer\x20)\x20*(?:bearer\x20+|basic\x20+)?["']?([!#-&(-+\--;=?-\\^-|~]{8,})""",
    re.I | re.A,
)
#: Rows of a keyboard, each shifted to the right against the one above, and the alphabet as a row of its own.
KEYS = ("1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
#: Other ways to write a letter.
LOOKALIKES = str.maketrans("4@831!0$57", "aabeeiosst")
#: Guesses (log 10) that tell the kind of a stretch, and for a change of direction in a walk.
KIND, TURN = log10(5), log10(8)
LONGEST_WORD = 32


def keyboard() -> dict[str, tuple[int, int]]:
    """(row, place) of each key; neighbours are at most one row and one place apart."""
    return {c: (r, x) for r, row in enumerate(KEYS) for x, c in enumerate(row)}


AT = keyboard()


def steps(a: str, b: str) -> tuple[int, int] | None:
    """The step from one key or letter to the next in a walk, or None if they are no neighbours."""
    a, b = a.lower(), b.lower()
    if a.isalnum() and b.isalnum() and a.isdigit() == b.isdigit() and abs(ord(a) - ord(b)) == 1:
        return (9, ord(b) - ord(a))  # up or down the alphabet or the numbers
    if a in AT and b in AT and a != b:
        (r, x), (s, y) = AT[a], AT[b]
        if (s - r, y - x) in ((0, 1), (0, -1), (1, -1), (1, 0), (-1, 0), (-1, 1)):
            return (s - r, y - x)
    return None


DATE = re.compile(r"(?:(?:19|20)\d\d([-/._]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])([-/._]?)(?:0[1-9]|1[0-2])\2(?:(?:19|20)\d\d)|(?:19|20)\d\d)")


def brute(c: str) -> float:
    """Guesses for one character of its class."""
    return log10(10 if c.isdigit() else 26 if c.isascii() and c.isalpha() else 33 if c.isascii() else 1000)


def guess_cost(value: str, ranks: dict[str, int], prefixes: list[str]) -> tuple[float, list[tuple[str, int, int]]]:
    """log10 of the fewest guesses for ``value``, and the (kind, start, end) of its stretches.

    The cost of a stretch adds up: a word its rank, its capitals and lookalikes; a date its
    days; a repeat its unit and how often; a walk its start and its turns; other characters
    one by one; and the kind of each stretch, where characters in a row are one. ``prefixes``
    are the sorted words, to stop where no word goes on.
    """
    n = len(value)
    low = value.lower()
    plain = low.translate(LOOKALIKES)
    # From each place: (end, kind, cost without that of the kind).
    options: list[list[tuple[int, str, float]]] = [[] for _ in range(n)]
    for i in range(n):
        for text, extra in ((low, 0.0), (plain, 1.0)) if plain != low else ((low, 0.0),):
            for j in range(i + 3, min(n, i + LONGEST_WORD) + 1):
                part = text[i:j]
                k = bisect.bisect_left(prefixes, part)
                if k == len(prefixes) or not prefixes[k].startswith(part):
                    break
                if part in ranks:
                    own = value[i:j]
                    case = 0.0 if own == low[i:j] else 0.3 if own[0].isupper() and own[1:] == low[i + 1 : j] or own.isupper() else 0.3 * sum(c.isupper() for c in own) + 0.3
                    options[i].append((j, "word", log10(ranks[part] + 1) + case + extra))
        m = DATE.match(value, i)
        if m:
            options[i].append((m.end(), "date", log10(366 * 200) if m.end() - i > 4 else log10(200)))
    i = 0
    while i < n - 2:  # longest walks; a shorter one is a walk too
        j, turns, last = i + 1, 0, None
        while j < n and (s := steps(value[j - 1], value[j])) is not None:
            turns += s != last
            last = s
            if j - i >= 2:
                options[i].append((j + 1, "walk", log10(47) + turns * TURN + log10(j - i + 1)))
            j += 1
        i = j - 1 if j - i > 2 else i + 1
    best: list[tuple[float, int, str]] = [(0.0, -1, "")] + [(inf, -1, "")] * n  # cost, where the stretch starts, kind
    loose = [inf] * (n + 1)  # the cost where the last stretch is of single characters
    loose_at = [-1] * (n + 1)
    reach = [0] * 9  # for each period, how far the text repeats itself
    for i in range(n):
        here = best[i][0]
        for cost, start in ((here + KIND, i), (loose[i], loose_at[i])):
            if cost + brute(value[i]) < loose[i + 1]:
                loose[i + 1], loose_at[i + 1] = cost + brute(value[i]), start
        if loose[i + 1] < best[i + 1][0]:
            best[i + 1] = (loose[i + 1], loose_at[i + 1], "brute")
        for j, kind, cost in options[i]:
            if here + KIND + cost < best[j][0]:
                best[j] = (here + KIND + cost, i, kind)
        for period in range(1, 9):
            if i + 2 * period > n:
                break
            if reach[period] < i + period:
                reach[period] = i + period
            while reach[period] < n and value[reach[period]] == value[reach[period] - period]:
                reach[period] += 1
            times = (reach[period] - i) // period
            unit = sum(map(brute, value[i : i + period]))
            # Each whole number of times, up to a few; the rest only as the longest.
            for t in {*range(2, min(times, 8) + 1), times} if times >= 2 else ():
                cost = here + KIND + unit + log10(t)
                if cost < best[i + t * period][0]:
                    best[i + t * period] = (cost, i, "repeat")
    found, j = [], n
    while j > 0:
        _, i, kind = best[j]
        found.append((kind, i, j))
        j = i
    return best[n][0], found[::-1]


def vocabulary(path: str) -> dict[str, int]:
    """Words of three letters or more of a byte-pair vocabulary, lower-cased, by rank; its merges come by falling frequency."""
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    ranks: dict[str, int] = {}
    for token, n in sorted(vocab.items(), key=lambda x: x[1]):
        word = token.removeprefix("Ġ").lower()
        if len(word) >= 3 and word.isascii() and word.isalpha() and len(word) <= LONGEST_WORD:
            ranks.setdefault(word, len(ranks))
    return ranks


def spans_of(text: str, ranks: dict[str, int], prefixes: list[str], least_cost: float) -> list[dict]:
    """The spans of a text: those of the fixed patterns and, kind "value", costly values that share no character with them."""
    found = []
    for kind, (pattern, least) in BASE.items():
        for m in pattern.finditer(text):
            a, b = m.span(2 if kind == "assign" else 0)
            if b - a >= least:
                found.append({"kind": kind, "start": m.start(), "end": m.end(), "value": text[a:b]})
    covered = sorted((s["start"], s["end"]) for s in found)
    ends = []  # the furthest end so far, as spans of two kinds may overlap
    for _, e in covered:
        ends.append(max(e, ends[-1] if ends else 0))
    for m in CONTEXT.finditer(text):
        a, b = m.span(1)
        k = bisect.bisect_left(covered, (b, -1))
        if not (k and ends[k - 1] > a):
            found.append({"kind": "value", "start": a, "end": b, "value": text[a:b]})
    for s in found:
        s["cost"], parts = guess_cost(s["value"], ranks, prefixes)
        s["parts"] = ",".join(f"{k}:{i}:{j}" for k, i, j in parts)
    order = {k: n for n, k in enumerate((*BASE, "value"))}
    return sorted((s for s in found if s["kind"] != "value" or s["cost"] >= least_cost), key=lambda s: (s["start"], order[s["kind"]]))


def secret_spans(docs: DataFrame, words_path: str, least_cost: float = 14.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans) for every row of ``docs``; spans are (kind, start, end, value, cost, parts) by start and kind.

    ``assign``, ``access`` and ``hex`` are matches of the fixed patterns, found from the left
    without overlap in each kind; too short ones are dropped. ``value`` are values in a
    credential context that overlap none of these and take 10 ** ``least_cost`` guesses. Every
    span has its cost (log 10) and the parts of its cheapest segmentation. Places count code
    points, the end not included. ``words_path`` is a byte-pair vocabulary file at the same
    place on every machine, whose words rank by its order. Null and empty texts have no spans;
    null ids and repeated rows are kept; ids keep their type; further columns are not read.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    span = "struct<kind:string,start:long,end:long,value:string,cost:double,parts:string>"
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string()), ("cost", pa.float64()), ("parts", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = vocabulary(words_path)
        prefixes = sorted(ranks)
        for b in batches:
            found = [spans_of(t.as_py() or "", ranks, prefixes, least_cost) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, kind)], names=["id", "spans"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string")).mapInArrow(run, f"id {id_type}, spans array<{span}>")
