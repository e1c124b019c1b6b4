"""Token counts by byte-pair merging with a heap and a linked list; no ids are made."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

#: Words kept with their counts in each worker; longer words are counted anew each time.
CACHE_WORDS, CACHE_CHARS = 400_000, 64
#: A blank beside white space or at an end. Other blanks stand alone before a word.
_ODD = re.compile(r"\s |^ | \s| \Z")


def byte_chars() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies.

    Printable bytes stand for themselves, the others in order for characters from 256 on.
    """
    printable = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    out, spare = [], 256
    for b in range(256):
        if b in printable:
            out.append(chr(b))
        else:
            out.append(chr(spare))
            spare += 1
    return out


class TokenCounter:
    """Counts tokens as the tokenizers library does for a byte-level BPE file."""

    def __init__(self, path: str, pattern: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        self.base = [vocab[c] for c in byte_chars()]
        self.rank, self.merged = {}, []
        for r, pair in enumerate(merges):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.rank.setdefault(vocab[a] << 32 | vocab[b], r)
            self.merged.append(vocab[a + b])
        self.pattern = regex.compile(pattern)
        special = [t["content"] for t in spec.get("added_tokens", [])]
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.words: dict[str, int] = {}
        self.plain: dict[str, int] = {}
        self.spaced: dict[str, int] = {}

    def word(self, word: str) -> int:
        """Tokens of one word: initial symbols minus merges."""
        data = word.encode("utf-8", "surrogatepass")
        n = len(data)
        if n < 2:
            return n
        symbols = [self.base[b] for b in data]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank, merged = self.rank.get, self.merged
        heap = [r * n + i for i in range(n - 1) if (r := rank(symbols[i] << 32 | symbols[i + 1])) is not None]
        heapify(heap)
        left = n
        while heap:
            r, i = divmod(heappop(heap), n)
            a, j = symbols[i], after[i]
            # Stale if either side was merged meanwhile.
            if a < 0 or j >= n or rank(a << 32 | symbols[j]) != r:
                continue
            symbols[i], symbols[j] = merged[r], -1
            left -= 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (q := rank(symbols[i] << 32 | symbols[k])) is not None:
                    heappush(heap, q * n + i)
            h = before[i]
            if h >= 0 and (q := rank(symbols[h] << 32 | symbols[i])) is not None:
                heappush(heap, q * n + h)
        return left

    def piece(self, text: str) -> int:
        total, words = 0, self.words
        for w in self.pattern.findall(text):
            c = words.get(w)
            if c is None:
                c = self.word(w)
                if len(w) <= CACHE_CHARS:
                    if len(words) >= CACHE_WORDS:
                        words.clear()
                    words[w] = c
            total += c
        return total

    def cached(self, store: dict[str, int], w: str, text: str) -> int:
        c = self.piece(text)
        if len(w) <= CACHE_CHARS:
            if len(store) >= CACHE_WORDS:
                store.clear()
            store[w] = c
        return c

    def ordinary(self, text: str) -> int:
        """Tokens of a text without special strings.

        The pattern takes a single blank along with the word after it, so that texts split
        at such blanks without a change.
        """
        if _ODD.search(text):
            return self.piece(text)
        first, *rest = text.split(" ")
        total = c if (c := self.plain.get(first)) is not None else self.cached(self.plain, first, first)
        get = self.spaced.get
        for w in rest:
            c = get(w)
            total += c if c is not None else self.cached(self.spaced, w, " " + w)
        return total

    def count(self, text: str) -> int:
        if self.special is None or not self.special.search(text):
            return self.ordinary(text) if text else 0
        parts = self.special.split(text)
        return len(parts) - 1 + sum(self.ordinary(p) for p in parts if p)


@lru_cache(maxsize=2)
def counter_of(tokenizer: str, pattern: str) -> TokenCounter:
    """A worker's counter, which its tasks share with all it remembers."""
    return TokenCounter(tokenizer, pattern)


def token_counts(docs: DataFrame, tokenizer: str, pattern: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_bytes, n_tokens, over_limit) for every row of ``docs``.

    ``tokenizer`` is a byte-level BPE file of the tokenizers library and ``pattern`` its
    word pattern. Special strings in texts count as one token, as is the library's default;
    none are added. Null texts count as empty: no bytes, no tokens. Repeated rows are all
    returned.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_of(tokenizer, pattern)
        for b in batches:
            n = [counter.count(t.as_py() or "") for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(n, pa.int64())], names=["id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
