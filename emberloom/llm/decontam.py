"""Benchmark decontamination by pigeonhole edit matching.

A benchmark item of m words may match with up to k = floor(error_rate * m) word
edits (substitutions, insertions, deletions). Its words are split into k + 1
pieces; wherever the item matches, at least one piece occurs unchanged. All piece
hashes are looked up at every word of every text; each hit gives a place where
the item may lie, and Myers' bit-parallel algorithm computes the item's true
distance there. Words are runs of letters, marks and digits of any script in the
lower-cased text, so case and punctuation do not count as edits; each character of a
script that is written without spaces is a word. Items of fewer than `exact_below`
words match without edits only.

The benchmark is taken in blocks of at most `block_bytes` of text; a block, of
that proven size, goes to all executors. Of several blocks one is handled after the
other, with a written table after each, so the driver holds one at a time.

Defined results: null and empty texts match nothing, nor do items that are null or have
no word; a null doc_id is reported as null;
repeated rows and repeated items are each reported; extra columns pass through
`drop_contaminated` and are ignored by `find_matches`; an empty table on either
side gives no matches.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, Hasher, column, filter_rows, ngrams, stage_path, stage_table

ERROR_RATE, EXACT_BELOW, BLOCK_BYTES = 0.25, 5, 8 << 20
_BITS = 20
# Beyond ASCII: what parts words, or (the group) is a word by itself: kana, Han, Thai, Lao, Khmer and Myanmar.
_PARTS = re.compile(r"([\u3005-\u3007\u3041-\u30ff\u3400-\u9fff\uf900-\ufaff\u0e01-\u0e30\u0e40-\u0e46\u0e81-\u0eb0\u1000-\u102a\u1780-\u17b3\U00020000-\U0003ffff])|[^\x00-\x7f\w\u0300-\u036f\u0900-\u1cff]")


def plain(text: str) -> bytes:
    """Lower-cased UTF-8 in which ASCII bytes other than letters and digits part the words."""
    low = text.lower()
    if not low.isascii():
        low = _PARTS.sub(lambda m: f" {m[1]} " if m[1] else " ", low)
    return low.encode("utf-8", "replace")


@dataclass
class Pattern:
    item: int
    m: int
    k: int
    masks: dict[int, int]

    def best(self, text: list[int]) -> tuple[int, int]:
        """(distance, end) of the item's best match that ends anywhere in text (Myers 1999)."""
        m = self.m
        full, top = (1 << m) - 1, 1 << (m - 1)
        pv, mv, d = full, 0, m
        best, end = m, 0
        for j, w in enumerate(text, 1):
            eq = self.masks.get(w, 0)
            xv = eq | mv
            xh = (((eq & pv) + pv) ^ pv) | eq
            ph = mv | (full & ~(xh | pv))
            mh = pv & xh
            if ph & top:
                d += 1
            elif mh & top:
                d -= 1
            ph, mh = (ph << 1) & full, (mh << 1) & full
            pv = mh | (full & ~(xv | ph))
            mv = ph & xv
            if d < best:
                best, end = d, j
        return best, end


@dataclass
class Index:
    """The pieces of a block of items by their length in words."""

    patterns: list[Pattern]
    pieces: dict[int, tuple[np.ndarray, np.ndarray, list[list[tuple[int, int]]]]] = field(default_factory=dict)

    @classmethod
    def of(cls, items: list[tuple[int, str]], error_rate: float, exact_below: int) -> Index:
        hasher, patterns = Hasher("alnum"), []
        by_len: dict[int, dict[int, list]] = defaultdict(lambda: defaultdict(list))
        for item, text in items:
            h = hasher.batch([plain(text or "")])[0]
            m = len(h)
            if not m:
                continue
            k = math.floor(error_rate * m) if m >= exact_below else 0
            masks: dict[int, int] = defaultdict(int)
            for j, w in enumerate(h.tolist()):
                masks[w] |= 1 << j
            cuts = [m * j // (k + 1) for j in range(k + 2)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                by_len[b - a][int(ngrams(h[a:b], b - a)[0])].append((len(patterns), a))
            patterns.append(Pattern(item, m, k, dict(masks)))
        out = cls(patterns)
        for n, found in by_len.items():
            keys = np.array(sorted(found), np.uint64)
            bits = np.zeros(1 << _BITS, bool)
            bits[keys >> np.uint64(64 - _BITS)] = True
            out.pieces[n] = keys, bits, [found[int(x)] for x in keys]
        return out

    def matches(self, hasher: Hasher, held: list[bytes]) -> list[list[tuple[int, int, int]]]:
        """For each text, (item, distance, end word) of every item that matches within its errors."""
        h, _, _, first, _ = hasher.batch(held)
        places: dict[tuple[int, int], list[int]] = defaultdict(list)
        for n, (keys, bits, found) in self.pieces.items():
            g = ngrams(h, n)
            at = np.flatnonzero(bits[g >> np.uint64(64 - _BITS)])
            key = np.minimum(np.searchsorted(keys, g[at]), len(keys) - 1)
            ok = keys[key] == g[at]
            at, key = at[ok], key[ok]
            doc = np.searchsorted(first, at, "right") - 1
            inside = at + n <= first[doc + 1]
            for x, q, d in zip(at[inside].tolist(), key[inside].tolist(), doc[inside].tolist(), strict=True):
                for p, offset in found[q]:
                    places[d, p].append(x - offset)
        out: list[list[tuple[int, int, int]]] = [[] for _ in held]
        for (d, p), starts in places.items():
            pattern = self.patterns[p]
            lo, hi, best = int(first[d]), int(first[d + 1]), None
            for a, b in _merged(sorted(starts), pattern.m, pattern.k):
                a = max(lo, a)
                score, end = pattern.best(h[a : min(hi, b)].tolist())
                if score <= pattern.k and (best is None or score < best[0]):
                    best = score, a + end - lo
            if best:
                out[d].append((pattern.item, *best))
        return out


def _merged(starts: list[int], m: int, k: int) -> Iterator[tuple[int, int]]:
    """Stretches that hold every match beginning near one of the starts."""
    a, b = starts[0] - k, starts[0] + m + k
    for s in starts[1:]:
        if s - k <= b and b - a < 8 * (m + 2 * k):
            b = s + m + k
        else:
            yield a, b
            a, b = s - k, s + m + k
    yield a, b


def _blocks(bench: DataFrame, item_col: str, text_col: str, block_bytes: int) -> tuple[int, Iterator[list[tuple[int, str]]]]:
    """How many blocks of about block_bytes of text the benchmark has, and their items, each read when it is asked for."""
    items = bench.select(column(item_col).cast("long").alias("item"), column(text_col).cast("string").alias("text")).filter("text IS NOT NULL")
    size = items.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    n = max(1, math.ceil(2 * size / block_bytes))
    parts = (items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k) if n > 1 else items for k in range(n))
    return n, ([(r.item, r.text) for r in part.collect()] for part in parts)


def find_matches(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", error_rate: float = ERROR_RATE, exact_below: int = EXACT_BELOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc id, item id, distance, end_word) of every item in every text that holds it."""
    src = docs.select(column(id_col).cast("string").alias("id"), column(text_col).cast("string").alias("text"))
    schema = "id string, item long, distance long, end_word long"

    def search(index: Index) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            hasher = Hasher("alnum")
            for pdf in batches:
                for ids, held in _chunks(pdf["id"], pdf["text"]):
                    got = index.matches(hasher, held)
                    rows = [(i, *g) for i, own in zip(ids, got, strict=True) for g in own]
                    res = pd.DataFrame(rows, columns=["id", "item", "distance", "end_word"])
                    res["item"] = res["item"].astype("Int64")
                    yield res

        return src.mapInPandas(run, schema)

    n, blocks = _blocks(bench, item_col, item_text_col, block_bytes)
    if n == 1:
        found = search(Index.of(next(blocks), error_rate, exact_below))
    else:
        folder = stage_path(docs.sparkSession, "benchmark-matches")
        for block in blocks:
            search(Index.of(block, error_rate, exact_below)).write.mode("append").parquet(folder)
        found = docs.sparkSession.read.schema(schema).parquet(folder)
    return found.select(F.col("id").cast("long").alias(id_col), F.col("item").alias(item_col), "distance", "end_word")


def drop_contaminated(docs: DataFrame, bench: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", error_rate: float = ERROR_RATE, exact_below: int = EXACT_BELOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs, all columns, whose texts hold no item."""

    def judge(index: Index):
        def make():
            hasher = Hasher("alnum")
            return lambda texts: [not own for _, held in _chunks(texts, texts) for own in index.matches(hasher, held)]

        return make

    n, blocks = _blocks(bench, item_col, item_text_col, block_bytes)
    for block in blocks:
        docs = filter_rows(docs, text_col, judge(Index.of(block, error_rate, exact_below)))
        if n > 1:
            docs = stage_table(docs, "decontaminated")
    return docs


def _chunks(ids, texts) -> Iterator[tuple[list, list[bytes]]]:
    """(ids, plain texts) in runs of about CHUNK_BYTES."""
    keys, held, size = [], [], 0
    for k, t in zip(ids, texts, strict=True):
        keys.append(k)
        held.append(plain(t or ""))
        size += len(held[-1])
        if size >= CHUNK_BYTES:
            yield keys, held
            keys, held, size = [], [], 0
    if keys:
        yield keys, held
