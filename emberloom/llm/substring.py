"""Substring deduplication by suffix automata of reference shards.

A passage of at least `span_words` consecutive words that also starts in a
document with a smaller id is removed. A generalised suffix automaton over words
holds a shard of reference text; each of its states knows the smallest document
that its words occur in. Documents stream through the automaton for matching
statistics, and where the match is at least `span_words` long and the state's
document is smaller, the span is covered.

The reference is the text that can match at all: of each stretch of words that shares
a hashed k-gram with another document, the first document's. Hashes only say what
cannot match and where the rest goes; every removed window is found by an automaton.
An automaton of a whole corpus has no size bound and streaming every document past
every shard is quadratic, so shards are formed by content. Every window of
`span_words` words is owned by its minimiser, the k-gram of smallest hash in it.
Equal windows have equal minimisers, so a shard of whole minimiser groups meets all
that can match there, and only the stretches of documents that belong to it are
streamed past it, equal ones once. Minimisers that occur in one document only are
dropped first. A stretch that is the only one of its minimiser can match its own copies
only, so any shard will do: it goes into an automaton of the batch that holds it, and
its words are not shuffled. A minimiser in more than `hot_anchor` documents is dealt out again by
whole windows: equal windows collapse to one reference row, so no group grows with a
frequent phrase.

Where all texts together have at most `broadcast_bytes`, they are the reference as they
are: automata of shards of them are broadcast, and every document streams past each.

Defined results: null text has no words and keeps the empty string; empty or
short texts lose nothing; a row with null id loses nothing and is nobody's
reference; repeated rows of one id are judged alike, as equal is not smaller;
extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, Hasher, column, join_hot, mix, ngrams, text_chunks

ANCHOR_WORDS = 4


class SuffixAutomaton:
    """Generalised suffix automaton over word sequences added in ascending order
    of document: a state's document is then the smallest that holds its words."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link, self.length, self.low = [-1], [0], [None]

    def _state(self, moves: dict, length: int, link: int, low) -> int:
        self.next.append(moves)
        self.length.append(length)
        self.link.append(link)
        self.low.append(low)
        return len(self.link) - 1

    def _split(self, p: int, c, q: int) -> int:
        """The state for p's words and c, cut out of the longer state q."""
        nxt = self.next
        clone = self._state(nxt[q].copy(), self.length[p] + 1, self.link[q], self.low[q])
        self.link[q] = clone
        while p >= 0 and nxt[p].get(c) == q:
            nxt[p][c] = clone
            p = self.link[p]
        return clone

    def add(self, words: list, low) -> None:
        nxt, link, length = self.next, self.link, self.length
        last = 0
        for c in words:
            q = nxt[last].get(c)
            if q is not None:
                last = q if length[q] == length[last] + 1 else self._split(last, c, q)
                continue
            new = self._state({}, length[last] + 1, 0, low)
            p = last
            while p >= 0 and c not in nxt[p]:
                nxt[p][c] = new
                p = link[p]
            if p >= 0:
                q = nxt[p][c]
                link[new] = q if length[q] == length[p] + 1 else self._split(p, c, q)
            last = new

    def first_documents(self, words: list, span: int) -> list:
        """For each window of `span` words: the smallest document that it occurs in, or None."""
        nxt, link, length, low = self.next, self.link, self.length, self.low
        out, v, n = [], 0, 0
        for i, c in enumerate(words):
            while v and c not in nxt[v]:
                v = link[v]
                n = length[v]
            q = nxt[v].get(c)
            if q is None:
                v = n = 0
            else:
                v, n = q, n + 1
                while length[link[v]] >= span:  # the state of the last `span` words
                    v = link[v]
                    n = length[v]
            if i + 1 >= span:
                out.append(low[v] if n >= span else None)
        return out


def _runs(hasher: Hasher, held: list[bytes], span: int):
    """Runs of windows with one owning minimiser: (anchor hash, text, first word, windows),
    words counted over all texts, and the batch's word hashes and offsets."""
    h, s, e, first, _ = batch = hasher.batch(held)
    m = len(h) - span + 1
    if m <= 0:
        none = np.empty(0, np.int64)
        return none.view(np.uint64), none, none, none, batch
    doc = np.repeat(np.arange(len(held)), np.diff(first))
    g = ngrams(h, ANCHOR_WORDS)
    best, pos = g[:m].copy(), np.zeros(m, np.int8)
    for j in range(1, span - ANCHOR_WORDS + 1):
        less = g[j : j + m] < best
        np.copyto(best, g[j : j + m], where=less)
        pos[less] = j
    at = np.flatnonzero(doc[:m] == doc[span - 1 :])
    owner = at + pos[at]
    new = np.ones(len(at), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (doc[at[1:]] != doc[at[:-1]])
    begin = np.flatnonzero(new)
    n = np.diff(np.append(begin, len(at)))
    at = at[begin]
    return best[at], doc[at], at, n, batch


def _tag(doc: np.ndarray, *parts: np.ndarray) -> np.ndarray:
    """One number for a text of the batch and some hashes."""
    out = mix(doc.astype(np.uint64) + np.uint64(1))
    for x in parts:
        out = mix(out ^ x)
    return out


def _lists(lists, dtype=np.int64) -> tuple[np.ndarray, np.ndarray]:
    """The texts' lists (None: empty) as one array, and the text of each entry."""
    sizes = [0 if x is None else len(x) for x in lists]
    held = [np.asarray(x, dtype) for x, n in zip(lists, sizes, strict=True) if n]
    return np.concatenate(held) if held else np.empty(0, dtype), np.repeat(np.arange(len(sizes)), sizes)


def _hashes(hasher: Hasher, h: np.ndarray, at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A hash of the n words from each place."""
    hasher._powers(len(h) + 1)
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * hasher.pow[: len(h)], out=sums[1:])
    return mix((sums[at + n] - sums[at]) * hasher.inv[at] + n.astype(np.uint64))


def _windows(h: np.ndarray, hasher: Hasher, at: np.ndarray, n: np.ndarray, doc: np.ndarray, span: int):
    """Each window of the runs on its own: (key, the same as hash, text, first word)."""
    at = np.repeat(at - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum()) if len(n) else at
    hashes = _hashes(hasher, h, at, np.full(len(at), span, np.int64))
    return hashes, hashes, np.repeat(doc, n), at


def _anchors(span: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = Hasher()
        for pdf in batches:
            for ids, held in text_chunks(pdf["id"], pdf["text"]):
                a, d, *_ = _runs(hasher, held, span)
                _, one = np.unique(_tag(d, a), return_index=True)
                yield pd.DataFrame({"anchor": a[one].view(np.int64), "id": np.asarray(ids, np.int64)[d[one]]})

    return run


def _pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Texts as compressed bytes: they are shuffled once and read by three steps."""
    codec = pa.Codec("zstd", compression_level=3)
    for pdf in batches:
        raw = [None if t is None else t.encode("utf-8", "replace") for t in pdf["text"]]
        packed = [x and codec.compress(x, asbytes=True) for x in raw]
        yield pd.DataFrame({"id": pdf["id"], "size": [-1 if x is None else len(x) for x in raw], "packed": packed})


def _unpack(size: int, packed) -> bytes:
    return pa.decompress(bytes(packed), size, "zstd", asbytes=True) if size > 0 else b""


def _with_lists(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, list[bytes]]]:
    """Rows that have a text and lists, in runs of about CHUNK_BYTES."""
    for pdf in batches:
        pdf = pdf[pdf["list"].notna() & (pdf["size"] > 0)]
        begin, held, total = 0, [], 0
        for i, (size, packed) in enumerate(zip(pdf["size"].tolist(), pdf["packed"], strict=True), 1):
            held.append(_unpack(size, packed))
            total += size
            if total >= CHUNK_BYTES:
                yield pdf.iloc[begin:i], held
                begin, held, total = i, [], 0
        if held:
            yield pdf.iloc[begin:], held


#: So many heads are held in a task until equal ones are combined and sent.
HEADS = 400_000


def _heads(held: list[tuple[np.ndarray, ...]]) -> pd.DataFrame:
    """Of equal stretches (key, seg, id), the first document and the last."""
    key, seg, ids = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.lexsort((ids, seg, key))
    k, s = key[order], seg[order]
    edge = np.concatenate(([True], (k[1:] != k[:-1]) | (s[1:] != s[:-1]), [True])) if len(order) else np.zeros(1, bool)
    one, last = order[edge[:-1]], order[edge[1:]]
    return pd.DataFrame({"key": key[one].view(np.int64), "seg": seg[one].view(np.int64), "id": ids[one], "last": ids[last]})


def _occurrences(span: int, firsts: bool = False):
    """The stretches of texts that belong to shared anchors; hot ones window by window (key = seg).
    pos holds the first word in the text and, above it, a checksum of the text.
    firsts: of a task's equal stretches once, with the first document and the last."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher, heads = Hasher(), []
        for part, held in _with_lists(batches):
            a, d, at, n, (h, _, _, first, _) = _runs(hasher, held, span)
            shared, of = _lists(part["list"])
            hot, _ = _lists(part["hot"], bool)
            want, tag = _tag(of, shared.view(np.uint64)), _tag(d, a)
            is_hot = np.isin(tag, want[hot])
            cold = np.isin(tag, want) & ~is_hot
            whole = _windows(h, hasher, at[is_hot], n[is_hot], d[is_hot], span)
            key = np.concatenate((a[cold], whole[0]))
            seg = np.concatenate((_hashes(hasher, h, at[cold], n[cold] + span - 1), whole[1]))
            doc = np.concatenate((d[cold], whole[2]))
            ids = part["id"].to_numpy(np.int64)[doc]
            if firsts:
                heads.append((key, seg, ids))
                if sum(len(x[0]) for x in heads) >= HEADS:
                    yield _heads(heads)
                    heads = []
                continue
            start = np.concatenate((at[cold], whole[3])) - first[doc]
            sums = np.array([_checksum(x) for x in held], np.int64)
            yield pd.DataFrame({"key": key.view(np.int64), "seg": seg.view(np.int64), "id": ids, "pos": (sums[doc] << 32) | start})
        if heads:
            yield _heads(heads)

    return run


def _checksum(raw: bytes) -> int:
    return zlib.crc32(raw) >> 1


def _judge(rows: list[tuple], span: int) -> pd.DataFrame:
    """The stretches (document, key, seg, words) of a reference shard past its automaton: for each
    stretch, runs of n windows from the o-th on whose first document is low."""
    auto, out = SuffixAutomaton(), []
    for low, _, _, words in sorted(rows, key=lambda r: r[0]):
        auto.add(words, low)
    for key, seg, words in {(key, seg): (key, seg, words) for _, key, seg, words in rows}.values():
        first = np.array(auto.first_documents(words, span), np.int64)
        o = np.flatnonzero(np.concatenate(([True], first[1:] != first[:-1])))
        out += [(key, seg, first[a], None, a, b - a) for a, b in zip(o.tolist(), [*o[1:].tolist(), len(first)], strict=True)]
    return pd.DataFrame(out, columns=["key", "seg", "low", "words", "o", "n"])


def _references(span: int, shard_words: int):
    """The words of the stretches that a text is the first to hold. Those that are alone in their
    minimiser, whose copies no other shard can match, are judged here, in an automaton of the batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher, step = Hasher(), max(1, shard_words // span)
        for part, held in _with_lists(batches):
            a, d, at, n, (h, s, e, _, _) = _runs(hasher, held, span)
            keys, of = _lists(part["list"])
            segs, _ = _lists(part["segs"])
            lone, _ = _lists(part["lone"], bool)
            want = _tag(of, keys.view(np.uint64), segs.view(np.uint64))
            seg = _hashes(hasher, h, at, n + span - 1)
            found = [(a, seg, d, at, n + span - 1)]
            if (keys == segs).any():
                pick = np.isin(d, of[keys == segs])
                found.append((*_windows(h, hasher, at[pick], n[pick], d[pick], span), None))
            buf, here = b"\n".join(held), []
            for key, seg, d, at, n in found:
                tag = _tag(d, key, seg)
                _, one = np.unique(tag, return_index=True)
                one = one[np.isin(tag[one], want)]
                alone = np.isin(tag[one], want[lone])
                n = np.full(len(one), span) if n is None else n[one]
                text = np.array([buf[x:y] for x, y in zip(s[at[one]].tolist(), e[at[one] + n - 1].tolist(), strict=True)], object)
                key, seg, low = key[one].view(np.int64), seg[one].view(np.int64), part["id"].to_numpy(np.int64)[d[one]]
                here += zip(low[alone].tolist(), key[alone].tolist(), seg[alone].tolist(), map(bytes.split, text[alone]), strict=True)
                yield pd.DataFrame({"key": key[~alone], "seg": seg[~alone], "low": low[~alone], "words": text[~alone], "o": 0, "n": 0})
            for i in range(0, len(here), step):
                yield _judge(here[i : i + step], span)

    return run


def _shards(span: int, shard_words: int):
    """Automata of reference shards; the input comes in order of key. Rows judged before pass."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, size, last = [], 0, None
        for pdf in batches:
            done = pdf["words"].isna()
            yield pdf[done].drop(columns="words")
            pdf = pdf[~done]
            for key, seg, words, low in zip(pdf["key"].tolist(), pdf["seg"].tolist(), pdf["words"], pdf["low"].tolist(), strict=True):
                if key != last and size >= shard_words:
                    yield _judge(rows, span).drop(columns="words")
                    rows, size = [], 0
                words = bytes(words).split()
                rows.append((low, key, seg, words))
                size += len(words)
                last = key
        if rows:
            yield _judge(rows, span).drop(columns="words")

    return run


def _cut(span: int, keep_text: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for i, size, packed, starts, sizes in zip(pdf["id"], pdf["size"].tolist(), pdf["packed"], pdf["starts"], pdf["sizes"], strict=True):
                raw = _unpack(size, packed)
                words = raw.split()
                n, spans = len(words), []
                if starts is not None and size > 0:
                    at, run = np.asarray(starts, np.int64), np.asarray(sizes, np.int64)
                    own = at >> 32 == _checksum(raw)
                    at, run = at[own] & 0xFFFFFFFF, run[own]
                    hit = np.zeros(n + 1, np.int32)
                    np.add.at(hit, at, 1)
                    np.add.at(hit, at + run + span - 1, -1)
                    gone = np.cumsum(hit[:n]) > 0
                    edges = np.flatnonzero(np.diff(np.concatenate(([0], gone.view(np.int8), [0])))).tolist()
                    spans = [{"start": a, "end": b} for a, b in zip(edges[0::2], edges[1::2], strict=True)]
                    words = [w for w, g in zip(words, gone, strict=True) if not g]
                kept = b" ".join(words)
                row = (i, n, n - len(words), hashlib.sha256(kept).hexdigest(), spans)
                out.append((*row, kept.decode("utf-8")) if keep_text else row)
            cols = ["id", "n_words", "n_removed", "kept_sha256", "spans"] + ["kept_text"] * keep_text
            yield pd.DataFrame(out, columns=cols)

    return run


def _stream(span: int, shards: list[list[tuple[int, bytes]]]):
    """Documents past the automata of broadcast reference shards, each a list of (document, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automata = []
        for pdf in batches:
            for rows in shards[len(automata) :]:
                automata.append(SuffixAutomaton())
                for low, raw in rows:
                    automata[-1].add(raw.split(), low)
            out = []
            for i, size, packed in zip(pdf["id"].tolist(), pdf["size"].tolist(), pdf["packed"], strict=True):
                raw = _unpack(size, packed)
                words = raw.split()
                at = {k for auto in automata for k, low in enumerate(auto.first_documents(words, span)) if low is not None and low < i}
                out += [(i, (_checksum(raw) << 32) | k, 1) for k in at]
            yield pd.DataFrame(out, columns=["id", "pos", "n"]).astype("int64")

    return run


def _broadcast_spans(docs: DataFrame, packed: DataFrame, span: int, shard_words: int) -> DataFrame:
    """(id, pos, n): runs of windows that a smaller document holds, by automata of all texts; the caller has checked their size."""
    rows = sorted((r.id, r.text.encode("utf-8", "replace")) for r in docs.filter("id IS NOT NULL AND text IS NOT NULL").collect())
    shards, words = [], shard_words
    for i, raw in rows:
        if words >= shard_words:
            shards.append([])
            words = 0
        shards[-1].append((i, raw))
        words += raw.count(b" ") + 1
    return packed.filter("id IS NOT NULL").mapInPandas(_stream(span, shards), "id long, pos long, n long")


def _shuffled_spans(docs: DataFrame, packed: DataFrame, span: int, hot_anchor: int, shard_words: int) -> DataFrame:
    """(id, pos, n): runs of windows that a smaller document holds, by automata of content shards."""
    anchors = docs.filter("id IS NOT NULL AND text IS NOT NULL").mapInPandas(_anchors(span), "anchor long, id long")
    shared = anchors.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1").select("anchor", (F.col("n") > hot_anchor).alias("hot"))
    lists = join_hot(anchors, shared, "anchor").groupBy("id").agg(F.collect_list("anchor").alias("list"), F.collect_list("hot").alias("hot"))
    # All joins with packed are left joins of the same rows, so that their texts are shuffled once.
    listed = packed.join(lists, "id", "left")
    found = listed.mapInPandas(_occurrences(span), "key long, seg long, id long, pos long")
    # Different stretches of a minimiser, each named and sent to a shard by its first document.
    heads = listed.mapInPandas(_occurrences(span, firsts=True), "key long, seg long, id long, last long").repartition("key")
    firsts = heads.groupBy("key", "seg").agg(F.min("id").alias("low"), F.max("last").alias("last"))
    firsts = firsts.withColumn("lone", F.count("*").over(Window.partitionBy("key")) == 1).filter("NOT lone OR low < last")
    senders = firsts.groupBy(F.col("low").alias("id")).agg(F.collect_list("key").alias("list"), F.collect_list("seg").alias("segs"), F.collect_list("lone").alias("lone"))
    refs = packed.join(senders, "id", "left").mapInPandas(_references(span, shard_words), "key long, seg long, low long, words binary, o int, n int")
    shards = refs.repartition("key").sortWithinPartitions("key").mapInPandas(_shards(span, shard_words), "key long, seg long, low long, o int, n int")
    return found.join(shards, ["key", "seg"]).filter("low < id").select("id", (F.col("pos") + F.col("o")).alias("pos"), F.col("n").cast("long").alias("n"))


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span_words: int = 13, hot_anchor: int = 2048, shard_words: int = 20_000, broadcast_bytes: int = 1 << 21, keep_text: bool = True) -> DataFrame:
    """One row per row of docs: id, n_words, n_removed, kept_sha256, spans (start and
    end word of each maximal removed span) and, if keep_text, kept_text."""
    docs = docs.select(column(id_col).cast("long").alias("id"), column(text_col).cast("string").alias("text"))
    packed = docs.withColumn("id", F.col("id").cast("string")).mapInPandas(_pack, "id string, size int, packed binary").withColumn("id", F.col("id").cast("long"))
    if (docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) <= broadcast_bytes:
        spans = _broadcast_spans(docs, packed, span_words, shard_words)
    else:
        spans = _shuffled_spans(docs, packed, span_words, hot_anchor, shard_words)
    spans = spans.groupBy("id").agg(F.collect_list("pos").alias("starts"), F.collect_list("n").alias("sizes"))
    schema = "id string, n_words long, n_removed long, kept_sha256 string, spans array<struct<start:int,end:int>>" + ", kept_text string" * keep_text
    out = packed.join(spans, "id", "left").withColumn("id", F.col("id").cast("string")).mapInPandas(_cut(span_words, keep_text), schema)
    return out.withColumn("id", F.col("id").cast("long")).withColumnRenamed("id", id_col)
