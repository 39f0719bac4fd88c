"""Language identification by a byte convolutional network, in numpy.

A text's UTF-8 bytes, folded to 128 classes (letters by lower case, digits, other
ASCII, each continuation and lead byte), are cut into windows of WINDOW bytes.
Filters of several widths slide over a window, each keeps its largest response
(rectified), and a softmax layer turns those into language probabilities. A text's
probabilities are the mean over all its windows, weighted by their letters.

As the input is one-hot, a filter of width 4 is the sum of two looked-up values,
one for each pair of bytes, so that whole texts are scored by table look-ups.

Training is by Adam on a bounded sample: of each language that occurs `sample_docs`
rows at most (those of smallest id hash; fewer, but one at least, where all languages
together would exceed `sample_total`), and `sample_windows` windows of each, drawn from
the whole text.

Defined results: null, empty and letterless texts are `und` with score 0; rows
with a null language are not learned from; with no labelled row everything is
`und`; with one language, it is always predicted; a null doc_id is null in the
result; repeated rows score alike; extra columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import column, text_chunks

WINDOW, WIDTHS, FILTERS, CLASSES = 256, (2, 3, 4), 8, 128
SAMPLE_DOCS, SAMPLE_WINDOWS, SAMPLE_TOTAL = 500, 4, 20_000
#: Windows that are scored at once; longer texts are taken piece by piece.
PIECE = 4096
STEPS, BATCH, RATE, SEED = 500, 64, 0.01, 7


def byte_classes() -> np.ndarray:
    out = np.zeros(256, np.int64)
    for b in range(256):
        if chr(b).isascii():
            out[b] = 1 + ord(chr(b).lower()) - ord("a") if chr(b).isalpha() else 27 if chr(b).isdigit() else 0
        elif b < 0xC0:  # continuation bytes
            out[b] = 28 + b - 0x80
        else:  # lead bytes of two bytes, then of more
            out[b] = 92 + (b & 0x1F) if b < 0xE0 else 124 + min(3, (b - 0xE0) >> 2)
    return out


def windows(held: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Byte classes of all windows of the texts, padded with class 0, and each one's text."""
    n = np.array([-(-len(x) // WINDOW) for x in held], np.int64)
    buf = np.zeros(int(n.sum()) * WINDOW, np.uint8)
    at = 0
    for x, k in zip(held, n.tolist(), strict=True):
        buf[at : at + len(x)] = np.frombuffer(x, np.uint8)
        at += k * WINDOW
    return byte_classes()[buf].reshape(-1, WINDOW), np.repeat(np.arange(len(held)), n)


def letters(cls: np.ndarray) -> np.ndarray:
    return ((cls >= 1) & (cls <= 26) | (cls >= 28)).sum(axis=1)


@dataclass
class Network:
    langs: list[str]
    conv: list[np.ndarray]  # (width, CLASSES, FILTERS) for each width
    bias: np.ndarray
    dense: np.ndarray
    shift: np.ndarray

    def forward(self, cls: np.ndarray) -> np.ndarray:
        """Log probabilities of the windows."""
        flat = np.ascontiguousarray(cls).reshape(-1)
        pair = np.zeros(len(flat), np.int64)
        pair[:-1] = flat[:-1] * CLASSES + flat[1:]
        feats = np.empty((len(cls), self.dense.shape[0]), np.float32)
        a, b = np.empty(len(flat), np.float32), np.empty(len(flat), np.float32)
        for i, (w, conv) in enumerate(zip(WIDTHS, self.conv, strict=True)):
            for f in range(FILTERS):
                head = (conv[0, :, f][:, None] + conv[1, :, f][None, :]).ravel()
                np.take(head, pair, out=a, mode="clip")
                if w == 3:
                    np.take(np.ascontiguousarray(conv[2, :, f]), flat, out=b, mode="clip")
                elif w == 4:
                    np.take((conv[2, :, f][:, None] + conv[3, :, f][None, :]).ravel(), pair, out=b, mode="clip")
                if w > 2:
                    a[:-2] += b[2:]
                feats[:, i * FILTERS + f] = a.reshape(cls.shape)[:, : WINDOW - w + 1].max(axis=1)
        return _log_softmax(np.maximum(feats + self.bias, 0) @ self.dense + self.shift)

    def predict(self, held: list[bytes | None]) -> tuple[list[str], np.ndarray]:
        out, score = ["und"] * len(held), np.zeros(len(held))
        if not self.langs:
            return out, score
        p, total = np.zeros((len(held), len(self.langs))), np.zeros(len(held))
        for at, parts in _pieces(held):
            cls, part = windows(parts)
            weight, doc = letters(cls).astype(float), np.array(at)[part]
            np.add.at(p, doc, np.exp(self.forward(cls)) * weight[:, None])
            total += np.bincount(doc, weight, len(held))
        for i, x in enumerate(held):
            if total[i] and (cls_has_ascii(x) or any(c.isalpha() for c in x.decode("utf-8", "ignore"))):
                best = int(np.argmax(p[i]))
                out[i], score[i] = self.langs[best], min(1.0, p[i, best] / total[i])
        return out, score


def _pieces(held: list[bytes | None]) -> Iterator[tuple[list[int], list[bytes]]]:
    """The texts in runs of about PIECE windows, long ones cut between windows: (text, piece) lists."""
    at, parts, n = [], [], 0
    for i, x in enumerate(held):
        for a in range(0, len(x or b""), PIECE * WINDOW):
            at.append(i)
            parts.append(x[a : a + PIECE * WINDOW])
            n += -(-len(parts[-1]) // WINDOW)
            if n >= PIECE:
                yield at, parts
                at, parts, n = [], [], 0
    if parts:
        yield at, parts


def cls_has_ascii(raw: bytes) -> bool:
    """Whether a text has an ASCII letter, by far the usual case."""
    return raw.upper() != raw or raw.lower() != raw


def _log_softmax(z: np.ndarray) -> np.ndarray:
    z = z - z.max(axis=1, keepdims=True)
    return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def gradients(net: Network, x: np.ndarray, target: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """The mean cross entropy of windows and its derivatives by the filters, bias, dense and shift."""
    rows, at, raw = np.arange(len(x)), [], []
    for w, conv in zip(WIDTHS, net.conv, strict=True):
        r = sum(conv[j][x[:, j : WINDOW - w + 1 + j]] for j in range(w))
        best = r.argmax(axis=1)
        at.append(best)
        raw.append(np.take_along_axis(r, best[:, None, :], 1)[:, 0, :])
    z = np.hstack(raw) + net.bias
    h = np.maximum(z, 0)
    logs = _log_softmax(h @ net.dense + net.shift)
    p = np.exp(logs)
    p[rows, target] -= 1
    p /= len(x)
    dh = (p @ net.dense.T) * (z > 0)
    grads = []
    for i, w in enumerate(WIDTHS):
        g = np.zeros_like(net.conv[i])
        d = dh[:, i * FILTERS : (i + 1) * FILTERS]
        for j in range(w):
            np.add.at(g[j], (x[rows[:, None], at[i] + j], np.arange(FILTERS)[None, :]), d)
        grads.append(g)
    return -float(logs[rows, target].mean()), [*grads, dh.sum(axis=0), h.T @ p, p.sum(axis=0)]


def fit(samples: list[tuple[str, bytes]], steps: int = STEPS) -> Network:
    """Train on (language, window of bytes); batches draw the languages evenly."""
    langs = sorted({x for x, _ in samples})
    rng = np.random.default_rng(SEED)
    nf = FILTERS * len(WIDTHS)
    net = Network(langs, [rng.normal(0, 0.3, (w, CLASSES, FILTERS)).astype(np.float32) for w in WIDTHS], np.zeros(nf, np.float32), rng.normal(0, 0.3, (nf, max(1, len(langs)))).astype(np.float32), np.zeros(max(1, len(langs)), np.float32))
    if not langs:
        return net
    cls = windows([x[:WINDOW] or b" " for _, x in samples])[0]
    y = np.array([langs.index(x) for x, _ in samples])
    members = [np.flatnonzero(y == k) for k in range(len(langs))]
    params = [*net.conv, net.bias, net.dense, net.shift]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, steps + 1):
        pick = np.array([rng.choice(members[k]) for k in rng.integers(0, len(langs), BATCH)])
        _, grads = gradients(net, cls[pick], y[pick])
        rate = RATE * (1 - step / (steps + 1))
        for q, g, a, b in zip(params, grads, m, v, strict=True):
            a *= 0.9
            a += 0.1 * g
            b *= 0.999
            b += 0.001 * g * g
            q -= (rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net


def _sample_windows(count: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for key, lang, text in zip(pdf["key"], pdf["lang"], pdf["text"], strict=True):
                raw = text.encode("utf-8", "replace")
                n = max(1, len(raw) // WINDOW)
                rng = np.random.default_rng(key & 0xFFFFFFFF)
                for j, k in enumerate(sorted(rng.choice(n, min(n, count), replace=False).tolist())):
                    if len(cut := raw[k * WINDOW : (k + 1) * WINDOW]):
                        rows.append((key, lang, j, cut))
            yield pd.DataFrame(rows, columns=["key", "lang", "j", "cut"])

    return run


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_docs: int = SAMPLE_DOCS, sample_windows: int = SAMPLE_WINDOWS, sample_total: int = SAMPLE_TOTAL) -> Network:
    """Fit on the sample of docs with text and language; every language is learned."""
    key = F.xxhash64(column(id_col).cast("string"), F.lit(SEED)).alias("key")
    known = docs.filter(column(lang_col).isNotNull() & (F.length(F.trim(column(text_col))) > 0)).select(key, column(lang_col).alias("lang"), column(text_col).cast("string").alias("text"))
    langs = known.select("lang").distinct().count()
    share = max(1, min(sample_docs, sample_total // max(1, langs)))
    ranked = known.select("key", "lang").withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("key"))).filter(F.col("n") <= share)
    chosen = ranked.select("key", "lang").distinct()  # at most sample_total rows, or one a language
    cuts = known.join(F.broadcast(chosen), ["key", "lang"]).mapInPandas(_sample_windows(sample_windows), "key long, lang string, j int, cut binary")
    cuts = cuts.groupBy("key", "lang", "j").agg(F.min("cut").alias("cut"))  # repeated rows once
    return fit([(r.lang, bytes(r.cut)) for r in cuts.orderBy("key", "lang", "j").collect()])


def identify(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, lang_pred, score."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for ids, held in text_chunks(pdf["id"], pdf["text"]):
                lang, score = net.predict(held)
                yield pd.DataFrame({"id": ids, "lang_pred": lang, "score": score})

    src = docs.select(column(id_col).cast("string").alias("id"), column(text_col).cast("string").alias("text"))
    out = src.mapInPandas(run, "id string, lang_pred string, score double")
    return out.select(F.col("id").cast("long").alias(id_col), "lang_pred", "score")


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a document is kept from training: crc32 of its id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))
