"""Toxicity by a classifier chain of linear models.

Categories are predicted one after the other; the model of each also sees the
probabilities of the categories before it. In training those are out-of-fold
predictions, so that a later model meets the same kind of value that it will meet
in use. Features are the distinct words (runs of ASCII letters, digits and
non-ASCII bytes, lower-cased) of the whole text. For each category the
`n_features` words of largest chi-square in the sample enter a logistic
regression fitted by Newton's method with a ridge penalty. The last category's
threshold is the one of best F1 on the out-of-fold predictions.

Training takes a bounded sample, the `sample_rows` labelled rows of smallest id hash,
with all words of their texts; texts of equal words count once. Words are counted by
the executors; the driver gets the features of the sampled rows only. Scoring reads
every word of every text.

Defined results: null and empty texts have no words and get the score of the
intercepts; rows with a null label are not trained on; a category with one class
only (or no labelled row at all) scores its base rate, 0 without rows, and
rejects nothing; repeated rows score alike; extra columns pass through `clean`
and are ignored by `score`; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Hasher, column, filter_rows, scratch_scope, stage_table, text_chunks

SAMPLE_ROWS, N_FEATURES, FOLDS, RIDGE, LEAST_DOCS = 6000, 128, 5, 1.0, 5


@dataclass
class Link:
    """One category's model: weights of words, of the earlier categories and the intercept."""

    name: str
    words: np.ndarray
    weights: np.ndarray
    earlier: np.ndarray
    intercept: float


@dataclass
class Chain:
    links: list[Link]
    threshold: float

    def probabilities(self, hasher: Hasher, held: list[bytes | None]) -> np.ndarray:
        """A row for each text, a column for each category."""
        h, _, _, first, _ = hasher.batch([(x or b"").lower() for x in held])
        doc = np.repeat(np.arange(len(held)), np.diff(first))
        out = np.zeros((len(held), len(self.links)))
        for k, link in enumerate(self.links):
            z = np.full(len(held), link.intercept) + out[:, :k] @ link.earlier
            if len(link.words) and len(h):
                at = np.minimum(np.searchsorted(link.words, h), len(link.words) - 1)
                hit = link.words[at] == h
                pair = np.unique(doc[hit] * len(link.words) + at[hit])
                z += np.bincount(pair // len(link.words), link.weights[pair % len(link.words)], len(held))
            out[:, k] = 1 / (1 + np.exp(-z))
        return out


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of the columns of x and, last, the intercept."""
    x = np.hstack((x, np.ones((len(x), 1))))
    w, ridge = np.zeros(x.shape[1]), np.full(x.shape[1], RIDGE)
    ridge[-1] = 1e-6
    for _ in range(12):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + ridge * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), grad)
        w -= step * min(1.0, 5 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return w


def _predict(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))


def fit_chain(docs: list[np.ndarray], labels: np.ndarray, names: list[str]) -> Chain:
    """docs: each one's sorted distinct word hashes; labels: a 0/1 column for each name."""
    n = len(docs)
    flat = np.concatenate(docs) if n else np.empty(0, np.uint64)
    row = np.repeat(np.arange(n), [len(d) for d in docs]) if n else np.empty(0, np.int64)
    vocab, col = np.unique(flat, return_inverse=True)
    df = np.bincount(col, minlength=len(vocab)).astype(float)
    fold = np.arange(n) % FOLDS
    links, earlier, threshold = [], np.zeros((n, 0)), 0.5
    for k, name in enumerate(names):
        y = labels[:, k].astype(float)
        rate = float(y.mean()) if n else 0.0
        if n < 2 * FOLDS or rate in (0.0, 1.0):
            flatly = -30.0 if rate == 0 else 30.0 if rate == 1 else float(np.log(rate / (1 - rate)))
            links.append(Link(name, np.empty(0, np.uint64), np.empty(0), np.zeros(k), flatly))
            earlier, threshold = np.hstack((earlier, np.full((n, 1), rate))), 1.1
            continue
        with np.errstate(divide="ignore", invalid="ignore"):
            both = np.bincount(col, y[row], len(vocab))
            chi = (both - df * rate) ** 2 / (df * rate * (1 - rate) * (1 - df / n))
        chi[(df < LEAST_DOCS) | ~np.isfinite(chi)] = 0
        best = np.argsort(-chi, kind="stable")[:N_FEATURES]
        pick = np.sort(best[chi[best] > 0])
        place = np.full(len(vocab), -1)
        place[pick] = np.arange(len(pick))
        x = np.zeros((n, len(pick)))
        x[row[place[col] >= 0], place[col][place[col] >= 0]] = 1
        x = np.hstack((x, earlier))
        oof = np.empty(n)
        for f in range(FOLDS):
            oof[fold == f] = _predict(x[fold == f], _logistic(x[fold != f], y[fold != f]))
        w = _logistic(x, y)
        links.append(Link(name, vocab[pick], w[: len(pick)], w[len(pick) : -1], float(w[-1])))
        earlier = np.hstack((earlier, oof[:, None]))
        order = np.argsort(-oof, kind="stable")
        good = np.cumsum(y[order])
        f1 = 2 * good / (np.arange(1, n + 1) + y.sum())
        f1[:-1][oof[order][1:] == oof[order][:-1]] = -1  # a threshold does not part equal scores
        at = int(np.argmax(f1))
        threshold = float((oof[order[at]] + oof[order[min(at + 1, n - 1)]]) / 2)
    return Chain(links, threshold)


def _distinct_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The sorted distinct word hashes of each text, as bytes, and their digest."""
    hasher = Hasher("alnum")
    for pdf in batches:
        for ids, held in text_chunks(pdf.index, pdf["text"]):
            h, _, _, first, _ = hasher.batch([(x or b"").lower() for x in held])
            sets = [np.unique(h[a:b]).tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
            yield pdf.loc[ids].drop(columns="text").assign(words=sets, digest=[hashlib.md5(x).hexdigest() for x in sets])


def _count_words(ys: list[str]):
    """Of each word: the rows that have it, and those of each category among them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            words, at = np.unique(np.frombuffer(b"".join(map(bytes, pdf["words"])), np.int64), return_inverse=True)
            row = np.repeat(np.arange(len(pdf)), [len(x) // 8 for x in pdf["words"]])
            sums = {y: np.bincount(at, pdf[y].to_numpy(float)[row], len(words)) for y in ys}
            yield pd.DataFrame({"word": words, "n": np.bincount(at, minlength=len(words)).astype(float), **sums})

    return run


def train_chain(docs: DataFrame, labels: DataFrame, categories: dict[str, str], id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> Chain:
    """Fit on the labelled rows' sample. categories: name to a boolean SQL expression over labels, in chain order."""
    ys = [f"y{k}" for k in range(len(categories))]
    known = labels.select(column(id_col).cast("long").alias("id"), *[F.expr(c).cast("int").alias(y) for y, c in zip(ys, categories.values(), strict=True)]).dropna()
    sample = known.orderBy(F.xxhash64("id"), "id", *ys).limit(sample_rows)
    texts = docs.select(column(id_col).cast("long").alias("id"), column(text_col).cast("string").alias("text"))
    held = texts.join(F.broadcast(sample), "id")  # at most sample_rows rows
    sets = held.mapInPandas(_distinct_words, "id long, " + ", ".join(f"{y} int" for y in ys) + ", words binary, digest string")
    with scratch_scope(docs.sparkSession, "toxicity"):
        # Texts of equal words once, else a group of copies would teach its own words.
        once = sets.groupBy("digest").agg(F.min(F.struct("id", *ys)).alias("label"), F.first("words").alias("words"))
        rows = stage_table(once.orderBy("digest").limit(sample_rows).select("digest", "label.*", "words"), "sample")
        total = rows.agg(F.count("*").alias("n"), *[F.coalesce(F.sum(y), F.lit(0)).alias(y) for y in ys]).first()
        counts = rows.mapInPandas(_count_words(ys), "word long, n double, " + ", ".join(f"{y} double" for y in ys))
        counts = stage_table(counts.groupBy("word").agg(*[F.sum(c).alias(c) for c in ("n", *ys)]).filter(F.col("n") >= LEAST_DOCS), "words")
        picked: set[int] = set()
        for y in ys:  # the same choice as in fit_chain, which sees no other words then
            rate = total[y] / max(1, total.n)
            chi = F.expr(f"pow({y} - n * {rate!r}D, 2) / nullif(n * {rate * (1 - rate)!r}D * (1 - n / {total.n}D), 0D)")
            best = counts.select("word", chi.alias("chi")).filter("chi > 0").orderBy(F.desc("chi"), F.col("word").bitwiseXOR(F.lit(-(1 << 63)))).limit(N_FEATURES)
            picked |= {r.word for r in best.collect()}
        features = np.sort(np.array(sorted(picked), np.int64).view(np.uint64))

        def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                own = [np.frombuffer(x, np.uint64) for x in pdf["words"]]
                yield pdf.assign(words=[x[np.isin(x, features)].tobytes() for x in own])

        got = rows.mapInPandas(keep, rows.schema).orderBy("digest").collect()  # at most sample_rows short rows
    sets = [np.frombuffer(bytes(r.words), np.uint64) for r in got]
    return fit_chain(sets, np.array([[r[y] for y in ys] for r in got]).reshape(len(sets), len(ys)), list(categories))


def score(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, p_<category> for each category, rejected."""
    names = [f"p_{x.name}" for x in chain.links]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = Hasher("alnum")
        for pdf in batches:
            for ids, held in text_chunks(pdf["id"], pdf["text"]):
                p = chain.probabilities(hasher, held)
                yield pd.DataFrame({"id": ids, **dict(zip(names, p.T, strict=True)), "rejected": p[:, -1] >= chain.threshold})

    src = docs.select(column(id_col).cast("string").alias("id"), column(text_col).cast("string").alias("text"))
    out = src.mapInPandas(run, "id string, " + ", ".join(f"{n} double" for n in names) + ", rejected boolean")
    return out.withColumn("id", F.col("id").cast("long")).withColumnRenamed("id", id_col)


def clean(docs: DataFrame, chain: Chain, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, that the chain's last category does not reject."""

    def judge():
        hasher = Hasher("alnum")
        return lambda texts: np.concatenate([chain.probabilities(hasher, held)[:, -1] < chain.threshold for _, held in text_chunks(texts, texts)]).tolist()

    return filter_rows(docs, text_col, judge)
