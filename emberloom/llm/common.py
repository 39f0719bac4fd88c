"""Shared pieces of the training-data operators: scratch tables, whole-text
word hashing in numpy, and connected components.

Word hashing never loops over words in Python: a batch of texts is joined into
one byte buffer, words are the runs between separator bytes, and each word's
hash is a polynomial over its bytes taken as a difference of prefix sums.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy pass takes at a time.
CHUNK_BYTES = 1 << 20

_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 1 << 64)
_S33 = np.uint64(33)


#: The folder that stage_table() writes to while a scratch_scope() is open.
_SCOPE: ContextVar[str | None] = ContextVar("scope", default=None)


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named in spark.checkpoint.dir. Where that is unset, a local session, whose
    executor is the driver, gets a private one; on a cluster there is an error, as a folder chosen
    here would be another on each machine."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark._jsc.sc().isLocal():
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="emberloom-"))
        root = spark.sparkContext.getCheckpointDir()
    return root.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the scratch folder, if it is there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def scratch_scope(spark: SparkSession, label: str) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Tables staged inside go when the scope ends; the function that it gives stages one that lasts longer."""
    outer, folder = _SCOPE.get() or scratch_root(spark), f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"
    token = _SCOPE.set(folder)
    try:
        yield lambda df, name: stage_table(df, name, outer)
    finally:
        _SCOPE.reset(token)
        remove(spark, folder)


def stage_path(spark: SparkSession, label: str, folder: str | None = None) -> str:
    """A new folder's name in the given one, the open scope's or the scratch folder."""
    return f"{folder or _SCOPE.get() or scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


def stage_table(df: DataFrame, label: str, folder: str | None = None) -> DataFrame:
    """Write df as Parquet in the shared scratch folder and read it back: cuts
    lineage in a way that survives the loss of any executor."""
    path = stage_path(df.sparkSession, label, folder)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(name: str, taken: Iterable[str]) -> str:
    """name, or name_2, name_3 and so on: the first that is no column yet (in any case of letters)."""
    held, out, k = {c.lower() for c in taken}, name, 1
    while out.lower() in held:
        k += 1
        out = f"{name}_{k}"
    return out


def columns(df: DataFrame) -> list[Column]:
    """All columns of df, by names that may hold dots."""
    return [column(c) for c in df.columns]


def column(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def join_hot(rows: DataFrame, groups: DataFrame, key: str) -> DataFrame:
    """rows joined by an integer key with groups, which are aggregated by it. The plain join would use
    the aggregation's partitions as they are, and adaptive execution splits a hot key's rows only
    where both sides are shuffled for the join itself: the complement of the key makes it so."""
    other = f"{key}_{uuid.uuid4().hex}"
    groups = groups.withColumn(other, F.bitwise_not(key)).drop(key)
    return rows.join(groups, F.bitwise_not(rows[key]) == groups[other]).drop(other)


def filter_rows(df: DataFrame, text_col: str, judge: Callable[[], Callable[[list[str | None]], list[bool]]]) -> DataFrame:
    """The rows of df, all columns of any name, for whose texts a judge says so. judge() makes one in each task."""
    plain = df.toDF(*[f"c{k}" for k in range(len(df.columns))])  # mapInArrow looks columns up by name
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = judge()
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(keep(batch.column(at).to_pylist()), pa.bool_()))

    return plain.mapInArrow(run, plain.schema).toDF(*df.columns)


def separators(words: str = "space") -> np.ndarray:
    """256 booleans: which bytes separate words. "space" is [\\x20\\x09-\\x0D];
    "alnum" makes every ASCII byte other than a letter or digit a separator."""
    sep = np.zeros(256, bool)
    if words == "space":
        sep[[0x20, *range(0x09, 0x0E)]] = True
    else:
        sep[:128] = [not chr(b).isalnum() for b in range(128)]
    return sep


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; equal inputs stay equal, bits spread."""
    h = h ^ (h >> _S33)
    h = h * _M1
    h ^= h >> _S33
    h *= _M2
    h ^= h >> _S33
    return h


class Hasher:
    """Hashes of all words of a batch of texts, with the text each belongs to."""

    def __init__(self, words: str = "space"):
        self.sep = separators(words)
        self.table = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
        self.pow = self.inv = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.pow) < n:
            n = max(n, 2 * len(self.pow))
            for name, base in (("pow", _BASE), ("inv", _BASE_INV)):
                p = np.full(n, base, np.uint64)
                p[0] = 1
                setattr(self, name, np.multiply.accumulate(p))

    def words(self, buf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash, start, end) of each word of a byte buffer."""
        ok = np.zeros(len(buf) + 2, np.int8)
        ok[1:-1] = ~self.sep[buf]
        edges = np.flatnonzero(ok[1:] != ok[:-1])
        starts, ends = edges[0::2], edges[1::2]
        out = np.empty(len(starts), np.uint64)
        at = 0
        while at < len(starts):  # whole words, about CHUNK_BYTES at a time
            to = max(at + 1, int(np.searchsorted(ends, starts[at] + CHUNK_BYTES, "right")))
            lo, hi = int(starts[at]), int(ends[to - 1])
            self._powers(hi - lo + 1)
            sums = np.zeros(hi - lo + 1, np.uint64)
            np.cumsum(self.table[buf[lo:hi]] * self.pow[: hi - lo], out=sums[1:])
            out[at:to] = (sums[ends[at:to] - lo] - sums[starts[at:to] - lo]) * self.inv[starts[at:to] - lo]
            at = to
        return mix(out), starts, ends

    def batch(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(hash, start, end) of all words in the texts joined by a newline, and
        for each text its first word's index (one more entry at the end) and its offset."""
        lens = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        offs = np.concatenate(([0], np.cumsum(lens)))
        h, s, e = self.words(np.frombuffer(b"\n".join(texts), np.uint8))
        return h, s, e, np.searchsorted(s, offs), offs


def ngrams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n consecutive word hashes (len(h) - n + 1 of them)."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    out = h[: len(h) - n + 1].copy()
    for j in range(1, n):
        out *= np.uint64(_BASE)
        out += h[j : len(h) - n + 1 + j]
    return mix(out)


def text_chunks(ids, texts, limit: int = CHUNK_BYTES) -> Iterator[tuple[list, list[bytes]]]:
    """(ids, UTF-8 texts) in runs of about `limit` bytes; a null text is None."""
    keys, held, size = [], [], 0
    for k, t in zip(ids, texts, strict=True):
        b = None if t is None else t.encode("utf-8", "replace")
        keys.append(k)
        held.append(b)
        size += len(b or b"")
        if size >= limit:
            yield keys, held
            keys, held, size = [], [], 0
    if keys:
        yield keys, held


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every end of an edge; component is the smallest node reachable.

    Minimum labels with pointer jumping; each round is a written table, nothing
    is collected but the count of changed labels. No edges give no rows."""
    spark = edges.sparkSession
    with scratch_scope(spark, "components") as keep:
        two = edges.select(F.col(a).alias("x"), F.col(b).alias("y"))
        two = stage_table(two.union(two.select("y", "x")).distinct(), "edges")
        lab = stage_table(two.groupBy(F.col("x").alias("node")).agg(F.least(F.min("y"), F.col("x")).alias("component")), "labels")
        while True:
            near = two.join(lab, two.y == lab.node).groupBy("x").agg(F.min("component").alias("near"))
            hop = lab.select(F.col("node").alias("via"), F.col("component").alias("far"))
            step = lab.join(near, lab.node == near.x, "left").join(hop, F.col("component") == F.col("via"), "left")
            new = stage_table(step.select("node", F.least("component", "near", "far").alias("component"), F.col("component").alias("old")), "labels")
            lab = new.select("node", "component")
            if not new.filter("component < old").limit(1).count():
                return keep(lab, "labels")
