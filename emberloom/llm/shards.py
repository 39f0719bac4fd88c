"""A store of immutable shards with size-tiered compaction and versioned manifests.

Arrivals are appended as small Parquet shards. Compaction sorts the live shards
into tiers by size (powers of `ratio` below the target); where a tier holds
`min_run` shards or more, its shards, oldest first, are packed up to the target
size and each pack is rewritten as one file. A shard of at least half the target is final,
so a row is rewritten a few times at most. What readers see is the newest
manifest: a JSON file that lists the live shards. It is written under another
name and renamed to its version number, which fails if that version exists, so a
commit happens whole or not at all and one of two writers of a version loses.
Shards that no manifest version lists any more are removed by vacuum().

All files are reached through the Hadoop file system API, from the driver, and
their rows through Spark: a pack is one task, so a task handles the target size. Rows
are opaque: null columns, empty and long texts, repeated rows and extra columns of
any name are stored as they are; a shard column asked for is numbered (shard_2) if
the rows have one of that name. Rows of a null arrival are the arrival -1. An empty
arrival adds no shard (but a version); an empty store reads as an empty table.
"""

from __future__ import annotations

import json
import math
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name

#: The names of so many shards at most (some 10 MB) are broadcast; those of more are joined by shuffle.
BROADCAST_SHARDS = 50_000


class CommitConflict(RuntimeError):
    """Another writer has committed this version."""


@dataclass(frozen=True)
class Shard:
    path: str
    bytes: int
    arrival: int


class ShardStore:
    def __init__(self, spark: SparkSession, root: str, schema: T.StructType, target_bytes: int = 32 << 20, ratio: float = 4.0, min_run: int = 4, broadcast_shards: int = BROADCAST_SHARDS):
        self.spark, self.root, self.schema = spark, root.rstrip("/"), schema
        self.target, self.ratio, self.min_run, self.broadcast_shards = target_bytes, ratio, min_run, broadcast_shards
        self._hadoop = spark._jvm.org.apache.hadoop
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self._path(self.root).getFileSystem(self._conf)

    def _path(self, name: str):
        return self._hadoop.fs.Path(name)

    def _list(self, folder: str) -> list[tuple[str, int]]:
        if not self._fs.exists(self._path(folder)):
            return []
        return [(s.getPath().toString(), s.getLen()) for s in self._fs.listStatus(self._path(folder))]

    # -- manifests

    def version(self) -> int:
        """The newest committed version; 0 if there is none."""
        names = [p.rpartition("/")[2] for p, _ in self._list(f"{self.root}/manifests")]
        return max((int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json")), default=0)

    def shards(self, version: int | None = None) -> list[Shard]:
        version = self.version() if version is None else version
        if not version:
            return []
        stream = self._fs.open(self._path(f"{self.root}/manifests/v{version:08d}.json"))
        try:
            text = bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()
        return [Shard(**x) for x in json.loads(text)["shards"]]

    def commit(self, base: int, shards: list[Shard]) -> int:
        """Make `shards` the version after `base`, or raise CommitConflict."""
        temp = self._path(f"{self.root}/manifests/_{uuid.uuid4().hex}")
        out = self._fs.create(temp, False)
        try:
            out.write(bytearray(json.dumps({"version": base + 1, "shards": [asdict(s) for s in shards]}).encode()))
        finally:
            out.close()
        final = self._path(f"{self.root}/manifests/v{base + 1:08d}.json")
        options = self.spark.sparkContext._gateway.new_array(getattr(self._hadoop.fs, "Options$Rename"), 0)
        try:
            self._hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf).rename(temp, final, options)
        except Exception as e:
            self._fs.delete(temp, False)
            if "FileAlreadyExists" in str(e) or self._fs.exists(final):
                raise CommitConflict(f"version {base + 1} exists") from e
            raise
        return base + 1

    # -- writing

    def append(self, df: DataFrame, arrival: int = 0) -> int:
        """Add the rows of df as shards of one arrival and commit."""
        base = self.version()
        live = self.shards(base)
        folder = f"{self.root}/data/{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(folder)
        return self.commit(base, live + self._written(folder, arrival))

    def append_arrivals(self, df: DataFrame, arrival) -> int:
        """Add df as one arrival for each value (-1 for null) of the integer column expression
        `arrival`, all written in one pass, each committed as its own version, in order."""
        column = f"arrival_{uuid.uuid4().hex}"
        folder = f"{self.root}/data/{uuid.uuid4().hex}"
        df.withColumn(column, F.coalesce(arrival.cast("int"), F.lit(-1))).write.option("compression", "zstd").partitionBy(column).parquet(folder)
        version = self.version()
        for n, sub in sorted((int(p.rpartition("=")[2]), p) for p, _ in self._list(folder) if f"{column}=" in p):
            version = self.commit(version, self.shards(version) + self._written(sub, n))
        return version

    def _written(self, folder: str, arrival: int) -> list[Shard]:
        return [Shard(p, n, arrival) for p, n in sorted(self._list(folder)) if p.endswith(".parquet")]

    def tier(self, size: int) -> int:
        """0 for final shards, then 1 for those above target / (2 * ratio), and so on."""
        return max(0, math.ceil(math.log(self.target / 2 / max(1, size), self.ratio)))

    def plan(self, shards: list[Shard]) -> list[list[Shard]]:
        """The packs that compaction would rewrite now, each of two shards or more."""
        tiers: dict[int, list[Shard]] = {}
        for s in shards:
            if t := self.tier(s.bytes):
                tiers.setdefault(t, []).append(s)
        packs: list[list[Shard]] = []
        for t in sorted(tiers):
            if len(tiers[t]) < self.min_run:
                continue
            pack, size = [], 0
            for s in sorted(tiers[t], key=lambda s: (s.arrival, s.path)):
                if pack and size + s.bytes > self.target:
                    packs.append(pack)
                    pack, size = [], 0
                pack.append(s)
                size += s.bytes
            packs.append(pack)
        return [p for p in packs if len(p) > 1]

    def compact(self) -> int:
        """Rewrite and commit until no tier holds a run to merge; the version then."""
        while packs := self.plan(self.shards()):
            base = self.version()
            live = self.shards(base)
            gone = {s.path for p in packs for s in p}
            folder = f"{self.root}/data/{uuid.uuid4().hex}"
            pack = f"pack_{uuid.uuid4().hex}"
            numbers = {s.path: k for k, p in enumerate(packs) for s in p}
            rows = self._numbered([s for p in packs for s in p], numbers, pack)
            rows.repartitionById(len(packs), F.col(pack).cast("int")).write.option("compression", "zstd").partitionBy(pack).parquet(folder)
            made = []
            for sub, _ in self._list(folder):
                if f"{pack}=" in sub:
                    made += self._written(sub, max(s.arrival for s in packs[int(sub.rpartition("=")[2])]))
            self.commit(base, [s for s in live if s.path not in gone] + sorted(made, key=lambda s: s.path))
        return self.version()

    def vacuum(self, keep_versions: int = 1) -> int:
        """Forget all but the newest versions and delete the shards only they list; how many."""
        newest = self.version()
        old = [v for v in range(1, newest - keep_versions + 1) if self._fs.exists(self._path(f"{self.root}/manifests/v{v:08d}.json"))]
        held = {s.path for v in range(max(1, newest - keep_versions + 1), newest + 1) for s in self.shards(v)}
        gone = {s.path for v in old for s in self.shards(v)} - held
        for v in old:
            self._fs.delete(self._path(f"{self.root}/manifests/v{v:08d}.json"), False)
        for p in gone:
            self._fs.delete(self._path(p), False)
        return len(gone)

    # -- reading

    def _read(self, shards: list[Shard]) -> DataFrame:
        if not shards:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[s.path for s in shards])

    def _numbered(self, shards: list[Shard], numbers: dict[str, int], column: str) -> DataFrame:
        """The rows of the shards with their file's number, looked up by its (unique) name."""
        # The last folder counts, as one write may name its files alike in several folders.
        file, at = (f"{x}_{uuid.uuid4().hex}" for x in ("file", "at"))
        place = self.spark.createDataFrame([("/".join(p.split("/")[-2:]), k) for p, k in numbers.items()], f"{at} string, {column} long")
        rows = self._read(shards).withColumn(file, F.regexp_extract(F.input_file_name(), "[^/]+/[^/]+$", 0))
        if len(numbers) <= self.broadcast_shards:
            place = F.broadcast(place)
        return rows.join(place, F.col(file) == F.col(at)).drop(file, at)

    def remove(self) -> None:
        """Delete the store with all its shards and versions."""
        self._fs.delete(self._path(self.root), True)

    def read(self, version: int | None = None, shard_col: str | None = None) -> DataFrame:
        """The rows of a version; shard_col: also the number of each row's shard in the manifest,
        under that name or, if the rows have one of that name, the first free one (shard_col_2)."""
        shards = self.shards(version)
        if shard_col is None:
            return self._read(shards)
        return self._numbered(shards, {s.path: k for k, s in enumerate(shards)}, free_name(shard_col, self.schema.names))
