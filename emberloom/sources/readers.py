"""Sources. Every one has an explicit schema; none infers."""

from __future__ import annotations

import struct
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import parse_multi_select, strip

RAW_ENTRY = T.StructType([T.StructField(c, T.StringType()) for c in ("id", "name", "summary", "location", "source")])
ENTRY = T.StructType([*RAW_ENTRY.fields, T.StructField("embedding", T.ArrayType(T.FloatType()))])
ASSIGNMENT = T.StructType([*(T.StructField(c, T.StringType()) for c in ("id", "name", "summary", "location")), T.StructField("clusterId", T.IntegerType()), T.StructField("confidence", T.DoubleType())])
CLUSTER_LABEL = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("size", T.IntegerType()), *(T.StructField(c, T.ArrayType(T.StringType())) for c in ("representativeWords", "representativeYokai", "allYokai")), T.StructField("label", T.StringType())])

# The columns of stored surveys and documents.
_TEXT, _INT, _FLAG, _TIME, _LIST = T.StringType(), T.IntegerType(), T.BooleanType(), T.TimestampType(), T.ArrayType(T.StringType())
SURVEY = T.StructType(
    [T.StructField("id", _TEXT, False), T.StructField("created_at", _TIME, False)]
    + [T.StructField(c, _TEXT) for c in ("visitor_type", "pre_origin", "pre_image", "pre_age", "pre_gender", "pre_yokai_perception")]
    + [T.StructField(c, _INT) for c in ("pre_familiarity", "pre_ai_experience")]
    + [T.StructField("post_completed", _FLAG, False), T.StructField("post_completed_at", _TIME)]
    + [T.StructField(c, _TEXT) for c in ("post_theme", "post_impression", "post_yokai_perception")]
    + [T.StructField("post_selections", _LIST), T.StructField("post_systems", _LIST), T.StructField("post_action", _INT)]
    + [T.StructField("print_triggered", _FLAG, False), T.StructField("printed", _FLAG, False)]
    + [T.StructField(c, _TEXT) for c in ("yokai_name", "yokai_desc", "yokai_image_b64")]
    + [T.StructField("survey_declined", _FLAG), T.StructField("texture", _TEXT)]
)


def json_entries(spark: SparkSession, path: str, schema: T.StructType, field: str = "entries") -> DataFrame:
    """The rows of a JSON document {field: [...]}."""
    root = T.StructType([T.StructField(field, T.ArrayType(schema))])
    return spark.read.schema(root).json(path, multiLine=True).select(F.inline(field))


def json_map(spark: SparkSession, path: str, schema: T.StructType, field: str = "clusters", key: str = "key") -> DataFrame:
    """The rows of a JSON document {field: {key: {...}}}, with their keys."""
    root = T.StructType([T.StructField(field, T.MapType(T.StringType(), schema))])
    return spark.read.schema(root).json(path, multiLine=True).select(F.explode(field).alias(key, "_v")).select(key, "_v.*")


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def children(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return [f.getPath().getName() for f in p.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(p)]


def first_of(spark: SparkSession, candidates: Sequence[tuple[str, Callable[[str], DataFrame]]], schema: T.StructType, log: Callable[[str], None] = lambda text: None) -> DataFrame:
    """The first candidate (path, reader) that exists and can be read; else an empty table."""
    for path, read in candidates:
        if not exists(spark, path):
            log(f"{path}: not there")
            continue
        try:
            df = read(path)
            df.limit(1).count()
            return df
        except Exception as e:  # a damaged file is passed over like a missing one
            log(f"{path}: {e}")
    return spark.createDataFrame([], schema)


def stage_file(spark: SparkSession, url: str, path: str, timeout: float = 60.0) -> str:
    """Fetch a file once, on the driver, to a path that executors can read; the path."""
    from urllib.request import urlopen

    from .writers import put_bytes

    with urlopen(url, timeout=timeout) as reply:
        put_bytes(spark, path, reply.read())
    return path


def stage_json(spark: SparkSession, url: str, path: str, timeout: float = 60.0) -> str:
    """stage_file() of a JSON document."""
    import json
    from urllib.request import urlopen

    from .writers import put_bytes

    with urlopen(url, timeout=timeout) as reply:
        data = reply.read()
    json.loads(data)  # a damaged reply is not kept
    put_bytes(spark, path, data)
    return path


def _tiers(spark: SparkSession, local: Sequence[tuple], remote: Sequence[tuple], staging: str | None, log: Callable[[str], None]):
    """What the first tier that can be read gives, else None. A tier is a reader and its files:
    paths of the local ones, URLs (staged when their turn comes) or paths of the remote ones."""
    for read, *files in [*local, *remote]:
        try:
            if any(f is None for f in files):
                continue
            missing = [f for f in files if "://" not in f and not exists(spark, f)]
            if missing:
                log(f"{missing[0]}: not there")
                continue
            here = [stage_file(spark, f, f"{staging}/{f.rsplit('/', 1)[-1]}") if f.startswith(("http://", "https://")) else f for f in files]
            return read(*here)
        except Exception as e:  # the next tier is tried
            log(f"{files[0]}: {e}")
    return None


def json_matrix(spark: SparkSession, path: str) -> tuple[np.ndarray, int, int]:
    """(matrix, rows of an axis, axes) of a JSON document {matrix, subspaceDim, axes}."""
    import json

    doc = json.loads(_bytes(spark, path))
    return np.asarray(doc["matrix"], "<f4"), int(doc["subspaceDim"]), len(doc["axes"])


def matrix_of_tiers(spark: SparkSession, binary: str | None = None, document: str | None = None, remote_binary: str | None = None, remote_document: str | None = None, staging: str | None = None, log: Callable[[str], None] = lambda text: None) -> tuple[np.ndarray, int, int] | None:
    """The projection matrix from the first of: binary file, JSON document, the same two remotely.
    A tier that is missing or damaged is logged and passed over; None if none can be read."""
    b, j = (lambda p: binary_matrix(spark, p)), (lambda p: json_matrix(spark, p))
    return _tiers(spark, [(b, binary), (j, document)], [(b, remote_binary), (j, remote_document)], staging, log)


META = T.StructType([*RAW_ENTRY.fields, T.StructField("ordinal", T.LongType())])


def projected_of_tiers(spark: SparkSession, axes: Sequence[str], binary: tuple[str, str] | None = None, document: str | None = None, remote_binary: tuple[str, str] | None = None, remote_document: str | None = None, staging: str | None = None, log: Callable[[str], None] = lambda text: None) -> DataFrame | None:
    """Entries with a vector for each axis from the first of: vectors file and its meta document
    {subspaceDim, entries}, one document {entries} with the axes as fields, the same two
    remotely. Rows of the two files belong together by position; missing texts become empty."""
    texts = [f.name for f in RAW_ENTRY.fields]

    def both(vectors: str, meta: str) -> DataFrame:
        root = T.StructType([T.StructField("subspaceDim", T.IntegerType()), T.StructField("entries", T.ArrayType(RAW_ENTRY))])
        doc = spark.read.schema(root).json(meta, multiLine=True)
        width = (doc.select("subspaceDim").first()[0] or 0) or 128
        rows = doc.select(F.posexplode("entries").alias("ordinal", "e")).select(F.col("ordinal").cast("long").alias("ordinal"), "e.*")
        out = projected_entries(binary_vectors(spark, vectors), rows, axes, width)
        if out.count() != rows.count():
            raise ValueError("the meta document has more entries than there are vectors")
        return out.select(*texts, *axes)

    def one(path: str) -> DataFrame:
        schema = T.StructType([*RAW_ENTRY.fields, *(T.StructField(a, T.ArrayType(T.FloatType())) for a in axes)])
        out = json_entries(spark, path, schema).select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in texts], *axes)
        if not out.limit(1).count():
            raise ValueError("no entries")
        return out

    return _tiers(spark, [(both, *(binary or (None,))), (one, document)], [(both, *(remote_binary or (None,))), (one, remote_document)], staging, log)


def decode_matrix(data: bytes) -> tuple[np.ndarray, int, int]:
    """(matrix, rows of an axis, axes) of a header [rows, columns, axis rows, axes] and
    little-endian float32 values by rows; 128 where the header says 0 rows of an axis."""
    rows, cols, width, axes = struct.unpack_from("<4I", data)
    return np.frombuffer(data, "<f4", rows * cols, 16).reshape(rows, cols), width or 128, axes


def decode_vectors(data: bytes) -> np.ndarray:
    n, dim = struct.unpack_from("<2I", data)
    return np.frombuffer(data, "<f4", n * dim, 8).reshape(n, dim)


def _bytes(spark: SparkSession, path: str) -> bytes:
    return bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])


def binary_matrix(spark: SparkSession, path: str) -> tuple[np.ndarray, int, int]:
    return decode_matrix(_bytes(spark, path))


def binary_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(ordinal, vector) of a binary vectors file."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            for data in pdf["content"]:
                v = decode_vectors(bytes(data))
                for a in range(0, len(v), 1024):
                    part = v[a : a + 1024]
                    yield pd.DataFrame({"ordinal": np.arange(a, a + len(part)), "vector": list(part)})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "ordinal long, vector array<float>")


def projected_entries(vectors: DataFrame, meta: DataFrame, axes: Sequence[str], width: int) -> DataFrame:
    """meta (ordinal and attributes) with the axes of the vectors of the same ordinal; missing
    text attributes become empty."""
    joined = meta.join(vectors, "ordinal")
    texts = {f.name: F.coalesce(F.col(f.name), F.lit("")) for f in meta.schema.fields if f.dataType == T.StringType()}
    return joined.withColumns(texts | {a: F.slice("vector", k * width + 1, width) for k, a in enumerate(axes)}).drop("vector")


def csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV with a header, quoted line breaks and perhaps a byte order mark; the columns are
    taken by name, arrays are given as text. A column that the file lacks is null."""
    lines = spark.read.text(path, wholetext=False).limit(1).collect()
    import csv as reader

    names = next(reader.reader([lines[0][0].lstrip("﻿")])) if lines else []
    by_name = {f.name: f.dataType for f in schema.fields}
    flat = T.StructType([T.StructField(n, T.StringType() if isinstance(by_name.get(n), T.ArrayType | None) else by_name[n]) for n in names])
    rows = spark.read.schema(flat).csv(path, header=True, multiLine=True, escape='"', enforceSchema=True)
    def column(f: T.StructField) -> Column:
        if f.name not in names:
            return F.lit(None).cast(f.dataType).alias(f.name)
        c = F.col(f"`{f.name}`")
        return (parse_multi_select(c) if isinstance(f.dataType, T.ArrayType) else c).alias(f.name)

    return rows.select(*[column(f) for f in schema.fields])


def table(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """A Parquet table, whole or some columns of it."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def jdbc_table(spark: SparkSession, url: str, name: str, key: str, low: int, high: int, parts: int, **options) -> DataFrame:
    """A remote table in `parts` ranges of a key, without a row cap."""
    return spark.read.format("jdbc").options(url=url, dbtable=name, partitionColumn=key, lowerBound=low, upperBound=high, numPartitions=parts, **options).load()


def lookup(df: DataFrame, key: str, value):
    """The row of a key; LookupError unless there is exactly one."""
    rows = df.filter(F.col(key) == F.lit(value)).limit(2).collect()
    if len(rows) != 1:
        raise LookupError(f"{len(rows) or 'no'} rows with {key} = {value!r}")
    return rows[0]


def text_records(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, body) of text files: the first line and the rest."""
    raw = spark.read.format("binaryFile").load(path).select("path", F.regexp_replace(F.decode("content", "UTF-8"), "^﻿", "").alias("t"))
    parts = F.split("t", "\r?\n", 2)
    return raw.select("path", strip(parts[0]).alias("name"), strip(F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit(""))).alias("body"))
