"""Sinks: documents, binary artefacts, CSV, and a change log in place of row updates."""

from __future__ import annotations

import struct

import numpy as np
import uuid
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_json_document(df: DataFrame, path: str, field: str = "entries", order: str | None = None) -> None:
    """{field: [...]} as one JSON document, for results that a browser reads. Large tables go to
    write_table()."""
    rows = df.select(F.struct(*df.columns).alias("r"), *([F.col(order).alias("o")] if order else [F.lit(0).alias("o")]))
    doc = rows.agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "r"))), lambda x: x["r"]).alias(field))
    doc.select(F.to_json(F.struct(field)).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def write_table(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header and a byte order mark; arrays as {A,B}."""
    arrays = {n for n, t in df.dtypes if t.startswith("array")}
    cols = [F.when(F.col(c).isNotNull(), F.concat(F.lit("{"), F.array_join(c, ","), F.lit("}"))).alias(c) if c in arrays else F.col(c) for c in df.columns]
    cols[0] = cols[0].alias("﻿" + df.columns[0])
    df.select(*cols).coalesce(1).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def encode_matrix(matrix: np.ndarray, width: int, axes: int) -> bytes:
    m = np.asarray(matrix, "<f4")
    return struct.pack("<4I", *m.shape, width, axes) + m.tobytes()


def encode_vectors(vectors: np.ndarray) -> bytes:
    v = np.asarray(vectors, "<f4")
    return struct.pack("<2I", *v.shape) + v.tobytes()


def put_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """Write a file of the driver's through the Hadoop file system, whole or not at all."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    final, temp = hadoop.Path(path), hadoop.Path(path + ".part")
    fs = final.getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(temp, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()
    fs.delete(final, False)
    fs.rename(temp, final)


def remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def upload(spark: SparkSession, sources: dict[str, str], root: str) -> dict[str, str]:
    """Copy artefacts {name: path} under root; missing ones are skipped. {name: new path}."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    conf, out = spark._jsc.hadoopConfiguration(), {}
    for name, path in sources.items():
        src, dst = hadoop.Path(path), hadoop.Path(f"{root.rstrip('/')}/{name}")
        fs = src.getFileSystem(conf)
        if fs.exists(src):
            hadoop.FileUtil.copy(fs, src, dst.getFileSystem(conf), dst, False, True, conf)
            out[name] = dst.toString()
    return out


def event(op: str, key: Column, payload: Column, seq: Column) -> list[Column]:
    """The columns of a change: op INSERT, UPDATE or DELETE; payload holds the changed fields only."""
    return [F.lit(op).alias("op"), key.alias("id"), seq.alias("seq"), payload.alias("payload")]


def insert(df: DataFrame, log: str, fields: list[str], id_col: str | None = None) -> DataFrame:
    """Append rows to a change log, with new ids where there are none; returns the changes as they are stored."""
    key = F.col(id_col) if id_col else F.expr("uuid()")
    payload = F.map_from_arrays(F.array(*map(F.lit, fields)), F.array(*[F.col(c).cast("string") for c in fields]))
    changes = df.select(*event("INSERT", key, payload, F.expr("unix_micros(current_timestamp())")))
    staged = f"{log.rstrip('/')}.inserts/{uuid.uuid4().hex}"  # ids and times are drawn once
    changes.write.parquet(staged)
    changes = df.sparkSession.read.schema(changes.schema).parquet(staged)
    changes.write.mode("append").parquet(log)
    return changes


def update(df: DataFrame, log: str, fields: list[str], id_col: str) -> None:
    payload = F.map_from_arrays(F.array(*map(F.lit, fields)), F.array(*[F.col(c).cast("string") for c in fields]))
    df.select(*event("UPDATE", F.col(id_col), payload, F.expr("unix_micros(current_timestamp())"))).write.mode("append").parquet(log)


def delete(df: DataFrame, log: str, id_col: str) -> None:
    df.select(*event("DELETE", F.col(id_col), F.lit(None).cast("map<string,string>"), F.expr("unix_micros(current_timestamp())"))).write.mode("append").parquet(log)


def upsert(df: DataFrame, log: str, fields: list[str], id_col: str) -> None:
    """UPDATE for rows with an id, INSERT under a new one for the others."""
    payload = F.map_from_arrays(F.array(*map(F.lit, fields)), F.array(*[F.col(c).cast("string") for c in fields]))
    given = F.col(id_col).isNotNull()
    rows = df.select(F.when(given, "UPDATE").otherwise("INSERT").alias("op"), F.coalesce(F.col(id_col).cast("string"), F.expr("uuid()")).alias("id"), F.expr("unix_micros(current_timestamp())").alias("seq"), payload.alias("payload"))
    rows.write.mode("append").parquet(log)
