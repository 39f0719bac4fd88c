"""Views kept from a change log: rows (op, id, seq, payload map<string,string>).

Two rules differ on purpose. In the *list* view only an INSERT creates a row: an
UPDATE of an unknown or deleted id is ignored. In the *gallery* view a row appears
when a change first gives it a name, also by an UPDATE, and a later blank name does
not take it away; only DELETE does. UPDATE payloads hold changed fields only, so they
are merged field by field.

The folds are ordinary aggregations, so that the batch and the streaming forms
share them: a stream keeps the log (exactly once, by checkpoint) and the view is the
fold over it, or keeps per-id state with `keep_state`.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

LOG = "op string, id string, seq long, payload map<string,string>"


def _at() -> Column:
    """A change's place in the log; of one seq, a DELETE is before an INSERT and that before an UPDATE."""
    return F.struct("seq", "op")


def _same_id(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    """Joined by id, a null id being one."""
    return left.join(right.withColumnRenamed("id", "_id"), F.col("id").eqNullSafe(F.col("_id")), how).drop("_id")


def _payloads(log: DataFrame, starts: DataFrame) -> DataFrame:
    """(id, payload): the last value of each field of an id that was set at or after `start`
    (null: ever). Fields are aggregated one by one, so that an id of many changes is no row."""
    rows = log.filter("op <> 'DELETE'").select("id", _at().alias("at"), F.explode("payload").alias("field", "value"))
    last = rows.groupBy("id", "field").agg(F.max(F.struct("at", "value")).alias("last"))
    kept = _same_id(last, starts.select("id", "start"), "inner").filter(F.col("start").isNull() | (F.col("last.at") >= F.col("start")))
    return kept.groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "last.value")))).alias("payload"))


def _with_payload(rows: DataFrame, payloads: DataFrame) -> DataFrame:
    empty = F.create_map().cast("map<string,string>")
    return _same_id(rows, payloads, "left").withColumn("payload", F.coalesce("payload", empty))


def list_view(log: DataFrame, latest: int | None = 200) -> DataFrame:
    """(id, created_seq, payload), newest INSERT first, at most `latest` rows.

    The last INSERT or DELETE of an id says whether it is there; only the rows that are listed
    have their fields merged."""
    starts = log.filter(F.col("op").isin("INSERT", "DELETE")).groupBy("id").agg(F.max(_at()).alias("start")).filter("start.op = 'INSERT'")
    rows = starts.select("id", F.col("start.seq").alias("created_seq"), "start")
    if latest is not None:
        rows = rows.orderBy(F.desc("created_seq"), "id").limit(latest)
    changes = _same_id(log, rows.select("id"), "left_semi") if latest is not None else log
    return _with_payload(rows, _payloads(changes, rows)).select("id", "created_seq", "payload").orderBy(F.desc("created_seq"), "id")


def gallery_view(log: DataFrame, name: str = "name") -> DataFrame:
    """(id, shown_seq, payload) of the rows that have had a name since their last DELETE."""
    ended = F.max(F.when(F.col("op") == "DELETE", _at())).alias("gone")
    marks = log.filter(F.col("op").isin("INSERT", "DELETE")).groupBy("id").agg(ended, F.max(_at()).alias("start"))
    named = log.filter(F.col("op") != "DELETE").filter(F.coalesce(F.try_element_at("payload", F.lit(name)), F.lit("")) != "").select("id", "seq", _at().alias("at"))
    shown = _same_id(named, marks.select("id", "gone"), "left").filter(F.col("gone").isNull() | (F.col("at") > F.col("gone")))
    shown = shown.groupBy("id").agg(F.min("seq").alias("shown_seq"))
    starts = _same_id(shown.select("id"), marks.select("id", "start"), "left")
    return _with_payload(shown, _payloads(log, starts)).select("id", "shown_seq", "payload")


def latest_state(log: DataFrame) -> DataFrame:
    """(id, op, seq): the last change of each id."""
    return log.groupBy("id").agg(F.max_by(F.struct("op", "seq"), F.struct("seq", "op")).alias("s")).select("id", "s.op", "s.seq")


def store_log(stream: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Keep a stream of changes as a log, exactly once."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def keep_state(stream: DataFrame, name: str = "name") -> DataFrame:
    """(id, seq, shown, payload_json) updates of the gallery view, by per-id state."""
    import json

    from pyspark.sql.streaming.state import GroupStateTimeout

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        shown, payload, last = (*state.get,) if state.exists else (False, "{}", -1)
        fields = json.loads(payload)
        rows = pd.concat(list(batches)).sort_values("seq")
        for op, seq, change in zip(rows["op"], rows["seq"], rows["payload"], strict=True):
            if seq <= last:  # a change that has been seen
                continue
            change = dict(change or {})
            if op == "DELETE":
                shown, fields = False, {}
            else:
                shown = shown or bool(change.get(name))
                fields = change if op == "INSERT" else {**fields, **change}
            last = int(seq)
        state.update((shown, json.dumps(fields), last))
        yield pd.DataFrame({"id": [key[0]], "seq": [last], "shown": [shown], "payload_json": [json.dumps(fields, sort_keys=True)]})

    return stream.groupBy("id").applyInPandasWithState(step, "id string, seq long, shown boolean, payload_json string", "shown boolean, payload string, last long", "update", GroupStateTimeout.NoTimeout)


def refetch(signals: DataFrame, store: DataFrame, key: str = "id") -> DataFrame:
    """Signals of a key's change with the full row from the store, as events drop large fields."""
    return signals.select(key).distinct().join(store, key)
