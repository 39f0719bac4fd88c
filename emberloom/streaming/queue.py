"""A print queue: pending rows are handled once, failures are tried again, then set aside."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.survey import pending_print
from ..sources.readers import children, exists
from ..sources.writers import remove

MOST_RETRIES = 3


def pending(state: DataFrame) -> DataFrame:
    return state.filter(pending_print(F.col("print_triggered"), F.col("printed")))


def retry_state(attempts: DataFrame) -> DataFrame:
    """(id, attempts, retries, outcome) from attempts (id, seq, ok): done at the first success;
    else queued while fewer than MOST_RETRIES retries have been spent after the first failure
    and the queue's own first try, then dropped."""
    first = F.min(F.when(F.col("ok"), F.col("seq")))
    fails = F.count_if(~F.col("ok"))
    rows = attempts.groupBy("id").agg(F.count("*").alias("attempts"), fails.alias("failures"), first.alias("done"))
    retries = F.greatest(F.col("failures") - 1, F.lit(0))
    outcome = F.when(F.col("done").isNotNull(), "printed").when(retries > MOST_RETRIES, "dropped").otherwise("queued")
    return rows.select("id", "attempts", retries.alias("retries"), outcome.alias("outcome"))


def recent_jobs(jobs: DataFrame, keep: int = 20, show: int = 10) -> DataFrame:
    """The newest `show` of the newest `keep` jobs."""
    return jobs.orderBy(F.desc("seq"), "id").limit(keep).orderBy(F.desc("seq"), "id").limit(show)


def drain(stream: DataFrame, handle: Callable[[DataFrame], DataFrame], log: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Handle each pending row of a stream of states once per key: handle() returns (id, ok),
    which is appended to the attempts' log under the batch's number, so that a batch run again
    after a failure replaces its own rows. Keys that have succeeded are left out."""

    def batch(df: DataFrame, epoch: int) -> None:
        spark = df.sparkSession
        todo = pending(df).dropDuplicates(["id"])
        path = spark._jvm.org.apache.hadoop.fs.Path(log)
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            done = spark.read.schema("id string, ok boolean, epoch long").parquet(log).filter("ok").filter(F.col("epoch") != epoch).select("id")
            mine = done.join(todo.select("id"), "id", "left_semi")  # the batch is the small side
            todo = todo.join(mine, "id", "left_anti")
        handle(todo).select("id", "ok").withColumn("epoch", F.lit(epoch).cast("long")).write.mode("overwrite").parquet(f"{log}/epoch={epoch}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "10 seconds"})).start()


def embed_incrementally(stream: DataFrame, embed: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, id_col: str = "id", done: DataFrame | None = None) -> StreamingQuery:
    """Embed the rows of a file stream that have not been embedded; resumes where it stopped.

    The ids seen are keyed state of the stream, kept with its checkpoint, so that a batch costs
    what is new in it. done: ids embedded before this stream's time. A null id is one id."""
    if done is not None:
        stream = stream.join(done.select(id_col), id_col, "left_anti")

    def batch(df: DataFrame, epoch: int) -> None:
        embed(df).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return stream.dropDuplicates([id_col]).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class RetryQueue:
    """Jobs that wait for another try, kept as numbered versions of a table (id, job, retries)
    in a shared folder; a version counts once it is whole, so a crash leaves the one before.

    drain() is what a consumer calls when it starts. A job that fails is kept while fewer than
    MOST_RETRIES retries have been noted, then it goes to the folder of the discarded. One
    consumer writes at a time."""

    SCHEMA = "id string, job string, retries int"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _versions(self) -> list[int]:
        if not exists(self.spark, f"{self.path}/waiting"):
            return []
        names = children(self.spark, f"{self.path}/waiting")
        return sorted(int(n) for n in names if exists(self.spark, f"{self.path}/waiting/{n}/_SUCCESS"))

    def _next(self, df: DataFrame) -> None:
        """Commit df as the next version; only the one before is kept besides."""
        old = self._versions()
        df.write.mode("overwrite").parquet(f"{self.path}/waiting/{old[-1] + 1 if old else 0}")
        for v in old[:-1]:
            remove(self.spark, f"{self.path}/waiting/{v}")

    def waiting(self) -> DataFrame:
        v = self._versions()
        return self.spark.read.schema(self.SCHEMA).parquet(f"{self.path}/waiting/{v[-1]}") if v else self.spark.createDataFrame([], self.SCHEMA)

    def discarded(self) -> DataFrame:
        path = f"{self.path}/discarded"
        return self.spark.read.schema(self.SCHEMA).parquet(f"{path}/*") if exists(self.spark, path) else self.spark.createDataFrame([], self.SCHEMA)

    def enqueue(self, jobs: DataFrame) -> None:
        """Add jobs (id, job)."""
        self._next(self.waiting().unionByName(jobs.select(F.col("id").cast("string").alias("id"), F.col("job").cast("string").alias("job"), F.lit(0).alias("retries"))))

    def drain(self, handle: Callable[[DataFrame], DataFrame]) -> None:
        """Try every waiting job once: handle() adds a column ok; null counts as failed."""
        old = self._versions()
        if not old:
            return
        tried = f"{self.path}/tried/{old[-1]}"  # handled once, however often the result is read
        handle(self.waiting()).select("id", "job", "retries", F.coalesce("ok", F.lit(False)).alias("ok")).write.mode("overwrite").parquet(tried)
        failed = self.spark.read.schema(self.SCHEMA + ", ok boolean").parquet(tried).filter("NOT ok").drop("ok")
        failed.filter(F.col("retries") >= MOST_RETRIES).write.mode("overwrite").parquet(f"{self.path}/discarded/{old[-1]}")
        self._next(failed.filter(F.col("retries") < MOST_RETRIES).withColumn("retries", F.col("retries") + 1))
        remove(self.spark, tried)
