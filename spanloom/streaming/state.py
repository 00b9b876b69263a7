"""The state of jobs as a table that survives runs: a stream of job events is folded into it, batch by batch.

A version of the table is a list of buckets of keys and where their rows lie. A
micro-batch rewrites the buckets that its events touch, stages the new list beside the
versions and puts it in place by one rename. A batch that is broken off leaves files
that no version names, and one that is repeated finds its version there: the state is
the same.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What an event makes of a job's status. ``started`` begins a job anew; others change only what they tell.
STATUS = {"started": "processing", "finished": "uploading", "sent": "done", "not_sent": "upload_failed", "broken": "error"}
EVENT = "video_id string, at long, kind string, title string, local_source string, reel_path string, description_path string, error string"
STATE = "video_id string, status string, title string, local_source string, reel_path string, description_path string, error string, at long"
_KEPT = ("title", "local_source", "reel_path", "description_path")
#: Buckets of keys; a batch rewrites only those that it touches.
BUCKETS = 64


def _last(value: Column, when: Column) -> Column:
    """The value of the last event for which ``when`` holds, in a box; null without one."""
    return F.max_by(F.struct(value.alias("v")), F.when(when, F.col("at")))


def folded(events: DataFrame, state: DataFrame) -> DataFrame:
    """The rows of ``state`` (each job once) after ``events`` (see ``EVENT`` and ``STATE``).

    Events count in order of ``at`` (no two of a job at once); those that are not
    after what the state has seen are dropped, as are kinds that aren't known.
    """
    known = state.select("video_id", F.col("at").alias("_seen"))
    new = events.where(F.col("kind").isin(*STATUS) & F.col("video_id").isNotNull() & F.col("at").isNotNull()).join(known, "video_id", "left").where(F.col("_seen").isNull() | (F.col("at") > F.col("_seen")))
    starts = new.where("kind = 'started'").groupBy("video_id").agg(F.max("at").alias("_start"))
    new = new.join(starts, "video_id", "left").where(F.col("_start").isNull() | (F.col("at") >= F.col("_start")))
    status = F.create_map(*[F.lit(x) for pair in STATUS.items() for x in pair])[F.col("kind")]
    tells = F.col("kind") != "finished"  # an upload that begins says nothing of the error before
    found = new.groupBy("video_id").agg(
        F.max_by(status, "at").alias("_status"), F.max("at").alias("_at"), F.max("_start").isNotNull().alias("_anew"),
        _last(F.when(F.col("kind").isin("not_sent", "broken"), F.col("error")), tells).alias("_error"), *[_last(F.col(c), F.col(c).isNotNull()).alias(f"_{c}") for c in _KEPT],
    )
    both = state.join(found, "video_id", "full_outer")
    old = lambda c: F.when(F.coalesce("_anew", F.lit(False)), None).otherwise(F.col(c))
    kept = [F.coalesce(F.col(f"_{c}.v"), old(c)).alias(c) for c in _KEPT]
    error = F.when(F.col("_error").isNotNull(), F.col("_error.v")).otherwise(old("error"))
    return both.select("video_id", F.coalesce("_status", "status").alias("status"), *kept, error.alias("error"), F.coalesce("_at", "at").alias("at"))


class StateTable:
    """A table of ``STATE`` rows below ``folder``, which any file system that Spark knows may hold."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS):
        self.spark, self.folder, self.buckets = spark, folder.rstrip("/"), buckets

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.folder, *parts]))

    def _files(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """Numbers of the versions in place, in order."""
        files, top = self._files(), self._path("versions")
        return sorted(int(s.getPath().getName()) for s in files.listStatus(top)) if files.exists(top) else []

    def _buckets(self, version: int | None) -> dict[int, str]:
        """Where the rows of each bucket lie: at most ``buckets`` rows."""
        if version is None:
            return {}
        return {r["bucket"]: r["path"] for r in self.spark.read.schema("bucket int, path string").parquet(f"{self.folder}/versions/{version}").collect()}

    def _rows(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(STATE).parquet(*paths) if paths else self.spark.createDataFrame([], STATE)

    def read(self) -> DataFrame:
        """The newest version."""
        return self._rows(sorted(set(self._buckets(next(reversed(self.versions()), None)).values())))

    def merge(self, events: DataFrame, number: int) -> None:
        """Folds a batch of events into the state, as version ``number``; one that is in place already is left alone."""
        versions = self.versions()
        if number in versions:
            return
        before = self._buckets(max((v for v in versions if v < number), default=None))
        bucket = F.pmod(F.xxhash64("video_id"), F.lit(self.buckets)).cast("int")
        rows = events.withColumn("_bucket", bucket)
        touched = sorted(r["_bucket"] for r in rows.select("_bucket").distinct().collect())  # at most ``buckets``
        state = self._rows([before[b] for b in touched if b in before])
        made = f"{self.folder}/data/{number}-{uuid.uuid4().hex}"
        folded(rows.drop("_bucket"), state).withColumn("bucket", bucket).repartition("bucket").write.partitionBy("bucket").parquet(made)
        now = before | {b: f"{made}/bucket={b}" for b in touched if self._files().exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{made}/bucket={b}"))}
        staged = f"staged/{number}-{uuid.uuid4().hex}"
        self.spark.createDataFrame(sorted(now.items()), "bucket int, path string").coalesce(1).write.parquet(f"{self.folder}/{staged}")
        self.swap(staged, number)

    def swap(self, staged: str, number: int) -> None:
        """Puts a staged version in place."""
        files = self._files()
        files.mkdirs(self._path("versions"))
        if not files.rename(self._path(staged), self._path("versions", str(number))):
            raise OSError(f"version {number} could not be put in place")

    def follow(self, stream: DataFrame) -> None:
        """Runs a stream of events over what is there."""
        query = stream.writeStream.foreachBatch(self.merge).option("checkpointLocation", f"{self.folder}/stream").trigger(availableNow=True).start()
        query.awaitTermination()
