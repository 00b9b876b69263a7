"""File jobs: which files to take, and what happens to each by its recorded state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a job's status leads to on the next run.
SKIP, UPLOAD, REDO = "skip", "upload", "redo"


def settled(files: DataFrame, modified_us: str, now_us: int, settle_us: int, suffixes: tuple[str, ...], path: str = "path") -> DataFrame:
    """Files of the wanted kinds that weren't written to in the last ``settle_us``."""
    kind = F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))
    return files.where(kind.isin(*suffixes) & (F.lit(now_us) - F.col(modified_us) >= settle_us))


def next_action(status: Column, reel_exists: Column, force: bool = False) -> Column:
    """done is skipped; a failed or broken-off upload is tried again if its result is still there; all else is redone."""
    if force:
        return F.lit(REDO)
    again = status.isin("upload_failed", "uploading") & F.coalesce(reel_exists, F.lit(False))
    return F.when(status == "done", SKIP).when(again, UPLOAD).otherwise(REDO)


def after(action: Column, processed: Column, uploaded: Column) -> Column:
    """The status after a run."""
    sent = F.when(uploaded, "done").otherwise("upload_failed")
    return F.when(action == SKIP, "done").when(action == UPLOAD, sent).when(~processed, "error").otherwise(sent)


def merged_state(state: DataFrame, changed: DataFrame, key: str) -> DataFrame:
    """The state with changed rows in place of the old of their key."""
    return state.join(changed.select(key), key, "left_anti").unionByName(changed)


def state_rows(documents: DataFrame, column: str = "value") -> DataFrame:
    """video_id, status and error of every job that state documents (JSON, ``{"processed": {id: {...}}}``) list; one that is empty, broken or without jobs lists none."""
    jobs = F.from_json(F.col(column), "processed map<string, struct<status: string, error: string>>")["processed"]
    return documents.select(F.explode(jobs).alias("video_id", "job")).select("video_id", F.col("job.status").alias("status"), F.col("job.error").alias("error"))


def state_document(jobs: DataFrame) -> DataFrame:
    """The one document of all jobs (video_id, status, error), ids in order: what :func:`state_rows` reads."""
    each = F.struct(F.col("video_id"), F.struct("status", "error").alias("job"))
    return jobs.agg(F.to_json(F.struct(F.map_from_entries(F.array_sort(F.collect_list(each))).alias("processed"))).alias("value"))
