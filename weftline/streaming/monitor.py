"""Task events folded into task states, on streams and tables alike.

The fold is made of built-in aggregates (least and greatest structs), so it is combined before the shuffle, needs no order
of arrival and keeps a bounded state a task: the first final state by event time sticks, else the furthest state counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: Order of states that aren't final, and the final ones.
PROGRESS = ("initializing", "localizing", "pending", "running")
FINAL = ("completed", "failed", "canceled", "preempted", "cached", "orphaned")


def state_rank(state: Column, progress: tuple[str, ...] = PROGRESS) -> Column:
    out = F.lit(-1)
    for i, s in enumerate(progress):
        out = F.when(state == s, i).otherwise(out)
    return out


def fold_states(events: DataFrame, task: str = "task", state: str = "state", at: str = "ts", tie: str = "event_id", progress: tuple[str, ...] = PROGRESS, final: tuple[str, ...] = FINAL) -> DataFrame:
    """(task, status, n_events, first_at, last_at): works on a batch and on a stream. Events without a task go."""
    is_final = F.col(state).isin(*final)
    ended = F.min(F.when(is_final, F.struct(F.col(at), F.col(tie), F.col(state).alias("s"))))
    furthest = F.max(F.when(~is_final, F.struct(state_rank(F.col(state), progress).alias("r"), F.col(state).alias("s"))))
    got = events.where(F.col(task).isNotNull()).groupBy(task).agg(ended.alias("_e"), furthest.alias("_f"), F.count("*").alias("n_events"), F.min(at).alias("first_at"), F.max(at).alias("last_at"))
    return got.select(task, F.coalesce("_e.s", "_f.s").alias("status"), "n_events", "first_at", "last_at")


def monitor(events: DataFrame, name: str, checkpoint: str, **how) -> StreamingQuery:
    """The fold of a stream, kept up to date in the memory table `name`; reads what is there and ends. For a table at scale
    give `foreach_batch` a function that upserts the changed tasks."""
    each = how.pop("foreach_batch", None)
    out = fold_states(events, **how).writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if each is not None:
        return out.outputMode("update").foreachBatch(each).start()
    return out.outputMode("complete").format("memory").queryName(name).start()


class StateTable:
    """The newest state of each task in a folder, for `monitor`'s foreach_batch: a batch writes a version of its own, so a batch
    that is run again writes the same. Nothing is held at the driver."""

    def __init__(self, folder: str, key: str = "task"):
        self.folder, self.key, self.versions = folder, key, set()

    def __call__(self, changed: DataFrame, batch: int) -> None:
        before = [v for v in self.versions if v < batch]
        if before:
            old = changed.sparkSession.read.schema(changed.schema).parquet(f"{self.folder}/{max(before)}")
            changed = old.join(changed, self.key, "left_anti").unionByName(changed)
        changed.write.mode("overwrite").parquet(f"{self.folder}/{batch}")
        self.versions.add(batch)

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.folder}/{max(self.versions)}")


def reconcile(states: DataFrame, final: tuple[str, ...] = FINAL) -> DataFrame:
    """After the last event: tasks that never ended are canceled."""
    return states.withColumn("status", F.when(F.col("status").isin(*final), F.col("status")).otherwise("canceled"))


def liveness(heartbeats: DataFrame, session: str = "session_id", at: str = "ts", gap: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """(session, since, until, beats): stretches without a silence over `gap`; beats later than `late` behind the newest are
    dropped on a stream."""
    spans = heartbeats.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("w"), session).agg(F.count("*").alias("beats"))
    return spans.select(session, F.col("w.start").alias("since"), F.col("w.end").alias("until"), "beats")


def stale_sessions(heartbeats: DataFrame, cutoff: Column, session: str = "session_id", at: str = "ts") -> DataFrame:
    """Sessions whose last sign of life is before the cutoff."""
    return heartbeats.groupBy(session).agg(F.max(at).alias("last_at")).where(F.col("last_at") < cutoff)
