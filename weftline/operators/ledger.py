"""The run ledger: sessions, runs, tasks, logs and index entries as tables, and the queries over them.

Tables are DataFrames; updates give new DataFrames (write them where the caller keeps its tables). Times are timestamps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCHEMAS = {
    "metadata": "key string, value string, created_at timestamp",
    "sessions": "id long, uuid string, subcommand string, created_by string, created_at timestamp, heartbeat_at timestamp",
    "runs": "id long, uuid string, session_id long, name string, source string, target string, status string, inputs string, outputs string, error string, directory string, index_directory string, started_at timestamp, completed_at timestamp, created_at timestamp",
    "tasks": "name string, run_id long, status string, exit_status int, error string, created_at timestamp, started_at timestamp, completed_at timestamp",
    "task_logs": "id long, task_name string, source string, chunk binary, created_at timestamp",
    "index_log": "id long, run_id long, link_path string, target_path string, created_at timestamp",
}
RUN_STATES = ("queued", "analyzing", "running", "completed", "failed", "canceling", "canceled", "orphaned")
TASK_STATES = ("initializing", "localizing", "pending", "running", "completed", "failed", "canceled", "preempted", "cached", "orphaned")
PAGE = 100


def with_session(runs: DataFrame, sessions: DataFrame, uuid: str | None = None) -> DataFrame:
    """Runs, or the run of one uuid, with their sessions' uuid and subcommand."""
    runs = runs if uuid is None else runs.where(F.col("uuid") == uuid)
    return runs.join(sessions.select(F.col("id").alias("session_id"), F.col("uuid").alias("session_uuid"), "subcommand"), "session_id")


def page(rows: DataFrame, order: list[Column], limit: int = PAGE, offset: int = 0) -> DataFrame:
    """The rows of one page; the order must end in something unique for pages to fit together."""
    return rows.orderBy(*order).offset(offset).limit(limit)


def next_token(total: int, limit: int = PAGE, offset: int = 0) -> int | None:
    """Where the next page begins, if there is one."""
    return offset + limit if offset + limit < total else None


def runs_of_session(runs: DataFrame, session_id: int, limit: int = PAGE, offset: int = 0) -> DataFrame:
    """A session's runs, the oldest first."""
    return page(runs.where(F.col("session_id") == session_id), [F.col("created_at"), F.col("id")], limit, offset)


def page_after(rows: DataFrame, keys: list[str], last: list | None, limit: int = PAGE) -> DataFrame:
    """The page after the row whose keys are `last` (None: the first page), in ascending order of the keys. What comes before is
    filtered out, so a late page costs no more than an early one; the keys must be unique together."""
    if last is not None:
        rows = rows.where(F.struct(*keys) > F.struct(*(F.lit(x).alias(k) for k, x in zip(keys, last))))
    return rows.orderBy(*keys).limit(limit)


def counts(rows: DataFrame, by: str = "status") -> DataFrame:
    return rows.groupBy(by).agg(F.count("*").alias("n"))


def pivoted_counts(rows: DataFrame, states: tuple[str, ...] = TASK_STATES, by: str = "status", keys: tuple[str, ...] = ()) -> DataFrame:
    """A column for each state and the total, in one pass."""
    return rows.groupBy(*keys).agg(*(F.count_if(F.col(by) == s).alias(s) for s in states), F.count("*").alias("total"))


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row a key, the first in the order. A maximum of structs would be combined before the shuffle, but only for
    ascending orders of plain columns; see `latest_by`."""
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_rank", first).where("_rank = 1").drop("_rank")


def latest_by(rows: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """One row a key: that of the greatest `by`. Combined before the shuffle, so a hot key costs a row a task."""
    rest = [c for c in rows.columns if c not in keys]
    top = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*by)).alias("_r"))
    return top.select(*keys, "_r.*").select(*rows.columns)


def latest_index_entries(index_log: DataFrame, runs: DataFrame) -> DataFrame:
    """The newest entry of each link (by time, then id), with the uuid of its run."""
    newest = latest_by(index_log, ["link_path"], ["created_at", "id"])
    return newest.join(runs.select(F.col("id").alias("run_id"), F.col("uuid").alias("run_uuid")), "run_id")


def upsert(table: DataFrame, changes: DataFrame, key: str, order: list[str]) -> DataFrame:
    """table with the changes: of rows with one key, the one of the greatest `order` stays (a change before an old row)."""
    both = table.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)))
    return latest_by(both, [key], [*order, "_new"]).drop("_new")


def transition(rows: DataFrame, to: str, allowed: tuple[str, ...], where: Column | None = None) -> DataFrame:
    """The state becomes `to` where the row is meant and its state allows it."""
    meant = F.col("status").isin(*allowed) & (where if where is not None else F.lit(True))
    return rows.withColumn("status", F.when(meant, to).otherwise(F.col("status")))


def cancel_requested(runs: DataFrame, ids: DataFrame) -> DataFrame:
    """runs with a request to cancel those of `ids` (a column id): a run that hasn't begun is canceled at once, one under way is
    canceling, and a second request cancels what is canceling already. Runs that ended stay as they are."""
    asked = ids.select("id").distinct().withColumn("_asked", F.lit(True))
    at, out = F.col("status"), runs.join(asked, "id", "left")
    to = F.when(at.isin("queued", "canceling"), "canceled").when(at.isin("analyzing", "running"), "canceling").otherwise(at)
    return out.withColumn("status", F.when(F.col("_asked"), to).otherwise(at)).select(*runs.columns)


def canceled_tasks(tasks: DataFrame, runs: DataFrame) -> DataFrame:
    """tasks with those that haven't ended canceled where their run is canceled."""
    gone = runs.where("status = 'canceled'").select(F.col("id").alias("run_id"), F.lit(True).alias("_gone"))
    out = tasks.join(gone, "run_id", "left")
    live = F.col("status").isin("initializing", "localizing", "pending", "running")
    return out.withColumn("status", F.when(F.col("_gone") & live, "canceled").otherwise(F.col("status"))).select(*tasks.columns)


def orphaned(runs: DataFrame, sessions: DataFrame, cutoff: Column) -> DataFrame:
    """Unfinished runs whose session gave no sign of life since the cutoff."""
    stale = sessions.where(F.coalesce("heartbeat_at", "created_at") < cutoff).select(F.col("id").alias("session_id"))
    return runs.where(F.col("status").isin("queued", "analyzing", "running", "canceling")).join(stale, "session_id", "left_semi")


def sweep(runs: DataFrame, sessions: DataFrame, cutoff: Column) -> DataFrame:
    """runs with the orphaned ones marked so."""
    gone = orphaned(runs, sessions, cutoff).select("id", F.lit(True).alias("_gone"))
    out = runs.join(gone, "id", "left")
    return out.withColumn("status", F.when(F.col("_gone"), "orphaned").otherwise(F.col("status"))).drop("_gone").select(*runs.columns)


def logs(task_logs: DataFrame, task: str, source: str | None = None, limit: int = PAGE, offset: int = 0) -> DataFrame:
    rows = task_logs.where(F.col("task_name") == task)
    return page(rows if source is None else rows.where(F.col("source") == source), [F.col("created_at"), F.col("id")], limit, offset)


def inserted(rows: DataFrame, parents: DataFrame, parent_key: str, by: str) -> DataFrame:
    """rows (with the parents' value of `by`) with the parents' id as parent_key; rows without a parent go."""
    return rows.join(parents.select(F.col(by), F.col("id").alias(parent_key)), by).drop(by)
