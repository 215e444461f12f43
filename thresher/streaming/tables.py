"""Tables that streams keep up to date: logs of changes by batch, snapshots, one commit for several tables.

A stream's micro-batch may be run again after a failure, and a batch that changes two tables
may fail between them. So a batch first writes its changes to a folder of its own in the log
of every table, over what an earlier try left there, and then one commit, a file that names
the batch. Readers take committed batches alone: until the commit no table shows anything of
the batch, which is the roll-back, and a batch that is run again changes nothing twice.

    tables = coordination(spark, path)
    decisions.writeStream.foreachBatch(lambda rows, batch: tables.commit(batch, decided(rows)))

A table's rows are the last change of each key; a change whose op is `delete` removes it.
compact() folds committed changes into a snapshot, so reading doesn't grow with the age of
the table. A snapshot, too, is named by a commit of its own, and what it replaces goes
afterwards. One writer at a time; any number of readers.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators import jobs

_BATCH = "_batch"


class Tables:
    """Tables below one path. schemas: of the rows of each table, among them the columns of its key, `order`, which orders a key's changes in a batch, and perhaps `op`."""

    def __init__(self, spark: SparkSession, path: str, keys: Mapping[str, str | list[str]], schemas: Mapping[str, StructType | str], order: str = "ts", op: str = "op"):
        self.spark, self.path, self.order, self.op = spark, path.rstrip("/"), order, op
        self.keys = {name: [k] if isinstance(k, str) else list(k) for name, k in keys.items()}
        self.schemas = {name: StructType.fromDDL(s) if isinstance(s, str) else s for name, s in schemas.items()}

    # --- commits: a row for each, batch or snapshot -----------------------------------------

    def _commits(self) -> tuple[int | None, list[int]]:
        """The batch up to which the last snapshot goes, and the batches committed after it. There are as many as since the last compaction."""
        folder = f"{self.path}/commits"
        if not self._exists(folder):
            return None, []
        rows = self.spark.read.schema("kind string, batch bigint").parquet(folder).collect()
        snapshot = max((r["batch"] for r in rows if r["kind"] == "snapshot"), default=None)
        return snapshot, sorted({r["batch"] for r in rows if r["kind"] == "batch" and (snapshot is None or r["batch"] > snapshot)})

    def _note(self, kind: str, batch: int) -> None:
        one = self.spark.createDataFrame([(kind, batch)], "kind string, batch bigint").coalesce(1)
        one.write.mode("append").parquet(f"{self.path}/commits")

    def _fs(self, folder: str):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(folder)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _exists(self, folder: str) -> bool:
        fs, path = self._fs(folder)
        return fs.exists(path)

    def _delete(self, folder: str) -> None:
        fs, path = self._fs(folder)
        fs.delete(path, True)

    # --- writing ------------------------------------------------------------------------------

    def commit(self, batch: int, changes: Mapping[str, DataFrame]) -> bool:
        """Takes over the changes of a batch to all tables, or, if one of them fails, to none. False: the batch had been committed before, and nothing is done."""
        snapshot, committed = self._commits()
        if batch in committed or (snapshot is not None and batch <= snapshot):
            return False
        if unknown := set(changes) - set(self.keys):
            raise ValueError(f"no such tables: {sorted(unknown)}")
        for name, rows in changes.items():
            self._last(name, rows.withColumn(_BATCH, F.lit(batch))).drop(_BATCH).write.mode("overwrite").parquet(f"{self.path}/{name}/log/{_BATCH}={batch}")
        self._note("batch", batch)
        return True

    def _ordered(self) -> Column:
        return F.struct(_BATCH, self.order)

    def _last(self, name: str, rows: DataFrame) -> DataFrame:
        """The last change of each key."""
        fields = [f.name for f in self.schemas[name].fields]
        kept = [*fields, *([self.op] if self.op in rows.columns and self.op not in fields else []), _BATCH]
        found = rows.groupBy(*self.keys[name]).agg(F.max_by(F.struct(*kept), self._ordered()).alias("r"))
        return found.select("r.*")

    # --- reading ------------------------------------------------------------------------------

    def _changes(self, name: str, snapshot: int | None, batches: list[int]) -> DataFrame:
        fields = self.schemas[name].fields
        logged = StructType([*fields, *StructType.fromDDL(f"{self.op} string").fields]) if self.op not in [f.name for f in fields] else StructType(fields)
        found = self.spark.createDataFrame([], logged).withColumn(_BATCH, F.lit(0).cast("bigint"))
        if snapshot is not None and self._exists(folder := f"{self.path}/{name}/snapshot-{snapshot}"):
            found = found.unionByName(self.spark.read.schema(logged).parquet(folder).withColumn(_BATCH, F.lit(snapshot).cast("bigint")))
        folders = [f for b in batches if self._exists(f := f"{self.path}/{name}/log/{_BATCH}={b}")]
        if folders:
            at = F.regexp_extract(F.col("_metadata.file_path"), rf"/{_BATCH}=(\d+)/", 1).cast("bigint")
            found = found.unionByName(self.spark.read.schema(logged).parquet(*folders).withColumn(_BATCH, at))
        return found

    def read(self, name: str) -> DataFrame:
        """The table as the committed batches leave it."""
        current = self._last(name, self._changes(name, *self._commits()))
        return current.where(F.coalesce(F.col(self.op), F.lit("")) != "delete").select(*(f.name for f in self.schemas[name].fields if f.name != self.op))

    def compact(self) -> None:
        """Folds all committed batches into snapshots. Deleted keys go for good, as no later batch is older."""
        snapshot, batches = self._commits()
        if not batches:
            return
        upto = batches[-1]
        for name in self.keys:
            current = self._last(name, self._changes(name, snapshot, batches)).where(F.coalesce(F.col(self.op), F.lit("")) != "delete")
            current.drop(_BATCH).write.mode("overwrite").parquet(f"{self.path}/{name}/snapshot-{upto}")
        self._note("snapshot", upto)
        for name in self.keys:
            for b in batches:
                self._delete(f"{self.path}/{name}/log/{_BATCH}={b}")
            if snapshot is not None:
                self._delete(f"{self.path}/{name}/snapshot-{snapshot}")


RETRIES = {
    "states": "job_id bigint, ts timestamp, kind string, reason string, error string",
    "retries": "job_id bigint, ts timestamp, retry_at timestamp, op string",
    "actions": "job_id bigint, ts timestamp, action string, action_url string, op string",
}


def coordination(spark: SparkSession, path: str) -> Tables:
    """The tables of a coordinator: the last step of each job, its scheduled retry and its pending action."""
    return Tables(spark, path, dict.fromkeys(RETRIES, "job_id"), RETRIES)


def decided(decisions: DataFrame) -> dict[str, DataFrame]:
    """The changes that access decisions make to the tables of coordination().

    decisions: job_id, ts, decision, reason, message, retry_after_ms, attempt, max_retries,
    action, action_url. A job that waits is scheduled, or fails if its budget is spent; one
    that asks for the user gets a pending action; any decision ends what was pending before.
    """
    routed = jobs.route_retries(decisions.where("decision = 'RETRY_LATER'"), F.col("ts"), carried=("ts",))
    asked, _ = jobs.user_actions(decisions, F.col("ts"))
    denied = F.col("decision") == "DENY"
    ended = decisions.where(denied | (F.col("decision") == "ALLOW")).select(
        "job_id", "ts", F.when(denied, "DENIED").otherwise("ALLOWED").alias("kind"), F.when(denied, F.col("reason")).alias("reason"), F.when(denied, F.col("message")).alias("error")
    )
    states = routed.select("job_id", "ts", "kind", "reason", "error").unionByName(asked.select("job_id", "ts", "kind", "reason", "error")).unionByName(ended)
    scheduled = routed.select("job_id", "ts", "retry_at", F.when(F.col("kind") == "RETRY_LATER", "set").otherwise("delete").alias("op"))
    others = decisions.where("decision <> 'RETRY_LATER'").select("job_id", "ts", F.lit(None).cast("timestamp").alias("retry_at"), F.lit("delete").alias("op"))
    pending = decisions.select("job_id", "ts", "action", "action_url", F.when(F.col("decision") == "USER_ACTION_REQUIRED", "set").otherwise("delete").alias("op"))
    return {"states": states, "retries": scheduled.unionByName(others), "actions": pending}
