"""A registry of connectors as a table: registering, listing, removing, what syncs leave behind, and the last errors of each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows that a sample of a source may have, and errors that are kept of a connector.
MOST_SAMPLE, KEPT_ERRORS = 1000, 10


def register(stored: DataFrame, incoming: DataFrame, now: Column) -> DataFrame:
    """stored (connector_id, graph_id, sample_row_limit, status, updated_at, ...) and the incoming connectors (connector_id, graph_id,
    sample_row_limit) that it hasn't: active, their samples bounded. Columns that incoming lacks are null; a null id isn't registered."""
    new = incoming.where("connector_id is not null").dropDuplicates(["connector_id"]).join(stored.select("connector_id"), "connector_id", "left_anti")
    new = new.withColumns({"sample_row_limit": F.least("sample_row_limit", F.lit(MOST_SAMPLE)), "status": F.lit("active"), "updated_at": now})
    return stored.unionByName(new.select(*[c for c in stored.columns if c in new.columns]), allowMissingColumns=True)


def remove(stored: DataFrame, gone: DataFrame, now: Column) -> DataFrame:
    """Connectors of gone (connector_id) get the status deleted, those that have it already stay as they are."""
    hit = gone.select("connector_id", F.lit(True).alias("_gone")).distinct()
    fresh = F.coalesce("_gone", F.lit(False)) & (F.coalesce("status", F.lit("")) != "deleted")
    return stored.join(hit, "connector_id", "left").withColumns({"updated_at": F.when(fresh, now).otherwise(F.col("updated_at")), "status": F.when(fresh, "deleted").otherwise(F.col("status"))}).select(*stored.columns)


def listed(stored: DataFrame, graph_ids: list[str] | None = None) -> DataFrame:
    """Connectors that aren't deleted, of the graphs that a caller may read if given."""
    own = stored.where(F.coalesce("status", F.lit("")) != "deleted")
    return own if graph_ids is None else own.where(F.col("graph_id").isin(*graph_ids))


def synced(stored: DataFrame, results: DataFrame) -> DataFrame:
    """stored with last_sync_at, last_sync_status, last_sync_error and last_sync_row_count of each connector's last result.

    results: connector_id, occurred_at, status, row_count, error; ties in time go to the greatest status, then row count. The last result
    is an aggregate that combines before the shuffle, so a connector with most of the results costs one row a task.
    """
    names = ["last_sync_at", "last_sync_status", "last_sync_row_count", "last_sync_error"]
    last = results.where("occurred_at is not null").groupBy("connector_id").agg(F.max(F.struct("occurred_at", "status", "row_count", "error")).alias("r"))
    last = last.select("connector_id", *[F.col(f"r.{c}").alias(f"_{n}") for c, n in zip(("occurred_at", "status", "row_count", "error"), names, strict=True)], F.lit(True).alias("_synced"))
    both = stored.join(last, "connector_id", "left")
    keep = lambda n: F.when(F.col("_synced"), F.col(f"_{n}")).otherwise(F.col(n) if n in stored.columns else F.lit(None))
    out = both.withColumns({n: keep(n) for n in names} | {"updated_at": F.when(F.col("_synced"), F.col("_last_sync_at")).otherwise(F.col("updated_at"))})
    return out.select(*dict.fromkeys([*stored.columns, *names]))


def kept_errors(errors: DataFrame, most: int = KEPT_ERRORS) -> DataFrame:
    """The last errors (connector_id, error_id, occurred_at, ...) of each connector; ties by error_id. Spark drops what ranks lower before it shuffles."""
    rank = F.row_number().over(W.partitionBy("connector_id").orderBy(F.desc("occurred_at"), F.desc("error_id")))
    return errors.withColumn("_k", rank).where(F.col("_k") <= most).drop("_k")
