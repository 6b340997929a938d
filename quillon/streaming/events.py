"""Change events: which rows of which table were inserted, updated or deleted."""

from __future__ import annotations

from enum import StrEnum

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Event(StrEnum):
    INSERT = "insert"
    UPDATE = "update"
    DELETE = "delete"
    UPSERT = "upsert"


#: Events of one kind that make one row, about.
BATCH = 1000


def grouped(events: DataFrame, table: str = "table", op: str = "type", key: str = "id", batch: int = BATCH) -> DataFrame:
    """The events of a table and kind as batches of about `batch` distinct ids, sorted, and how many
    they are: one row for few events, and no row that grows with their number."""
    # One row for each table and kind.
    counts = events.groupBy(table, op).agg(F.count("*").alias("_all")).withColumnsRenamed({table: "_table", op: "_op"})
    same = events[table].eqNullSafe(F.col("_table")) & events[op].eqNullSafe(F.col("_op"))
    part = F.pmod(F.xxhash64(events[key]), F.ceil(F.col("_all") / batch)).alias("part")
    dealt = events.join(F.broadcast(counts), same).select(events[table], events[op], events[key], part)
    return dealt.groupBy(table, op, "part").agg(F.sort_array(F.collect_set(key)).alias("ids")).withColumn("n_ids", F.size("ids"))


def by_kind(events: DataFrame, op: str = "type") -> dict[str, DataFrame]:
    """The events of each kind, still distributed."""
    return {str(e): events.filter(F.col(op) == str(e)) for e in Event}


def latest(events: DataFrame, key: str, order: str) -> DataFrame:
    """The last event of each key."""
    return events.groupBy(key).agg(F.max_by(F.struct(*[c for c in events.columns if c != key]), order).alias("_last")).select(key, "_last.*")


def new_rows(rows: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """Polling for changes: rows whose key wasn't seen before."""
    return rows.join(seen.select(key), key, "left_anti")


def from_change_records(records: DataFrame, op: str = "operationType", key: str = "documentKey._id") -> DataFrame:
    """id and type of a document store's change records, read or streamed. A replaced document is an
    update; records without a key, and those of whole collections, are left out."""
    kind = F.when(F.col(op) == "replace", str(Event.UPDATE)).when(F.col(op).isin("insert", "update", "delete"), F.col(op))
    return records.select(F.col(key).cast("string").alias("id"), kind.alias("type")).filter("id is not null and type is not null")


def from_row_versions(rows: DataFrame, key: str, action: str = "METADATA$ACTION", update: str = "METADATA$ISUPDATE", appends: bool = False) -> DataFrame:
    """id and type of a warehouse's row versions, read or streamed. An update is a deleted and an
    inserted version, of which the inserted one counts. appends: inserted versions are all that is
    read, each as an insert."""
    inserted, changed = F.col(f"`{action}`") == "INSERT", F.coalesce(F.col(f"`{update}`").cast("boolean"), F.lit(False))
    if appends:
        kind = F.when(inserted, str(Event.INSERT))
    else:
        kind = F.when(inserted & changed, str(Event.UPDATE)).when(inserted, str(Event.INSERT)).when(~changed, str(Event.DELETE))
    return rows.select(F.col(key).cast("string").alias("id"), kind.alias("type")).filter("id is not null and type is not null")


def differences(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """key and type of the events that turn one state of a table into another."""
    names = [c for c in new.columns if c != key]
    o = old.select(F.col(key).alias("_ok"), F.struct(*[F.col(c) for c in names]).alias("_o"))
    n = new.select(F.col(key).alias("_nk"), F.struct(*[F.col(c) for c in names]).alias("_n"))
    kind = F.when(F.col("_ok").isNull(), "insert").when(F.col("_nk").isNull(), "delete").when(~F.col("_o").eqNullSafe(F.col("_n")), "update")
    return o.join(n, F.col("_ok") == F.col("_nk"), "full_outer").select(F.coalesce("_nk", "_ok").alias(key), kind.alias("type")).filter("type is not null")
