"""Upserts, replacements, two-way merges and folds of user progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def replace_by(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows whose key is not among the new ones, and the new rows. Idempotent."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def merge_progress(local: DataFrame, remote: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer merge of (status, is_bookmarked, user_answer): bookmarks are or-ed, the local status wins unless unattempted, the
    local answer wins unless empty. ``migrate`` marks rows that the remote side lacks or has otherwise."""
    fields = ("status", "is_bookmarked", "user_answer")
    a = local.select(*keys, *(F.col(f).alias(f"l_{f}") for f in fields))
    b = remote.select(*keys, *(F.col(f).alias(f"r_{f}") for f in fields), F.lit(True).alias("r_there"))
    m = a.join(b, keys, "full_outer")
    none = F.lit("unattempted")
    status = F.when(F.coalesce("l_status", none) != none, F.col("l_status")).otherwise(F.coalesce("r_status", none))
    marked = F.coalesce("l_is_bookmarked", F.lit(False)) | F.coalesce("r_is_bookmarked", F.lit(False))
    answer = F.coalesce(F.nullif("l_user_answer", F.lit("")), F.nullif("r_user_answer", F.lit("")))
    out = m.select(*keys, status.alias("status"), marked.alias("is_bookmarked"), answer.alias("user_answer"), "r_there", "r_status", "r_is_bookmarked", "r_user_answer")
    changed = F.col("r_there").isNull() | ~F.col("status").eqNullSafe(F.col("r_status")) | ~F.col("is_bookmarked").eqNullSafe(F.col("r_is_bookmarked")) | ~F.col("user_answer").eqNullSafe(F.nullif("r_user_answer", F.lit("")))
    worth = (F.col("status") != none) | F.col("is_bookmarked") | F.col("user_answer").isNotNull()
    return out.withColumn("migrate", changed & worth).drop("r_there", "r_status", "r_is_bookmarked", "r_user_answer")


def latest(events: DataFrame, keys: list[str], order: list[str], *values: str) -> DataFrame:
    """Each key's values from its last event: partial aggregates, no sort."""
    return events.groupBy(*keys).agg(F.max_by(F.struct(*values), F.struct(*order)).alias("v")).select(*keys, "v.*")


def partial_latest(events: DataFrame, keys: list[str], order: list[str], *values: str) -> DataFrame:
    """Each key's last non-null value of every field: unspecified fields keep what they had."""
    parts = [F.max_by(F.when(F.col(v).isNotNull(), F.col(v)), F.when(F.col(v).isNotNull(), F.struct(*order))).alias(v) for v in values]
    return events.groupBy(*keys).agg(*parts)


def toggled(events: DataFrame, keys: list[str], name: str = "on") -> DataFrame:
    """A switch after all its flips."""
    return events.groupBy(*keys).agg((F.count(F.lit(1)) % 2 == 1).alias(name))


def ghost_purge(items: DataFrame, keys: list[str], parent: Column, children_of: Column) -> DataFrame:
    """Drop parents whose children are present: items whose own key is some other item's parent key."""
    held = items.select(*keys, children_of.alias("__parent")).where("__parent is not null").distinct()
    return items.withColumn("__parent", parent).join(held, [*keys, "__parent"], "left_anti").drop("__parent")
