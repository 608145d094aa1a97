"""Table changes as table in, table out. Keys are compared null-safely nowhere: a null key matches nothing.

Where a source says what becomes of existing rows, one of its rows counts for each key (the greatest,
column by column), so a repeated key never multiplies target rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def true_where(predicate: Column) -> Column:
    """The predicate, with null as false: so a row is deleted or changed only where it holds."""
    return F.coalesce(predicate, F.lit(False))


def delete_where(rows: DataFrame, predicate: Column) -> DataFrame:
    return rows.where(~true_where(predicate))


def count_where(rows: DataFrame, predicate: Column | None = None) -> DataFrame:
    return (rows if predicate is None else rows.where(predicate)).agg(F.count("*").alias("n"))


def update_set(rows: DataFrame, predicate: Column, values: dict[str, Column]) -> DataFrame:
    hit = true_where(predicate)
    return rows.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in values.items()})


def add_to_set(rows: DataFrame, array: str, value: Column, predicate: Column | None = None) -> DataFrame:
    """Adds the value to the array if it is absent; a null array becomes one of that value."""
    old = F.coalesce(F.col(array), F.array().cast(rows.schema[array].dataType))
    return update_set(rows, F.lit(True) if predicate is None else predicate, {array: F.array_union(old, F.array(value))})


def set_array(rows: DataFrame, array: str, old: Column, value: Column) -> DataFrame:
    return rows.withColumn(array, F.concat(old, F.array(value)))


def one_per_key(source: DataFrame, on: Sequence[str]) -> DataFrame:
    """The source with one row for each key; the aggregation deals rows out as the join that follows does.

    Rows are compared by their values, column by column; only where a column cannot be compared (a map) by JSON.
    """
    row = F.struct(*source.columns)
    place = F.to_json(row) if any(_holds_map(f.dataType) for f in source.schema) else row
    best = source.groupBy(*on).agg(F.max_by(row, place).alias("row_"))
    return best.select(*(F.col(c) if c in on else F.col(f"row_.{c}").alias(c) for c in source.columns))  # the keys are the groups', so the join needs no exchange of its own


def _holds_map(kind: T.DataType) -> bool:
    inner = [f.dataType for f in kind] if isinstance(kind, T.StructType) else [kind.elementType] if isinstance(kind, T.ArrayType) else []
    return isinstance(kind, (T.MapType, T.VariantType)) or any(map(_holds_map, inner))


def update_if_changed(target: DataFrame, source: DataFrame, on: Sequence[str]) -> DataFrame:
    """The target with the source's values, and ``changed``: whether any value differed."""
    values = [c for c in target.columns if c not in on]
    s = one_per_key(source.select(*on, *values), on).select(*on, F.struct(*values).alias("new_"))
    joined = target.join(s, list(on), "left")
    changed = F.col("new_").isNotNull() & ~F.struct(*values).eqNullSafe(F.col("new_"))
    joined = joined.withColumn("changed", changed)
    return joined.select(*on, *(F.when(F.col("changed"), F.col(f"new_.{c}")).otherwise(F.col(c)).alias(c) for c in values), "changed")


def update_status(target: DataFrame, changes: DataFrame, on: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """``changes``: key, new_status, new_creation (null keeps the old one). Returns the table, and the changes that did not hit one row."""
    joined = target.join(one_per_key(changes, on).withColumn("hit_", F.lit(True)), list(on), "left")
    table = joined.withColumn("status", F.coalesce("new_status", "status")).withColumn("creation", F.coalesce("new_creation", "creation")).select(*target.columns)
    hits = target.groupBy(*on).agg(F.count("*").alias("hits"))
    missed = changes.join(hits, list(on), "left").where(F.coalesce("hits", F.lit(0)) != 1).drop("hits")
    return table, missed


def keep_existing(target: DataFrame, source: DataFrame, on: Sequence[str]) -> DataFrame:
    """Inserts only keys that the target lacks."""
    return target.unionByName(source.join(target.select(*on), list(on), "left_anti"), allowMissingColumns=True)


def replace(target: DataFrame, source: DataFrame, on: Sequence[str]) -> DataFrame:
    """Replaces or inserts."""
    return source.unionByName(target.join(source.select(*on), list(on), "left_anti"), allowMissingColumns=True)


def merge_or_discard(target: DataFrame, source: DataFrame, on: Sequence[str], fields: Sequence[str], once: bool = False) -> DataFrame:
    """Overwrites the fields of existing keys; source rows without a target are dropped, null values change nothing.

    ``once``: the source is known to have one row per key.
    """
    s = source.select(*on, *fields) if once else one_per_key(source.select(*on, *fields), on)
    s = s.select(*on, *(F.col(c).alias(f"{c}_new") for c in fields))
    joined = target.join(s, list(on), "left")
    return joined.select(*(F.coalesce(f"{c}_new", c).alias(c) if c in fields else F.col(c) for c in target.columns))


def concat_array(target: DataFrame, source: DataFrame, on: Sequence[str], array: str) -> DataFrame:
    """Appends the source's array to an existing row's, else inserts the row. ``on`` and the array are the result."""
    s = source.select(*on, F.col(array).alias("more_"))
    empty = F.array().cast(target.schema[array].dataType)
    joined = target.select(*on, array).join(s, list(on), "full_outer")
    return joined.select(*on, F.concat(F.coalesce(array, empty), F.coalesce("more_", empty)).alias(array))


def null_out(native: DataFrame, snapshot: DataFrame, on: Sequence[str]) -> DataFrame:
    """Sets ``db`` from the snapshot; where its rank says deleting or deleted, clears ``driver``."""
    joined = native.select(*on, F.col("db").alias("old_"), "driver").join(snapshot.select(*on, "db"), list(on), "full_outer")
    gone = F.coalesce(F.col("db.nstatus").isin(4, 5, 6), F.lit(False))
    return joined.select(*on, F.coalesce("db", "old_").alias("db"), F.when(~gone, F.col("driver")).alias("driver"))
