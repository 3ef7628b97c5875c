"""Validation, corrections and immutable captures of keyed records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .evaluation import percentiles


def first_reason(rules: list[tuple[str, Column]]) -> Column:
    """Name of the first rule whose condition holds; null if none does. A condition that is unknown does not hold."""
    out = F
    for name, failed in rules:
        out = out.when(failed, F.lit(name))
    return out.otherwise(F.lit(None).cast("string")) if rules else F.lit(None).cast("string")


def latest_rows(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def replace_keys(stored: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """stored with all rows of the keys that `new` has replaced by new's."""
    return stored.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def content_id(*columns: str) -> Column:
    """SHA-256 of the columns as a JSON array of strings, so that nulls and separators inside values keep contents apart."""
    return F.sha2(F.to_json(F.array(*[F.col(c).cast("string") for c in columns])), 256)


def capture_once(stored: DataFrame, new: DataFrame, content: list[str]) -> DataFrame:
    """Rows of new, with an id of their content, that were not stored before; of rows with one content, one."""
    ident = lambda df: df.withColumn("capture_id", content_id(*content))
    return ident(new).dropDuplicates(["capture_id"]).join(ident(stored).select("capture_id"), "capture_id", "left_anti")


def version_availability(rows: DataFrame, group: list[str], content: str, order: list[str], available: str) -> DataFrame:
    """rows with `changed`, and `available` moved where it is true. order: the day a row was first seen, then what settles ties.

    Within a group (a source and a date of publication) the first content is what was published; a content that none of the earlier rows
    had has been put in its place later, and is available from the day after it was seen at the earliest. A content that comes back is
    known already and moves nothing. Two windows by group; unknown contents are one content."""
    first = F.row_number().over(Window.partitionBy(*group).orderBy(*order)) == 1
    new = F.row_number().over(Window.partitionBy(*group, content).orderBy(*order)) == 1
    out = rows.withColumn("changed", ~first & new)
    return out.withColumn(available, F.when(F.col("changed"), F.greatest(F.date_add(order[0], 1), available)).otherwise(F.col(available)))


def merge_first_seen(stored: DataFrame, new: DataFrame, keys: list[str], value: str, tolerance: float = 1e-8) -> tuple[DataFrame, DataFrame]:
    """(stored and rows with new keys, revisions): what was observed first stays, later values that differ go to revisions."""
    merged = stored.unionByName(new.join(stored, keys, "left_anti"))
    both = new.join(stored.select(*keys, F.col(value).alias("first_value")), keys)
    return merged, both.where(F.abs(F.col(value) - F.col("first_value")) > tolerance * F.abs("first_value"))


def not_null(rows: DataFrame, defaults: dict) -> DataFrame:
    """Nulls of the named columns become typed defaults."""
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    return rows.select(*[F.coalesce(c, F.lit(defaults[c]).cast(kinds[c])).alias(c) if c in defaults else F.col(c) for c in rows.columns])


def duplicate_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def adjustment_revision(records: DataFrame, reference: DataFrame, keys: list[str], by: str, value: str, tolerance: float = 0.005) -> DataFrame:
    """Per `by`: how many overlapping values moved, and whether that is a restatement (two or more and at least 60 %, or one by over 25 %)."""
    both = records.join(reference.select(*keys, F.col(value).alias("old")), keys)
    off = F.abs(F.col(value) / F.col("old") - 1)
    out = both.where("old > 0").groupBy(by).agg(F.count("*").alias("n_overlap"), F.count_if(off > tolerance).alias("n_moved"), F.max(off).alias("largest"))
    return out.withColumn("restated", ((F.col("n_moved") >= 2) & (F.col("n_moved") >= 0.6 * F.col("n_overlap"))) | (F.col("largest") > 0.25))


def robust_outliers(rows: DataFrame, key: list[str], columns: list[str], limit: float = 8.0, least: int = 4) -> DataFrame:
    """key, column_name, value of values whose modified z-score exceeds the limit."""
    long = rows.select(*key, F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("value")) for c in columns])).alias("x")).select(*key, "x.*").where("value is not null")
    med = percentiles(long, "value", {"med": 0.5}, "column_name")
    dev = long.join(F.broadcast(med), "column_name").withColumn("dev", F.abs(F.col("value") - F.col("med")))
    mad = percentiles(dev, "dev", {"mad": 0.5}, "column_name").drop("n")
    hit = dev.join(F.broadcast(mad), "column_name").where((F.col("n") >= least) & (F.col("mad") != 0) & (0.6745 * F.col("dev") / F.col("mad") > limit))
    return hit.select(*key, "column_name", "value")
