"""Profiles and data-quality rules; rules give issues, they don't stop a job."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def field_profile(df: DataFrame, fields: list[str], top: int = 12, small: int = 50) -> DataFrame:
    """profile of some fields of a table."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields]))
    return profile(df.select(pairs.alias("p")).select("p.field", "p.value"), top, small)


def layer_profile(features: DataFrame, layers: list[str], fields: list[str]) -> DataFrame:
    """layer and the profile of its fields, for the layers that are shown."""
    shown = features.where(F.col("layer").isin(layers))
    named = lambda f: F.struct(F.concat("layer", F.lit("."), F.lit(f)).alias("field"), F.col(f).cast("string").alias("value"))
    out = profile(shown.select(F.explode(F.array(*map(named, fields))).alias("p")).select("p.field", "p.value"))
    return out.select(F.substring_index("field", ".", 1).alias("layer"), F.substring_index("field", ".", -1).alias("field"), *out.columns[1:])


def profile(pairs: DataFrame, top: int = 12, small: int = 50) -> DataFrame:
    """field, rows, nulls, null_ppm, distinct_values, value, n of pairs (field, value): a row for each value of fields with
    ``small`` or fewer values, for each of the ``top`` most frequent ones of others, and one with a null value for fields
    of nulls only."""
    counts = pairs.groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"))
    whole = counts.groupBy("field").agg(F.sum("n").alias("rows"), F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("nulls"), F.count("value").alias("distinct_values"))
    given, few = counts.where("value is not null"), F.col("distinct_values") <= small
    # a limit alone in its filter is applied by every task before the shuffle, so that no task ranks all values of a field
    w = Window.partitionBy("field").orderBy(F.desc("n"), "value")
    most = given.join(whole.where(~few).select("field"), "field").withColumn("place", F.row_number().over(w)).where(F.col("place") <= top)
    best = given.join(whole.where(few).select("field"), "field").unionByName(most.drop("place"))
    out = whole.join(best, "field", "left").withColumn("null_ppm", F.floor(F.col("nulls") * 1000000 / F.col("rows") + 0.5).cast("long"))
    return out.select("field", "rows", "nulls", "null_ppm", "distinct_values", "value", "n")


def issues(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """source_id, code: one row for each rule a row breaks (a rule that is null counts as broken)."""
    found = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(code)) for code, ok in rules.items()]
    return df.select(F.col(key).alias("source_id"), F.explode(F.array_compact(F.array(*found))).alias("code"))


def repeated(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(F.col(key).alias("source_id")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("source_id", F.lit("duplicate-id").alias("code"))


def reconcile(declared: DataFrame, computed: DataFrame, key: str, value: str) -> DataFrame:
    """key, declared, computed, problem (missing, extra, wrong) of the counts that don't agree."""
    d = declared.select(key, F.col(value).alias("declared")).join(computed.select(key, F.col(value).alias("computed")), key, "full_outer")
    problem = F.when(F.col("declared").isNull(), "extra").when(F.col("computed").isNull(), "missing").when(F.col("declared") != F.col("computed"), "wrong")
    return d.withColumn("problem", problem).where("problem is not null")


def uncovered(wanted: DataFrame, given: DataFrame, key: str) -> DataFrame:
    """key, side: ids that one side has and the other hasn't."""
    a = wanted.select(key).join(given.select(key), key, "left_anti").withColumn("side", F.lit("missing"))
    return a.unionByName(given.select(key).join(wanted.select(key), key, "left_anti").withColumn("side", F.lit("unknown"))).distinct()


def differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """side (left, right) and the row, for each row that one build of a table has and the other hasn't; repeats count."""
    cols = left.columns
    only = lambda a, b, side: a.select(*cols).exceptAll(b.select(*cols)).select(F.lit(side).alias("side"), *cols)
    return only(left, right, "left").unionByName(only(right, left, "right"))


def dataset_sizes(tables: dict[str, DataFrame]) -> DataFrame:
    """dataset, rows: what a release holds."""
    return reduce(DataFrame.unionByName, [t.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("dataset"), "rows") for n, t in tables.items()])


def same_rows(left: DataFrame, right: DataFrame) -> bool:
    """Whether two builds of a table hold the same rows."""
    diff = [left.exceptAll(right), right.exceptAll(left)]
    return reduce(DataFrame.unionByName, diff).limit(1).count() == 0
