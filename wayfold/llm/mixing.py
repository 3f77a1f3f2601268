"""Mixing sources to target weights: token totals per source, repetition rates, hash-seeded copies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, BROADCAST_ROWS, durable, free_name, read

WORD = r"[^\x20\x09-\x0D]+"
SALTS = 32


def word_count(text: Column) -> Column:
    """Words of a text (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def unit_hash(key: Column, seed: str) -> Column:
    """A number in [0, 1) that depends on the key alone: 52 bits of MD5. Equal in any SQL engine."""
    digest = F.md5(F.concat(F.lit(seed), F.coalesce(key.cast("string"), F.lit("null"))).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(2**52))


def source_targets(sizes: DataFrame, source: str = "source", size: str = "size", weights=(5, 2, 1), budget: float = 1.5, cap: float = 2.0) -> DataFrame:
    """One row a source: source_size, weight, target.

    Sources in code point order (null last) get the weights in turn and share ``budget`` times all sizes.
    A target stops at ``cap`` times its source's size; the excess is shared by weight among the rest until no
    target is above. That is a common water level, found by running sums over the sources ordered by cap / weight.
    The windows see one row a source, not documents. Sources without words get target 0.
    """
    by_name = Window.orderBy(F.col(source).asc_nulls_last())
    everything = Window.partitionBy()
    by_ratio = Window.orderBy("ratio", "rank")
    t = sizes.groupBy(source).agg(F.sum(size).cast("long").alias("source_size"))
    t = t.withColumn("rank", F.row_number().over(by_name) - 1)
    t = t.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")).cast("double"))
    t = t.withColumn("most", F.col("source_size") * F.lit(float(cap))).withColumn("ratio", F.col("most") / F.col("weight"))
    t = t.withColumn("all_size", F.sum("source_size").over(everything) * F.lit(float(budget)))
    t = t.withColumn("filled", F.sum("most").over(by_ratio.rowsBetween(Window.unboundedPreceding, 0)) - F.col("most"))
    t = t.withColumn("weight_left", F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
    t = t.withColumn("level", (F.col("all_size") - F.col("filled")) / F.col("weight_left"))
    level = F.max(F.when(F.col("most") >= F.col("weight") * F.col("level"), F.col("level"))).over(everything)
    t = t.withColumn("level", level)
    open_target = F.col("weight") * F.col("level")
    target = F.when(F.col("level").isNull() | (F.col("most") < open_target), F.col("most")).otherwise(open_target)
    return t.select(source, "source_size", "weight", target.alias("target"))


def join_sources(docs: DataFrame, sources: DataFrame, source: str, spread: str) -> DataFrame:
    """docs with the columns of its source. Broadcast when the counted table is small, else salted by the column spread."""
    size = sources.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length(F.col(source))).alias("b")).first()
    name, salt, pick = (free_name(docs, f"__mix_{k}") for k in ("name", "salt", "pick"))
    right = sources.withColumnRenamed(source, name)
    if size.n <= BROADCAST_ROWS and (size.b or 0) <= BROADCAST_BYTES:
        return docs.join(F.broadcast(right), F.col(source).eqNullSafe(F.col(name)), "left").drop(name)
    right = right.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    left = docs.withColumn(pick, F.pmod(F.xxhash64(F.col(spread)), F.lit(SALTS)))
    on = F.col(source).eqNullSafe(F.col(name)) & (F.col(pick) == F.col(salt))
    return left.join(right, on, "left").drop(name, salt, pick)


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: str = "mix:", **shares) -> DataFrame:
    """Per document: doc_id, size, source_size, target, copies, taken.

    copies = floor(rate) + 1 with probability frac(rate), where rate = target / source_size; the draw is a hash of
    seed and doc_id, so that reruns agree and repeated rows of one id share their draw. A null or empty text has
    size 0 and takes no words; an empty table gives no rows; a null source is a source of its own, the last one.
    """
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"))
    sources = durable(source_targets(d, **shares))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    d = join_sources(d, sources, "source", "doc_id").withColumn("rate", rate)
    copies = F.floor("rate") + (unit_hash(F.col("doc_id"), seed) < F.col("rate") - F.floor("rate")).cast("long")
    d = d.withColumn("copies", copies.cast("long"))
    return d.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def emit_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: str = "mix:", **shares) -> DataFrame:
    """The mixed corpus: each row of docs, with all its columns, as often as the mix takes it (see mix). Rows of one id
    share their draw; a null or empty text is taken as often as its source's rate says; an empty table gives no rows, and
    so does a source without words."""
    d = docs.select(F.col(source).alias("source"), word_count(F.col(text)).alias("size"))
    sources = source_targets(d, **shares)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    key, plan = free_name(docs, "__mix_source"), free_name(docs, "__mix_rate")
    sources = durable(sources.select(F.col("source").alias(key), rate.alias(plan)))
    out = join_sources(docs.withColumn(key, F.col(source)), sources, key, doc_id)
    copies = F.floor(plan) + (unit_hash(F.col(doc_id), seed) < F.col(plan) - F.floor(plan)).cast("long")
    each = free_name(docs, "__mix_copy")
    return out.withColumn(each, F.explode(F.array_repeat(F.lit(1), copies.cast("int")))).select(*docs.columns)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents"))


OP1_SQL = r"""
with d as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size from documents
), s0 as (
  select source, sum(size)::bigint as source_size from d group by source
), s1 as (
  select *, row_number() over (order by source asc nulls last) - 1 as rnk from s0
), s2 as (
  select *, (case rnk % 3 when 0 then 5 when 1 then 2 else 1 end)::double as weight, source_size * 2.0::double as most,
         sum(source_size) over () * 1.5::double as all_size from s1
), s3 as (
  select *, sum(most) over (order by most / weight, rnk rows unbounded preceding) - most as filled,
         sum(weight) over (order by most / weight, rnk rows between current row and unbounded following) as weight_left from s2
), s4 as (select *, (all_size - filled) / weight_left as lvl from s3),
s5 as (select *, max(case when most >= weight * lvl then lvl end) over () as level from s4),
s as (
  select source, source_size, case when level is null or most < weight * level then most else weight * level end as target from s5
), r as (
  select d.doc_id, d.size, s.source_size, s.target, case when s.source_size > 0 then s.target / s.source_size else 0.0::double end as rate,
         ('0x' || substr(md5('mix:' || coalesce(d.doc_id::varchar, 'null')), 1, 13))::bigint / 4503599627370496.0::double as u
  from d join s on d.source is not distinct from s.source
), c as (select *, (floor(rate) + case when u < rate - floor(rate) then 1 else 0 end)::bigint as copies from r)
select doc_id, size, source_size, target, size * copies as taken, copies from c
"""
