"""Mixing sources to target weights by systematic sampling.

Sources in code point order (null last) take the weights in turn.  Targets share
all words by weight; a target stops at ``cap`` times its source's size and what
is over goes to the others by weight until none is above.  Each document of a
source expects ``target / source size`` copies.  Within the source these expected
copies are summed up in one order, a random offset below one is added, and the
document is emitted once for each integer boundary its step crosses.

The order goes by size class (eight to each doubling), which spreads the
boundaries evenly over short and long documents, and within a class by buckets
of a hash of the id, so that a source with a third of all rows is numbered by
many tasks: the prefix sum is the row number in the bucket plus the rows of the
buckets before.

Defined results: null and empty texts have size 0 and may be emitted, which adds
no words; a source without words has target 0; repeated rows and null ids are
rows like any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

WEIGHTS = (5, 2, 1)
CAP = 3
BUCKETS = 64
SEED = "mix-1"


def size_of(text="text"):
    """Number of words (runs without white space); null: 0."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def bucket_of(number: str = "number", size: str = "size", buckets: int = BUCKETS):
    """Size class and hash bucket in one number, by plain integer arithmetic (the same in any SQL engine)."""
    bits = f"length(bin({size}))"
    size_class = F.expr(f"CASE WHEN {size} < 8 THEN {size} ELSE {bits} * 8 + (shiftright({size}, {bits} - 4) & 7) END")
    hashed = F.pmod(F.pmod(F.col(number), F.lit(2147483647)) * 48271, F.lit(2147483647)) % buckets
    return (size_class * buckets + hashed).cast("bigint")


def number_of():
    """The id, or a number of the text for rows without one, so that these fill all buckets."""
    return F.coalesce(F.col("doc_id").cast("bigint"), F.conv(F.substring(F.md5(F.coalesce("text", F.lit(""))), 1, 8), 16, 10).cast("bigint"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(source, source_size, n_docs, target, offset) from (source, source_size, n_docs), one row per source.

    Targets are ``least(cap * size, level * weight)``.  Going up by ``size /
    weight``, sources fill until the level that the rest allows is below the
    next one's cap.
    """
    numbered = sizes.withColumn("place", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    listed = F.array(*(F.lit(float(w)) for w in weights))
    weighed = numbered.withColumn("weight", F.element_at(listed, (F.col("place") % len(weights) + 1).cast("int")))
    w = W.orderBy((F.col("source_size") / F.col("weight")).asc(), F.col("place").asc())
    everything = W.partitionBy()
    before = w.rowsBetween(W.unboundedPreceding, -1)
    level = (F.sum("source_size").over(everything) - cap * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    filled = weighed.withColumn("level", level).withColumn("open", F.col("level") * F.col("weight") < cap * F.col("source_size"))
    water = F.min(F.when(F.col("open"), F.struct((F.col("source_size") / F.col("weight")).alias("r"), "place", "level"))).over(everything)["level"]
    target = F.when(F.col("source_size") == 0, 0.0).otherwise(F.least(F.lit(float(cap)) * F.col("source_size"), F.coalesce(water * F.col("weight"), F.lit(float(cap)) * F.col("source_size"))))
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{SEED}:"), F.coalesce("source", F.lit("\0")))), 1, 8), 16, 10).cast("double") / 4294967296.0
    return filled.select("source", "source_size", "n_docs", target.alias("target"), offset.alias("offset"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, carry: tuple[str, ...] = (), buckets: int = BUCKETS) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken (and carried columns) for every document.

    Rows that tie on size and id are numbered in any order.
    """
    own = ("doc_id", "source", "size", "source_size", "target", "copies", "taken")
    carry = tuple(c for c in carry if c not in own)
    sized = docs.select("doc_id", F.col("source").cast("string").alias("source"), size_of().alias("size"), number_of().alias("_number"), *(F.col(c).alias(f"_c{i}") for i, c in enumerate(carry)))
    sized = sized.withColumn("_bucket", bucket_of("_number", buckets=buckets))
    per_bucket = sized.groupBy("source", "_bucket").agg(F.sum("size").alias("words"), F.count("*").alias("rows"))
    sources = targets(per_bucket.groupBy("source").agg(F.sum("words").alias("source_size"), F.sum("rows").alias("n_docs")), weights, cap)
    earlier = W.partitionBy("source").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    heads = per_bucket.select("source", "_bucket", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("rows_before"))
    plan = heads.join(sources, heads["source"].eqNullSafe(sources["source"])).select(heads["source"].alias("s"), F.col("_bucket").alias("b"), "rows_before", "source_size", "target", "offset")
    within = W.partitionBy("source", "_bucket").orderBy(F.col("size").desc(), F.col("doc_id").asc_nulls_last())
    numbered = sized.withColumn("_i", F.row_number().over(within))
    joined = numbered.join(plan, F.col("source").eqNullSafe(F.col("s")) & (F.col("_bucket") == F.col("b")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    at = F.col("rows_before") + F.col("_i")
    copies = (F.floor(rate * at + F.col("offset")) - F.floor(rate * (at - 1) + F.col("offset"))).cast("bigint")
    return joined.select(
        "doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), *(F.col(f"_c{i}").alias(c) for i, c in enumerate(carry))
    )


def emitted(mixed: DataFrame) -> DataFrame:
    """One row per copy, numbered by ``copy`` from 1."""
    return mixed.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))


#: DuckDB SQL over a relation named ``mix_docs`` (doc_id, text, source).
MIX_SQL = f"""
counted AS (SELECT doc_id, source, CAST(COALESCE(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
  COALESCE(doc_id, CAST('0x' || substr(md5(COALESCE(text, '')), 1, 8) AS BIGINT)) AS number FROM mix_docs),
sized AS (SELECT *, CASE WHEN size < 8 THEN size ELSE length(bin(size)) * 8 + ((size >> (length(bin(size)) - 4)) & 7) END * {BUCKETS}
  + (((number % 2147483647 + 2147483647) % 2147483647) * 48271) % 2147483647 % {BUCKETS} AS b FROM counted),
sources AS (SELECT source, CAST(SUM(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM sized GROUP BY source),
weighed AS (SELECT *, CASE place % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM sources),
levels AS (SELECT *, source_size / weight AS ratio,
  (CAST(SUM(source_size) OVER () AS BIGINT) - {CAP} * CAST(COALESCE(SUM(source_size) OVER w, 0) AS BIGINT))::DOUBLE / (SUM(weight) OVER () - COALESCE(SUM(weight) OVER w, 0.0)) AS level
  FROM weighed WINDOW w AS (ORDER BY source_size / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
water AS (SELECT first(level ORDER BY ratio, place) AS water FROM levels WHERE level * weight < {CAP} * source_size),
targets AS (SELECT source, source_size, CASE WHEN source_size = 0 THEN 0.0::DOUBLE ELSE LEAST({CAP}.0::DOUBLE * source_size, COALESCE(water * weight, {CAP}.0::DOUBLE * source_size)) END AS target,
  CAST(CAST(('0x' || substr(md5('{SEED}:' || COALESCE(source, chr(0))), 1, 8)) AS BIGINT) AS DOUBLE) / 4294967296.0::DOUBLE AS off FROM levels LEFT JOIN water ON TRUE),
numbered AS (SELECT s.*, t.source_size, t.target, t.off, row_number() OVER (PARTITION BY s.source ORDER BY s.b, s.size DESC, s.doc_id NULLS LAST) AS i
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
rated AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0::DOUBLE END AS rate FROM numbered),
mixed AS (SELECT doc_id, source, size, source_size, target, CAST(floor(rate * i + off) - floor(rate * (i - 1) + off) AS BIGINT) AS copies FROM rated)
"""
