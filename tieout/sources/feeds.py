"""Two feeds, a stream and their planted faults, derived from the ``orders`` and ``events`` tables.

The faults go by bucket ``(orderkey * 7919) mod 1000``, so any engine derives the same feeds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tieout.operators import scan

FIRST_DAY = "2026-03-02"
AS_OF = "2026-03-09"
DAYS = 5
PARTITIONS = 4
CLOSE = "2026-03-06 18:00:00"
FIRST_CLOSE = "2026-03-06 17:04:00"
DROPPED, DELAYED, SILENT = 12, 5, "p3"


def _base(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_totalprice")
    key = F.col("o_orderkey")
    amount = F.round(F.col("o_totalprice") * 100).cast("bigint")
    return o.select(
        key.alias("k"),
        F.pmod(key * 7919, F.lit(1000)).alias("b"),
        F.concat(F.lit("TX"), F.lpad(key.cast("string"), 9, "0")).alias("ref"),
        F.date_add(F.lit(FIRST_DAY).cast("date"), F.pmod(key, F.lit(DAYS)).cast("int")).alias("business_date"),
        F.concat(F.lit("AC"), F.lpad(F.pmod(F.col("o_custkey"), F.lit(40)).cast("string"), 4, "0")).alias("account"),
        F.when(F.pmod(key, F.lit(10)) == 9, -amount).otherwise(amount).alias("amount_minor"),
        F.when(F.pmod(F.col("o_custkey"), F.lit(5)) == 3, "EUR").when(F.pmod(F.col("o_custkey"), F.lit(5)) == 4, "GBP").otherwise("USD").alias("currency"),
        F.when(F.pmod(key, F.lit(10)) == 9, "refund").otherwise("payment").alias("kind"),
    )


def _between(low: int, high: int) -> Column:
    return (F.col("b") >= low) & (F.col("b") < high)


_RECORD = ["ref", "business_date", "account", "amount_minor", "currency", "kind", "source", "source_file", "line_no"]


def core(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The core feed: one record per order, but for those planted as missing."""
    rows = _base(spark, sf_dir).where(~_between(42, 50))
    return rows.withColumns({"source": F.lit("core"), "source_file": F.lit("core.bai"), "line_no": F.col("k")}).select(*_RECORD)


def processor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The processor feed, with the planted faults."""
    a, usd = F.col("amount_minor"), F.col("currency") == "USD"
    fee = F.greatest(F.lit(25), F.call_function("div", F.abs(a) * 20, F.lit(10000))).cast("bigint")
    amount = (
        F.when(_between(60, 85), F.when(a < 0, a + fee).otherwise(a - fee))
        .when(_between(85, 100) & ~usd, a + 2)
        .when(_between(85, 106), -a)
        .when(_between(118, 124), a + 77777)
        .otherwise(a)
    )
    days = F.when(_between(0, 30), 1).when(_between(112, 118), 10).otherwise(0)
    rows = _base(spark, sf_dir).where(~_between(30, 42))
    rows = rows.withColumn("copy", F.explode(F.when(_between(50, 60), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    return rows.withColumns(
        {
            "amount_minor": amount,
            "business_date": F.date_add("business_date", days),
            "currency": F.when(_between(106, 112), "JPY").otherwise(F.col("currency")),
            "source": F.lit("processor"),
            "source_file": F.lit("processor.jsonl"),
            "line_no": F.col("k") * 2 + F.col("copy"),
        }
    ).select(*_RECORD)


def planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ref, break_type) of every planted fault."""
    bands = ((0, 30, "timing"), (30, 50, "missing"), (50, 60, "duplicate"), (60, 85, "amount_fee"), (100, 106, "sign"), (106, 112, "currency"), (112, 118, "date_gap"), (118, 124, "amount_unknown"))
    kind = F.when(_between(85, 100), F.when(F.col("currency") == "USD", "sign").otherwise("amount_fx"))
    for low, high, name in bands:
        kind = kind.when(_between(low, high), name)
    return _base(spark, sf_dir).select("ref", kind.alias("break_type")).where("break_type is not null")


def stream_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delivered events (partition, seq, arrival): with a hole in p1, late events in p2, and repeats in p0."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.concat(F.lit("p"), F.pmod("user_id", F.lit(PARTITIONS)).cast("string")).alias("partition"))
    stamped = scan.numbered(e, "partition", "event_id", "seq").withColumn("seq", F.col("seq").cast("bigint"))
    # One row a partition.
    sized = stamped.join(F.broadcast(e.groupBy("partition").agg(F.count("*").alias("n"))), "partition")
    third = F.floor(F.col("n") / 3)
    hole = (F.col("partition") == "p1") & (F.col("seq") >= third) & (F.col("seq") < third + DROPPED)
    late = (F.col("partition") == "p2") & (F.col("seq") > F.col("n") - 25) & (F.col("seq") <= F.col("n") - 25 + DELAYED)
    sent = sized.where(~hole).withColumn("arrival", F.when(late, F.col("event_id") + 1_000_000_000).otherwise(F.col("event_id")))
    again = sent.where("partition = 'p0' and seq % 97 = 0").withColumn("arrival", F.col("arrival") + 2_000_000_000)
    return sent.unionByName(again).select("partition", "seq", "arrival")


def heartbeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One beat per partition at the close; the silent partition's is 40 minutes earlier."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.concat(F.lit("p"), F.pmod("user_id", F.lit(PARTITIONS)).cast("string")).alias("partition"))
    at = F.when(F.col("partition") == SILENT, F.expr(f"timestamp'{CLOSE}' - interval 40 minutes")).otherwise(F.expr(f"timestamp'{CLOSE}'"))
    return e.groupBy("partition").agg(F.count("*").alias("producer_high_water")).select("partition", at.alias("at"), "producer_high_water", F.substring("partition", 2, 9).cast("bigint").alias("arrival"))


def beats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two beats per partition: an hour before the close at half of its events, then those of ``heartbeats``."""
    last = heartbeats(spark, sf_dir)
    first = last.select("partition", F.expr(f"timestamp'{CLOSE}' - interval 1 hour").alias("at"), F.floor(F.col("producer_high_water") / 2).cast("bigint").alias("producer_high_water"), "arrival")
    return first.unionByName(last.withColumn("arrival", F.col("arrival") + PARTITIONS))


#: The same feeds as DuckDB CTEs: core, proc, planted, stream_event, beat.
DUCKDB = f"""
base AS (SELECT o_orderkey AS k, (o_orderkey * 7919) % 1000 AS b, 'TX' || lpad(CAST(o_orderkey AS VARCHAR), 9, '0') AS ref,
  DATE '{FIRST_DAY}' + CAST(o_orderkey % {DAYS} AS INTEGER) AS business_date, 'AC' || lpad(CAST(o_custkey % 40 AS VARCHAR), 4, '0') AS account,
  CAST(round(o_totalprice * 100) AS BIGINT) * CASE WHEN o_orderkey % 10 = 9 THEN -1 ELSE 1 END AS amount_minor,
  CASE o_custkey % 5 WHEN 3 THEN 'EUR' WHEN 4 THEN 'GBP' ELSE 'USD' END AS currency, CASE WHEN o_orderkey % 10 = 9 THEN 'refund' ELSE 'payment' END AS kind FROM orders),
core AS (SELECT ref, business_date, account, amount_minor, currency, kind, 'core' AS source, 'core.bai' AS source_file, k AS line_no FROM base WHERE NOT b BETWEEN 42 AND 49),
proc AS (SELECT ref, business_date + CASE WHEN b < 30 THEN 1 WHEN b BETWEEN 112 AND 117 THEN 10 ELSE 0 END AS business_date, account,
  CASE WHEN b BETWEEN 60 AND 84 THEN amount_minor - sign(amount_minor)::BIGINT * greatest(25, abs(amount_minor) * 20 // 10000)
    WHEN b BETWEEN 85 AND 99 AND currency <> 'USD' THEN amount_minor + 2 WHEN b BETWEEN 85 AND 105 THEN -amount_minor
    WHEN b BETWEEN 118 AND 123 THEN amount_minor + 77777 ELSE amount_minor END AS amount_minor,
  CASE WHEN b BETWEEN 106 AND 111 THEN 'JPY' ELSE currency END AS currency, kind, 'processor' AS source, 'processor.jsonl' AS source_file, 2 * k + c AS line_no
  FROM base, unnest(CASE WHEN b BETWEEN 50 AND 59 THEN [0, 1] ELSE [0] END) AS t(c) WHERE NOT b BETWEEN 30 AND 41),
planted AS (SELECT ref, CASE WHEN b < 30 THEN 'timing' WHEN b < 50 THEN 'missing' WHEN b < 60 THEN 'duplicate' WHEN b < 85 THEN 'amount_fee'
  WHEN b < 100 THEN CASE WHEN currency = 'USD' THEN 'sign' ELSE 'amount_fx' END WHEN b < 106 THEN 'sign' WHEN b < 112 THEN 'currency'
  WHEN b < 118 THEN 'date_gap' WHEN b < 124 THEN 'amount_unknown' END AS break_type FROM base WHERE b < 124),
stamped AS (SELECT event_id, 'p' || (user_id % {PARTITIONS}) AS part, row_number() OVER (PARTITION BY user_id % {PARTITIONS} ORDER BY event_id) AS seq,
  count(*) OVER (PARTITION BY user_id % {PARTITIONS}) AS n FROM events),
sent AS (SELECT part, seq, CASE WHEN part = 'p2' AND seq > n - 25 AND seq <= n - 25 + {DELAYED} THEN event_id + 1000000000 ELSE event_id END AS arrival
  FROM stamped WHERE NOT (part = 'p1' AND seq >= n // 3 AND seq < n // 3 + {DROPPED})),
stream_event AS (SELECT part, seq, arrival FROM sent UNION ALL SELECT part, seq, arrival + 2000000000 FROM sent WHERE part = 'p0' AND seq % 97 = 0),
beat AS (SELECT part, TIMESTAMP '{CLOSE}' - CASE WHEN part = '{SILENT}' THEN INTERVAL 40 MINUTE ELSE INTERVAL 0 MINUTE END AS at, count(*) AS producer_high_water FROM stamped GROUP BY part)
"""
