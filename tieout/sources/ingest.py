"""Fixed-width batches with control totals, and JSON event lines.

A feed is a file or a folder of parts; its lines are numbered over all parts in order
of their names.  Spark gives no line numbers, but a task reads the lines of a split in
order.  So a first pass takes totals and the number of lines of each split, which the
trailer is held against; sums over one row per split say how many lines lie ahead of
it, and the second pass numbers lines inside the task that reads them.  Lines are never
shuffled, sorted or written.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tieout.errors import ControlTotalMismatch
from tieout.sources.files import Files

RECORD = "ref string, business_date date, account string, amount_minor bigint, currency string, kind string, source string, source_file string, line_no bigint"
_COLUMNS = [c.split()[0] for c in RECORD.split(", ")]
#: Field positions of a detail line (1-based start, length).
DETAIL = {"ref": (3, 16), "business_date": (19, 8), "account": (27, 6), "currency": (33, 3), "amount_minor": (36, 15), "kind": (51, 8)}
TRAILER = {"count": (3, 10), "total": (13, 20)}


@dataclass
class Ingested:
    """Records and rejects of one source, with declared and parsed control totals."""

    records: DataFrame
    rejects: DataFrame
    declared_count: int
    declared_total: int
    parsed_count: int
    parsed_total: int
    rejected: int

    @property
    def ok(self) -> bool:
        return self.declared_count == self.parsed_count and self.declared_total == self.parsed_total and not self.rejected


#: Offsets (some 150 bytes a split) are broadcast up to so many tasks; a task reads some 30 small files at most.
BROADCAST_PARTITIONS = 20_000


#: Left alone, the size of splits follows the executors that are there when a pass is planned.
MIN_PARTITIONS = "spark.sql.files.minPartitionNum"


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """(value, f, b, i): lines with their file, the start of their split, and a number that grows within it.

    Both passes must cut files alike, so the session's least number of partitions is
    fixed if it is not; ``numbered`` raises if they were cut otherwise all the same.
    """
    if spark.conf.get(MIN_PARTITIONS, None) is None:
        spark.conf.set(MIN_PARTITIONS, spark.sparkContext.defaultParallelism)
    return spark.read.text(path).select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i"))


def _sums() -> list[Column]:
    """Lines, records, their absolute total, rejects, and what trailers declare."""
    fine, trailer = F.col("reason").isNull(), F.col("reason") == "trailer"
    return [
        F.count("*").alias("lines"), F.count_if(fine).alias("n"), F.sum(F.when(fine, F.abs("amount_minor"))).alias("total"), F.count_if(~F.col("reason").isin("trailer", "skipped")).alias("bad"),
        F.count_if(trailer).alias("trailers"), F.max(F.when(trailer, F.col("count"))).alias("declared_count"), F.max(F.when(trailer, F.col("declared"))).alias("declared_total"),
    ]


def surveyed(parsed: DataFrame) -> DataFrame:
    """One row per split: its sums, and the number of its first line."""
    return parsed.groupBy("f", "b").agg(F.min("i").alias("start"), *_sums())


def counted(lines: DataFrame) -> DataFrame:
    """One row per split: lines and the first one's number, without parsing."""
    return lines.groupBy("f", "b").agg(F.count("*").alias("lines"), F.min("i").alias("start"))


def numbered(lines: DataFrame, splits: DataFrame) -> DataFrame:
    """Adds source_file and line_no to lines; ``splits`` has f, b, lines and start of each split."""
    before = W.orderBy(F.length("f"), "f", "b").rowsBetween(W.unboundedPreceding, -1)
    offsets = splits.select("f", "b", "start", "lines", F.coalesce(F.sum("lines").over(before), F.lit(0)).alias("ahead"))
    few = lines.rdd.getNumPartitions() <= BROADCAST_PARTITIONS
    joined = lines.join(F.broadcast(offsets) if few else offsets, ["f", "b"], "left")
    place = F.col("i") - F.col("start")
    number = F.when((place >= 0) & (place < F.col("lines")), F.col("ahead") + place + 1).otherwise(F.raise_error(F.lit("files were split otherwise than when their lines were counted")))
    return joined.withColumn("source_file", F.element_at(F.split("f", "/"), -1)).withColumn("line_no", number.cast("bigint")).drop("f", "b", "i", "start", "lines", "ahead")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, source_file, line_no) of text files, blank lines counted."""
    lines = lines_of(spark, path)
    return numbered(lines, counted(lines))


def _cut(name: str, fields: dict) -> Column:
    start, length = fields[name]
    return F.trim(F.substring("value", start, length))


def parsed_width(lines: DataFrame, source: str = "core") -> DataFrame:
    """Every line: record fields, ``reason`` not to take it (``skipped``: blank or a header), and what a trailer declares."""
    rest = [c for c in lines.columns if c != "value"]
    code = F.substring("value", 1, 2)
    detail = lines.select(
        *rest,
        code.alias("code"),
        (F.trim("value") == "").alias("blank"),
        _cut("ref", DETAIL).alias("ref"),
        F.try_to_date(_cut("business_date", DETAIL), "yyyyMMdd").alias("business_date"),
        _cut("account", DETAIL).alias("account"),
        F.when(_cut("amount_minor", DETAIL).rlike(r"^[+-]?[0-9]+$"), _cut("amount_minor", DETAIL).try_cast("bigint")).alias("amount_minor"),
        _cut("currency", DETAIL).alias("currency"),
        _cut("kind", DETAIL).alias("kind"),
        F.lit(source).alias("source"),
        _cut("count", TRAILER).try_cast("bigint").alias("count"),
        _cut("total", TRAILER).try_cast("bigint").alias("declared"),
    )
    reason = F.when(F.col("blank") | (F.col("code") == "01"), "skipped").when(F.col("code") == "99", "trailer").when(F.col("code") != "16", "unknown record code").when(F.col("ref") == "", "no reference").when(F.col("business_date").isNull(), "bad date").when(F.col("amount_minor").isNull(), "bad amount")
    return detail.withColumn("reason", reason)


def fixed_width(lines: DataFrame, source: str = "core") -> tuple[DataFrame, DataFrame]:
    """(records, rejects) of numbered lines."""
    parsed = parsed_width(lines, source)
    return _taken(parsed)


def _taken(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    return parsed.where("reason is null").select(*_COLUMNS), parsed.where("reason not in ('trailer', 'skipped')").select("source_file", "line_no", "reason")


def parsed_json(lines: DataFrame, source: str = "processor") -> DataFrame:
    """Record fields and ``reason`` to reject a JSON line: keys that are missing, null or of another type."""
    v = F.col("v")
    text = lambda key: F.try_variant_get(v, f"$.{key}", "string")
    kind = lambda key: F.expr(f"schema_of_variant(try_variant_get(v, '$.{key}', 'variant'))")
    strings = ("ref", "account", "currency", "kind")
    rest = [c for c in lines.columns if c != "value"]
    parsed = lines.withColumn("v", F.try_parse_json("value")).select(  # parsed once a line
        *rest, (F.trim("value") == "").alias("blank"), v.isNotNull().alias("json"), *(F.when(kind(k) == "STRING", text(k)).alias(k) for k in strings),
        F.try_to_date(F.when(kind("business_date") == "STRING", text("business_date")), "yyyy-MM-dd").alias("business_date"),
        F.when(kind("amount_minor") == "BIGINT", F.try_variant_get(v, "$.amount_minor", "bigint")).alias("amount_minor"), F.lit(source).alias("source"),
        F.lit(None).cast("bigint").alias("count"), F.lit(None).cast("bigint").alias("declared"),
    )
    missing = F.lit(False)
    for k in strings:
        missing = missing | F.col(k).isNull()
    reason = F.when(F.col("blank"), "skipped").when(~F.col("json"), "not JSON").when(missing, "missing field").when(F.col("business_date").isNull(), "bad date").when(F.col("amount_minor").isNull(), "bad amount")
    return parsed.withColumn("reason", reason)


def json_events(lines: DataFrame, source: str = "processor") -> tuple[DataFrame, DataFrame]:
    """(records, rejects) of numbered JSON lines."""
    # One struct a line, so that no filter repeats the parsing of JSON below it.
    return _taken(parsed_json(lines, source).select(F.inline(F.array(F.struct("*")))))


def _totals(splits: DataFrame):
    """One row over all splits."""
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "total", "bad", "trailers")]
    return splits.agg(*sums, F.max("declared_count").alias("declared_count"), F.max("declared_total").alias("declared_total")).first()


def control_totals(records: DataFrame) -> DataFrame:
    """One row: count and sum of absolute amounts."""
    return records.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.abs("amount_minor")), F.lit(0)).alias("total"))


def _batch(path: str, records: DataFrame, rejects: DataFrame, row) -> Ingested:
    """Raises if a batch is not what its trailer declares."""
    if row["trailers"] != 1 or row["declared_count"] is None or row["declared_total"] is None:
        raise ControlTotalMismatch(f"{path} has {row['trailers']} trailers, not one that is readable")
    out = Ingested(records, rejects, row["declared_count"], row["declared_total"], row["n"], row["total"], row["bad"])
    if not out.ok:
        raise ControlTotalMismatch(f"{path}: {out.parsed_count} of {out.declared_count} records, total {out.parsed_total} of {out.declared_total}, {out.rejected} rejected")
    return out


def _events(path: str, records: DataFrame, rejects: DataFrame, row) -> Ingested:
    """What was parsed counts as declared, so only rejects are held against it."""
    return Ingested(records, rejects, row["n"], row["total"], row["n"], row["total"], row["bad"])


def read_batch(spark: SparkSession, path: str, source: str = "core") -> Ingested:
    """A fixed-width batch; raises before anything is loaded if it is not what its trailer declares."""
    lines = lines_of(spark, path)
    splits = surveyed(parsed_width(lines, source)).persist()
    return _batch(path, *fixed_width(numbered(lines, splits), source), _totals(splits))


def read_events(spark: SparkSession, path: str, source: str = "processor") -> Ingested:
    """JSON event lines."""
    lines = lines_of(spark, path)
    splits = surveyed(parsed_json(lines, source)).persist()
    return _events(path, *json_events(numbered(lines, splits), source), _totals(splits))


class Passed:
    """A feed that is parsed once, while its records are written; its totals are observed on the way.

    Lines are counted before, without parsing, and what was observed is held against
    that, so a pass that saw other lines does not count.
    """

    def __init__(self, spark: SparkSession, path: str, parsed, held, source: str) -> None:
        self.path, self.held, self.seen = path, held, Observation()
        lines = lines_of(spark, path)
        self.splits = counted(lines).persist()
        self.lines = self.splits.agg(F.coalesce(F.sum("lines"), F.lit(0))).first()[0]
        self.records, self.rejects = _taken(parsed(numbered(lines, self.splits), source).observe(self.seen, *_sums()))

    def ingested(self) -> Ingested:
        """To be asked after the records have been written once."""
        self.splits.unpersist()
        row = {k: v or 0 for k, v in self.seen.get.items()} | {k: self.seen.get[k] for k in ("declared_count", "declared_total")}
        if row["lines"] != self.lines:
            raise ControlTotalMismatch(f"{self.path} has {self.lines} lines, of which {row['lines']} were read")
        return self.held(self.path, self.records, self.rejects, row)


def pass_batch(spark: SparkSession, path: str, source: str = "core") -> Passed:
    return Passed(spark, path, parsed_width, _batch, source)


def pass_events(spark: SparkSession, path: str, source: str = "processor") -> Passed:
    return Passed(spark, path, parsed_json, _events, source)


def read_transport(spark: SparkSession, path: str) -> DataFrame:
    """(partition, seq, arrival) of event lines, arrival being the line number."""
    lines = numbered_lines(spark, path).where(F.trim("value") != "")
    parsed = F.from_json("value", "partition string, seq bigint")
    return lines.select(parsed["partition"].alias("partition"), parsed["seq"].alias("seq"), F.col("line_no").alias("arrival")).where("partition is not null and seq is not null")


def read_heartbeats(spark: SparkSession, path: str) -> DataFrame:
    """Beats from a JSON array; arrival is the place in the array."""
    text = spark.read.text(path, wholetext=True)
    beats = F.from_json("value", "array<struct<`partition`:string,at:string,producer_high_water:bigint>>")
    return text.select(F.posexplode(beats).alias("arrival", "b")).select("b.partition", F.col("b.at").cast("timestamp").alias("at"), "b.producer_high_water", F.col("arrival").cast("bigint").alias("arrival"))


def read_truth(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON object or array of planted truth in one file, or its rows as lines in the parts of a folder."""
    p, fs = Files(spark).at(path)
    return spark.read.option("multiLine", fs.getFileStatus(p).isFile()).schema(schema).json(path)
