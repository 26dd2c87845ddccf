"""URL filter: host and path rules, and a character language-model ratio for the rest.

Two variable-order Markov models over the bytes of ``host || path`` (digits as
``0``) are trained on URLs that are known to be accepted and to be rejected.  A byte
is predicted from the longest context of up to four bytes that its model has seen,
smoothed into the shorter ones (Witten-Bell).  The score is the difference of log
likelihoods per byte.  A URL is blocked above a threshold taken from held-out
accepted URLs: ``quantile`` of them stay below it, and so does 0.

The models are whole and stay sharded, as in ``perplexity``: blocks of URLs ask the
shards about their distinct n-grams and get the difference of both models' log
probabilities, so nothing of the corpus reaches the driver but the threshold.

Training URLs are given as a table (url, kind), or else told by the rules and a
block list: rejected are those whose host holds one of ``BLOCK_WORDS``, accepted the
others that no rule blocks.  (A rule on a top-level domain says nothing about what
its URLs look like, so URLs that only a rule blocks are not trained on.)  Without
any of either kind there is no ratio, and URLs without a rule are allowed.

Defined results: a null URL, or one without ``://``, has an empty host and path,
fits no rule and is allowed; null page ids and repeated rows are judged like any
other; a URL of any length is scored whole; every input row has one output row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tieout.llm import blocks, kneser_ney, perplexity, runtime

#: (verdict, host, path)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Words of hosts that are rejected for training (usual on public lists of spam, gambling, adult and pharmacy hosts).
BLOCK_WORDS = (
    "ads-", "adult", "bets", "betting", "bingo", "casino", "cheap-", "cialis", "clickbait", "crack", "dating", "escort", "forex", "gambl", "hookup",
    "jackpot", "keygen", "loans", "lottery", "payday", "pharma", "pills", "poker", "porn", "replica", "sex", "slots", "spam", "torrent", "viagra", "warez", "xxx",
)
FOLDS = 5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL_PATTERN = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, URL_PATTERN, 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL_PATTERN, 2), F.lit(""))


def decided(urls: DataFrame, rules=RULES) -> DataFrame:
    """Adds host, path, rule (the longest that fits, else null) and ruled (its verdict)."""
    parts = urls.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    rule = ruled = F
    for verdict, host, path in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path)
        rule, ruled = rule.when(fits, host + path), ruled.when(fits, verdict)
    return parts.withColumn("rule", rule).withColumn("ruled", ruled)


class Markov(kneser_ney.KneserNey):
    """Variable-order model from the counts of every order, with Witten-Bell smoothing."""

    @staticmethod
    def _smoothed(n, start, per, cuts):
        total, kinds = np.add.reduceat(n, start), per.astype(np.float64)
        return n / np.repeat(total + kinds, per), kinds / (total + kinds)


def _text() -> Column:
    return F.regexp_replace(F.concat("host", "path"), "[0-9]", "0")


def counts(labelled: DataFrame) -> DataFrame:
    """(model, rank, key, n): n-grams of one to five bytes of the labelled texts (text, kind)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            for kind in sorted(set(table["kind"].to_pylist())):
                texts = [t or b"" for t in table.filter(pc.equal(table["kind"], kind))["text"].cast(pa.binary()).to_pylist()]
                top, _ = kneser_ney.ngrams(texts)
                for order in range(1, kneser_ney.ORDER + 1):
                    key, n = kneser_ney.summed(top & np.uint64((1 << (8 * order)) - 1))
                    yield pa.record_batch([pa.array([kind] * len(key), pa.string()), pa.array([order] * len(key), pa.int32()), pa.array(key.astype(np.int64)), pa.array(n.astype(np.int64))], ["model", "rank", "key", "n"])

    return labelled.mapInArrow(run, "model string, rank int, key bigint, n bigint").groupBy("model", "rank", "key").agg(F.sum("n").alias("n"))


def _differences(key: tuple[pa.Scalar, ...], asked: pa.Table, rows: pa.Table) -> pa.Table:
    """For the n-grams that blocks ask a shard about: log probability if rejected less that if accepted."""
    models = kneser_ney.models(perplexity.shard_rows(rows), Markov) if rows.num_rows else {}
    both = {"allow", "block"} <= set(models)
    return perplexity.replied(asked, lambda _, keys: models["block"].log_prob(keys) - models["allow"].log_prob(keys) if both else None)


_COLUMNS = ["url", "page_id", "host", "path", "rule", "ruled", "text", "kind", "fold", "model"]


def _ratios(n: int):
    def run(block: int, payloads: list[bytes], replies: pa.Table) -> pa.Table:
        lookups = perplexity.answered(payloads, replies, n)
        out = []
        for table in blocks.documents(payloads):
            ratio = np.full(table.num_rows, np.nan)
            for name, rows, texts in kneser_ney.by_model(table):
                if name in lookups:
                    ratio[rows] = perplexity.summed_up(texts, *lookups[name]) / np.array([len(t) + 1 for t in texts])
            out.append(table.drop_columns(["url", "model"]).append_column("ratio", pa.array(ratio, pa.float64(), mask=np.isnan(ratio))))
        return pa.concat_tables(out)

    return run


def known_kind(words=BLOCK_WORDS) -> Column:
    """block, allow, or null for URLs that are not trained on."""
    listed = F.lit(False)
    for word in words:
        listed = listed | F.col("host").contains(word)
    return F.when(F.col("text") == "", None).when(F.col("ruled") == "allow", "allow").when(listed, "block").when(F.col("ruled").isNull(), "allow")


def scored(pages: DataFrame, rules=RULES, words=BLOCK_WORDS, labelled: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, ruled, text, kind, fold and ratio for every row of ``pages``."""
    n = runtime.partitions(pages.sparkSession)
    fold = F.pmod(F.xxhash64(F.lit(1), "url"), F.lit(FOLDS)).cast("int")
    own = lambda df: decided(df, rules).withColumn("text", _text()).withColumn("fold", fold)
    urls = own(pages.select("page_id", F.col("url").cast("string").alias("url"))).withColumn("kind", known_kind(words)).withColumn("model", F.lit("url"))
    known = own(labelled.select(F.col("url").cast("string").alias("url"), F.col("kind").cast("string").alias("kind"))) if labelled is not None else urls
    model = perplexity.sharded(counts(known.where("kind in ('allow', 'block') and fold <> 0").select("text", "kind")), n)
    packed = blocks.pack(urls, _COLUMNS, n)
    asked = blocks.per_block(packed, perplexity.requests_of(n), perplexity.REQUESTS)
    replies = asked.groupBy("shard").cogroup(model.groupBy("shard")).applyInArrow(_differences, perplexity.REPLIES)
    shape = urls.select(*_COLUMNS[1:-1], F.lit(None).cast("double").alias("ratio")).schema
    return runtime.settled(blocks.answer(packed, replies, _ratios(n), shape))


def judge(pages: DataFrame, rules=RULES, words=BLOCK_WORDS, quantile: float = 0.99, labelled: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, ratio, threshold for every row of ``pages``."""
    out = scored(pages, rules, words, labelled)
    accepted = out.where("kind = 'allow' and fold = 0").agg(F.percentile_approx("ratio", quantile, 100_000)).first()[0]
    threshold = max(0.0, accepted or 0.0)
    verdict = F.coalesce("ruled", F.when((F.col("text") != "") & (F.col("ratio") > threshold), "block").otherwise("allow"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "ratio", F.lit(threshold).alias("threshold"))
