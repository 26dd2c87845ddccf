"""Perplexity filters on Kneser-Ney models of trusted text.

``classify``: the models stay sharded.  Blocks of documents send each shard the
distinct n-grams they hold, the shard joins them with its counts and answers
with log probabilities in the same order, and the blocks add them up per document.
The shard of an n-gram follows from its third and fourth byte, so that all contexts
and suffixes of three bytes and more that it backs off to are in the same shard;
the two lowest orders (at most 65,792 rows a model) are copied to each.

``rules``: the same models, in the same shards, beside the base rules on words,
symbols, lines and repeated windows.

Each language has two models.  Documents are halved by a hash of their id (of the
text, without one); a half
is scored by the model of the trusted documents of the other half.  So no text is
scored by a model that has seen it, and the quantiles of a language rest on the
perplexities of all its trusted documents.  The perplexity is per byte.

Defined results: a null language is the language ``''``; a document whose language
has no trusted text in the other half has no perplexity, and one whose language has
no trusted perplexities no bounds: neither is rejected by perplexity; a null or
empty text has no perplexity and is rejected; rows with equal ids are judged one by
one and share their label.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tieout.llm import blocks, kneser_ney, runtime
from tieout.llm.words import exact_groups, segment_any, window_hash, words_of

QUANTILE = 0.99
SALTS = 64
REQUESTS = "shard int, block int, models array<string>, keys array<binary>"
REPLIES = "block int, shard int, models array<string>, scores array<binary>"
_MASK2 = 0xFFFF


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Ids of documents that every label calls good and none calls toxic."""
    agreed = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.min("quality").alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("t"))
    return agreed.where("q = 1 and t = 0").select("doc_id")


def _dealt_by(text: str | None) -> Column:
    """What a document is dealt by: its id, or a hash of its text if it has none (then no label can mean it)."""
    return F.col("doc_id") if text is None else F.coalesce("doc_id", F.xxhash64(text))


def half_of(text: str | None = None) -> Column:
    return F.pmod(F.xxhash64(F.lit(5), _dealt_by(text)), F.lit(2)).cast("string")


def block_of(n: int, text: str | None = None) -> Column:
    """A block holds documents of one half only, so that it asks one model of a language."""
    if n < 2:
        return F.lit(0)
    return F.pmod(F.xxhash64(_dealt_by(text)), F.lit(n // 2)) * 2 + half_of(text).cast("int")


def other_half(model: str) -> str:
    """The model that the documents which ``model`` scores are trained into."""
    return {"0": "1", "1": "0"}[model[0]] + model[1:]


def _model(packed: DataFrame, trusted: DataFrame, n: int) -> DataFrame:
    """(model, rank, key, n, d1, d2, d3): the orders, and the discounts of each under rank -order."""
    train = trusted.select(block_of(n).cast("int").alias("block"), "doc_id")
    levels = kneser_ney.tables(kneser_ney.count(packed, train, other_half))
    cuts = kneser_ney.discounts(levels).select("model", (-F.col("rank")).alias("rank"), F.lit(0).cast("bigint").alias("key"), F.lit(0).cast("bigint").alias("n"), "d1", "d2", "d3")
    none = F.lit(None).cast("double")
    return levels.select("model", "rank", "key", "n", none.alias("d1"), none.alias("d2"), none.alias("d3")).unionByName(cuts)


def _lower_orders(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
    """One and two byte orders and the discounts of a model in one row (they are copied to every shard)."""
    return pa.table([pa.array([key[0].as_py()], pa.string()), pa.array([blocks._ipc(rows)], pa.binary())], ["model", "orders"])


def sharded(model: DataFrame, n: int) -> DataFrame:
    """The models' rows by shard, the lower orders in each."""
    shard = F.pmod(F.pmod(F.shiftright("key", 8).bitwiseAND(_MASK2) * 40503, F.lit(65521)), F.lit(n)).cast("int")
    upper = model.where("rank > 2").select(shard.alias("shard"), "model", "rank", "key", "n", F.lit(None).cast("binary").alias("orders"))
    lower = model.where("rank <= 2").groupBy("model").applyInArrow(_lower_orders, "model string, orders binary")
    null = {c: F.lit(None).cast(t) for c, t in (("rank", "int"), ("key", "bigint"), ("n", "bigint"))}
    copied = lower.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumns(null).select(*upper.columns)
    return upper.unionByName(copied)


def _shard_of(key: np.ndarray, n: int) -> np.ndarray:
    return (((key.astype(np.int64) >> 8) & _MASK2) * 40503 % 65521 % n).astype(np.int64)


def asked_of(payloads: list[bytes], n: int) -> dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By model: the distinct n-grams of a block in the order of shard and key, the shards, and where each begins."""
    found: dict[str, np.ndarray] = {}
    for table in blocks.documents(payloads):
        for name, _, texts in kneser_ney.by_model(table):
            key, _ = kneser_ney.summed(kneser_ney.ngrams(texts)[0])
            found[name] = kneser_ney.summed(np.concatenate([found.get(name, key[:0]), key]))[0]
    out = {}
    for name, key in found.items():
        shard = _shard_of(key, n)
        order = np.argsort(shard, kind="stable")
        out[name] = key[order], *blocks.by_shard(shard[order], n)
    return out


def requests_of(n: int):
    """Rows of REQUESTS: the distinct n-grams of a block by model, in one row for each shard."""

    def run(block: int, payloads: list[bytes]) -> Iterator[pa.RecordBatch]:
        rows: dict[int, list[tuple[str, bytes]]] = {}
        for name, (key, ids, edges) in asked_of(payloads, n).items():
            for s in ids.tolist():
                rows.setdefault(s, []).append((name, blocks.encode_sorted(key[edges[s] : edges[s + 1]])))
        ordered = sorted(rows.items())
        names, keys = ([[r[i] for r in own] for _, own in ordered] for i in (0, 1))
        yield pa.record_batch(
            [pa.array([s for s, _ in ordered], pa.int32()), pa.array([block] * len(ordered), pa.int32()), pa.array(names, pa.list_(pa.string())), pa.array(keys, pa.list_(pa.binary()))],
            ["shard", "block", "models", "keys"],
        )

    return run


def shard_rows(rows: pa.Table) -> pa.Table:
    """The model rows of a shard, with the lower orders that were copied to it."""
    lower = [blocks.unpack(p) for p in rows["orders"].to_pylist() if p]
    return pa.concat_tables([rows.filter(pc.is_null(rows["orders"])).select(["model", "rank", "key", "n"]), *lower], promote_options="default")


def replied(asked: pa.Table, score: Callable[[str, np.ndarray], np.ndarray | None]) -> pa.Table:
    """Rows of REPLIES: ``score(model, n-grams)`` for what each block asks, in its order (None: no answer)."""
    out = []
    for r in asked.to_pylist():
        scores = [(name, score(name, blocks.decode_sorted(keys, np.uint64))) for name, keys in zip(r["models"], r["keys"])]
        own = [(name, blocks.encode(x)) for name, x in scores if x is not None]
        if own:
            out.append((r["block"], r["shard"], [name for name, _ in own], [x for _, x in own]))
    kinds = [pa.int32(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.binary())]
    return pa.table([pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)], ["block", "shard", "models", "scores"])


def _join(key: tuple[pa.Scalar, ...], asked: pa.Table, rows: pa.Table) -> pa.Table:
    models = kneser_ney.models(shard_rows(rows)) if rows.num_rows else {}
    return replied(asked, lambda name, keys: models[name].log_prob(keys) if name in models else None)


def answered(payloads: list[bytes], replies: pa.Table, n: int) -> dict[str, tuple[blocks.Lookup, np.ndarray]]:
    """By model: the n-grams of a block and what the shards answered for each."""
    answers: dict[str, dict[int, bytes]] = {}
    for r in replies.to_pylist():
        for name, scores in zip(r["models"], r["scores"]):
            answers.setdefault(name, {})[r["shard"]] = scores
    out = {}
    for name, (key, ids, edges) in (asked_of(payloads, n) if answers else {}).items():
        if name in answers:
            score = np.concatenate([blocks.decode(answers[name][int(s)], np.float32) for s in ids])
            out[name] = kneser_ney.KneserNey._held(key, score)
    return out


def summed_up(texts: list[bytes], lookup: blocks.Lookup, value: np.ndarray) -> np.ndarray:
    """The sum of each text's n-gram values."""
    key, begin = kneser_ney.ngrams(texts)
    at, _ = lookup.find(kneser_ney.mix(key))
    return np.add.reduceat(value[at].astype(np.float64), begin)


def _sum_up(fields: str, n: int, measured: bool = False, carry: tuple[str, ...] = ()):
    """Rows of ``fields``: the loss of each text, its base measures where ``measured``, and what it carries."""
    names = [f.split()[0] for f in fields.split(", ")]

    def run(block: int, payloads: list[bytes], replies: pa.Table) -> pa.Table:
        lookups = answered(payloads, replies, n)
        out = []
        for table in blocks.documents(payloads):
            loss = np.full(table.num_rows, np.nan)
            size = np.zeros(table.num_rows, np.int64)
            for name, rows, texts in kneser_ney.by_model(table):
                size[rows] = [len(t) for t in texts]
                if name in lookups:
                    loss[rows] = -summed_up(texts, *lookups[name])
            columns = {"doc_id": table["doc_id"], "lang": pa.array([x[1:] for x in table["model"].to_pylist()], pa.string()), "n_bytes": pa.array(size, pa.int64())}
            columns |= {c: table[c] for c in carry}
            if measured:
                columns |= {name: pa.array(value, pa.int64()) for name, value in text_stats(table).items()}
            columns["loss"] = pa.array(loss, pa.float64(), mask=(size == 0) | np.isnan(loss))
            out.append(pa.table([columns[c] for c in names], names))
        return pa.concat_tables(out)

    return run


def _scored(docs: DataFrame, trusted: DataFrame, fields: str, measured: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """A row of ``fields`` for every document, with its loss under the sharded model of the other half."""
    n = runtime.partitions(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.concat(half_of("text"), F.coalesce(F.col("lang").cast("string"), F.lit(""))).alias("model"), F.col("text").cast("string").alias("text"), *carry)
    packed = blocks.pack(docs, ["doc_id", "model", "text", *carry], n, block_of(n, "text"))
    model = sharded(_model(packed, trusted, n), n)
    requests = blocks.per_block(packed, requests_of(n), REQUESTS)
    replies = requests.groupBy("shard").cogroup(model.groupBy("shard")).applyInArrow(_join, REPLIES)
    return runtime.settled(blocks.answer(packed, replies, _sum_up(fields, n, measured, carry), fields))


def _banded(scored: DataFrame, trusted: DataFrame, low: float, high: float) -> DataFrame:
    """Adds perplexity, floor and ceiling: quantiles of the perplexities of each language's trusted documents."""
    scored = scored.withColumn("perplexity", F.exp(F.col("loss") / (F.col("n_bytes") + 1)))
    bands = scored.where("perplexity is not null").join(trusted, "doc_id").groupBy("lang").agg(
        F.percentile_approx("perplexity", low, 100_000).alias("floor"), F.percentile_approx("perplexity", high, 100_000).alias("ceiling")
    )
    # One language may hold most rows, so its one row is met in SALTS tasks.
    copies = bands.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return scored.withColumn("salt", F.pmod(F.xxhash64("doc_id", "n_bytes"), F.lit(SALTS)).cast("int")).join(copies, ["lang", "salt"], "left").drop("salt")


def classify(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, lang, n_bytes, perplexity, ceiling, kept for every document, and the bigint columns ``carry``."""
    trusted = trusted_ids(labels)
    scored = _scored(docs, trusted, ", ".join(["doc_id bigint, lang string, n_bytes bigint, loss double", *(f"{c} bigint" for c in carry)]), carry=carry)
    banded = _banded(scored, trusted, 0.0, quantile)
    kept = (F.col("n_bytes") > 0) & (F.col("perplexity").isNull() | F.col("ceiling").isNull() | (F.col("perplexity") <= F.col("ceiling")))
    return banded.select("doc_id", "lang", "n_bytes", "perplexity", "ceiling", kept.alias("kept"), *carry)


_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[list(b"#*$%&|<>")] = 1
REPEAT_WINDOW = 8


def text_stats(table: pa.Table) -> dict[str, np.ndarray]:
    """The base measures of each text: words, code points in them, symbols, equal lines, repeated windows."""
    words = words_of(table["text"])
    data, first = words.data, words.first
    texts = table["text"].cast(pa.binary()).to_pylist()
    ends = np.cumsum([len(t or b"") + 1 for t in texts])
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    total = lambda x: np.concatenate([[0], np.cumsum(x)])
    points = total((data & 0xC0) != 0x80)
    chars = total(points[words.end] - points[words.start])[first]
    symbols = total(_SYMBOL[data])
    size = max(0, len(words.doc) - REPEAT_WINDOW + 1)
    twice = np.zeros(len(words.doc), bool)
    if size:
        whole = np.flatnonzero(words.left(REPEAT_WINDOW)[:size])
        with np.errstate(over="ignore"):
            value = window_hash(words.hash, REPEAT_WINDOW)[whole] + kneser_ney.mix(words.doc[whole].astype(np.uint64) + np.uint64(1))
        window = words.rows(REPEAT_WINDOW)
        order, new = exact_groups(value, lambda at: np.column_stack([words.doc[whole[at]], window(whole[at])]))
        same = ~new[1:]
        twice[whole[order[1:][same]]] = True
        twice[whole[order[:-1][same]]] = True
    repeated = total(segment_any(twice, REPEAT_WINDOW))[first]
    lines = np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        if text and b"\n" in text:
            worded = [line for line in text.split(b"\n") if line and not line.isspace()]
            lines[i] = len(worded) - len(set(worded))
    return {"n_words": np.diff(first), "word_chars": np.diff(chars), "n_symbols": symbols[ends] - symbols[starts], "n_dup_lines": lines, "n_repeat_words": np.diff(repeated), "n_bytes": ends - starts - 1}


_RULE_ROWS = "doc_id bigint, lang string, n_bytes bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, loss double"


def rules(docs: DataFrame, labels: DataFrame, low: float = 0.001, high: float = QUANTILE) -> DataFrame:
    """The base measures, base_failed, perplexity, its band, and kept for every document."""
    trusted = trusted_ids(labels)
    banded = _banded(_scored(docs, trusted, _RULE_ROWS, measured=True), trusted, low, high)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    within = F.col("perplexity").isNull() | F.col("ceiling").isNull() | F.col("perplexity").between(F.col("floor"), F.col("ceiling"))
    return banded.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & within).alias("kept"), "lang", "perplexity", "floor", "ceiling")
