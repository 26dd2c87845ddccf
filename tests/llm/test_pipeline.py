"""Every stage of the pipeline on its own input of the fixture, against brute force."""

import math

import duckdb
import pytest
from test_dedup import brute_links, brute_words
from test_other import plain_edits
from test_scoring import Plain

import corpus_pipeline
from tieout.llm import contamination, kneser_ney, mixing, perplexity


@pytest.fixture(scope="module")
def stages(spark, sf):
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, sf).cache()
        out.append(([r.asDict() for r in before.collect()], [r.asDict() for r in docs.collect()]))
    return out


def test_quality(spark, sf, stages):
    before, after = stages[0]
    half = {r["doc_id"]: r["h"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", perplexity.half_of().alias("h")).collect()}
    trusted = {r["doc_id"] for r in perplexity.trusted_ids(spark.read.parquet(f"{sf}/labels.parquet")).collect()}
    score = {}
    for lang in {r["lang"] for r in before}:
        for h in "01":
            texts = [r["text"].encode() for r in before if r["lang"] == lang and half[r["doc_id"]] != h and r["doc_id"] in trusted]
            model = Plain(texts, kneser_ney.ORDER) if texts else None
            for r in before:
                if r["lang"] == lang and half[r["doc_id"]] == h and r["text"] and model:
                    s = b"\x02" * 4 + r["text"].encode() + b"\x03"
                    score[r["doc_id"]] = -sum(math.log(model.p(s[i : i + 5])) for i in range(len(s) - 4)) / (len(s) - 4)
    kept = {r["doc_id"] for r in after}
    for lang in {r["lang"] for r in before}:
        own = sorted(score[r["doc_id"]] for r in before if r["lang"] == lang and r["doc_id"] in trusted and r["doc_id"] in score)
        ceiling = own[math.ceil(perplexity.QUANTILE * len(own)) - 1] if own else math.inf
        for r in before:
            s = score.get(r["doc_id"])
            if r["lang"] == lang and (s is None or abs(s - ceiling) > 1e-4):
                assert (r["doc_id"] in kept) == (bool(r["text"]) and (s is None or s <= ceiling))


def test_near_duplicates(stages):
    before, after = stages[1]
    links = brute_links([r["text"] or "" for r in before])
    classes = {}
    for i, r in enumerate(before):
        classes.setdefault(links[i][0], []).append(r["doc_id"])
    assert sorted(r["doc_id"] for r in after) == sorted(min(ids) for ids in classes.values())


def test_repeated_passages(stages):
    before, after = stages[2]
    ordered = sorted(before, key=lambda r: r["doc_id"])
    want = brute_words([r["text"] or "" for r in ordered], 13)
    assert {r["doc_id"]: r["text"] for r in after} == {ordered[i]["doc_id"]: text for i, (n, gone, text) in want.items() if not n or gone < n}


def test_decontamination(spark, sf, stages):
    before, after = stages[3]
    split = lambda t: "".join(c if ord(c) >= 128 or c.isalnum() else " " for c in (t or "").lower()).split()
    items = [split(r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    gone = set()
    for r in before:
        text = split(r["text"])
        for item in items:
            k = len(item) // 5 if len(item) >= contamination.MIN_WORDS else 0
            own = set(item)
            if sum(w in own for w in text) >= len(item) - k and len(own & set(text)) >= len(own) - k and plain_edits(item, text) <= k:
                gone.add(r["doc_id"])
    assert {r["doc_id"] for r in before} - {r["doc_id"] for r in after} == gone


def test_mixture(spark, stages):
    before, after = stages[4]
    import pandas as pd

    mix_docs = pd.DataFrame([(r["doc_id"], r["text"], r["source"]) for r in before], columns=["doc_id", "text", "source"])
    con = duckdb.connect()
    con.register("mix_docs", mix_docs)
    want = con.sql(f"WITH {mixing.MIX_SQL} SELECT doc_id, copies FROM mixed WHERE copies > 0").fetchall()
    assert sorted((r["doc_id"], r["copies"], r["copy"]) for r in after) == sorted((d, n, c + 1) for d, n in want for c in range(n))


def test_run_is_the_stages_one_after_the_other(spark, sf, stages):
    """What run() returns is the last stage's result, which with those before is held against brute force above."""
    rows = sorted((tuple(r[c] for c in sorted(r)) for r in stages[-1][1]), key=str)
    assert sorted((tuple(r[c] for c in sorted(r.asDict())) for r in corpus_pipeline.run(spark, sf).collect()), key=str) == rows


def test_rows_with_one_id_and_with_one_half_of_a_digest_keep_their_own_verdict(spark, sf, monkeypatch):
    """Every other row has no id, and all share the first number of their digests."""
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("doc_id")))
    want = sorted(r["text"] for r in corpus_pipeline.quality(spark, docs, sf).collect())
    keyed = corpus_pipeline._keyed
    monkeypatch.setattr(corpus_pipeline, "_keyed", lambda d: keyed(d).withColumn("row", F.lit(1).cast("bigint")))
    got = sorted(r["text"] for r in corpus_pipeline.quality(spark, docs, sf).collect())
    assert got == want and 0 < len(got) < docs.count()


def test_stages_bear_awkward_rows_and_empty_tables(spark, sf, awkward, clashing):
    for df in (awkward, clashing, awkward.limit(0), awkward.where("doc_id is null")):
        docs = df
        for name, stage in corpus_pipeline.STAGES:
            before, docs = docs, spark.createDataFrame((out := stage(spark, docs, sf)).collect(), out.schema)
            if name != corpus_pipeline.STAGES[-1][0]:
                assert docs.columns == corpus_pipeline.COLUMNS and docs.count() <= before.count()
        assert not docs.where("text is null or text = ''").count()


def test_rows_without_ids_fill_all_blocks(spark):
    from pyspark.sql import functions as F

    from tieout.llm import blocks

    docs = spark.range(2000).select(F.lit(None).cast("bigint").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"), F.lit("a").alias("source"))
    dealt = [r["count"] for r in blocks.pack(docs, ["doc_id", "text"], 8).select("block").distinct().groupBy("block").count().collect()]
    assert len(dealt) == 8
    assert docs.select(perplexity.block_of(8, "text").alias("b")).distinct().count() == 8
    buckets = docs.withColumn("size", mixing.size_of()).withColumn("number", mixing.number_of()).select(mixing.bucket_of().alias("b")).distinct().count()
    assert buckets == mixing.BUCKETS
