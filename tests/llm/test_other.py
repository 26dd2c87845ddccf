import gzip
import hashlib
import random
import re

import numpy as np
import pytest
from compare import connect, same
from pyspark.sql import functions as F

import corpus_pipeline
from tieout.llm import contamination, licenses, mixing, queries, warc
from tieout.llm.words import mix


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, sf, con, name):
    df = queries.queries()[name](spark, sf)
    same(df, con, queries.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_every_query_covers_its_table(spark, sf, name):
    table = "pages" if name.startswith(("op1_", "op8_")) else "documents"
    key = "page_id" if table == "pages" else "doc_id"
    ids = sorted(r[0] for r in spark.read.parquet(f"{sf}/{table}.parquet").select(key).collect())
    assert sorted(r[0] for r in queries.queries()[name](spark, sf).select(key).collect()) == ids


# ---- licenses


def regex_of(template):
    return re.compile(" " + licenses._pattern(licenses.parts(template)))


def plainest(template):
    return [w for item in licenses.parts(template) for w in ([item] if isinstance(item, str) else ["q"] * item[2] if isinstance(item, tuple) else [])]


def test_automata_equal_regular_expressions():
    rnd = random.Random(1)
    templates = (*licenses.TEMPLATES, ("t", "a [[b {{x:0-2}} c]] d {{y:2-3}} e [[f]]"))
    shared = licenses.build(templates)
    free = licenses.build((("u", "[[{{x:1-2}}]] a b"), *templates))
    words = sorted({w for _, t in templates for w in re.findall(r"[a-z0-9]+", t)}) + ["zz"]
    tries = [rnd.choices(words[:12], k=rnd.randint(1, 25)) for _ in range(200)]
    for _, template in templates:
        plain = plainest(template)
        tries += [plain, ["x", *plain, "y"], plain[:-1], plain[1:], plain[: len(plain) // 2] + plain, plain + rnd.choices(words, k=5) + plain]
    for t in tries:
        want = {label for label, template in templates if regex_of(template).search(" " + " ".join(t) + " ")}
        assert shared.accepts([w.encode() for w in t]) == want, t
        assert free.accepts([w.encode() for w in t]) - {"u"} == want


@pytest.mark.parametrize("label", ["mit-text", "bsd-2-text", "bsd-3-text", "isc-text", "apache-2.0-header", "gpl-header"])
def test_every_mandatory_word_counts(label):
    shared = licenses.build()
    plain = [w.encode() for w in plainest(dict(licenses.TEMPLATES)[label])]
    assert label in shared.accepts(plain)
    for i in [i for i in range(0, len(plain), 7) if plain[i] != b"q"] + [len(plain) - 1]:
        assert label not in shared.accepts([*plain[:i], b"noncommercial", *plain[i + 1 :]])
    assert label not in shared.accepts(plain[:-1])
    if label == "bsd-3-text":
        assert "bsd-2-text" not in shared.accepts(plain)


def test_license_rows(spark, awkward, clashing):
    rows = [(1, "Released under the MIT License. MIT license"), (2, None), (3, "the GNU General-Public license, mit"), (4, "LICENSED under the Apache License, Version 2.0 of Ünicode")]
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert (got[1]["n_base"], got[1]["first_word"], got[1]["last_word"], got[1]["labels"]) == (2, 3, 5, "mit,mit-notice")
    assert got[2]["n_words"] == 0 and got[2]["labels"] == "" and got[2]["first_word"] is None
    assert got[3]["base_labels"] == "gpl" and got[3]["score"] == 0.5
    assert got[4]["labels"] == "apache,apache-2.0-notice" and got[4]["n_words"] == 10
    for df in (awkward, clashing):
        assert licenses.scan(df).count() == 9
    assert licenses.scan(awkward.limit(0)).count() == 0


# ---- decontamination


def test_planted_items_are_found_and_clean_texts_are_not(spark):
    rnd = random.Random(6)
    words = [f"t{i}" for i in range(500)]
    items = [" ".join(rnd.choices(words, k=rnd.randint(12, 60))) for _ in range(40)]
    docs, want = [], {}
    for i in range(300):
        body = rnd.choices(words, k=rnd.randint(0, 200))
        if i % 3 == 0:
            j = rnd.randrange(40)
            part = items[j].split()
            for _ in range(rnd.randint(0, len(part) // 10)):
                at = rnd.randrange(len(part))
                part[at : at + 1] = rnd.choice([[], [rnd.choice(words)], [part[at], "new"]])
            at = rnd.randint(0, len(body))
            body[at:at] = [w.upper() + "," for w in part]
            want[i] = j
        docs.append((i, " ".join(body)))
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    got = {r["doc_id"]: set(r["item_ids"]) for r in contamination.find(spark.createDataFrame(docs, "doc_id bigint, text string"), benchmark).collect()}
    assert sum(want[i] in got[i] for i in want) >= 0.99 * len(want)
    assert not any(got[i] for i in range(300) if i not in want)


def plain_edits(item, region):
    last = [0] * (len(region) + 1)
    for i, a in enumerate(item):
        new = [i + 1]
        for j, b in enumerate(region):
            new.append(min(last[j] + (a != b), last[j + 1] + 1, new[j] + 1))
        last = new
    return min(last)


def test_edit_distance_is_exact():
    rnd = np.random.default_rng(2)
    for _ in range(50):
        item, regions = rnd.integers(1, 4, rnd.integers(1, 9)), rnd.integers(1, 4, (3, rnd.integers(1, 14)))
        assert contamination.edit_distances(item, regions).tolist() == [plain_edits(item, r) for r in regions.tolist()]


def test_whole_result_against_brute_force_at_the_largest_number_of_edits(spark):
    """Items of 1 to 70 words, planted with exactly as many edits as are allowed, and with more."""
    rnd = random.Random(16)
    words = [f"t{i}" for i in range(300)]
    sizes = [1, 3, 7, 8, 9, 12, 15, 16, 17, 23, 31, 40, 70]
    items = [[f"only{i}" if n < 8 else rnd.choice(words) for i in range(n)] for n in sizes * 2]
    docs = []
    for i in range(520):
        own = list(items[i % len(items)])
        for j in range(len(own) // 5 + (rnd.randint(1, 4) if i % 5 == 4 else 0)):
            at = rnd.randrange(len(own))
            own[at : at + 1] = rnd.choice([[], [f"new{j}"], [own[at], f"more{j}"]]) or ([] if len(own) > 1 else own)
        docs.append(rnd.choices(words, k=rnd.randint(0, 60)) + own + rnd.choices(words, k=rnd.randint(0, 60)))
    allowed = [len(w) // 5 if len(w) >= 8 else 0 for w in items]
    want = {(d, i) for d, text in enumerate(docs) for i, item in enumerate(items) if sum(w in item for w in text) >= len(set(item)) - allowed[i] and plain_edits(item, text) <= allowed[i]}
    assert len(want) > 400
    benchmark = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id bigint, text string")
    rows = contamination.find(spark.createDataFrame([(i, ", ".join(w)) for i, w in enumerate(docs)], "doc_id bigint, text string"), benchmark).collect()
    got = {(r["doc_id"], i) for r in rows for i in r["item_ids"]}
    assert got <= want and len(got) >= 0.98 * len(want)
    short = {(d, i) for d, i in want if len(items[i]) < 8}
    assert short <= got


def test_each_class_of_items_reaches_its_recall(spark):
    """Few long items among many short ones, with substitutions only and at the ends as well."""
    rnd = random.Random(21)
    words = [f"v{i}" for i in range(3000)]
    items = [rnd.choices(words, k=9) for _ in range(950)] + [rnd.choices(words, k=15) for _ in range(50)]
    docs, want = [], {}
    for i in range(600):
        j = rnd.randrange(950) if i % 2 else 950 + rnd.randrange(50)
        own, k = list(items[j]), len(items[j]) // 5
        for n, at in enumerate(rnd.sample(range(len(own)), k)):
            own[at] = f"new{n}"
        docs.append((i, " ".join(rnd.choices(words, k=rnd.randint(0, 40)) + own + rnd.choices(words, k=rnd.randint(0, 40)))))
        want[i] = j
    benchmark = spark.createDataFrame([(j, " ".join(w)) for j, w in enumerate(items)], "item_id bigint, text string")
    got = {r["doc_id"]: set(r["item_ids"]) for r in contamination.find(spark.createDataFrame(docs, "doc_id bigint, text string"), benchmark).collect()}
    for long in (False, True):
        mine = [i for i in want if (want[i] >= 950) == long]
        assert sum(want[i] in got[i] for i in mine) >= 0.97 * len(mine)


@pytest.mark.parametrize(("n", "k"), [(8, 1), (9, 1), (10, 2), (12, 2), (15, 3), (16, 3), (25, 5)])
def test_measured_repetitions_hold_on_fresh_items(n, k):
    """Repetitions measured on some items are enough for others that were not seen."""
    random_ = np.random.default_rng(n)
    digest = mix(np.arange(1, 5001, dtype=np.uint64))
    repeats = contamination.repeats_for([random_.integers(0, 2000, n) for _ in range(50)], [k] * 50, digest, 0.99)
    own, other = [], []
    for i in range(1000):
        w = random_.integers(2000, 4000, n)
        changed = w.copy()
        changed[random_.choice(n, k, replace=False)] = 4000 + np.arange(k)
        own.append(w)
        other.append(np.concatenate([random_.integers(4100, 5000, 16), changed, random_.integers(4100, 5000, 16)]))
    met = np.zeros(1000, bool)
    for r in range(repeats):
        met |= contamination._found_in(own, other, digest, r)
    assert met.mean() >= 0.98


def test_confidence_of_a_measured_recall():
    assert contamination._misses(1000, 0.99) == 4 and contamination._misses(100, 0.99) == -1 and contamination._misses(299, 0.99) == 0


def test_very_long_items_are_found(spark):
    rnd = random.Random(3)
    item = [f"x{rnd.randrange(4000)}" for _ in range(8300)]
    near = [w if i % 9 else "changed" for i, w in enumerate(item)]
    docs = spark.createDataFrame([(1, " ".join(["a"] * 50 + near)), (2, " ".join(item[:4000])), (3, " ".join(item))], "doc_id bigint, text string")
    benchmark = spark.createDataFrame([(7, " ".join(item))], "item_id bigint, text string")
    assert {r["doc_id"]: r["contaminated"] for r in contamination.find(docs, benchmark).collect()} == {1: True, 2: False, 3: True}


def test_items_are_found_by_words_not_by_hashes(spark):
    morse = lambda a, b: "".join((a, b)[bin(i).count("1") % 2] for i in range(1024))
    docs = spark.createDataFrame([(1, " ".join([morse("a", "b")] * 10))], "doc_id bigint, text string")
    assert not contamination.find(docs, spark.createDataFrame([(1, " ".join([morse("b", "a")] * 10))], "item_id bigint, text string")).first()["contaminated"]


def test_decontamination_bears_awkward_rows_and_blocks_of_items(spark, awkward, clashing, monkeypatch):
    rows = [(1, "one two three four five six seven eight nine ten"), (2, None), (None, "word100 word101 word102 word103 word104 word105 word106 word107"), (3, "short"), (4, "One, two three four five six seven eight nine ten!"), (5, "")]
    benchmark = spark.createDataFrame(rows, "item_id bigint, text string")
    for most in (20_000, 2):
        monkeypatch.setattr(contamination, "ITEMS", most)
        for df in (awkward, clashing):
            found = contamination.find(df, benchmark).collect()
            by = {r["doc_id"]: r for r in found}
            assert len(found) == 9  # one row for each row, however many blocks
            assert by[1]["item_ids"] == by[None]["item_ids"] == [1, 4] and by[5]["n_items"] == 1 and by[5]["item_ids"] == [] and by[5]["contaminated"]
            assert not by[2]["contaminated"] and by[7]["item_ids"] == [3]
    assert contamination.find(awkward.limit(0), benchmark).count() == 0
    assert not any(r["contaminated"] for r in contamination.find(awkward, benchmark.limit(0)).collect())


# ---- mixing


def fill(sizes, cap=3):
    """Targets by sharing out again and again."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(order)}
    total, target, open_ = sum(sizes.values()), {}, set(order)
    while True:
        left = total - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > cap * sizes[s]}
        if not over:
            return target | share
        target |= {s: cap * sizes[s] for s in over}
        open_ -= over


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 5, None: 700}, {"a": 1, "b": 1, "c": 98}, {"x": 40}, {"a": 0, "b": 10}])
def test_targets_equal_repeated_sharing(spark, sizes):
    frame = spark.createDataFrame([(s, n, 1) for s, n in sizes.items()], "source string, source_size bigint, n_docs bigint")
    got = {r["source"]: r["target"] for r in mixing.targets(frame).collect()}
    want = fill({s: n for s, n in sizes.items()}) if all(sizes.values()) else {"a": 0.0, "b": 10.0}
    assert got == pytest.approx(want)


def test_copies_follow_the_prefix_sum(spark):
    rnd = random.Random(2)
    rows = [(i, "w " * rnd.randint(1, 400), rnd.choice(["a", "a", "a", "b", "c", None])) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    mixed = mixing.mix(df).collect()
    assert sorted(map(tuple, mixed), key=str) == sorted(map(tuple, mixing.mix(df.repartition(7)).collect()), key=str)  # reruns agree
    for s in ("a", "b", "c", None):
        own = [r for r in mixed if r["source"] == s]
        rate = own[0]["target"] / own[0]["source_size"]
        assert all(int(rate) <= r["copies"] <= min(3, int(rate) + 1) for r in own)
        assert abs(sum(r["copies"] for r in own) - rate * len(own)) <= 1
        assert abs(sum(r["taken"] for r in own) / own[0]["target"] - 1) < 0.05
    assert mixing.emitted(mixing.mix(df)).count() == sum(r["copies"] for r in mixed)


def test_mixing_bears_awkward_rows(awkward, clashing):
    for df in (awkward, clashing):
        rows = mixing.mix(df, carry=("lang", "size")).collect()
        assert len(rows) == 9 and all(r["taken"] <= 3 * r["size"] for r in rows)
    assert mixing.mix(awkward.limit(0)).count() == 0


# ---- archives


def test_archives_round_trip(spark, tmp_path):
    same_ = "<p>" + "é" * 60
    rows = [
        (5, "http://a/x?y\r\nInjected: 1", same_), (2, "http://b", same_), (9, "http://c", same_), (3, None, None), (4, "http://d", "WARC/1.1\r\n\r\nWARC-Type: response\r\n\r\n"),
        (7, "http://e", "x" * 99), (8, "http://f", "x" * 99), (None, "http://g", "z" * 200), (11, "http://h", "z" * 200), (12, "http://i", "q" * 3_000_000), (2, "http://b", same_),
    ]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    path = f"file:{tmp_path}/archives"
    got = warc.roundtrip(pages.withColumn("record_type", F.lit("clash")), path).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r["page_id"], []).append(r)
    data = {r[0]: (r[2] or "").encode() for r in rows}
    for k, found in by.items():
        assert {(r["payload_bytes"], r["payload_digest"]) for r in found} == {(len(data[k]), hashlib.sha256(data[k]).hexdigest())}
    kinds = {k: sorted((r["record_type"], r["refers_to"]) for r in v) for k, v in by.items()}
    assert kinds[5] == kinds[9] == [("revisit", 2)] and kinds[2] == [("response", None), ("revisit", 2)]  # one of the repeated rows
    assert kinds[7] == kinds[8] == [("response", None)] and kinds[11] == [("response", None)] and kinds[None] == [("revisit", 11)]
    files = list((tmp_path / "archives").glob("*.gz"))
    records = [h for f in files for h, _ in warc.parse(gzip.decompress(f.read_bytes()))]
    assert sorted(h["warc-type"] for h in records) == ["metadata"] * 11 + ["request"] * 11 + sorted(r["record_type"] for r in got)
    assert len({h["warc-record-id"] for h in records}) == 33
    payloads = warc.read(spark, path, with_payload=True).where("record_type = 'response'")
    assert {bytes(r["payload"]) for r in payloads.collect()} == {x for x in data.values()}
    nested = warc.assemble(warc.read(spark, path)).first()
    assert nested["request"]["record_id"] and nested["metadata"]["fields"]["payloadBytes"]


def test_archives_are_bounded_whatever_the_pages(spark, tmp_path):
    """Pages of very different sizes, the large ones in a row."""
    rows = [(i, f"http://a/{i}", str(i) + "x" * (200_000 if 300 <= i < 340 else 30)) for i in range(2000)]
    path = f"file:{tmp_path}/archives"
    warc.write(warc.planned(spark.createDataFrame(rows, "page_id bigint, url string, html string").coalesce(2)), path, 1_000_000)
    sizes = [len(gzip.decompress(f.read_bytes())) for f in (tmp_path / "archives").glob("*.gz")]
    assert 9 <= len(sizes) <= 20 and max(sizes) <= 1_000_000 + 201_500
    assert warc.read(spark, path).count() == 6000


def test_revisits_refer_to_the_record_of_the_response(spark, tmp_path):
    rows = [(i, f"http://a/{i}", "same " * 50 if i % 3 else f"own {i} " * 30) for i in range(60)]
    path = f"file:{tmp_path}/archives"
    got = {r["page_id"]: r for r in warc.roundtrip(spark.createDataFrame(rows, "page_id bigint, url string, html string"), path).collect()}
    assert all((r["record_type"], r["refers_to"], r["payload_bytes"]) == (("revisit", 1, 250) if i % 3 and i > 1 else ("response", None, len(rows[i][2]))) for i, r in got.items())
    found = [h for f in (tmp_path / "archives").glob("*.gz") for h, _ in warc.parse(gzip.decompress(f.read_bytes()))]
    one = {h["warc-record-id"] for h in found if h["warc-type"] == "response" and h["warc-target-uri"] == "http://a/1"}
    assert {h["warc-refers-to"] for h in found if h["warc-type"] == "revisit"} == one and len(one) == 1


def test_malformed_archives_are_refused():
    for data in (b"WARC/1.1\r\nContent-Length: 9\r\n\r\nshort\r\n\r\n", b"junk"):
        with pytest.raises(ValueError):
            list(warc.parse(data))


def test_no_pages(spark, tmp_path):
    assert warc.roundtrip(spark.createDataFrame([], "page_id bigint, url string, html string"), f"file:{tmp_path}/none").count() == 0


# ---- pipeline


def test_stages_each_take_effect_and_keep_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    ids = [{r[0] for r in docs.select("doc_id").collect()}]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, sf)
        if i < 4:
            assert docs.columns == corpus_pipeline.COLUMNS
        ids.append({r[0] for r in docs.select("doc_id").collect()})
        assert ids[-1] <= ids[-2]
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    gone = ids[0] - ids[1]
    clean = {k for k, r in labels.items() if r["quality"] == 1 and r["toxic"] == 0}
    assert len(gone & clean) <= 0.05 * len(clean)
    assert len(ids[2]) < len(ids[1])


def test_run_is_the_stages_in_order(spark, sf):
    rows = corpus_pipeline.run(spark, sf).collect()
    assert rows and {"doc_id", "text", "copies", "copy", "target"} <= set(rows[0].asDict())
    assert len({(r["doc_id"], r["copy"]) for r in rows}) == len(rows)


def test_stages_judge_rows_without_or_with_equal_ids_one_by_one(spark, tmp_path):
    rnd = random.Random(5)
    prose = lambda: " ".join(rnd.choice(["an", "re", "ti", "on"]) + rnd.choice(["the", "es", "in"]) for _ in range(60))
    frame = lambda rows: spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    kept = lambda stage, rows: sorted(((r["doc_id"], r["text"]) for r in stage(spark, frame(rows), str(tmp_path)).collect()), key=str)
    good = [(i, prose()) for i in range(120)]
    junk = " ".join("".join(rnd.choices("#%&XQZ0123", k=5)) for _ in range(80))
    spark.createDataFrame([(i, 1, 0) for i, _ in good], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    odd = [(None, good[1][1]), (500, good[2][1]), (500, junk), (None, junk)]
    got = kept(corpus_pipeline.quality, good + odd)
    assert (None, good[1][1]) in got and (500, good[2][1]) in got and junk not in {t for _, t in got}

    a, b, c = ([f"{x}{i}" for i in range(60)] for x in "abc")
    na, nc = (" ".join([*w[:-1], "other"]) for w in (a, c))
    a, b, c = map(" ".join, (a, b, c))
    rows = [(7, a), (7, a), (7, b), (9, na), (None, na), (None, c), (None, nc)]
    got = kept(corpus_pipeline.near_duplicates, rows)
    assert len(got) == 3 and (7, a) in got and (7, b) in got and {t for i, t in got if i is None} < {c, nc}

    spark.createDataFrame([(1, " ".join(a.split()[:20]))], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert kept(corpus_pipeline.decontamination, [(7, a), (7, b), (None, na), (None, c)]) == sorted([(7, b), (None, c)], key=str)
