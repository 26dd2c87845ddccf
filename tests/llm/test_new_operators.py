"""Conversation trie, vector codes and exact duplicates against brute force and SQL."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from compare import connect, same
from pyspark.sql import functions as F

from tieout.llm import codes, exact, oracles, queries, tries


@pytest.mark.parametrize(("name", "sql"), [("op11_conversation_trie", oracles.OP11_SQL), ("op12_vector_codes", oracles.OP12_SQL), ("op13_exact_dedup", oracles.OP13_SQL)])
def test_query_equals_sql(spark, sf, name, sql):
    same(queries.queries()[name](spark, sf), connect(sf), sql)


# --- conversations


def brute_trie(rows):
    convs = collections.defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            convs[c].append((t is not None, t or 0, r or "", hashlib.sha256(f"{len((r or '').encode())}:{r or ''}{x or ''}".encode()).digest(), x or ""))
    turns = {c: [(r, x) for _, _, r, _, x in sorted(v)] for c, v in convs.items()}
    built = {c: turns.get(c - int(math.fmod(c, 5)), [])[: (h := zlib.crc32(str(c).encode()) % 9)] + t[h:] for c, t in turns.items()}
    members, children = collections.defaultdict(list), collections.defaultdict(list)
    for c, t in built.items():
        for d in range(len(t) + 1):
            members[tuple(t[:d])].append(c)
    for k in members:
        if k:
            children[k[:-1]].append(k)
    leaves, saved = {}, {}
    for k in sorted(members, key=len, reverse=True):
        own = (len(members[k]) - 1) * (len(k[-1][1].encode()) if k else 0)
        leaves[k], saved[k] = sum(leaves[x] for x in children[k]) or 1, own + sum(saved[x] for x in children[k])
    ends = lambda k: hashlib.sha256(",".join(map(str, sorted(c for c in members[k] if len(built[c]) == len(k)))).encode()).hexdigest()
    return sorted((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(children[k]), leaves[k], saved[k], ends(k)) for k, m in members.items())


def nodes_of(df):
    rows = [tuple(r) for r in df.collect()]
    assert len({r[:2] for r in rows}) == len(rows)
    return sorted(rows)


CONVERSATION = "conv_id bigint, turn bigint, role string, text string"


@pytest.mark.parametrize("seed", range(3))
def test_trie_equals_brute_force(spark, seed):
    rnd = random.Random(seed)
    rows = []
    for c in rnd.sample(range(-20, 300), 120):
        rows += [(c, t, rnd.choice("ua"), rnd.choice(["x", "yy", "é"])) for t in range(rnd.choice([0, 1, 3, 12]))]
    rnd.shuffle(rows)
    assert nodes_of(tries.trie(spark.createDataFrame(rows, CONVERSATION))) == brute_trie(rows)


def test_trie_of_one_hot_conversation(spark):
    rows = [(c, t, "u", f"turn {t}") for c in range(500) for t in range(10)] + [(1000, t, "u", f"turn {t}") for t in range(2000)]
    got = nodes_of(tries.trie(spark.createDataFrame(rows, CONVERSATION)))
    assert got == brute_trie(rows)


def test_ids_that_end_at_a_node_are_joined_over_pieces(spark, monkeypatch):
    monkeypatch.setattr(tries, "_PIECE", 40)
    steps = spark.range(-50, 1000).select(F.col("id").alias("conv_id"), F.lit(b"k").alias("key"), F.lit(True).alias("ends"))
    assert tries.ends_of(steps).first()[1] == hashlib.sha256(",".join(map(str, range(-50, 1000))).encode()).hexdigest()


def test_peeling_takes_few_rounds_on_a_deep_trie(spark, monkeypatch):
    """Each conversation leaves the one before a turn later, so a chain by ids would take a round a conversation."""
    rows = [(5 * c, t, "u", f"turn {t}" if t < c else f"own {c}") for c in range(9, 120) for t in range(c + 1)]
    rounds = []
    settled = tries.runtime.settled
    monkeypatch.setattr(tries.runtime, "settled", lambda df: rounds.append(1) or settled(df))
    got = nodes_of(tries.trie(spark.createDataFrame(rows, CONVERSATION)))
    assert got == brute_trie(rows)
    assert len(rounds) < 20


def test_trie_bears_awkward_rows(spark):
    rows = [(5, None, None, None), (5, None, None, None), (5, 1, "u", ""), (6, 0, "u", "long " * 20_000), (7, 3, None, "x"), (7, 3, "u", None), (None, 1, "u", "x"), (6, 0, "u", "long " * 20_000), (8, 1, "u", "a\x00b")]
    df = spark.createDataFrame(rows, CONVERSATION)
    assert nodes_of(tries.trie(df)) == brute_trie(rows)
    clashing = df.select("*", *(F.lit("x").alias(n) for n in ("key", "depth", "chain", "family", "n_convs", "ends")))
    assert nodes_of(tries.trie(clashing)) == brute_trie(rows)
    assert tries.trie(df.limit(0)).collect() == []
    assert tries.trie(df.where("conv_id is null")).collect() == []


# --- codes


def brute_codes(rows, parts=8, entries=16, rounds=6):
    good = [r for r in rows if r[1] is not None and r[1] and all(x is not None and math.isfinite(x) for x in r[1])]
    good.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    good = [r for r in good if len(r[1]) == next(len(x[1]) for x in good if len(x[1]) % parts == 0)]
    v = np.floor(np.array([r[1] for r in good], np.float64) * 4096).astype(np.int64).reshape(len(good), parts, -1)
    code, error, told = np.zeros((len(good), parts), int), np.zeros(len(good), np.int64), []
    for p in range(parts):
        x = v[:, p]
        book = x[:entries].copy()
        for r in range(rounds + 1):
            d = ((x[:, None] - book[None]) ** 2).sum(axis=2)
            a = d.argmin(axis=1)
            if r < rounds:
                book = np.array([x[a == k].sum(axis=0) // (a == k).sum() if (a == k).any() else book[k] for k in range(len(book))])
        code[:, p] = a
        error += d.min(axis=1)
        told += book.reshape(-1).tolist()
    sums = collections.Counter()
    for r, e in zip(good, error.tolist()):
        sums[r[2]] += e
    h = hashlib.sha256(",".join(map(str, told)).encode()).hexdigest()
    return sorted(((r[0], bytes(c.tolist()).hex(), e, sums[r[2]], h) for r, c, e in zip(good, code, error.tolist())), key=str)


def codes_of(df, **more):
    return sorted(((r["vec_id"], r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in codes.encode(df, **more).collect()), key=str)


VECTOR = "vec_id bigint, embedding array<float>, label int"


def vectors(seed, n, dims, spread):
    rnd = np.random.default_rng(seed)
    values = np.round(rnd.normal(0, spread, (n, dims)), 3).astype(np.float32)
    return [(int(i), v.tolist(), int(i) % 3 if i % 5 else None) for i, v in zip(rnd.permutation(n), values)]


@pytest.mark.parametrize(("seed", "n", "dims", "spread"), [(0, 700, 16, 0.1), (1, 300, 8, 0.001), (2, 9, 24, 5.0)])
def test_codes_equal_brute_force(spark, monkeypatch, seed, n, dims, spread):
    """The second has one component a part and few values, so ties abound; the third fewer vectors than entries."""
    monkeypatch.setattr(codes, "CHUNK", 128)
    rows = vectors(seed, n, dims, spread)
    assert codes_of(spark.createDataFrame(rows, VECTOR)) == brute_codes(rows)


def test_bounds_hold_and_spare_most_scans():
    """After every move the entry is the nearest, and a part that was not measured is in no tie."""
    rnd = np.random.default_rng(3)
    points = rnd.integers(-500, 500, (3000, 4)) + rnd.integers(0, 12, (3000, 1)) * 3000
    book = points[:12].copy()
    held = codes.Bounds(*codes._scan(points, book))
    spared = []
    for _ in range(6):
        new = np.array([points[held.entry == k].sum(axis=0) // max(1, (held.entry == k).sum()) if (held.entry == k).any() else book[k] for k in range(len(book))])
        scanned = held.moved(points, book, new)
        squares = codes._squares(points, new)
        assert (held.entry == squares.argmin(axis=1)).all()
        near = np.sort(squares, axis=1)
        assert (held.upper.astype(float) ** 2 >= near[:, 0]).all() and (np.maximum(held.lower, 0).astype(float) ** 2 <= near[:, 1]).all()
        spared.append(1 - len(scanned) / len(points))
        book = new
    assert spared[-1] > 0.5


def test_codes_bear_awkward_rows(spark):
    rows = vectors(4, 60, 16, 0.2)
    rows += [(None, rows[0][1], 1), rows[1], rows[1], (100, None, 1), (101, [0.1] * 15 + [None], 1), (102, [float("nan")] * 16, 1), (103, [float("inf")] * 16, 2), (104, [], 1), (105, [0.5] * 24, 1), (106, [-0.0] * 16, None)]
    df = spark.createDataFrame(rows, VECTOR)
    assert codes_of(df) == brute_codes(rows)
    clashing = df.select("*", *(F.lit("x").alias(n) for n in ("rows", "vectors", "width", "error", "code", "sums")))
    assert codes_of(clashing) == brute_codes(rows)
    assert codes.encode(df.limit(0)).collect() == [] and codes.encode(df.where("vec_id = 100")).collect() == []
    with pytest.raises(Exception, match="a component from"):
        codes.encode(spark.createDataFrame([(1, [1e9] * 16, 1)], VECTOR)).collect()


def test_only_the_newest_round_is_kept(spark):
    import glob

    df = spark.createDataFrame(vectors(5, 40, 8, 1.0), VECTOR)
    codes.encode(df)
    folder = spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:")
    newest = max(glob.glob(f"{folder}/codes-*"), key=lambda p: __import__("os").path.getmtime(p))
    assert [p.rsplit("/", 1)[1] for p in glob.glob(f"{newest}/*")] == ["6"]


# --- exact duplicates


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def brute_exact(rows):
    groups = collections.defaultdict(list)
    for i, r in enumerate(rows):
        groups[lowered(r[1])].append((r[0] is not None, r[0] or 0, i))
    out = []
    for text, same_text in groups.items():
        last = max(same_text)
        keep = last[1] if last[0] else None
        for has, d, i in same_text:
            out.append((d if has else None, keep, len(same_text), (has, d) == last[:2], hashlib.sha256(text.encode()).hexdigest()))
    return out


def exact_of(df, **more):
    return [(r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in exact.mark(df, **more).collect()]


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string")


@pytest.mark.parametrize("filter_bytes", [exact.FILTER_BYTES, 64])
def test_duplicates_equal_brute_force(spark, filter_bytes):
    """Also with filters too small to tell rows apart: more rows shuffle, none is lost."""
    rnd = random.Random(7)
    rows = [(i, rnd.choice(["A", "b", "É", "ß"]) * rnd.randint(0, 400)) for i in range(900)] + [(1000 + i, "Hot" if i % 2 else "hOT") for i in range(600)]
    rnd.shuffle(rows)
    assert sorted(exact_of(docs(spark, rows), filter_bytes=filter_bytes)) == sorted(brute_exact(rows))
    assert sorted(r["doc_id"] for r in exact.survivors(docs(spark, rows), filter_bytes=filter_bytes).collect()) == sorted(r[0] for r in brute_exact(rows) if r[3])


def test_duplicates_bear_awkward_rows(awkward, clashing):
    for df in (awkward, clashing):
        got = exact_of(df)
        assert len(got) == df.count()
        kept = collections.Counter(r[4] for r in got if r[3])
        assert set(kept.values()) == {1} and set(kept) == {r[4] for r in got}  # one of equal rows stays
        want = {(r[0], r[1], r[2], r[4]) for r in brute_exact([(r["doc_id"], r["text"]) for r in df.collect()])}
        assert {(r[0], r[1], r[2], r[4]) for r in got} == want
        stays = exact.survivors(df)
        assert stays.columns == df.columns and stays.count() == len(kept)
        assert exact_of(df.limit(0)) == []


def test_few_rows_without_equals_shuffle(spark):
    rows = [(i, f"text {i}") for i in range(20_000)] + [(50_000 + i, f"text {i}") for i in range(300)]
    df = docs(spark, rows).select(F.xxhash64(exact.digest("text")).alias("h"))
    maybe = exact.possibly_repeated(df)
    through = df.groupBy("h").count().withColumn("maybe", maybe("h"))
    assert through.where("count > 1 and not maybe").isEmpty()
    assert through.where("count = 1 and maybe").count() < 0.01 * 20_000


def test_filters_stay_within_their_bound(spark):
    df = spark.range(40_000).select(F.xxhash64(F.col("id") % 20_000).alias("h"))
    maybe = exact.possibly_repeated(df, filter_bytes=1024)
    assert df.select(maybe("h").alias("m")).where("not m").isEmpty()  # every one repeats, and the filter says so
