import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tieout.llm import components, jaccard, substring, suffixes, words


def docs_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")


def some_texts(seed, n=60):
    """Texts with passages shared at random places, copies and periodic runs."""
    rnd = random.Random(seed)
    words = [f"w{i}é" if i % 7 == 0 else f"w{i}" for i in range(300)]
    passages = [" ".join(rnd.choices(words, k=rnd.randint(10, 90))) for _ in range(5)]
    out = []
    for _ in range(n):
        parts = [" ".join(rnd.choices(words, k=rnd.randint(0, 40)))]
        for _ in range(rnd.randint(0, 2)):
            p = rnd.choice(passages).split()
            a = rnd.randint(0, len(p) // 2)
            parts.append(" ".join(p[a : a + rnd.randint(5, len(p))]))
            parts.append(" ".join(rnd.choices(words, k=rnd.randint(0, 10))))
        out.append(rnd.choice([" ", "\n"]).join(parts))
    out += [out[3], out[3], "ab " * 200, "xyz" * 150, "", out[5] + " tail"]
    return out


def brute_words(texts, window):
    first = {}
    for d, t in enumerate(texts):
        w = t.split()
        for i in range(len(w) - window + 1):
            first.setdefault(tuple(w[i : i + window]), d)
    out = {}
    for d, t in enumerate(texts):
        w = t.split()
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < d:
                gone[i : i + window] = [True] * window
        out[d] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g))
    return out


@pytest.mark.parametrize("window", [13, 4])
def test_word_windows_equal_brute_force(spark, window):
    texts = some_texts(window)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["text"]) for r in substring.remove_repeats(docs_of(spark, texts), window).collect()}
    assert got == brute_words(texts, window)


def test_word_windows_bear_awkward_rows(awkward, clashing):
    for df in (awkward, clashing):
        rows = substring.remove_repeats(df, carry=("lang", "n_words")).collect()
        assert len(rows) == 9 and rows[0].asDict().keys() == {"doc_id", "lang", "text", "n_words", "n_removed"}
        by = {r["doc_id"]: r for r in rows}
        assert by[2]["n_words"] == by[3]["n_words"] == by[4]["n_words"] == 0 and by[2]["text"] == ""
        assert by[None]["n_removed"] == 0 and by[1]["n_removed"] == 0
        assert by[5]["n_removed"] == 0 and by[6]["n_removed"] == 30_000
    assert substring.remove_repeats(awkward.limit(0)).count() == 0


def test_claims_are_compared_word_by_word(spark, monkeypatch):
    docs = pa.table({"doc_id": pa.array([1, 1, 2]), "text": pa.array(["a b c d", "e f g h", "a b x y"])})
    claims = lambda *rows: pa.table({"doc_id": pa.array([r[0] for r in rows]), "text": pa.array([r[1] for r in rows], pa.binary())})
    assert substring.differing(docs, claims((1, b"a b c"), (1, b"b c d"), (1, b"f g h"), (2, b"b x y")), 3) == 0
    assert substring.differing(docs, claims((1, b"a b x"), (2, b"c d e"), (1, b"d e f"), (2, b"a b x y")), 3) == 3
    monkeypatch.setattr(substring, "differing", lambda *_: 1)
    with pytest.raises(Exception, match="run again with another key"):
        # In one process: what the block of the owner does with a claim.
        payload = substring.blocks._ipc(docs), substring.blocks._ipc(claims((1, b"a b c")))
        substring._compared(3, 0)(0, [payload[0]], pa.table({"payload": pa.array([payload[1]], pa.binary())}))


def brute_bytes(texts, length):
    raw = [t.encode() for t in texts]
    seen = {}
    for b in raw:
        for i in range(len(b) - length + 1):
            seen[b[i : i + length]] = seen.get(b[i : i + length], 0) + 1
    out = {}
    for d, b in enumerate(raw):
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        gone = gone[: len(b)]
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        out[d] = (len(b), int(gone.sum()), spans, bytes(np.frombuffer(b, np.uint8)[~gone]))
    return out


@pytest.mark.parametrize(("length", "seed", "partitions"), [(200, 24, 4), (60, 16, 7), (40, 12, 1)])
def test_byte_strings_equal_brute_force(spark, length, seed, partitions):
    texts = some_texts(length)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        rows = suffixes.remove_repeated_bytes(docs_of(spark, texts), length, seed).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in rows} == brute_bytes(texts, length)


def test_byte_strings_at_a_range_bound_are_compared_over_shards(spark):
    """One seed before differing bytes in every document: ranges are bounded inside of it."""
    rnd = random.Random(1)
    common = "the very common line that opens every document of the crawl. "
    tail = ["".join(rnd.choices("abcdefgh ", k=150)) for _ in range(12)]
    texts = [common + tail[i % 12] + "".join(rnd.choices("ijklmnop", k=80)) for i in range(400)]
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in suffixes.remove_repeated_bytes(docs_of(spark, texts), 120, 24).collect()}
    assert got == brute_bytes(texts, 120)


def test_equal_hashes_of_different_strings_are_told_apart():
    whole = suffixes._window_hashes

    def coarse(keys, length):
        index, left, one, two = whole(keys, length)
        return index, left, one % np.uint64(3), two % np.uint64(2)

    keys = [(b"abcdef" + b"zyx", 6), (b"abcdeX" + b"zyx", 6), (b"abcdef" + b"zyQ", 6)]
    want = {(0, 0), (2, 0)} | {(k, l) for k in range(3) for l in (1, 2)} | {(0, 3), (1, 3)}
    for hashes in (whole, coarse):
        index, left, one, two = hashes(keys, 6)
        assert {(int(index[i]), int(left[i])) for i in suffixes._confirmed(keys, 6, index, left, one, two)} == want


def test_loser_tree_orders_runs_and_knows_prefixes():
    rnd = random.Random(2)
    runs, every = [], []
    for _ in range(9):
        strings = sorted(bytes(rnd.choices(b"ab", k=rnd.randint(1, 12))) for _ in range(rnd.randint(0, 30)))
        every += strings
        runs.append((strings, [0] + [suffixes.shared(a, b) for a, b in zip(strings, strings[1:])]))
    got = list(suffixes.merge_runs(runs))
    assert [g[0] for g in got] == sorted(every)
    assert [g[3] for g in got[1:]] == [suffixes.shared(a[0], b[0]) for a, b in zip(got, got[1:])]


def test_byte_strings_bear_awkward_rows(awkward, clashing):
    for df in (awkward, clashing):
        by = {}
        for r in suffixes.remove_repeated_bytes(df).collect():
            by.setdefault(r["doc_id"], r)
        assert by[2]["n_bytes"] == 0 and by[6]["n_removed"] == by[6]["n_bytes"] and by[5]["n_spans"] == 1
        assert by[1]["n_removed"] == 0  # shorter than 200 bytes
    assert suffixes.remove_repeated_bytes(awkward.limit(0)).count() == 0


def brute_links(texts, k=5, least=0.8):
    sets = []
    for t in texts:
        w = t.split()
        sets.append(frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset())
    root, links = list(range(len(texts))), [0] * len(texts)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= least:
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (find(i), links[i]) for i in range(len(sets))}


def near_copies(seed, groups=12, size=8):
    rnd = random.Random(seed)
    words = [f"v{i}" for i in range(2000)]
    out = []
    for _ in range(groups):
        base = rnd.choices(words, k=rnd.randint(40, 400))
        for _ in range(size):
            w = list(base)
            for _ in range(rnd.randint(0, max(1, len(w) // 45))):
                w[rnd.randrange(len(w))] = rnd.choice(words)
            out.append(" ".join(w))
    rnd.shuffle(out)
    return out + ["", "a", "a", "a b c d", out[0]]


@pytest.mark.parametrize("tile, refine", [(1024, False), (3, False), (3, True)])
def test_join_equals_brute_force(spark, monkeypatch, tile, refine):
    monkeypatch.setattr(jaccard, "TILE", tile)
    texts = near_copies(tile)
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard.join(docs_of(spark, texts), refine=refine).collect()}
    assert got == brute_links(texts)


def test_join_bears_awkward_rows(awkward, clashing):
    for df in (awkward, clashing):
        rows = jaccard.join(df).collect()
        by = {r["doc_id"]: r for r in rows}
        assert len(rows) == 9 and by[5]["class_id"] == by[6]["class_id"] == 5 and by[6]["n_links"] == 2
        assert by[2]["n_links"] == by[3]["n_links"] == 0 and by[None]["class_id"] is None
    assert jaccard.join(awkward.limit(0)).count() == 0


def test_join_of_reused_ids_and_repeated_rows(spark):
    words = [f"r{i}" for i in range(200)]
    a, b = words[:60], words[100:160]
    near = lambda w: " ".join([*w[:-1], "other"])
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, near(a)), (3, near(b)), (4, " ".join(words[60:95])), (4, " ".join(words[60:95])), (5, near(words[60:95]))]
    for rows_ in (rows, rows[::-1]):
        got = sorted(tuple(r) for r in jaccard.join(spark.createDataFrame(rows_, "doc_id bigint, text string").coalesce(1)).collect())
        assert got == [(1, 1, 1, 1), (1, 1, 1, 1), (2, 1, 1, 1), (3, 1, 1, 1), (4, 4, 2, 1), (4, 4, 2, 1), (5, 4, 2, 1)]


def test_prefix_is_shortened_until_the_target():
    assert jaccard.prefix_length([1000] * 5 + [990, 900, 500], 1000, 0.998) == 5
    assert jaccard.prefix_length([1000] * 8, 1000, 0.998) == 8 and jaccard.prefix_length([5] * 8, 1000, 0.998) == 1
    rnd = np.random.default_rng(1)
    sets = [rnd.integers(0, 1 << 63, rnd.integers(4, 300), dtype=np.uint64) for _ in range(60)]
    met = jaccard.probed(sets, 0.8, 60, jaccard.TREES, jaccard.DEPTH)
    assert met[-1] == 3600 and all(a >= b for a, b in zip(met[:-1], met[1:-1]))
    for level in (5, 8):  # a partner is at the threshold, or above it for small sets
        assert met[level - 1] / 3600 >= 1 - (1 - 0.8**level) ** jaccard.TREES - 0.02
    assert jaccard.prefix_length(met[:-1].tolist(), 3600) in (5, 6)


def test_runs_of_sorted_labels_chain_over_partition_bounds(spark):
    rnd = random.Random(3)
    labels = {i: [bytes([0, rnd.randrange(2)] * 4 + [0, rnd.randrange(9)] * 4) for _ in range(3)] for i in range(200)}
    frame = spark.createDataFrame([(i, [bytearray(x) for x in row]) for i, row in labels.items()], "text bigint, labels array<binary>")
    for prefix in (4, 5, 8):
        edges = [tuple(r) for r in jaccard.edges_of(frame, prefix).collect()]
        got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
        root = {i: i for i in labels}
        for tree in range(3):
            by = {}
            for i in sorted(labels):
                by.setdefault(labels[i][tree][: 2 * prefix], []).append(i)
            for run in by.values():
                roots = {root[i] for i in run}
                root = {i: min(roots) if r in roots else r for i, r in root.items()}
        assert {i: got.get(i, i) for i in labels} == root


def test_flagged_runs_need_a_row_with_flag_0(spark):
    rnd = random.Random(9)
    # Few tokens, so that runs go over several partitions; some have no flag 0 at all.
    rows = [(0, bytearray([0, t, t > 3 or i % 7 and rnd.random() < 0.9]), i) for i in range(300) for t in {0, rnd.randrange(12)}]
    frame = spark.createDataFrame(rows, "tree int, label binary, text bigint")
    for cut in (frame, frame.where("text % 30 = 1"), frame.where("text < 0")):
        got = {r["node"]: r["root"] for r in components.components(jaccard.chained(cut, 2, flagged=True)).collect()}
        kept = [(bytes(r["label"]), r["text"]) for r in cut.collect()]
        root = {i: i for _, i in kept}
        for token in {label[:2] for label, _ in kept}:
            run = {i for label, i in kept if label[:2] == token}
            if any(label == token + b"\0" for label, _ in kept):
                roots = {root[i] for i in run}
                root = {i: min(roots) if r in roots else r for i, r in root.items()}
        assert {i: got.get(i, i) for i in root} == root


def test_prefixes_of_linked_sets_meet():
    rnd = random.Random(11)
    for _ in range(3000):
        a = set(rnd.sample(range(60), rnd.randint(1, 40)))
        b = {*rnd.sample(sorted(a), rnd.randint(1, len(a))), *rnd.sample(range(60, 70), rnd.randint(0, 6))}
        small, large = sorted((a, b), key=len)
        if len(a & b) / len(a | b) >= 0.8:
            index, probe = jaccard.prefix_sizes(len(small), 0.8)[0], jaccard.prefix_sizes(len(large), 0.8)[1]
            assert set(sorted(small)[:index]) & set(sorted(large)[:probe])


def test_texts_of_one_template_are_not_compared_all_with_all(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "TILE", 16)
    rnd = random.Random(5)
    words = [f"v{i}" for i in range(5000)]
    site = rnd.choices(words, k=150)
    texts = [" ".join(site + rnd.choices(words, k=35)) for _ in range(240)]  # similarity 0.65
    texts += [" ".join([*t.split()[:-2], "x", str(i)]) for i, t in enumerate(texts[:20])]
    verified = []
    similar = jaccard._with_tiles
    monkeypatch.setattr(jaccard, "_with_tiles", lambda df: verified.append(similar(df)) or verified[-1])
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard.join(docs_of(spark, texts), refine=True).collect()}
    assert got == brute_links(texts)
    before, after = (df.groupBy("cluster").count().agg({"count": "max"}).first()[0] for df in verified)
    assert before > 200 and 2 <= after < 8  # one cluster of candidates, then the links and few that share a word more than the template


def morse(a, b, n=1024):
    """A word of two letters in Thue-Morse order, on which polynomial hashes modulo powers of two collide."""
    return "".join((a, b)[bin(i).count("1") % 2] for i in range(n))


def test_words_are_told_apart_where_polynomial_hashes_collide(spark):
    x, y = morse("a", "b"), morse("b", "a")
    texts = [" ".join([x] * 13), " ".join([y] * 13), " ".join([x] * 7 + [y] * 6)]
    assert all(r["n_removed"] == 0 for r in substring.remove_repeats(docs_of(spark, texts)).collect())
    assert all(r["n_links"] == 0 for r in jaccard.join(docs_of(spark, texts)).collect())


def test_equal_hashes_of_different_items_are_told_apart():
    rnd = np.random.default_rng(5)
    rows = rnd.integers(0, 3, (500, 4))
    for value in (np.zeros(500, np.uint64), rows[:, 0].astype(np.uint64), (rows @ [27, 9, 3, 1]).astype(np.uint64)):
        order, new = words.exact_groups(value, lambda at: rows[at])
        group = np.cumsum(new)
        assert sorted(order.tolist()) == list(range(500)) and group[-1] == len(np.unique(rows, axis=0))
        assert all((rows[order[group == g]] == rows[order[group == g][0]]).all() for g in range(1, group[-1] + 1))


def test_links_are_of_equal_words_even_if_every_hash_is_equal(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "window_hash", lambda value, n, seed=0: np.zeros(max(0, len(value) - n + 1), np.uint64))
    grams = jaccard.gram_numbers(pa.chunked_array([pa.array(["a b c d e f", "b c d e f", "c d", "c d", "d c"])]), 5)
    assert len({tuple(g) for g in grams}) == 4 and len(grams[0]) == 2 and set(grams[1]) <= set(grams[0]) and grams[2].tolist() == grams[3].tolist()


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100 + i, 100) for i in range(1, 9)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(9)}
    assert components.components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def test_kept_digest_is_of_the_joined_words(spark):
    df = docs_of(spark, ["a  b\tc"])
    row = substring.remove_repeats(df).select(F.sha2("text", 256).alias("d")).first()
    assert row["d"] == hashlib.sha256(b"a b c").hexdigest()


def brute_kept(texts, length):
    """Kept bytes of each text: every string told apart by itself."""
    count = {}
    for t in texts:
        for i in range(len(t) - length + 1):
            s = t[i : i + length]
            count[s] = count.get(s, 0) + 1
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                gone[i : i + length] = True
        out.append(bytes(np.frombuffer(t, np.uint8)[~gone]))
    return out


def raw_docs(spark, texts):
    """Texts of any bytes, valid UTF-8 or not."""
    df = spark.createDataFrame(list(enumerate(map(bytearray, texts))), "doc_id bigint, raw binary")
    return df.select("doc_id", F.col("raw").cast("string").alias("text"))


def test_strings_at_range_bounds_are_not_told_apart_by_a_polynomial(spark):
    """A Thue-Morse string and its complement, whose polynomial hashes modulo 2**64 are equal."""
    morse = bytes(b"\x03\xa4"[bin(i).count("1") % 2] for i in range(128))
    texts = [morse + bytes(range(100, 172)), morse.translate(bytes.maketrans(b"\x03\xa4", b"\xa4\x03")) + bytes(range(100, 172))]
    rows = suffixes.remove_repeated_bytes(raw_docs(spark, texts)).collect()
    assert {r["doc_id"]: bytes(r["kept"]) for r in rows} == dict(enumerate(texts))


@pytest.mark.parametrize("every", [False, True])
def test_bytes_equal_brute_force_with_bounds_on_every_seed(spark, monkeypatch, every):
    if every:  # then all strings go by digest
        def bounds(docs, length, seed, n):
            found = set()
            for r in docs.collect():
                s = suffixes.Suffixes(pa.chunked_array([pa.array([r["text"]], pa.string())]), length, seed)
                found |= {k for k, _ in s.keys(np.arange(len(s.at)))[1]}
            return sorted(found)

        monkeypatch.setattr(suffixes, "_bounds", bounds)
    texts = [t.encode() for t in some_texts(40, 40)]
    got = {r["doc_id"]: bytes(r["kept"]) for r in suffixes.remove_repeated_bytes(raw_docs(spark, texts), 40, 12).collect()}
    assert got == dict(enumerate(brute_kept(texts, 40)))


def test_periodic_stretches_equal_brute_force(spark):
    """Units of 1 to 12 bytes, stretches that end in the middle of a unit, at a text's ends, and that meet each other."""
    rnd = random.Random(5)
    noise = lambda n: bytes(rnd.randrange(97, 123) for _ in range(n))
    texts = []
    for k in (1, 2, 3, 5, 7, 8, 9, 12):
        unit = noise(k)
        for n in (39, 40, 41, 200, 500, 1300):
            texts.append(noise(rnd.choice([0, 3, 60])) + (unit * n)[:n] + noise(rnd.choice([0, 3, 60])))
    texts += [b"-" * 900 + b"=" * 900, b"-" * 40, b"ab" * 600 + b"a" * 600, b"\x00" * 700, b"\x00" * 39, noise(100) + b"=" * 41 + noise(5)]
    got = {r["doc_id"]: bytes(r["kept"]) for r in suffixes.remove_repeated_bytes(raw_docs(spark, texts), 40, 12).collect()}
    want = dict(enumerate(brute_kept(texts, 40)))
    assert [i for i in want if got[i] != want[i]] == []


def test_a_long_line_of_dashes_is_sampled_at_its_ends():
    for text in ("-" * 3_000_000, "- " * 1_500_000, "=-=_" * 750_000):
        s = suffixes.Suffixes(pa.chunked_array([pa.array([text])]), 200, 24)
        assert len(s.at) < 2_000 and s.sure
    plain = suffixes.Suffixes(pa.chunked_array([pa.array([" ".join(f"word{i}" for i in range(20_000))])]), 200, 24)
    assert not plain.sure
