import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tieout.llm import blocks, kneser_ney, perplexity, urls

SYLLABLES = ["an", "re", "ti", "on", "the", "es", "in", "st"]


def prose(rnd, n):
    return " ".join("".join(rnd.choices(SYLLABLES, k=rnd.randint(1, 3))) for _ in range(n))


def junk(rnd, n):
    return " ".join("".join(rnd.choices("#%&XQZ0123", k=5)) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark):
    rnd = random.Random(1)
    docs, labels = [], []
    for i in range(600):
        lang = "en" if i % 3 else "de"
        bad = i % 10 == 9
        docs.append((i, junk(rnd, 80) if bad else prose(rnd, rnd.randint(25, 120)), lang))
        if i < 400:
            labels.append((i, 0 if bad else 1, 0))
    docs += [(1000, prose(rnd, 50), "zz"), (1001, None, "en"), (1002, "", None)]
    return spark.createDataFrame(docs, "doc_id bigint, text string, lang string"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


class Plain:
    """Interpolated modified Kneser-Ney by dictionaries."""

    def __init__(self, texts, order):
        self.order = order
        self.levels = {order: Counter()}
        for t in texts:
            s = b"\x02" * (order - 1) + t + b"\x03"
            self.levels[order].update(s[i : i + order] for i in range(len(s) - order + 1))
        for n in range(order - 1, 0, -1):
            self.levels[n] = Counter(g[1:] for g in self.levels[n + 1])
        self.cuts, self.contexts = {}, {}
        for n, level in self.levels.items():
            t = [max(0.5, sum(c == i for c in level.values())) for i in (1, 2, 3, 4)]
            y = t[0] / (t[0] + 2 * t[1])
            d = [1 - 2 * y * t[1] / t[0], 2 - 3 * y * t[2] / t[1], 3 - 4 * y * t[3] / t[2]]
            self.cuts[n] = [min(max(x, 0.1), most) for x, most in zip(d, (0.95, 1.9, 2.9))]
            by = defaultdict(list)
            for g, c in level.items():
                by[g[:-1]].append(c)
            self.contexts[n] = by

    def p(self, gram):
        n = len(gram)
        if not n:
            return 1 / kneser_ney.UNITS
        counts = self.contexts[n].get(gram[:-1])
        if not counts:
            return self.p(gram[1:])
        cut = lambda c: min(c, self.cuts[n][min(c, 3) - 1])
        total, c = sum(counts), self.levels[n].get(gram, 0)
        return (c - cut(c) if c else 0) / total + sum(map(cut, counts)) / total * self.p(gram[1:])


def test_model_equals_dictionaries(spark):
    rnd = random.Random(3)
    train, held = [prose(rnd, 30).encode() for _ in range(20)], [prose(rnd, 10).encode(), b"unseen \xc3\xa9 bytes", b""]
    docs = spark.createDataFrame([(i, t.decode(), "en") for i, t in enumerate(train)], "doc_id bigint, text string, model string")
    every = docs.selectExpr("cast(pmod(xxhash64(doc_id), 3) as int) as block", "doc_id")
    levels = kneser_ney.tables(kneser_ney.count(blocks.pack(docs, ["doc_id", "model", "text"], 3, F.pmod(F.xxhash64("doc_id"), F.lit(3))), every))
    cuts = kneser_ney.discounts(levels).selectExpr("model", "-rank as rank", "0L as key", "0L as n", "d1", "d2", "d3")
    rows = levels.selectExpr("model", "rank", "key", "n", "cast(null as double) as d1", "cast(null as double) as d2", "cast(null as double) as d3").unionByName(cuts).toArrow()
    model, plain = kneser_ney.models(rows)["en"], Plain(train, kneser_ney.ORDER)
    for t in (*held, train[0]):
        key, _ = kneser_ney.ngrams([t])
        s = b"\x02" * (kneser_ney.ORDER - 1) + t + b"\x03"
        want = [math.log(plain.p(s[i : i + kneser_ney.ORDER])) for i in range(len(t) + 1)]
        assert np.allclose(model.log_prob(key), want, atol=1e-4)


def test_classifier_on_held_out_documents(spark, corpus):
    docs, labels = corpus
    rows = {r["doc_id"]: r for r in perplexity.classify(docs, labels).collect()}
    assert len(rows) == docs.count()
    unseen = range(400, 600)
    assert all(not rows[i]["kept"] for i in unseen if i % 10 == 9)
    assert sum(rows[i]["kept"] for i in unseen if i % 10 != 9) >= 0.95 * 180
    assert rows[1000]["kept"] and rows[1000]["perplexity"] is None  # a language without trusted text
    assert not rows[1001]["kept"] and not rows[1002]["kept"]


def test_sharded_and_held_scores_agree(spark, corpus):
    docs, labels = corpus
    a = {r["doc_id"]: r["perplexity"] for r in perplexity.classify(docs, labels).collect()}
    b = {r["doc_id"]: r["perplexity"] for r in perplexity.rules(docs, labels).collect()}
    for k, v in a.items():
        assert (v is None) == (b[k] is None) and (v is None or abs(v - b[k]) < 0.01 * v)


def test_rules_equal_brute_force(spark):
    rnd = random.Random(4)
    words = ["a", "bé", "#c", "d&", "e|f", "g<h>"]
    texts = ["\n".join(" ".join(rnd.choices(words, k=rnd.randint(0, 9))) for _ in range(rnd.randint(1, 9))) for _ in range(80)] + [None, "", " \n \n", "x\n\x0bx\nx"]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([(0, 1, 0)], "doc_id bigint, quality int, toxic int")
    for r in perplexity.rules(docs, labels).collect():
        t = (texts[r["doc_id"]] or "").encode()
        w = t.split()
        windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        gone = [False] * len(w)
        for i in range(len(w) - 7):
            if windows[tuple(w[i : i + 8])] > 1:
                gone[i : i + 8] = [True] * 8
        seen, lines = set(), 0
        for line in t.split(b"\n"):
            lines += bool(line.split()) and line in seen
            seen.add(line)
        want = (len(w), sum(len(x.decode()) for x in w), sum(t.count(c) for c in (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">")), lines, sum(gone))
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (len(w) < 20 or 100 * sum(gone) > 30 * len(w))
        assert not (r["base_failed"] and r["kept"])


def test_scorers_bear_awkward_rows(spark, awkward, clashing):
    labels = spark.createDataFrame([(1, 1, 0), (5, 1, None), (6, None, 0), (None, 1, 0), (7, 0, 0), (7, 1, 0)], "doc_id bigint, quality int, toxic int")
    for df in (awkward, clashing):
        assert perplexity.classify(df, labels).count() == 9
        assert perplexity.rules(df, labels).count() == 9
    none = awkward.limit(0)
    assert perplexity.classify(none, labels).count() == perplexity.rules(none, labels).count() == 0
    assert all(r["perplexity"] is None for r in perplexity.rules(awkward, labels.limit(0)).collect())


def test_verdicts_equal_models_and_quantiles_by_dictionaries(spark, corpus):
    """Both halves of every language: perplexities, band and verdict of every document."""
    docs, labels = corpus
    rows = {r["doc_id"]: r for r in docs.withColumn("half", perplexity.half_of()).collect()}
    trusted = {r["doc_id"] for r in labels.collect() if r["quality"] == 1 and r["toxic"] == 0}
    want = {}
    for lang in ("en", "de"):
        for half in "01":
            model = Plain([rows[i]["text"].encode() for i in sorted(trusted) if rows[i]["lang"] == lang and rows[i]["half"] != half], kneser_ney.ORDER)
            for i, r in rows.items():
                if r["lang"] == lang and r["half"] == half and r["text"] and i % 7 == 0 or (i in trusted and r["lang"] == lang and r["half"] == half):
                    t = r["text"].encode()
                    s = b"\x02" * (kneser_ney.ORDER - 1) + t + b"\x03"
                    want[i] = math.exp(-sum(math.log(model.p(s[j : j + kneser_ney.ORDER])) for j in range(len(t) + 1)) / (len(t) + 1))
    ordered = {lang: sorted(want[i] for i in trusted if rows[i]["lang"] == lang) for lang in ("en", "de")}
    ceiling = {lang: v[math.ceil(0.97 * len(v)) - 1] for lang, v in ordered.items()}
    floor = {lang: v[max(0, math.ceil(0.02 * len(v)) - 1)] for lang, v in ordered.items()}
    one = {r["doc_id"]: r for r in perplexity.classify(docs, labels, 0.97).collect()}
    two = {r["doc_id"]: r for r in perplexity.rules(docs, labels, 0.02, 0.97).collect()}
    for i, p in want.items():
        lang = rows[i]["lang"]
        assert one[i]["perplexity"] == pytest.approx(p, rel=1e-4) and two[i]["perplexity"] == pytest.approx(p, rel=1e-4)
        assert one[i]["ceiling"] == pytest.approx(ceiling[lang], rel=1e-4) and two[i]["floor"] == pytest.approx(floor[lang], rel=1e-4)
        if min(abs(p - ceiling[lang]), abs(p - floor[lang])) > 1e-3 * p:
            assert one[i]["kept"] == (p <= ceiling[lang]) and two[i]["kept"] == (not two[i]["base_failed"] and floor[lang] <= p <= ceiling[lang])


def test_bad_documents_are_told_apart_in_every_language(spark, sf):
    """Held-out accuracy on the labelled rows of the fixture."""
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = perplexity.classify(spark.read.parquet(f"{sf}/documents.parquet"), labels).join(labels, "doc_id").collect()
    for lang in {r["lang"] for r in rows}:
        own = [r for r in rows if r["lang"] == lang]
        good, bad = ([r["kept"] for r in own if (r["quality"] == 1 and r["toxic"] == 0) is x] for x in (True, False))
        assert sum(good) >= 0.98 * len(good) and (len(bad) < 10 or sum(bad) < sum(good) / len(good) * len(bad)), lang


URLS = ["http://a.net/x", "https://sub.EXAMPLE.net/en/1?q", "http://example.net/de", "http://x.org/fr/#t", "http://example.com/de/2", "http://net/", "http://anet/", "http://a.net", None, "no scheme", "x://y://z/net/", "http://user@h.org:80/fr/x"]


def test_hosts_paths_and_rules(spark):
    df = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)], "page_id bigint, url string")
    got = [(r["host"], r["path"], r["rule"], r["ruled"]) for r in urls.decided(df).orderBy("page_id").collect()]
    assert got[:6] == [
        ("a.net", "/x", "net/", "block"), ("sub.example.net", "/en/1", "example.net/en/", "allow"), ("example.net", "/de", "net/", "block"),
        ("x.org", "/fr/", "org/fr/", "allow"), ("example.com", "/de/2", "example.com/de/", "block"), ("net", "/", "net/", "block"),
    ]
    assert [g[2] for g in got[6:]] == [None] * 6 and got[8][:2] == got[9][:2] == ("", "") and got[10][:2] == ("y:", "//z/net/")


def some_urls():
    rnd = random.Random(8)
    good = [f"http://{prose(rnd, 1)}{prose(rnd, 1)}.com/en/{i}" for i in range(600)]
    bad = [f"http://{rnd.choice(['casino', 'pills', 'bets'])}-{rnd.choice(['win', 'now', 'xx'])}{i % 9}.com/en/{i}" for i in range(150)]
    return good + bad


def test_ratio_tells_spam_hosts_that_were_held_out(spark):
    df = spark.createDataFrame([*enumerate(some_urls()), (9999, None)], "page_id bigint, url string")
    rows = {r["page_id"]: r["verdict"] for r in urls.judge(df).collect()}
    assert len(rows) == 751 and rows[9999] == "allow"
    assert sum(rows[i] == "block" for i in range(600)) <= 15
    assert sum(rows[i] == "block" for i in range(600, 750)) >= 140


class WittenBell:
    def __init__(self, texts):
        self.counts = {n: Counter() for n in range(1, 6)}
        for t in texts:
            s = b"\x02" * 4 + t + b"\x03"
            for i in range(len(s) - 4):
                for n in range(1, 6):
                    self.counts[n][s[i : i + 5][-n:]] += 1
        self.by = {n: defaultdict(list) for n in self.counts}
        for n, c in self.counts.items():
            for g, k in c.items():
                self.by[n][g[:-1]].append(k)

    def p(self, gram):
        if not gram:
            return 1 / kneser_ney.UNITS
        own = self.by[len(gram)].get(gram[:-1])
        if not own:
            return self.p(gram[1:])
        return (self.counts[len(gram)][gram] + len(own) * self.p(gram[1:])) / (sum(own) + len(own))

    def log(self, text):
        s = b"\x02" * 4 + text + b"\x03"
        return sum(math.log(self.p(s[i : i + 5])) for i in range(len(text) + 1))


def test_whole_result_equals_models_by_dictionaries(spark):
    df = spark.createDataFrame([*enumerate(some_urls()), (None, "http://a.net/q"), (None, "http://a.net/q"), (3, None)], "page_id bigint, url string")
    rows = urls.scored(df).collect()
    train = lambda kind: [r["text"].encode() for r in rows if r["kind"] == kind and r["fold"] != 0]
    block, allow = WittenBell(train("block")), WittenBell(train("allow"))
    ratio = {r["text"]: (block.log(r["text"].encode()) - allow.log(r["text"].encode())) / (len(r["text"]) + 1) for r in rows}
    assert all(r["ratio"] == pytest.approx(ratio[r["text"]], abs=1e-4) for r in rows)
    held = sorted(ratio[r["text"]] for r in rows if r["kind"] == "allow" and r["fold"] == 0)
    threshold = max(0.0, held[math.ceil(0.95 * len(held)) - 1])
    got = urls.judge(df, quantile=0.95).collect()
    assert len(got) == len(rows) and got[0]["threshold"] == pytest.approx(threshold, abs=1e-4)
    for r in got:
        want = "block" if r["rule"] == "net/" or (r["host"] and r["ratio"] > r["threshold"]) else "allow"
        assert r["verdict"] == want
    labels = spark.createDataFrame([(f"http://{c * (3 + i % 3)}{i}.com/", kind) for i in range(40) for c, kind in (("a", "block"), ("z", "allow"))], "url string, kind string")
    own = {r["host"]: r["ratio"] for r in urls.judge(spark.createDataFrame([(1, "http://aaaa.com/"), (2, "http://zzzz.com/")], "page_id bigint, url string"), labelled=labels).collect()}
    assert own["aaaa.com"] > 0 > own["zzzz.com"]


def test_urls_bear_awkward_rows(spark):
    rows = [(1, "http://a.com/" + "x" * 100_000, "h"), (None, None, None), (2, "", ""), (2, "", ""), (3, "http://casino.com/", "h"), (4, "://", "h")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    clash = df.selectExpr("*", *(f"'x' as {c}" for c in ("host", "path", "rule", "ruled", "text", "kind", "fold", "model", "ratio", "verdict", "threshold", "_block")))
    for frame in (df, clash):
        got = urls.judge(frame).collect()
        assert sorted((r["page_id"] or 0) for r in got) == [0, 1, 2, 2, 3, 4] and all(r["verdict"] in ("allow", "block") for r in got)


def test_ratio_equals_plain_witten_bell(spark):
    texts = [b"abab", b"abba", b"b"]
    counts = {n: Counter() for n in range(1, 6)}
    for t in texts:
        s = b"\x02" * 4 + t + b"\x03"
        for i in range(len(s) - 4):
            for n in range(1, 6):
                counts[n][s[i : i + 5][-n:]] += 1
    levels = {n: (np.array([int.from_bytes(g) for g in c], np.uint64), np.array(list(c.values()))) for n, c in counts.items()}
    model = urls.Markov(levels, {})

    def p(gram):
        if not gram:
            return 1 / kneser_ney.UNITS
        own = {g: c for g, c in counts[len(gram)].items() if g[:-1] == gram[:-1]}
        if not own:
            return p(gram[1:])
        return (own.get(gram, 0) + len(own) * p(gram[1:])) / (sum(own.values()) + len(own))

    key, _ = kneser_ney.ngrams([b"abaz"])
    s = b"\x02" * 4 + b"abaz\x03"
    assert np.allclose(model.log_prob(key), [math.log(p(s[i : i + 5])) for i in range(5)], atol=1e-5)


def test_urls_without_training_are_allowed(spark):
    df = spark.createDataFrame([(1, "http://a.com/"), (2, "http://b.net/x")], "page_id bigint, url string")
    assert {r["page_id"]: r["verdict"] for r in urls.judge(df).collect()} == {1: "allow", 2: "block"}
    assert urls.judge(df.limit(0)).count() == 0
