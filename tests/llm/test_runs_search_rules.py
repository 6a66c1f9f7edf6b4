"""Rule ensemble, reversed search and periodic runs against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import edge
import numpy as np
import pytest
from pyspark.sql import functions as F

from panelflow.llm import periodic_runs, queries, repair, reversed_search, rule_ensemble
from panelflow.llm.store import Store

# ---------------------------------------------------------------- periodic runs


def all_runs(seq, least=24, times=3):
    """Runs by trying every period at every place."""
    found = {}
    for q in range(1, len(seq) // times + 1):
        i = 0
        while i < len(seq) - q:
            j = i
            while j < len(seq) - q and seq[j] == seq[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, times * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted(((s, e, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def repetitive(rng):
    seq = []
    for _ in range(rng.randint(1, 7)):
        unit = [rng.randrange(rng.choice([1, 2, 3, 60])) for _ in range(rng.randint(1, 24))]
        seq += unit * rng.choice([1, 1, 2, 3, 4, 9]) + unit[: rng.randint(0, len(unit))]
        if rng.random() < 0.3:
            seq += seq[-rng.randint(1, len(seq)) :] * rng.randint(1, 3)
        if len(seq) > 500:
            break
    return seq[:700]


def test_runs_equal_all_periods_at_all_places():
    rng = random.Random(11)
    n = 0
    for _ in range(400):
        seq = repetitive(rng)
        expected = all_runs(seq)
        assert periodic_runs.find_runs(np.array(seq, np.int64)) == expected
        n += len(expected)
    assert n > 500


@pytest.mark.parametrize("seq", [[], [0], [0] * 23, [0] * 24, [0] * 5000, list(range(8)) * 3, (list(range(9)) * 3)[:26], [0, 1] * 12 + [0], list(range(500)) * 4])
def test_runs_at_the_limits(seq):
    assert periodic_runs.find_runs(np.array(seq, np.int64)) == all_runs(seq)


def test_grammar_derives_its_input_and_leaves_no_pair_twice():
    rng = random.Random(3)
    for _ in range(200):
        seq = repetitive(rng)
        g = repair.compress(np.array(seq, np.int64), max(seq) + 1)

        def derive(s):
            if s < g.terminals:
                return [s]
            left, right = g.rules[s - g.terminals]
            return derive(left) + derive(right)

        assert [t for s in g.sequence for t in derive(s)] == seq
        sizes = [len(derive(s)) for s in g.sequence]
        assert g.starts == [sum(sizes[:i]) for i in range(len(sizes))]
        last, pairs = {}, Counter()
        for i, pair in enumerate(zip(g.sequence, g.sequence[1:])):
            if last.get(pair) != i - 1 or pair[0] != pair[1]:
                pairs[pair] += 1
                last[pair] = i
        assert max(pairs.values(), default=1) == 1


def told_runs(doc_id, text):
    """A row of the query, from words to digests."""
    words = edge.words(text)
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    names = {w: i for i, w in enumerate(dict.fromkeys(words))}
    runs = all_runs([names[w] for w in words])
    gone = {i for s, e, q in runs for i in range(s + q, e)}
    best = min(runs, key=lambda r: (-Fraction(r[1] - r[0], r[2]), r[0], r[2]), default=None)
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    told = "".join(f"{s},{e - s},{q}\n" for s, e, q in runs)
    first = (best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *first, hashlib.sha256(told.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def test_runs_query_equals_plain_version(spark, tmp_path):
    rng = random.Random(8)
    data = [(i, t) for i, t, *_ in edge.rows() if len(t or "") < 40_000]
    for k in range(120):
        w = edge.prose(rng, rng.randint(3, 160), "abc").split()
        if k % 3 == 0:
            at, q = rng.randrange(len(w)), rng.randint(1, 12)
            w[at:at] = w[at : at + q] * rng.randint(2, 30)
        data.append((1000 + k, rng.choice([" ", "\n", "\t "]).join(w)))
    spark.createDataFrame([(*r, "x") for r in data], "doc_id long, text string, runs string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    out = queries.QUERIES["op13_periodic_runs"](spark, str(tmp_path))
    assert out.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    got = sorted(map(tuple, out.collect()), key=edge.key)
    assert got == sorted((told_runs(*r) for r in data), key=edge.key)
    assert sum(r[1] for r in got) > 40


def test_runs_of_awkward_rows(docs, none):
    out = periodic_runs.periodic_runs(docs)
    assert out.columns == ["doc_id", "n_words", "runs", "collapsed"] and out.count() == docs.count()
    assert out.where("collapsed IS NULL OR runs IS NULL").count() == 0
    assert periodic_runs.periodic_runs(none).count() == 0
    with pytest.raises(ValueError, match="24 words"):
        periodic_runs.find_runs(np.zeros(30, np.int64), least=10)


# -------------------------------------------------------------- reversed search

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def ranked(docs, items, k=20):
    """(item, rank, doc, score) by scoring every document for every item."""
    told = [(i, Counter(TERM.findall(edge.lower(t)))) for i, t in docs]
    n, total = sum(bool(c) for _, c in told), sum(c.total() for _, c in told)
    df = Counter(t for _, c in told for t in c)
    out = []
    for item, text in items:
        terms = Counter(TERM.findall(edge.lower(text)))
        scored = []
        for doc, c in told:
            m = 75 + (25 * c.total() * n) // total if total else 0
            score = sum(
                times * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 12 * m))
                for t, times in terms.items() if t in c)
            if score > 0:
                scored.append((-score, doc is None, doc or 0))
        out += [(item, r, None if gone else doc, -score) for r, (score, gone, doc) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=edge.key)


def searched(docs, items, **options):
    return sorted((tuple(r) for r in reversed_search.search(docs, items, **options).collect()), key=edge.key)


@pytest.fixture(scope="module")
def bench(spark):
    rng = random.Random(6)
    texts = [None, "", " .,!", edge.rows()[8][1][:200], "one two TWO two", "tail Ünïcode 日本 123", edge.prose(rng, 40), "one two TWO two", "zzzz not there",
             *(edge.prose(rng, 30, "abcdefgh") for _ in range(6)), edge.rows()[14][1]]
    rows = [(i if i != 9 else None, t, "clash", 1) for i, t in enumerate(texts)] + [(4, "one two TWO two", "clash", 1)]
    return spark.createDataFrame(rows, "item_id long, text string, doc_id string, rank int")


def test_search_equals_scoring_all_pairs(docs, bench, monkeypatch):
    expected = ranked([(r[0], r[1]) for r in edge.rows()], [(r.item_id, r.text) for r in bench.collect()])
    assert searched(docs, bench) == expected
    monkeypatch.setattr(reversed_search, "BLOCK_BYTES", 300)  # many passes
    monkeypatch.setattr(reversed_search, "CELLS", 40)  # many blocks of documents
    assert searched(docs, bench) == expected


def test_search_with_sums_beyond_doubles(docs, spark):
    items = spark.createDataFrame([(1, "one " * 400_000 + "two"), (2, "one two")], "item_id long, text string")
    assert searched(docs, items) == ranked([(r[0], r[1]) for r in edge.rows()], [(r.item_id, r.text) for r in items.collect()])


def test_search_of_empty_tables(docs, none, bench):
    assert searched(none, bench) == [] and searched(docs, bench.limit(0)) == []
    assert reversed_search.search(docs, bench.limit(0)).columns == ["item_id", "rank", "doc_id", "score"]


# --------------------------------------------------------------- rule ensemble


def labelled_texts(rng, n):
    """Prose (label 1) and three kinds of junk (label 0)."""
    out = []
    for i in range(n):
        words = edge.prose(rng, rng.randint(8, 80)).split()
        kind = rng.choice(["prose", "prose", "prose", "shout", "symbols", "stutter"])
        if kind == "shout":
            words = [w.upper() + "!!" for w in words]
        elif kind == "symbols":
            words = [w + rng.choice(["###", "$$$", "%%%"]) for w in words]
        elif kind == "stutter":
            words = [w for w in words for _ in range(rng.randint(3, 6))]
        out.append((i, " ".join(words) + ".", int(kind == "prose")))
    return out


@pytest.fixture(scope="module")
def rated(spark):
    rows = labelled_texts(random.Random(2), 900)
    frame = spark.createDataFrame([(i, t, y, "d", 0.5) for i, t, y in rows], "doc_id long, text string, quality int, lang string, score double").repartition(4)
    return frame.drop("quality"), frame.select("doc_id", "quality", F.lit(0).alias("toxic"))


def test_rules_tell_unseen_rows_apart(rated):
    docs, labels = rated
    seen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0
    out = rule_ensemble.classify(docs, labels, allowed=seen)
    assert out.columns == ["doc_id", "score", "predicted"]
    rows = out.join(labels, "doc_id").where(~seen).collect()
    assert len(rows) > 120
    assert sum((r.score >= 0.5) == (r.quality == 1) for r in rows) >= 0.95 * len(rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)


def test_rules_are_sparse_and_compiled_as_they_read(spark, rated):
    docs, labels = rated
    store = Store(spark, "test")
    found = store.keep(rule_ensemble.with_statistics(docs, ["doc_id"]))
    model = rule_ensemble.train(found, labels, "quality", store)
    assert 0 < len(model.rules) < 100 and len({r for r, _ in model.rules}) == len(model.rules)
    for row in found.select("*", model.score().alias("s")).limit(50).collect():
        odds = model.intercept
        for rule, weight in model.rules:
            odds += weight * all(low < row[name] <= high for name, low, high in rule.bounds)
        assert row["s"] == pytest.approx(1 / (1 + math.exp(-odds)), abs=1e-12)


def test_labels_that_are_not_allowed_change_nothing(rated):
    docs, labels = rated
    seen = F.col("doc_id") % 2 == 0
    turned = labels.withColumn("quality", F.when(seen, F.col("quality")).otherwise(1 - F.col("quality")))
    a, b = (sorted(map(tuple, rule_ensemble.classify(docs, x, allowed=seen).collect())) for x in (labels, turned))
    assert a == b


def test_classifier_of_awkward_rows_and_one_kind_of_label(docs, none, rated):
    _, labels = rated
    out = rule_ensemble.classify(docs, labels)
    assert out.count() == docs.count() and out.where("score IS NULL OR isnan(score)").count() == 0
    only = labels.sparkSession.createDataFrame([(200 + i, 1) for i in range(6)], "doc_id long, quality int")
    same = {r.score for r in rule_ensemble.classify(docs, only).collect()}
    assert len(same) == 1 and same.pop() == pytest.approx(7 / 8)
    assert {r.score for r in rule_ensemble.classify(docs, labels.limit(0)).collect()} == {0.5}
    assert rule_ensemble.classify(none, labels).count() == 0
    assert rule_ensemble.statistics(b" \n") == [0.0] * len(rule_ensemble.FEATURES)
