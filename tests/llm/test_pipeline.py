"""The pipeline's stages on awkward and planted rows, each on what the last one kept."""

import random

import corpus_pipeline
import edge
import pytest
from pyspark.sql import functions as F

from panelflow.llm import decontamination
from panelflow.llm.store import Store

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def planted(rng):
    """(rows, passage): clean texts of two languages, copies, a leak, short ones and noise."""
    rows, passage = [], edge.prose(rng, 30, "abcdef")
    for i in range(140):
        lang = "aa" if i % 2 else "bb"
        rows.append((i, edge.prose(rng, rng.randint(70, 160), "abcdef" if i % 2 else "ghijkl"), lang, f"s{i % 2}"))
    base = rows[11][1]
    rows += [(1000 + k, base if k < 3 else base + f" word{k}", "aa", "s1") for k in range(6)]
    rows += [(2000 + k, edge.prose(rng, 60, "abcdef") + " " + passage + " " + edge.prose(rng, 60, "abcdef"), "aa", "s1") for k in range(3)]
    rows += [(3000, "too short", "aa", "s1"), (3001, None, "aa", None), (3002, "", None, "s1"), (3003, "12345 " * 80, "aa", "s1"), (None, rows[4][1], "bb", "s0")]
    return [(*r, len(r[1] or "")) for r in rows], passage


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rows, passage = planted(random.Random(31))
    at = tmp_path_factory.mktemp("pipeline")
    spark.createDataFrame(rows, COLUMNS).repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(1, passage), (2, None)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at)


def test_stages_take_effect_one_after_the_other(spark, folder):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "quality_rules", "ngram_jaccard_join", "benchmark_decontamination", "packing"]
    docs, store, kept = spark.read.parquet(f"{folder}/documents.parquet"), Store(spark, "test"), {}
    schema = docs.schema
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = store.keep(stage(spark, docs, folder), name)
        assert docs.schema.simpleString() == schema.simpleString()
        kept[name] = {r.doc_id for r in docs.select("doc_id").collect()}
    clean = set(range(140)) - {11}
    assert not kept["language_id"] & {3001, 3002, 3003}  # no letters
    assert not kept["quality_rules"] & {3000} and len(kept["quality_rules"] & clean) >= 0.95 * len(kept["language_id"] & clean)
    copies = {11, *range(1000, 1006)}
    assert len(kept["ngram_jaccard_join"] & copies) == 1 and kept["ngram_jaccard_join"] >= kept["quality_rules"] - copies
    assert {2000, 2001, 2002} <= kept["quality_rules"] and not kept["benchmark_decontamination"] & {2000, 2001, 2002}
    assert kept["benchmark_decontamination"] == kept["ngram_jaccard_join"] - {2000, 2001, 2002}
    pieces = corpus_pipeline.run(spark, folder).collect()
    assert {p.doc_id for p in pieces} == kept["benchmark_decontamination"]
    for doc in {p.doc_id for p in pieces} - {None}:
        own = sorted((p.start, p.length) for p in pieces if p.doc_id == doc)
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:]))


def test_stages_of_empty_tables(spark, folder):
    none = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, folder).count() == 0, name


def diagonals(doc, item):
    """(matched, compared) of the best place by trying every window of every mask on every diagonal."""
    best = None
    masks = [m for m in decontamination.MASKS if len(item) >= len(m)] or (["1" * len(item)] if len(item) >= decontamination.LEAST_WORDS else [])
    for mask in masks:
        for i in range(len(item) - len(mask) + 1):
            for d in range(len(doc) - len(mask) + 1):
                if all(doc[d + k] == item[i + k] for k, c in enumerate(mask) if c == "1"):
                    a = max(0, i - decontamination.AROUND, i - d)
                    b = min(len(item), i + len(mask) + decontamination.AROUND, len(doc) + i - d)
                    same = sum(item[k] == doc[k + d - i] for k in range(a, b))
                    if 100 * same >= decontamination.PERCENT * (b - a):
                        best = max(best or (0, 0), (same, b - a))
    return best


def test_decontamination_equals_all_diagonals(spark):
    rng = random.Random(14)
    items = [(i, [rng.choice("abcdefghij") + rng.choice("xyz") for _ in range(n)]) for i, n in enumerate([3, 5, 6, 9, 10, 11, 12, 20, 40, 40])]
    docs = []
    for k in range(400):
        words = [rng.choice("abcdefghij") + rng.choice("xyz") for _ in range(rng.randint(0, 40))]
        item = rng.choice(items)[1]
        a = rng.randrange(len(item))
        part = list(item[a : a + rng.randint(8, 40)])
        for _ in range(rng.randint(0, 2)):  # substitutions
            part[rng.randrange(len(part))] = "other"
        at = rng.randint(0, len(words))
        docs.append((k, words[:at] + part + words[at:]))
    df = spark.createDataFrame([(i, " ".join(w), "clash") for i, w in docs], "doc_id long, text string, item_id string").repartition(3)
    bench = spark.createDataFrame([(i, ", ".join(w).upper()) for i, w in items], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.matched, r.compared) for r in decontamination.leaks(df, bench).collect()}
    want = {(d, i): best for d, w in docs for i, item in items if (best := diagonals(w, item))}
    assert len(want) > 25 and got == want


def test_decontamination_with_shuffled_seeds(spark, monkeypatch):
    rng = random.Random(2)
    passage = edge.prose(rng, 25)
    docs = spark.createDataFrame([(i, edge.prose(rng, 40) + (" " + passage if i % 4 == 0 else "")) for i in range(40)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, passage)], "item_id long, text string")
    small = sorted(map(tuple, decontamination.leaks(docs, bench).collect()))
    monkeypatch.setattr(decontamination, "SMALL_ROWS", 0)
    monkeypatch.setattr(decontamination, "SMALL_BYTES", 0)
    assert sorted(map(tuple, decontamination.leaks(docs, bench).collect())) == small and len(small) == 10
    assert decontamination.filter_leaks(docs, bench).where(F.col("doc_id") % 4 == 0).count() == 0


def plan_of(df):
    text = df._jdf.queryExecution().toString()
    return text[text.index("== Physical Plan =="):]


def test_decontamination_joins_large_tables_by_sort(spark, monkeypatch):
    """Rows beyond the bound are not broadcast, however small Spark holds their files to be."""
    rng = random.Random(5)
    passage = edge.prose(rng, 25)
    docs = spark.createDataFrame([(i, edge.prose(rng, 40) + " " + passage) for i in range(20)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, passage)], "item_id long, text string")
    monkeypatch.setattr(decontamination, "SMALL_ROWS", 0)
    monkeypatch.setattr(decontamination, "SMALL_BYTES", 0)
    found = decontamination.leaks(docs, bench)
    assert found.count() == 20 and "Broadcast" not in plan_of(found)
    assert "Broadcast" not in plan_of(decontamination.filter_leaks(docs, bench))


def test_decontamination_of_a_long_document_full_of_passages(spark):
    """Some 24,000 hits in one document of 20,000 words: with the whole document at each, they do not fit."""
    words = [f"w{i}x" for i in range(25)]
    docs = spark.createDataFrame([(1, " ".join(words * 800)), (2, " ".join(words))], "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    got = sorted((r.doc_id, r.n_places, r.matched, r.compared) for r in decontamination.leaks(docs, bench).collect())
    assert got == [(1, 800, 19, 19), (2, 1, 19, 19)]


def test_decontamination_across_blocks(spark, monkeypatch):
    """Passages around the ends of blocks, on documents of any length; repeated rows and null ids are one document."""
    monkeypatch.setattr(decontamination, "BLOCK", 7)
    rng = random.Random(21)
    items = [(i, [rng.choice("abcdefgh") + rng.choice("xyz") for _ in range(n)]) for i, n in enumerate([5, 8, 11, 14, 30])]
    docs = []
    for k in range(400):
        words = [rng.choice("abcdefgh") + rng.choice("xyz") for _ in range(rng.randint(0, 30))]
        item = rng.choice(items)[1]
        a = rng.randrange(len(item))
        part = list(item[a : a + rng.randint(8, 30)])
        part[rng.randrange(len(part))] = "other"
        docs.append((k if k else None, words + part + words[: rng.randint(0, 20)]))
    rows = [(i, " ".join(w)) for i, w in docs]
    df = spark.createDataFrame(rows + rows[:30], "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    got = [((r.doc_id, r.item_id), (r.matched, r.compared)) for r in decontamination.leaks(df, bench).collect()]
    want = {(d, i): best for d, w in docs for i, item in items if (best := diagonals(w, item))}
    assert len(want) > 25 and len(got) == len(want) and dict(got) == want
