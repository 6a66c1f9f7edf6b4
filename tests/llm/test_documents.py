"""Operators on documents: awkward rows, empty tables, brute force."""

import zlib
from collections import Counter

import edge
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer


from panelflow.llm import decontamination, jaccard_join, language_id, license_scan, packing, quality_rules, token_counts, units
from panelflow.llm.store import Store


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=edge.key)


def test_jaccard_join_equals_all_pairs(docs):
    got = rows(jaccard_join.near_duplicates(docs), "doc_id", "n_shingles", "component_id")
    assert got == sorted(edge.components(edge.rows()), key=edge.key)


def test_jaccard_join_of_large_family_and_passage(spark):
    import random

    rng = random.Random(9)
    base, passage = edge.prose(rng, 150).split(), edge.prose(rng, 60)
    data = []
    for k in range(160):  # copies with up to 14 changed words: many pairs under the threshold, one component
        w = list(base)
        for p in rng.sample(range(150), rng.randint(0, 7)):
            w[p] = f"new{k}x{p}"
        data.append((k, " ".join(w)))
    data += [(1000 + k, passage + " " + edge.prose(rng, rng.randint(40, 200))) for k in range(120)]
    data += [(2000 + k, passage + " " + edge.prose(rng, 12)) for k in range(40)]
    got = rows(jaccard_join.near_duplicates(spark.createDataFrame(data, "doc_id long, text string").repartition(4)), "doc_id", "n_shingles", "component_id")
    assert got == sorted(edge.components(data), key=edge.key)


def test_keep_one_keeps_columns_and_one_of_each(docs):
    out = jaccard_join.keep_one(docs)
    assert out.columns == docs.columns
    got = [tuple(r) for r in out.select("doc_id", "text").collect()]
    all_rows = edge.rows()
    comp = edge.components(all_rows)
    assert Counter(t for i, t in got if i is None) == Counter(r[1] for r in all_rows if r[0] is None)
    wordless = [r[0] for r, c in zip(all_rows, comp) if c[1] == 0 and r[0] is not None]
    assert Counter(i for i, t in got if i is not None and not edge.words(t)) == Counter(wordless)
    kept = Counter(i for i, t in got if i is not None and edge.words(t))
    # 8 has two different texts in two components; all others one row each
    assert set(kept) == {c[2] for r, c in zip(all_rows, comp) if c[1] and r[0] is not None}
    assert {i: n for i, n in kept.items() if n > 1} == {8: 1} or kept[8] in (1, 2)
    assert all(n == 1 for i, n in kept.items() if i != 8)


def test_empty_documents(none, spark):
    assert jaccard_join.near_duplicates(none).count() == 0
    assert jaccard_join.keep_one(none).count() == 0
    assert quality_rules.judge(none).count() == 0
    assert token_counts.count_tokens(none).count() == 0
    assert packing.pack(none).count() == 0
    assert license_scan.scan(none).count() == 0
    model = language_id.train(none)
    assert language_id.identify(none, model, ["doc_id"]).count() == 0
    assert language_id.filter_identified(none).count() == 0
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.leaks(none, bench).count() == 0
    assert decontamination.filter_leaks(none, bench).count() == 0


def statistics(text):
    text = text or ""
    ws = edge.words(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if edge.words(line):
            dup += line in seen
            seen.add(line)
    c = Counter(tuple(ws[i : i + 3]) for i in range(len(ws) - 2))
    covered = {i + k for i in range(len(ws) - 2) if c[tuple(ws[i : i + 3])] > 1 for k in range(3)}
    failed = len(ws) < 50 or 100 * len(covered) > 50 * len(ws)
    return len(ws), sum(map(len, ws)), sum(ch in "#*$%&|<>" for ch in text), dup, len(covered), failed


def test_quality_statistics_and_base_rules(docs, spark):
    extra = [("a b c a b c a b c",), ("x\nx\n\n x\nx ",), ("p q r s p q r",), ("# | <b> & $5 %*",), ("a b\x0bc\x0cd\re",), ("a\u00a0b \u3000 c",)]
    df = docs.select("text", "lang", "source").union(spark.createDataFrame(extra, "text string").select("text", F.lit("en"), F.lit(None)))
    out = quality_rules.judge(df).select("row.text", "s.n_words", "s.word_chars", "s.n_symbols", "s.n_dup_lines", "s.n_repeat_words", "base_failed", "kept").collect()
    assert len(out) == df.count()
    for r in out:
        assert tuple(r)[1:7] == statistics(r[0]), repr(r[0])[:80]
        assert not (r["base_failed"] and r["kept"])


def regular(cov, rows):
    return cov + np.diag(np.array(quality_rules.NOISE) + np.array(quality_rules.PRIOR) * quality_rules.LEAST / (quality_rules.LEAST + rows))


def least_determinant(x, starts, rng):
    """(log determinant, mean, covariance) by concentration steps from many random starts, over whole rows."""
    n = len(x)
    h, best = int(np.ceil(quality_rules.SUPPORT * n)), (np.inf, None, None)
    for _ in range(starts):
        some = x[rng.choice(n, quality_rules.D + 1, replace=False)]
        mean, cov = some.mean(axis=0), regular(np.cov(some.T, bias=True), n)
        for _ in range(60):
            d = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)
            near = x[np.argsort(d, kind="stable")[:h]]
            after = near.mean(axis=0), regular(quality_rules.CONSISTENCY * np.cov(near.T, bias=True), n)
            if np.allclose(after[0], mean) and np.allclose(after[1], cov):
                break
            mean, cov = after
        logdet = np.linalg.slogdet(cov)[1]
        if logdet < best[0]:
            best = logdet, mean, cov
    return best


def test_quality_estimate_has_the_least_determinant(spark):
    rng = np.random.default_rng(1)
    mix = rng.normal(size=(7, 7)) * 0.1
    clean = rng.normal(size=(400, 7)) @ mix
    off = rng.normal(size=(90, 7)) * 0.05 + 1.5  # one cluster of outliers, below the share that is left out
    x = np.vstack((clean, off))
    points = spark.createDataFrame([("a", "b", *map(float, r)) for r in x], "k_lang string, k_source string, " + ", ".join(f"x{i} double" for i in range(7)))
    r = quality_rules.estimates(points.repartition(5), Store(spark, "test")).collect()
    assert len(r) == 1 and r[0].rows == 490
    lower = np.zeros((7, 7))
    for i in range(7):
        for j in range(i + 1):
            lower[i, j] = r[0][f"l{i}_{j}"]
    mean = np.array([r[0][f"m{i}"] for i in range(7)])
    want, m, cov = least_determinant(x, 60, rng)
    assert np.linalg.slogdet(lower @ lower.T)[1] <= want + 0.1
    mine, theirs = (np.einsum("ij,jk,ik->i", x - a, np.linalg.inv(c), x - a) for a, c in ((mean, lower @ lower.T), (m, cov)))
    assert np.allclose(mine, theirs, rtol=0.25, atol=1.0)
    assert (mine[400:] > quality_rules.CUT).all() and (mine[:400] > quality_rules.CUT).mean() < 0.01


def test_consistency_factor_and_cut():
    z = np.sort((np.random.default_rng(0).normal(size=(200_000, 7)) ** 2).sum(axis=1))
    assert quality_rules.chi_square_quantile(0.99, 7) == pytest.approx(18.475, abs=1e-3)
    assert quality_rules.chi_square_quantile(0.75, 7) == pytest.approx(z[150_000], rel=0.01)
    central = z[:150_000].mean() / 7  # a central share has this share of the variance
    assert quality_rules.CONSISTENCY == pytest.approx(1 / central, rel=0.01)


def outlying(rng, kind, n=200):
    """Texts of one statistic that the group does not have."""
    words = [w.lower() for w in edge.prose(rng, n).split()]
    if kind == "symbols":
        words[5:35] = [w + "#" for w in words[5:35]]
    elif kind == "capitals":
        words[5:65] = [w.upper() for w in words[5:65]]
    elif kind == "marks":
        words[5:65] = [w + "..;" for w in words[5:65]]
    elif kind == "repeats":
        words[100:140] = words[:40]
    elif kind == "long":
        words = [w * 6 for w in words]
    text = " ".join(words)
    return text + "\n" + "\n".join(["so it goes"] * 16) if kind == "lines" else text


def test_quality_outliers_of_every_statistic_where_it_is_constant(spark):
    import random

    rng, rows = random.Random(7), []
    for kind in ("symbols", "capitals", "marks", "repeats", "lines", "long"):  # a language each
        rows += [(i, outlying(rng, None, rng.randint(120, 260)), kind, "s") for i in range(150)] + [(1000 + i, outlying(rng, kind), kind, "s") for i in range(8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    out = quality_rules.judge(df).select("row.doc_id", "row.lang", "base_failed", "kept").collect()
    assert not any(r.base_failed for r in out)
    assert [r.lang for r in out if r.doc_id >= 1000 and r.kept] == []
    assert sum(r.kept for r in out if r.doc_id < 1000) >= 6 * 150 - 3


def test_quality_of_small_groups_rests_on_wider_ones(spark):
    import random

    rng = random.Random(3)
    rows = [(i, outlying(rng, None, rng.randint(120, 260)), "en", f"s{i % 40}") for i in range(160)]  # sources of 4 rows
    rows += [(500 + i, outlying(rng, None, rng.randint(120, 260)), f"l{i}", "s") for i in range(20)]  # languages of one row
    rows += [(1000, outlying(rng, "symbols"), "en", "s1"), (1001, outlying(rng, "symbols"), "l3", "s"), (1002, outlying(rng, "symbols"), None, None)]
    out = quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).select("row.doc_id", "distance", "kept").collect()
    assert all(r.distance is not None for r in out)
    assert sorted(r.doc_id for r in out if not r.kept) == [1000, 1001, 1002]
    alone = quality_rules.judge(spark.createDataFrame(rows[:1], "doc_id long, text string, lang string, source string")).collect()
    assert alone[0].kept and alone[0].distance == pytest.approx(0)


def test_quality_filter_keeps_columns(docs):
    out = quality_rules.filter_quality(docs)
    assert out.columns == docs.columns
    assert out.where("text IS NULL").count() == 0


@pytest.mark.parametrize("file", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_units_give_the_library_ids(file, monkeypatch):
    library = Tokenizer.from_file(public_tokenizers.path(file))
    texts = [r[1] or "" for r in edge.rows()] + [
        "a  b\n c \t d ", " lead", "trail ", "don't it's 'tis we'll x'y", "a<|endoftext|> b <|endoftext|>c", "é e\u0301 ΑΣ ΑΣ. İ", "12 34a5", "\u00a0a \u00a0 b\u3000c",
        "a \u0301b", "\x1c a \x1c", "日本 語 テスト", "a\r\n b\x85 c", "😀 😀😀 x"]
    monkeypatch.setattr(units, "BATCH_BYTES", 100)
    monkeypatch.setattr(units.parts, "__defaults__", (100,))
    encoder = units.Encoder(file, most=200)
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert encoder.lengths(texts).tolist() == [len(w) for w in want]
    assert [x.tolist() for x in encoder.ids(texts)] == want


def test_token_counts(docs):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = [(r[0], len((r[1] or "").encode()), (n := len(library.encode(r[1] or "", add_special_tokens=False).ids)), n > 1024) for r in edge.rows()]
    assert rows(token_counts.count_tokens(docs), "doc_id", "n_bytes", "n_tokens", "over_limit") == sorted(want, key=edge.key)


def test_packing_is_whole_and_tight(docs):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    out = packing.pack(docs, with_ids=True).toPandas()
    want = Counter(tuple(library.encode(r[1] or "", add_special_tokens=False).ids) + (1,) for r in edge.rows())
    got, pieces = Counter(), {}
    for p in out.sort_values(["doc_id", "start"]).itertuples():
        assert p.ids_crc32 == zlib.crc32(np.array(p.ids, "<u4").tobytes()) and len(p.ids) == p.length
        if p.length == p.doc_tokens:
            got[tuple(p.ids)] += 1
        else:
            pieces.setdefault((p.doc_id, p.doc_tokens), {})[p.start] = tuple(p.ids)
    for (_, n), by_start in pieces.items():
        joined = sum((by_start[s] for s in sorted(by_start)), ())
        assert len(joined) == n
        got[joined] += 1
    assert got == want
    for _, s in out.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert s.length.sum() <= 2048 and s.offset.tolist() == (s.length.cumsum() - s.length).tolist()


def test_differencing_is_near_equal():
    import random

    rng = random.Random(1)
    sizes = [rng.randint(1, 500) for _ in range(400)]
    for k in (1, 7, 50):
        sets = packing.differencing(sizes, k)
        assert sorted(i for s in sets for i in s) == list(range(400)) and len(sets) == k
        sums = [sum(sizes[i] for i in s) for s in sets]
        assert max(sums) - min(sums) < 60
    assert packing.differencing([], 3) == [[], [], []]
    assert packing.windows([], 10) == []
    assert sorted(map(sorted, packing.windows([10, 10, 1], 10))) == [[0], [1], [2]]


def test_language_id(spark):
    import random

    rng = random.Random(3)
    data = [(i, edge.prose(rng, 60, "abcdefg" if i % 2 else "defghijk"), "aa" if i % 2 else "bb") for i in range(400)]
    data += [(1000, None, "aa"), (1001, "", "aa"), (1002, "12 ?!", "bb"), (None, "abab", "aa"), (1004, "ijk", None), (1005, "abc abc abc", None), (1005, "abc abc abc", None)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string").withColumn("score", F.lit("x")).repartition(3)
    model = language_id.train(df)
    out = language_id.identify(df.withColumn("held", language_id.held_out()), model, ["doc_id", "held", "lang"]).collect()
    assert len(out) == len(data)
    for r in out:
        if r.doc_id is None or r.doc_id < 1000:
            assert r.held == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        if r.doc_id in (1000, 1001, 1002):
            assert (r.lang_pred, r.score, r.rejected) == ("und", 0.0, True)
    known = [r for r in out if r.doc_id is not None and r.doc_id < 1000]
    assert np.mean([r.lang == r.lang_pred for r in known if r.held]) > 0.97
    assert {r.lang_pred for r in out if r.doc_id in (1004, 1005)} == {"aa", "bb"}
    assert all(0 <= r.score <= 1 for r in out)
    kept = language_id.filter_identified(df)
    assert kept.columns == df.columns and kept.where("doc_id in (1000, 1001, 1002)").count() == 0
    assert kept.where("doc_id < 1000").count() > 390


def test_language_models_hold_every_gram(spark):
    import random

    rng = random.Random(5)
    letters = "".join(chr(0x4E00 + i) for i in range(400))
    data = [(i, edge.prose(rng, 60, letters if i % 2 else letters[200:]), "aa" if i % 2 else "bb") for i in range(120)]
    data += [(500, None, "aa"), (None, "12", "bb"), (501, edge.prose(rng, 30, letters), None), (501, edge.prose(rng, 30, "xyz"), None)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string").repartition(3)
    held = language_id.train(df)
    tables = language_id.train(df, held=10)
    assert isinstance(held, language_id.Identifier) and isinstance(tables, language_id.Tables)
    for i, lang in enumerate(held.langs):  # whole tables: as many grams as the in-memory model of all rows
        assert [t.where(F.col("lang") == lang).count() for t in tables.parts] == [len(g) for g in held.models[i].grams]
    assert np.allclose(tables.limits.middle, held.middle) and np.allclose(tables.limits.limit, held.limit) and tables.limits.scale == held.scale
    key = lambda r: (str(r.doc_id), str(r.text))
    got = sorted(language_id.identify(df, tables, ["doc_id", "text"]).collect(), key=key)
    want = sorted(language_id.identify(df, held, ["doc_id", "text"]).collect(), key=key)
    assert len(got) == len(data)
    for a, b in zip(got, want):
        assert (a.doc_id, a.text, a.lang_pred, a.rejected) == (b.doc_id, b.text, b.lang_pred, b.rejected) and abs(a.score - b.score) < 1e-9
    kept = language_id.filter_identified(df, held=10)
    assert kept.columns == df.columns
    assert sorted(map(tuple, kept.collect()), key=edge.key) == sorted(map(tuple, language_id.filter_identified(df).collect()), key=edge.key)
    assert language_id.identify(df.limit(0), tables, ["doc_id"]).count() == 0


def test_language_rejection(spark):
    import random

    rng = random.Random(7)
    words = {x: [edge.prose(rng, 1, letters) for _ in range(150)] for x, letters in
             {"aa": "aeiklmnost", "bb": "aeioubdgrtn", "rare": "aehopqrsty", "none": "cvwxyzjfu"}.items()}
    text = lambda x, n=80: " ".join(rng.choice(words[x]) for _ in range(n))
    data = [(i, text("aa" if i % 2 else "bb", rng.choice((15, 80, 300))), "aa" if i % 2 else "bb") for i in range(1200)]
    data += [(2000 + i, text("rare"), "rare") for i in range(40)]
    data += [(3000 + i, text("none"), None) for i in range(20)]  # a language without rows
    data += [(4000 + i, "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(rng.choice((80, 400)))), None) for i in range(20)]
    data += [(5000 + i, "".join(rng.choice("aeiklmnost ") for _ in range(60)), None) for i in range(20)]  # of letters that were learned
    df = spark.createDataFrame(data, "doc_id long, text string, lang string").repartition(3)
    out = {r.doc_id: r for r in language_id.identify(df, language_id.train(df), ["doc_id"]).collect()}
    assert all(out[i].rejected for i in out if i >= 3000)
    assert sum(out[i].rejected for i in range(1200)) <= 12
    assert sum(out[2000 + i].rejected for i in range(40)) <= 2


def test_kneser_ney_sums_to_one():
    texts = ["abba cab", "bab acca", "cab"]
    g, n = np.unique(np.concatenate([language_id.grams(t) for t in texts]), return_counts=True)
    model = language_id.kneser_ney(g, n)
    letters = sorted({int(x) & 0xFFFF for x in g})
    for history in {int(x) >> 16 for x in g} | {(ord("z") << 32) | (ord("q") << 16) | ord("a")}:
        packed = np.array([(history << 16) | c for c in letters], np.uint64)
        total = model.probability(packed).sum()
        unseen = model.probability(np.array([(history << 16) | 0x7A], np.uint64))[0]  # stands for every character not met
        assert abs(total + unseen - 1) < 1e-9


def test_decontamination(spark):
    import random

    rng = random.Random(8)
    items = [(i, edge.prose(rng, n)) for i, n in enumerate([40, 25, 12, 8, 5, 3])] + [(90, None), (91, ""), (None, edge.prose(rng, 30))]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    near = items[0][1].split()
    near[5] = near[17] = near[29] = "other"
    data = [(i, edge.prose(rng, 50) + " " + (t or "") + ". " + edge.prose(rng, 50)) for i, t in items]
    data += [(50, "pre " + " ".join(near).upper() + ", post"), (51, " ".join(near[:9])), (52, edge.prose(rng, 400)), (53, None), (54, ""), (0, data[0][1]),
             (55, " ".join(items[1][1].split()[5:22])), (56, items[0][1] + " " + items[1][1])]
    df = spark.createDataFrame(data, "doc_id long, text string").withColumns({"item_id": F.lit(7), "h": F.lit(1)}).repartition(3)
    got = {(r.doc_id, r.item_id) for r in decontamination.leaks(df, bench).collect()}
    assert got == {(0, 0), (1, 1), (2, 2), (3, 3), (4, 4), (None, None), (50, 0), (55, 1), (56, 0), (56, 1)}
    kept = decontamination.filter_leaks(df, bench)
    assert kept.columns == df.columns
    assert sorted(edge.key((r.doc_id,)) for r in kept.collect()) == sorted(edge.key((i,)) for i in (5, 90, 91, 51, 52, 53, 54))


def test_license_scan(spark):
    mit = license_scan.TEMPLATES["MIT"][1]
    w = mit.split()
    data = [(1, "x y. " + mit + " z"), (2, "All rights reserved. foo bar all RIGHTS reserved"), (3, " ".join(w[:20] + ["new"] + w[22:])), (4, None), (5, ""),
            (6, "rights are all reserved"), (7, ("word " * 30_000) + "Released under the MIT License."), (1, "Licensed under CC BY-NC 4.0"), (None, "Licensed under CC BY-NC 4.0")]
    df = spark.createDataFrame(data, "doc_id long, text string").withColumn("license", F.lit("x"))
    out = sorted(((r.doc_id, r.license, round(r.coverage, 2)) for r in license_scan.scan(df).collect()), key=edge.key)
    assert out == sorted([(1, "MIT", 1.0), (2, "all-rights-reserved", 1.0), (2, "all-rights-reserved", 1.0), (3, "MIT", 0.98), (7, "MIT", 1.0), (1, "CC-BY-NC-4.0", 1.0),
                          (None, "CC-BY-NC-4.0", 1.0)], key=edge.key)


def test_license_scan_without_the_longest_words():
    import random

    rng = random.Random(12)
    known = [license_scan.Template(name, t) for name, ts in license_scan.TEMPLATES.items() for t in ts]
    cut = lambda text, *parts: [text := text.replace(p, "") for p in parts][-1]
    apache, mit, gpl = (license_scan.TEMPLATES[x][1] for x in ("Apache-2.0", "MIT", "GPL-3.0"))
    cases = [("GPL-3.0", 35, cut(gpl, "as published by the Free Software Foundation, ")),
             ("MIT", 78, cut(mit, 'and associated documentation files (the "Software"), ', "without restriction, including ")),
             ("Apache-2.0", 72, cut(apache, " See the License for the specific language governing permissions and limitations under the License."))]
    for name, least, text in cases:
        found = license_scan.finds(edge.prose(rng, 300) + ". " + text + " " + edge.prose(rng, 300), known)
        assert any(x[0] == name and x[4] >= least for x in found), (name, found)
        twice = license_scan.finds(text + " " + edge.prose(rng, 60) + " " + text, known)
        assert sum(x[0] == name and x[4] >= least for x in twice) == 2, (name, twice)
    # any words that the coverage lets go, anywhere
    for t in known:
        spare = len(t.words) - -(-len(t.words) * 4 // 5)
        longest = sorted(range(len(t.words)), key=lambda i: -len(t.words[i]))[:spare]
        for gone in [longest, *[rng.sample(range(len(t.words)), spare) for _ in range(10)]]:
            w = [x for i, x in enumerate(t.words) if i not in gone]
            found = license_scan.finds(edge.prose(rng, 50) + " " + " ".join(w) + " " + edge.prose(rng, 50), [t])
            assert [x[4] for x in found] == [len(w)], (t.license, w, found)


def test_patience_is_increasing_and_exact():
    assert license_scan.patience(list("abcde"), list("xaybzcd")) == [(0, 1), (1, 3), (2, 5), (3, 6)]
    assert license_scan.patience(list("aab"), list("aab")) == [(0, 0), (1, 1), (2, 2)]
    assert license_scan.patience([], ["a"]) == [] and license_scan.patience(["a"], []) == []
    assert license_scan.increasing([3, 1, 2, 5, 4]) in ([1, 2, 3], [1, 2, 4])


def plain_kneser_ney(texts):
    """A function (context and character, as a string) -> probability, from dictionaries."""
    counts = {4: Counter()}
    for t in texts:
        counts[4].update(t[i : i + 4] for i in range(len(t) - 3))
    for k in (3, 2, 1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])

    def p(gram):
        k = len(gram)
        if k == 0:
            return 1 / (len(counts[1]) + 1)
        own = {g: n for g, n in counts[k].items() if g[:-1] == gram[:-1]}
        total = sum(own.values())
        lower = p(gram[1:])
        if not total:
            return lower
        return max(own.get(gram, 0) - 0.75, 0) / total + sum(min(n, 0.75) for n in own.values()) / total * lower

    return p


def plain_letters(text):
    out = "   "
    for c in text.lower():
        if c.isalpha():
            out += c
        elif out[-1] != " ":
            out += " "
    return out


def test_language_models_equal_dictionaries():
    import random

    rng = random.Random(17)
    texts = ["".join(rng.choice("abcé ,ß\U00010400\u65e5") for _ in range(rng.randint(5, 120))) + "a" for _ in range(12)]
    told = [plain_letters(t.lstrip(" ,")) for t in texts]
    g, n = np.unique(np.concatenate([language_id.grams(t.lstrip(" ,")) for t in texts]), return_counts=True)
    model, p = language_id.kneser_ney(g, n), plain_kneser_ney(told)
    for t in [*texts[:4], "zzz abc a", "x", "\U00010400\U00010401 b"]:
        t = t.lstrip(" ,")
        line = plain_letters(t)
        want = [p(line[i : i + 4]) for i in range(len(line) - 3)]
        assert np.allclose(model.probability(language_id.grams(t)), want, rtol=1e-12), t
    # probabilities of all characters after a context sum to one less the unseen share
    assert len({tuple(language_id.grams(c)) for c in "\U00010400\uF400\u0400"}) == 3


def test_packing_pads_little(spark):
    import random

    rng = random.Random(6)
    df = spark.createDataFrame([(i, edge.prose(rng, rng.choice([3, 40, 150, 400]))) for i in range(500)], "doc_id long, text string").coalesce(1)
    pieces = packing.pack(df).collect()
    filled: dict = {}
    for r in pieces:
        filled[r.sequence_id] = filled.get(r.sequence_id, 0) + r.length
    assert max(filled.values()) <= packing.CAPACITY
    assert sum(filled.values()) >= 0.97 * packing.CAPACITY * (len(filled) - 1)
