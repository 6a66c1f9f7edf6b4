"""Label normalisation and identity rules on written-out cases."""

import unicodedata
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from panelflow.functions import similarity, text


def values(spark, items, *columns):
    df = spark.createDataFrame([(i, *(x if isinstance(x, tuple) else (x,))) for i, x in enumerate(items)],
                               "i int, a string" + (", b string" if isinstance(items[0], tuple) else ""))
    return [tuple(r) for r in df.select("i", *columns).orderBy("i").drop("i").collect()]


SAME = [
    ("MANDUCA", "MANDUCA GASTROBAR", True),
    ("BIEN TIRADA", "BIENTIRADA", True),
    ("CASA RAMIRO", "CASA REMIRO", True),
    ("UP DOG", "UPDOG", True),
    ("PELUQUERIA", "LA TIENDA DE ANA", True),
    ("ZARA", "MANGO", False),
    ("CASA PEPE", "MERCERIA ROSARIO", False),
    ("ZARA", "SIN ACTIVIDAD", True),
    ("ZARA", "ZARA", True),
]


def test_identity_cases(spark):
    df = spark.createDataFrame(SAME, "a string, b string, expected boolean")
    out = similarity.with_same_business(df, "a", "b").where("same <> expected").collect()
    assert out == []


def _reference_ratio_rule(a, b):
    """The rule written a second time, straight on Python strings."""
    def core(n):
        return {w for w in n.split() if w not in text.GENERIC_WORDS and not w.isdigit() and len(w) > 1}

    ca, cb = core(a), core(b)
    r = lambda x, y: SequenceMatcher(None, x, y).ratio()
    if a == b or not ca or not cb or ca <= cb or cb <= ca:
        return True
    if r("".join(sorted(ca)), "".join(sorted(cb))) >= 0.9 or r(a.replace(" ", ""), b.replace(" ", "")) >= 0.9:
        return True
    near = sum(any(r(x, y) >= 0.82 for y in cb) for x in ca)
    return near / min(len(ca), len(cb)) >= 0.6


def test_identity_against_plain_python(spark):
    words = ["ALFA", "ALFAA", "BETA", "BAR", "GAMMA", "GAMA", "DELTA", "12", "BETTA"]
    labels = [" ".join(p) for p in zip(words, words[2:] + words[:2])] + words
    cases = [(a, b) for a in labels for b in labels]
    df = spark.createDataFrame(cases, "a string, b string")
    got = {(r.a, r.b): r.same for r in similarity.with_same_business(df, "a", "b").collect()}
    wrong = [(k, v) for k, v in got.items() if v != _reference_ratio_rule(*k)]
    assert wrong == []


def test_exact_only_never_says_same_where_fuzzy_says_different(spark):
    df = spark.createDataFrame([(a, b) for a, b, _ in SAME], "a string, b string")
    exact = similarity.with_same_business(df, "a", "b", "e", fuzzy=False)
    both = similarity.with_same_business(exact, "a", "b", "f")
    assert both.where("e and not f").count() == 0


def test_needed_limits_the_verdict(spark):
    df = spark.createDataFrame([("AMA BOL", "CIR DUX", True), ("AMA BOL", "CIR DUX", False)], "a string, b string, n boolean")
    rows = similarity.with_same_business(df, "a", "b", needed=F.col("n")).orderBy("n").collect()
    assert rows[0].same is None and rows[1].same is False


def test_ratio_depends_on_order(spark):
    got = values(spark, [("tide", "diet"), ("diet", "tide")], similarity.ratcliff_ratio("a", "b"))
    assert got == [(SequenceMatcher(None, "tide", "diet").ratio(),), (SequenceMatcher(None, "diet", "tide").ratio(),)]
    assert got[0] != got[1]


def test_normalise(spark):
    cases = {
        "Cafetería  El Rincón, S.L.": "CAFETERIA EL RINCON",
        "EDUCACI0N V1AJES": "EDUCACION VIAJES",
        "PUESTO 44": "PUESTO 44",
        "Mª JOSÉ": "Ma JOSE",
        "  D'Ángelo-Bar ": "D ANGELO BAR",
        "Straße": "STRASSE",
        "ACME S A U": "ACME",
        "": "",
    }
    got = values(spark, list(cases), text.normalise("a"), text.normalise_exact("a"))
    assert [g[0] for g in got] == list(cases.values())
    assert [g[1] for g in got] == list(cases.values())
    assert values(spark, [None, "x"], text.normalise("a"))[0] == ("",)


def test_fix_digits_token_by_token(spark):
    import itertools

    tokens = ["".join(t) for n in (1, 2, 3, 4) for t in itertools.product("01A2", repeat=n)]
    lines = tokens + [" ".join(p) for p in zip(tokens, tokens[7:], tokens[31:])]
    want = [" ".join(w.replace("0", "O").replace("1", "I") if "A" in w else w for w in s.split(" ")) for s in lines]
    assert [g[0] for g in values(spark, lines, text.fix_digits(F.col("a")))] == want


def test_fold_table_matches_unicode(spark):
    def plain(ch):
        return "".join(c for c in unicodedata.normalize("NFKD", ch.upper()) if not unicodedata.combining(c))

    # letters that decompose to several letters are for normalise_exact
    chars = [chr(c) for c in range(0xC0, 0x180) if len(plain(chr(c))) == 1]
    got = values(spark, chars, text.fold("a"))
    for ch, (g,) in zip(chars, got):
        assert g == plain(ch).strip(), (ch, g)


@pytest.mark.parametrize("norm,expected", [
    ("ROTULO NO INFORMADO", True), ("", True), ("SIN ROTULO FRUTERIA", True), ("ROTULO OPACO", True), ("S R", True),
    ("SIN DETERMINAR", True), ("SIN MAS PIOJITOS", False), ("SIN BARRERAS", False), ("CASA PEPE", False),
])
def test_placeholders(spark, norm, expected):
    assert values(spark, [norm], text.is_placeholder("a"))[0][0] is expected


def test_core_tokens(spark):
    got = values(spark, ["BAR CAFETERIA", "FARMACIA LOPEZ", "A B 12 LOPEZ LOPEZ", ""], text.core_key("a"), text.is_generic("a"))
    assert got == [("", True), ("LOPEZ", False), ("LOPEZ", False), ("", True)]
    extra = text.core_key("a", ["LOPEZ"])
    assert values(spark, ["FARMACIA LOPEZ RUIZ"], extra) == [("RUIZ",)]


def test_large_vocabulary_is_a_join(spark, monkeypatch):
    v = spark.createDataFrame([("UNO",), ("DOS",), ("UNO",)], "word string")
    assert text.vocabulary_words(v) == ["DOS", "UNO"]
    labels = ["UNO TRES", "FARMACIA UNO", "TRES TRES AB", "", None, "UNO TRES"]
    df = spark.createDataFrame([(x,) for x in labels], "a string")
    got = text.with_core_tokens(df, "a", v)
    small = df.select("a", F.coalesce(F.sort_array(text.core_tokens("a", text.vocabulary_words(v))), F.array().cast("array<string>")).alias("core"))
    key = lambda r: (r[0] or "~", r[1])
    assert sorted(map(tuple, got.collect()), key=key) == sorted(map(tuple, small.collect()), key=key)
    monkeypatch.setattr(text, "VOCABULARY_BOUND", 1)
    with pytest.raises(ValueError):
        text.vocabulary_words(v)


def test_match_keys(spark):
    got = values(spark, [" 00a ", "000", None], text.match_key("a"), text.match_key_no_zeros("a"))
    assert got == [("00A", "A"), ("000", "0"), (None, None)]
