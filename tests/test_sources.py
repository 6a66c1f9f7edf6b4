"""File sources and sinks, cleaning guards, requests and income parsing."""

import pytest
from pyspark.sql import functions as F

from panelflow.functions import geo
from panelflow.functions.numbers import decimal_comma, grouped_number, left_closed_bin, right_closed_bin, round_half_even
from panelflow.operators import catalogue, clean, income, ranking
from panelflow.sources import files, sinks

HEADER = "﻿ ID_LOCAL ;Rotulo;Codigo\n"
ROWS = [("1", "CAFÉ ÑANDÚ", "007"), ("2", "“DON’T” €", "010")]


def write(tmp_path, name, encoding, rows=ROWS, header=HEADER):
    text = header.lstrip("﻿") + "".join(";".join(r) + "\n" for r in rows)
    if encoding == "utf-8-sig":
        text, encoding = "﻿" + text, "utf-8"
    path = tmp_path / name
    path.write_bytes(text.encode(encoding))
    return str(path)


@pytest.mark.parametrize("encoding,found", [("utf-8", "utf-8"), ("utf-8-sig", "utf-8"), ("cp1252", "cp1252")])
def test_snapshot_csv_encodings(spark, tmp_path, encoding, found):
    path = write(tmp_path, "register_2020_12.csv", encoding)
    assert files.sniff_encoding(spark, path) == found
    df = files.read_snapshot_csv(spark, path)
    assert df.columns == ["id_local", "rotulo", "codigo"]
    assert [tuple(r) for r in df.orderBy("id_local").collect()] == ROWS


def test_latin1_is_the_last_resort(spark, tmp_path):
    path = tmp_path / "x_2020_12.csv"
    path.write_bytes(b"ID;N\n1;A\x81\xd1\n")
    assert files.sniff_encoding(spark, str(path)) == "latin-1"
    assert files.read_snapshot_csv(spark, str(path)).first()["n"] == "A\x81Ñ"


def test_yearly_files(spark, tmp_path):
    a = write(tmp_path, "register_2019_12.csv", "utf-8")
    b = write(tmp_path, "register_2020_06.csv", "cp1252", [("3", "Ñ")], "id_local;rotulo\n")
    df = files.read_snapshot_files(spark, [b, a], ["id_local", "rotulo"], ["codigo"])
    got = {(r.id_local, r.codigo, r.anio, r.mes) for r in df.collect()}
    assert got == {("1", "007", 2019, 12), ("2", "010", 2019, 12), ("3", None, 2020, 6)}
    with pytest.raises(ValueError, match="codigo"):
        files.read_snapshot_files(spark, [a, b], ["codigo"])
    audit = {r.column: (r.n_files, r.usable) for r in files.schema_audit(files.header_table(spark, [a, b]), ["id_local"], ["codigo", "rotulo"]).collect()}
    assert audit == {"id_local": (2, 1), "codigo": (1, 0), "rotulo": (2, 1)}


def test_separator(spark, tmp_path):
    for sep in (";", ","):
        p = tmp_path / f"s{ord(sep)}.csv"
        p.write_text(f"a{sep}b\n1{sep}2\n")
        assert files.sniff_separator(spark, str(p)) == sep


def test_review_states(spark):
    def frame(*v):
        return spark.createDataFrame([(x,) for x in v], "v string")

    assert files.read_review(frame(None, "", " "), "v") is None
    assert [r.v for r in files.read_review(frame("1.0", "0", "1"), "v").collect()] == [1, 0, 1]
    for bad in (frame("1", ""), frame("1", "2"), frame("1", "x")):
        with pytest.raises(ValueError):
            files.read_review(bad, "v")


def test_two_locales_have_bom_and_marks(spark, tmp_path):
    path = str(tmp_path / "out")
    sinks.write_two_locales(spark.createDataFrame([("a", 1.5)], "k string, v double"), path, single_file=True)
    read = lambda p: next((tmp_path / p).glob("part-*.csv")).read_bytes().decode()
    assert read("out") == "﻿k,v\na,1.5\n"
    assert read("out_es") == "﻿k;v\na;1,5\n"


def test_single_csv_is_one_file(spark, tmp_path):
    sinks.write_single_csv(spark.range(1100).repartition(4), str(tmp_path / "x"))
    assert len(list((tmp_path / "x").glob("part-*.csv"))) == 1


def test_numbers(spark):
    df = spark.createDataFrame([("1,5 ", "12.345,6"), ("abc", "."), (None, None)], "a string, b string")
    assert [tuple(r) for r in df.select(decimal_comma("a"), grouped_number("b")).collect()] == [(1.5, 12345.6), (None, None), (None, None)]
    e = spark.createDataFrame([(0.0,), (1.0,), (1.5,), (2.0,), (3.0,)], "v double")
    assert [tuple(r) for r in e.select(right_closed_bin("v", (0, 1, 2)), left_closed_bin("v", (0, 1, 2))).collect()] == [
        (None, 1), (1, 2), (2, 2), (2, None), (None, None)]
    assert spark.range(1).select(round_half_even(F.lit(2.5), 0)).first()[0] == 2.0


def test_column_guards():
    assert clean.resolve_column(["Id_Local", "Rotulo"], ["rotulo"]) == "Rotulo"
    assert clean.resolve_column(["x_desc_rotulo"], ["rotulo"]) is None
    assert clean.resolve_column(["x_desc_rotulo"], ["rotulo"], substring=True) == "x_desc_rotulo"
    with pytest.raises(ValueError, match="b"):
        clean.require_columns(["a"], ["a", "b"])


def test_remap_and_guard(spark):
    train = spark.createDataFrame([("056",), ("CENTRO",)], "c string")
    canon = clean.canonical_values(train, "c")
    df = spark.createDataFrame([("56",), (" centro ",), ("nuevo",), (None,)], "c string")
    out = clean.remap_categories(df, canon, "c")
    assert {(r.c, r.c_unmatched) for r in out.collect()} == {("056", False), ("CENTRO", False), ("nuevo", True), (None, False)}
    with pytest.raises(ValueError, match="c 33"):
        clean.check_unmatched(out, ["c"])
    clean.check_unmatched(out.where("not c_unmatched"), ["c"])


def test_keep_first_is_by_order_not_by_file(spark):
    df = spark.createDataFrame([(1, 3, "c"), (1, 2, "b"), (2, 1, None)], "k int, o int, v string")
    assert {tuple(r) for r in clean.keep_first(df, ["k"], ["o"]).collect()} == {(1, 2, "b"), (2, 1, None)}


def test_income_split(spark):
    rows = [
        ("28079 M", "2807901 d", "2807901001 s", "I", "2020", "12.345"),
        ("28079 M", "2807901 d", None, "I", "2020", "10.000,5"),
        ("28079 M", "2807901 d", "2807901002 s", "J", "2020", "1"),
        ("08019 B", "0801901 d", "0801901001 s", "I", "2020", "1"),
    ]
    df = spark.createDataFrame(rows, "municipality string, district string, section string, indicator string, period string, total string")
    s, d = income.split_income(df, "I")
    assert [(r.code, r.year, r.income) for r in s.collect()] == [("01001", 2020, 12345.0)]
    assert [(r.code, r.income) for r in d.collect()] == [("01", 10000.5)]


def test_requests_are_checked(spark):
    df = spark.createDataFrame(
        [(1, "56", "5", " centro", "puerta calle", 3.0, 1), (2, "XX", "5", "Nowhere", "Agrupado", 130.0, 60), (3, "56", "5", "CENTRO", "Agrupado", None, None)],
        "id int, activity string, division string, district string, access string, age double, previous_turnovers int")
    one = lambda *v: spark.createDataFrame([(x,) for x in v], "v string")
    out = catalogue.validate_requests(df, one("56"), one("5"), one("CENTRO"), one("Puerta Calle", "Agrupado")).orderBy("id").collect()
    assert (out[0].errors, out[0].district, out[0].access) == ([], "CENTRO", "Puerta Calle")
    assert out[1].errors == ["unknown activity", "unknown district", "age out of range", "turnovers out of range"]
    assert out[2].errors == [] and out[2].turnover_rate == 0.0
    assert abs(out[0].turnover_rate - 1 / 3) < 1e-12


def test_search(spark):
    df = spark.createDataFrame([(1, "Café Ñ (a.b)", "Sol", 0.5), (2, "CAFE", "sol", 0.9), (3, "bar", "Sól", 0.7)], "id int, label string, barrio string, p double")
    ids = lambda out: [r.id for r in out.collect()]
    assert ids(ranking.search(df, "café", "")) == [2, 1]
    assert ids(ranking.search(df, "(a.b", "")) == [1]
    assert ids(ranking.search(df, "", "SOL")) == [2, 3, 1]
    assert ids(ranking.search(df, " ", "")) == []
    with pytest.raises(KeyError):
        ranking.lookup_one(df, "id", 9)


def test_lon_lat_of_a_known_point(spark):
    """Central meridian and a point computed by the forward series."""
    df = spark.createDataFrame([(500000.0, 4649776.224718), (0.0, 0.0)], "x double, y double")
    a, b = geo.with_lon_lat(df).collect()
    assert abs(a.lon + 3) < 1e-9 and abs(a.lat - 42.0) < 1e-6
    assert b.lon is None and b.lat is None


def test_scenario_grid_guard(spark):
    g = catalogue.scenario_grid(spark.createDataFrame([("a",), ("b",)], "code string"), ["d1", "d2"], [{"profile": "x", "age": 1.0}])
    assert g.count() == 4 and g.columns == ["code", "district", "profile", "age"]
    scored = g.withColumn("p", F.lit(0.1))
    assert {r.varies for r in catalogue.varies_by_district(scored, ["code"], "p").collect()} == {0}
