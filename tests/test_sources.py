"""Configurations and delimited files."""

import datetime as dt
import json

import pytest
import yaml
from drovetrail.functions import dateformats
from drovetrail.functions.grid import add_degrees
from drovetrail.sources import config as C
from drovetrail.sources import delimited as D
from drovetrail.sources import sinks
from pyspark.sql import functions as F

MOVES = {"movedata_fileopts": {"separator": ",", "encoding": "UTF-8", "decimal": ".", "date_format": "%Y%m%d"}, "movedata_cols": {"from": "departure_cph", "to": "dest_cph", "date": "departure_date", "weight": "qty_pigs"}}
PLACES = {"holdingdata_fileopts": {"separator": ";", "encoding": "UTF-8", "decimal": ",", "coord_EPSG_code": 27700, "country_code": "UK"}, "holdingdata_cols": {"id": "cph", "coord_x": "easting", "coord_y": "northing", "type": "kind", "herd_size": "herd"}}


def changed(tree, group, **values):
    return {g: {k: v for k, v in {**o, **(values if g == group else {})}.items() if v is not ...} for g, o in tree.items()}


@pytest.mark.parametrize("name", ["denmark", "denmark_processed", "norway.yml", "sweden", "sweden_escaped", "sweden_numbers", "scotland", "scotland_arrivals", "scotland_holdings", "scotland_both"])
def test_bundled_configurations_are_valid(name):
    assert C.load_config(name).kinds
    assert C.load_config("sweden") == C.load_config("sweden_escaped")


@pytest.mark.parametrize(
    ("form", "text", "want"),
    [
        ("%d-%m-%Y 00:00:00", "05-03-2021 00:00:00", (2021, 3, 5)), ("%Y%m%d", "20210305", (2021, 3, 5)), ("%x", "21/03/05", (2021, 3, 5)), ("%D", "03/05/99", (1999, 3, 5)), ("%F %T", "2021-03-05 10:11:12", (2021, 3, 5)),
        ("%d %b %Y %I:%M %p", "5 Mar 2021 01:30 PM", (2021, 3, 5)), ("%A, %e %B %Y", "Friday,  5 March 2021", (2021, 3, 5)), ("%s", "1614902400", (2021, 3, 5)), ("%AD", "2021/3/5", (2021, 3, 5)), ("", "2021-03-05", (2021, 3, 5)),
        ("%Y-%m-%dT%H:%M:%OS%z", "2021-03-05T01:02:03.5+0100", (2021, 3, 5)), ("%Y.%m", "2021.03", (2021, 3, 1)), ("%Y-%m-%d", "2021-02-30", None), ("%Y-%m-%d", "2021-02-03 x", None), ("%b", "xyz", None), ("", "5/3/2021", None),
    ],
)
def test_date_formats(spark, form, text, want):
    assert dateformats.is_valid(form)
    got = spark.createDataFrame([(text,)], "t string").select(dateformats.read_date(F.col("t"), form)).first()[0]
    assert got == (dt.date(*want) if want else None)


@pytest.mark.parametrize("form", ["YYYY", "---", "%H:%M", "%q-%Y", "%I:%p", "%"])
def test_formats_that_hold_no_date(form):
    assert not dateformats.is_valid(form)


def test_line_breaks_torn_records_and_names(spark, tmp_path):
    path = write(tmp_path, 'departure_cph,dest_cph,departure_date,qty_pigs\na,"b\nc ""d""",20190203,5\n')
    got = D.read_delimited(spark, path, C.Config(MOVES), "movement").collect()
    assert [r["dest_cph"] for r in got] == ['b\nc "d"']
    path = write(tmp_path, "x,y\n1,2\n3\n4,5,6\n7,8\n")
    good, torn = D.scan_torn(spark, path, MOVES["movedata_fileopts"])
    assert [tuple(r) for r in good.collect()] == [("1", "2"), ("7", "8")] and sorted(r[0] for r in torn.collect()) == ["3", "4,5,6"]
    with pytest.raises(ValueError, match="2 records"):
        D.scan(spark, path, MOVES["movedata_fileopts"])
    named = D.with_names(C.load_config("sweden_numbers"), "movement", ["a", "b", "c", "d", "e", "f", "g"])
    assert named.cols("movement") == {"from": "a", "to": "b", "date": "c", "weight": "g"}


@pytest.mark.parametrize(
    ("tree", "what"),
    [
        (changed(MOVES, "movedata_cols", weight=...), "movedata_cols.weight"),
        ({"movedata_cols": MOVES["movedata_cols"]}, "for movement data this one isn't there: movedata_fileopts"),
        ({"other": {}}, "no group of options has a known name"),
        (changed(MOVES, "movedata_cols", to="departure_cph"), "two roles in movedata_cols: movedata_cols.from, movedata_cols.to"),
        (changed(MOVES, "movedata_fileopts", separator=",,"), "single character"),
        (changed(MOVES, "movedata_fileopts", decimal=1), "character format: movedata_fileopts.decimal"),
        (changed(MOVES, "movedata_fileopts", date_format="YYYY"), "date format"),
        (changed(MOVES, "movedata_cols", weight=1.5), "by name or number"),
        (changed(MOVES, "movedata_cols", weight=None), "by name or number"),
        (changed(PLACES, "holdingdata_cols", coord_y=...), "holdingdata_cols.coord_y"),
        (changed(PLACES, "holdingdata_fileopts", country_code=...), "holdingdata_fileopts.country_code"),
        (changed(PLACES, "holdingdata_fileopts", country_code="uk"), "two capitals"),
        (changed(PLACES, "holdingdata_fileopts", coord_EPSG_code="27700"), "a whole number"),
    ],
)
def test_faults_are_named(tree, what):
    assert any(what in p for p in C.validate(tree)), C.validate(tree)


def test_all_faults_come_together_and_more_keys_pass():
    assert C.validate(changed(MOVES, "movedata_cols", batch="lot_no", n=3)) == []
    assert len(C.validate({**changed(MOVES, "movedata_fileopts", separator="ab"), **changed(PLACES, "holdingdata_cols", id=...)})) == 2
    assert C.validate(MOVES, ["holding"])


def test_get_change_save(tmp_path):
    c = C.Config({**MOVES, **PLACES})
    assert c.get("movedata_cols.w")[0] == {"movedata_cols.weight": "qty_pigs"} and c.get("movedata")[1] == ["movedata"]
    swapped = c.change({"movedata_cols.from": "dest_cph", "movedata_cols.to": "departure_cph", "holdingdata_fileopts.coord_EPSG_code": 4326})
    assert swapped.cols("movement")["from"] == "dest_cph" and c.cols("movement")["from"] == "departure_cph"
    for bad in ({"movedata_cols.from": "dest_cph"}, {"movedata_cols.from": None}, {"nothing": 1}):
        with pytest.raises(C.ConfigError):
            c.change(bad)
    C.save_config(swapped, str(tmp_path / "c.yml"))
    assert C.load_config(str(tmp_path / "c.yml")) == swapped
    C.new_config(str(tmp_path / "t.yml"), ["holding"])
    assert set(yaml.safe_load((tmp_path / "t.yml").read_text())) == set(PLACES)
    with pytest.raises(FileExistsError):
        C.new_config(str(tmp_path / "t.yml"))
    (tmp_path / "bad.yml").write_text("a: [")
    with pytest.raises(C.ConfigError, match="not valid yaml"):
        C.load_config(str(tmp_path / "bad.yml"))


def test_asciify():
    assert D.asciify(["Frånppn", "Avfärdsdatum", "a b", "a.b", "1x", "if", "", "straße", "x", "x", "日本"]) == ["Franppn", "Avfardsdatum", "a.b", "a.b.1", "X1x", "if.", "X", "strasse", "x", "x.1", ".."]


def write(tmp_path, text):
    p = tmp_path / "m.csv"
    p.write_text(text, encoding="utf-8")
    return str(p)


def test_file_to_typed_table(spark, tmp_path):
    path = write(tmp_path, "lot,departure_cph,dest_cph,departure_date,qty_pigs,n,flag,when\nA,01/001/0001,02/002/0002,20190208,97,1,TRUE,2020-01-02\nB,01/001/0001,03/003/0003,NA,1.5,2.5,F,2021/3/4\n")
    c = C.Config(changed(MOVES, "movedata_cols", batch=1, n="n", flag="flag", when="when"))
    df = D.read_delimited(spark, path, c, "movement")
    assert df.dtypes == [("departure_cph", "string"), ("dest_cph", "string"), ("departure_date", "date"), ("qty_pigs", "double"), ("lot", "string"), ("n", "double"), ("flag", "boolean"), ("when", "date")]
    assert [r["departure_date"] for r in df.collect()] == [dt.date(2019, 2, 8), None]
    assert D.standardise(D.from_table(df.limit(0)), C.Config(MOVES).change({"movedata_fileopts.date_format": ""}), "movement").count() == 0


@pytest.mark.parametrize(("row", "options", "what"), [("a,b,20190230,5", {}, "match the date format"), ("a,b,tomorrow,5", {}, "contain no digits"), ('a,b,20190203,"97,000"', {}, "grouping mark"), ("a,b,2019-02-03,5", {}, "match the date format")])
def test_bad_values_raise(spark, tmp_path, row, options, what):
    path = write(tmp_path, f"departure_cph,dest_cph,departure_date,qty_pigs\n{row}\n")
    with pytest.raises(ValueError, match=what):
        D.read_delimited(spark, path, C.Config(MOVES), "movement")


def test_columns_by_number_and_missing_ones():
    cols = ["a", "b", "c", "d"]
    assert D.resolve(cols, {"from": 1, "to": 2, "date": 3, "weight": "d"}, ("from", "to", "date", "weight")) == {"from": "a", "to": "b", "date": "c", "weight": "d"}
    with pytest.raises(ValueError, match=r"from \(9\), weight \(x\)"):
        D.resolve(cols, {"from": 9, "to": 2, "date": 3, "weight": "x"}, ("from", "to", "date", "weight"))
    with pytest.warns(UserWarning, match="more"):
        assert "more" not in D.resolve(cols, {"from": 1, "more": "zz"}, ("from",))


def test_decimal_comma_and_national_grid(spark, tmp_path):
    path = write(tmp_path, "cph;kind;herd;easting;northing\n01;farm;12,5;651409,903;313177,270\n02;farm;NA;NA;NA\n")
    df = D.read_delimited(spark, path, C.Config(PLACES), "holding")
    assert df.columns == ["cph", "kind", "herd", "coordinates"]
    a, b = df.orderBy("cph").collect()
    # The survey's worked example, shifted from its datum to WGS84.
    assert a["herd"] == 12.5 and abs(a["coordinates"]["lat"] - 52.65798) < 1e-4 and abs(a["coordinates"]["lon"] - 1.71605) < 1e-4
    assert b["coordinates"] is None
    with pytest.raises(ValueError, match="EPSG"):
        add_degrees(spark.createDataFrame([(1.0, 2.0)], "x double, y double"), "x", "y", 9999, "p")


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("r<1>", [{"lon": 1.0, "lat": 2.0}, {"lon": 3.0, "lat": 4.0}])], "ref string, line array<struct<lon:double,lat:double>>")
    assert sinks.geojson(df, "line", ["ref"]).first()[0] == '{"type":"Feature","geometry":{"type":"LineString","coordinates":[[1.0,2.0],[3.0,4.0]]},"properties":{"ref":"r<1>"}}'
    sinks.write_geojson(df, str(tmp_path / "g"), "line", ["ref"])
    sinks.write_delimited(df.select("ref"), str(tmp_path / "d"))
    sinks.write_parquet(df, str(tmp_path / "p"))
    assert spark.read.text(str(tmp_path / "g")).count() == 1 and spark.read.option("header", True).csv(str(tmp_path / "d")).first()[0] == "r<1>" and spark.read.parquet(str(tmp_path / "p")).count() == 1
    assert sinks.write_feature_collection(df, str(tmp_path / "c.json"), "line", ["ref"]) == 1
    assert json.loads((tmp_path / "c.json").read_text())["features"][0]["properties"] == {"ref": "r<1>"}
    page = sinks.report({"refs": df.select("ref")}, str(tmp_path / "report"), "a & b")
    assert "a &amp; b" in open(page).read() and spark.read.parquet(str(tmp_path / "report" / "refs")).count() == 1
    assert "r&lt;1&gt;" in sinks.html_table(df.select("ref"), "t") and "first 0" in sinks.html_table(df.select("ref"), "t", 0)


@pytest.mark.parametrize(("epsg", "x", "y", "lon", "lat"), [(3035, 3962799.45, 2999718.85, 5.0, 50.0), (3035, 4321000.0, 3210000.0, 10.0, 52.0), (25832, 500000.0, 5538630.703, 9.0, 50.0), (3006, 500000.0, 5538630.703, 15.0, 50.0), (4258, 5.0, 50.0, 5.0, 50.0)])
def test_nordic_and_european_grids(spark, epsg, x, y, lon, lat):
    got = add_degrees(spark.createDataFrame([(x, y)], "x double, y double"), "x", "y", epsg, "p").first()["p"]
    assert abs(got["lon"] - lon) < 1e-6 and abs(got["lat"] - lat) < 1e-6
