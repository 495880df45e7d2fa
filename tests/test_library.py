"""The library's own operators: queries against their SQL on the smallest tables, and small fixtures for the rest."""

from __future__ import annotations

import math
from datetime import date, datetime

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sensorium.functions import geodesy
from sensorium.functions import geometry as g
from sensorium.operators import adjacency, calendar, emit, entities, graph_tables, levels, metrics, reports, scaling, splits, windows
from sensorium.plans import (
    advanced,  # noqa: F401  its queries are in the same dictionaries
    forecast,
    queries,
    standin,
)
from sensorium.sources import files, sinks, triples
from sensorium.streaming import device_levels

SF = "/root/testdata/sf0.001"
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for n in TABLES:
        con.execute(f"CREATE VIEW {n} AS SELECT * FROM '{SF}/{n}.parquet'")
    return con


def plain(rows):
    def one(v):
        if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
            return "None"
        if isinstance(v, bool | np.bool_):
            return str(bool(v))
        if isinstance(v, int | float | np.number):
            return f"{float(v) + 0.0:.5f}"
        return str(v)

    return sorted(tuple(map(one, r)) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_against_sql(spark, duck, name):
    got, want = queries.QUERIES[name](spark, SF).toPandas(), duck.execute(queries.SQL[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    assert plain(got[cols].astype(object).itertuples(index=False)) == plain(want[cols].astype(object).itertuples(index=False))


def test_calendar(spark):
    c = calendar.Calendar(datetime(2022, 3, 7), datetime(2023, 1, 30), 30)
    assert c.size == 13536 and c.block_size == 288 and c.spine(spark).count() == 13536
    two = calendar.Calendar(datetime(2022, 3, 7), datetime(2022, 3, 21), 30)
    starts = [r.start for r in two.spine(spark).orderBy("bucket_idx").collect()]
    assert starts == [x for x in pd.date_range("2022-03-07", "2022-03-21", freq="30min", inclusive="left").to_pydatetime() if x.weekday() != 6]
    when = spark.createDataFrame([(datetime(2022, 3, 13, 12),), (datetime(2022, 3, 14),), (datetime(2022, 3, 21),), (datetime(2022, 3, 6),)], "ts timestamp_ntz")
    assert [tuple(r) for r in when.select(two.bucket(F.col("ts")), two.bucket(F.col("ts"), True)).collect()] == [(287, None), (288, 288), (None, None), (None, None)]
    for start in (datetime(2022, 3, 9), datetime(2022, 3, 12), datetime(2022, 3, 13)):
        odd = calendar.Calendar(start, datetime(2022, 3, 30), 360)
        rows = odd.spine(spark).orderBy("bucket_idx").collect()
        assert [r.start for r in rows] == [x for x in pd.date_range(start, "2022-03-30", freq="6h", inclusive="left").to_pydatetime() if x.weekday() != 6]
        assert odd.spine(spark).where(odd.bucket(F.col("start")) != F.col("bucket_idx")).count() == 0
    assert calendar.easter(2022) == date(2022, 4, 17) and date(2022, 4, 18) in calendar.dutch_holidays([2022]) and date(2014, 4, 26) in calendar.dutch_holidays([2014])


def test_moving_average_modes(spark):
    rows = spark.createDataFrame([(0, 0, 1.0), (0, 1, 2.0), (0, 2, 3.0), (1, 3, 10.0), (1, 4, 20.0), (1, 5, 30.0)], "block_id int, bucket_idx int, v double")
    get = lambda **k: [r.v_ma_3_sh1 for r in windows.moving_averages(rows, [3], 1, ["v"], **k).orderBy("bucket_idx").collect()]
    assert get() == [None, 1, 1.5, None, 10, 15] and get(across_blocks=True) == [None, 1, 1.5, 1.5, 6, 15]


def test_turtle(spark, tmp_path):
    (tmp_path / "a.ttl").write_text('@prefix ex: <http://e/> .\n# note\nex:d1 a ex:Device ; ex:label "a \\"q\\" \\u00e9"@en, "x"^^ex:t ;\n ex:n 5, 2.5, 1e3, true ; .\n<urn:r> ex:has ex:d1 .\n')
    (tmp_path / "b.ttl").write_text('PREFIX ex: <http://e/>\n<urn:r> ex:has ex:d1 .\nex:x.y ex:long """two\nlines""" .')
    got = {(r.s, r.p, r.o, r.o_dtype) for r in triples.graph(triples.read_turtle(spark, str(tmp_path))).collect()}
    assert ("http://e/d1", triples.RDF_TYPE, "http://e/Device", None) in got and ("http://e/d1", "http://e/label", 'a "q" é', "@en") in got
    assert ("http://e/d1", "http://e/n", "1e3", f"{triples.XSD}double") in got and ("http://e/x.y", "http://e/long", "two\nlines", None) in got
    assert len(got) == 9 and triples.read_if_there(spark, str(tmp_path / "none.ttl")).count() == 0
    whole = triples.graph(triples.read_turtle(spark, str(tmp_path)))
    triples.turtle_lines(whole).coalesce(1).write.text(str(tmp_path / "out"))
    back = triples.graph(triples.read_turtle(spark, str(tmp_path / "out"), glob="*.txt"))
    assert back.exceptAll(whole).count() == 0 and back.count() == 9
    with pytest.raises(ValueError):
        list(triples.parse_turtle("<a> <b> [ <c> <d> ] ."))
    with pytest.raises(ValueError):
        triples.read_floors(spark, str(tmp_path), None, "polygons")


def test_entities(spark):
    p = triples.PREFIXES
    rows = [
        ("urn:roomname_1", triples.RDF_TYPE, f"{p['s4bldg']}BuildingSpace"), ("urn:roomname_1", f"{p['s4bldg']}isSpaceOf", "urn:floor_7"),
        ("urn:roomname_1", f"{p['ex-ont']}hasWindow", "w1"), ("w1", f"{p['ex-ont']}hasFacingDirection", "27"), ("w1", f"{p['ex-ont']}facingRelativeDirection", "front"),
        ("urn:roomname_1", f"{p['ex-ont']}hasDocumentGeometry", "g1"), ("g1", f"{p['geosparql']}asWKT", "POLYGON Z((0 0 7, 4 0 7, 4 3 7, 0 3 7, 0 0 7))"),
        ("d", f"{p['saref']}makesMeasurement", "m"), ("m", f"{p['saref']}hasTimestamp", "2022-03-07T10:00:00"), ("m", f"{p['saref']}hasValue", "21.5"), ("m", f"{p['saref']}relatesToProperty", "urn:x#property_t"),
        ("urn:x#property_t", triples.RDF_TYPE, f"{p['saref']}Temperature"),
    ]
    df = spark.createDataFrame(rows, "s string, p string, o string")
    assert entities.rooms(df).first().has_windows and entities.floors(df).first().floor_number == 7
    w = entities.windows(df).first()
    assert (w.direction_sin, w.direction_cos, w.has_front_windows, w.has_multiple_windows) == (0.454, 0.891, True, False)
    two = [("urn:roomname_1", f"{p['ex-ont']}hasWindow", "w2"), ("w2", f"{p['ex-ont']}hasFacingDirection", "27"), ("w2", f"{p['ex-ont']}facingRelativeDirection", "Front"), ("urn:roomname_2", triples.RDF_TYPE, f"{p['s4bldg']}BuildingSpace"), ("urn:roomname_2", f"{p['s4bldg']}isSpaceOf", "urn:floor_7")]
    w = {r.room_uri: r for r in entities.windows(df.unionByName(spark.createDataFrame(two, df.schema))).collect()}
    assert w["urn:roomname_1"].has_multiple_windows and w["urn:roomname_1"].direction_sin == 0.454
    none = w["urn:roomname_2"]
    assert (none.headings, none.direction_sin, none.direction_cos, none.has_multiple_windows, none.has_left_windows) == ([], 0.0, 0.0, False, False)
    typed = [("d", triples.RDF_TYPE, f"{p['s4ener']}Device"), ("d", f"{p['ic']}hasDeviceType", "sensor")]
    assert entities.devices(spark.createDataFrame(typed, df.schema)).first().device_type == "sensor" and p["ex-ont"] == "https://example.org/ontology#"
    m = entities.measurements(df).first()
    assert (m.value, m.timestamp) == (21.5, datetime(2022, 3, 7, 10)) and entities.property_types(df).first().property_type == "Temperature"
    pts = entities.polygons(df, document=True).select(g.parse_wkt(F.col("wkt")).alias("p"))
    assert pts.select(g.area(F.col("p"))).first()[0] == 12 and pts.select(g.to_wkt(F.col("p"), F.lit(7))).first()[0].startswith("POLYGON Z((0.0 0.0 7")


def test_geometry(spark):
    l = np.array([(0, 0), (4, 0), (4, 1), (1, 1), (1, 4), (0, 4)], float)  # noqa: E741
    box = lambda x, y, w, h: np.array([(x, y), (x + w, y), (x + w, y + h), (x, y + h)], float)
    assert g.overlap_area(l, box(0, 0, 2, 2)) == pytest.approx(3) and g.overlap_area(box(0, 0, 2, 2), l) == pytest.approx(3)
    assert g.overlap_area(l, box(2, 2, 2, 2)) == 0 and g.ring_distance(l, box(2, 2, 2, 2)) == pytest.approx(1)
    assert g.ring_distance(box(0, 0, 10, 10), box(2, 2, 1, 1)) == 0 and g.ring_distance(box(0, 0, 1, 1), box(4, 5, 1, 1)) == 5
    assert g.near_length(box(0, 0, 10, 10), box(11, 0, 10, 10), 2.0) == pytest.approx(10 + 2 * (math.sqrt(3)), abs=2)
    rnd = np.random.default_rng(1)
    tri = rnd.random((3, 2)) * 4
    ps = rnd.random((40000, 2)) * 4
    assert g.overlap_area(tri, l) == pytest.approx((g.inside(ps, tri) & g.inside(ps, l)).mean() * 16, abs=0.15)
    line = np.array([(0, 0), (1, 0.01), (2, 0), (3, 2), (4, 0)], float)
    assert len(g.simplify_ring(line, 0.1)) == 4 and len(g.boundary_points(np.vstack([l] * 5), 20)) == 20
    df = spark.createDataFrame([([(0.0, 0.0), (0.0, 2.0), (2.0, 2.0), (2.0, 0.0)],)], standin.T.StructType([standin.T.StructField("p", g.POINTS)]))
    c = df.select(g.centroid(F.col("p")).alias("a"), g.centroid(F.col("p"), absolute=True).alias("b")).first()
    assert (c.a.x, c.a.y, c.b.x) == (1, 1, -1)
    assert len(df.select(g.evenly_spaced("p", F.lit(3.0))).first()[0]) == 3
    assert files.path_points("m 0 0 h 4 v 3 h -4 z") == [{"x": 0, "y": 0}, {"x": 4, "y": 0}, {"x": 4, "y": 3}, {"x": 0, "y": 3}]


def test_adjacency(spark):
    box = lambda x, y, w, h: [(x, y), (x + w, y), (x + w, y + h), (x, y + h)]
    rows = [("a", "1", 1, box(0.0, 0.0, 10.0, 10.0), True), ("b", "2", 1, box(11.0, 0.0, 10.0, 10.0), False), ("c", "3", 1, box(22.0, 0.0, 10.0, 10.0), True), ("d", "4", 1, box(62.0, 0.0, 10.0, 10.0), True), ("e", "5", 2, box(0.0, 0.0, 20.0, 10.0), True)]
    kind = standin.T.StructType([standin.T.StructField("room_uri", standin.T.StringType()), standin.T.StructField("room_number", standin.T.StringType()), standin.T.StructField("floor_number", standin.T.IntegerType()), standin.T.StructField("points", g.POINTS), standin.T.StructField("has_windows", standin.T.BooleanType())])
    rooms = spark.createDataFrame(rows, kind)
    hor = adjacency.horizontal_binary(rooms)
    assert {(r.src, r.dst) for r in hor.collect()} == {("a", "b"), ("b", "a"), ("b", "c"), ("c", "b")}
    ver = {(r.src, r.dst): r.weight for r in adjacency.vertical(rooms, weighted=True).collect()}
    assert ver == {("a", "e"): 1.0, ("e", "a"): 0.5, ("b", "e"): 0.9, ("e", "b"): 0.45}
    weighted = {(r.src, r.dst): r.weight for r in adjacency.horizontal_weighted(rooms).collect()}
    assert set(weighted) == {("a", "b"), ("b", "a"), ("b", "c"), ("c", "b")} and all(0.25 < w < 0.4 for w in weighted.values())
    steps = adjacency.propagation(adjacency.combined(hor, adjacency.vertical(rooms)), rooms.where("room_uri = 'c'"))
    assert {r.room_uri: r.activation_step for r in steps.collect()} == {"c": 0, "b": 1, "a": 2, "e": 2}
    assert {(r.src, r.dst) for r in adjacency.masked_edges(hor, steps, 1).collect()} == {("b", "a"), ("b", "c"), ("c", "b")}
    assert adjacency.with_outside(hor, adjacency.outside(rooms)).where("src = 'outside'").count() == 4
    lap = {(r.src, r.dst): r.weight for r in adjacency.shift_operator(hor, "rw_lap").collect()}
    assert lap[("a", "a")] == 1 and lap[("b", "a")] == -0.5
    least = {(r.src, r.dst): r.weight for r in adjacency.vertical(rooms, weighted=True, min_weight=0.01).collect()}
    assert least[("c", "e")] == least[("e", "d")] == 0.01 and least[("b", "e")] == 0.9
    shares = adjacency.outside(rooms, adjacency.horizontal_weighted(rooms))
    out = {r.room_uri: r.weight for r in shares.collect()}
    assert out["b"] == 0 and out["d"] == out["e"] == 1 and 0.6 < out["a"] < 0.75


def test_scalers(spark):
    rnd = np.random.default_rng(2)
    df = spark.createDataFrame([(float(x),) for x in rnd.lognormal(size=300)], "x double").withColumn("y", F.col("x"))
    for kind in ("standard", "robust", "minmax", "maxabs", "quantile_uniform", "quantile_normal", "yeo-johnson_std", "box-cox"):
        s = scaling.fit(df, {"x": kind})
        inner = F.col("y").between(0.05, 15) if kind == "quantile_normal" else F.lit(True)  # its ends are cut off
        back = scaling.transform(scaling.transform(df, s), s, inverse=True)
        assert back.where(inner).agg(F.max(F.abs(F.col("x") - F.col("y")))).first()[0] < (1e-5 if kind == "quantile_normal" else 1e-6), kind
    assert abs(scaling.fit(df, {"x": "box-cox"})["x"].lam) < 0.25
    z = scaling.transform(df, scaling.fit(df, {"x": "quantile_normal"})).agg(F.stddev_pop("x"), F.avg("x")).first()
    assert abs(z[0] - 1) < 0.2 and abs(z[1]) < 0.05
    assert scaling.fit(spark.createDataFrame([(v,) for v in (1.0, 2.0, 4.0, 8.0)], "x double"), {"x": "robust"})["x"] == scaling.Scaler("robust", 3.0, 3.25)
    assert scaling.scaler_map(["a_mean", "b_std"], "standard", {"_std": "robust"}, ["a_"]) == {"a_mean": "none", "b_std": "robust"}


def test_splits(spark):
    s = splits.BlockSplitter(list(range(47)))
    train, test = s.train_test()
    folds = s.folds(train, test)
    assert not set(train) & set(test) and sorted(b for _, v in folds for b in v) == sorted(train) and len(folds) == 4
    again = splits.BlockSplitter(list(range(47)))
    assert again.train_test() == (train, test) and again.folds(train, test) == folds
    assert len(test) == 10 and {b // 5 for b in test} == set(range(10))  # the last stratum has two blocks
    t, v = s.last_validation(train, folds)
    assert set(t) | set(v) == set(train) and not set(t) & set(v) and len(v) == min(len(f) for _, f in folds)
    assert all(b in {f[i] for _, f in folds} for i, b in enumerate(sorted(v)) if i == 0)
    t, v = s.single_validation(train)
    assert sorted([*t, *v]) == train and len({b // 5 for b in v}) == len(v) >= 9
    with pytest.raises(ValueError):
        splits.BlockSplitter([1, 2])


def test_sources(spark, tmp_path):
    day = tmp_path / "meetdata_2022_03_07.csv"
    times = [f"{h:02d}:{m:02d}" for h in range(24) for m in (0, 15, 30, 45)][1:] + ["00:00"]
    day.write_text("time,consumption\n" + "\n".join(f"{t},{k}" for k, t in enumerate(times)))
    (tmp_path / "meetdata_2022_03_08.csv").write_text("time,consumption\n00:15,mv\n00:30,2\n00:45,3\n01:00,4\n")
    c = calendar.Calendar(datetime(2022, 3, 7), datetime(2022, 3, 9), 30)
    rows = files.read_consumption(spark, str(tmp_path), date(2022, 3, 7), date(2022, 3, 8))
    got = {r.bucket_idx: r.consumption for r in files.consumption_by_bucket(rows, c.spine(spark), 2).collect()}
    assert got[0] == 0.5 and got[47] == 94.5 and got[48] is None and got[49] == 4
    even = {r.bucket_idx: r.consumption for r in files.consumption_by_bucket(rows, c.spine(spark), 2, aligned=True).collect()}
    assert even[0] == 0.5 and even[48] == 2 and even[49] == 3.5
    assert files.file_date("x/meetdata_2022_03_07.csv") == date(2022, 3, 7)
    with pytest.raises(ValueError):
        files.file_date("other.csv")
    (tmp_path / "weather.csv").write_text("date," + ",".join(files.WEATHER) + "\n2022-03-07 00:00:00+01:00," + ",".join(["90"] * 9) + "\n2022-03-07T02:00:00," + ",".join(["1"] * 9) + "\n")
    w = files.weather_by_bucket(files.read_weather(spark, str(tmp_path / "weather.csv"), c.start, c.end), c.spine(spark), 30)
    assert sorted(r.bucket_idx for r in w.collect()) == [0, 1, 4, 5] and w.where("bucket_idx = 0").first().wind_direction_10m_sin == 1
    (tmp_path / "floor_1.csv").write_text("URI,isRoom,isFacing\nr1,TRUE,\"front, left\"\nr2,false,none\n")
    assert {(r.direction, r.heading) for r in files.windows_of(files.read_room_list(spark, str(tmp_path / "floor_1.csv"))).collect()} == {("front", 27.0), ("left", 297.0)}
    (tmp_path / "plan.svg").write_text('<svg xmlns:inkscape="http://i"><g><path inkscape:label="7.010" d="M 0 0 L 4 0 L 4 3 Z"/><path d="M 1 1 L 2 2"/></g></svg>')
    svg = files.read_svg(spark, str(tmp_path / "plan.svg"))
    assert {r.label: len(r.p) for r in svg.select("label", files.svg_points("d").alias("p")).collect()} == {"7.010": 3, None: 2}
    drawn = '<svg xmlns="http://www.w3.org/2000/svg" xmlns:inkscape="http://www.inkscape.org/namespaces/inkscape" {0}><path inkscape:label="building_ground" transform="translate(1,2)" d="M 1 2 L 5 2 L 5 6 Z"/><g {1} transform="translate(10,0)"><path inkscape:label="7.1" transform="translate(0,-5)" d="m 10 0 h 4 v 3 z"/><path d="M 0 0 L 1 1"/></g></svg>'
    (tmp_path / "a.xml").write_text(drawn.format('viewBox="0 0 40 30"', 'inkscape:label="rooms"'))
    (tmp_path / "b.xml").write_text(drawn.format('width="8pt" height="9pt"', 'id="layer1"'))
    plans = files.read_floor_plans(spark, str(tmp_path / "[ab].xml")).collect()
    assert {(r.width, r.height, r.label, tuple((p.x, p.y) for p in r.points)) for r in plans} == {(w, h, k, v) for w, h in ((40, 30), (8, 9)) for k, v in (("building_ground", ((0, 0), (4, 0), (4, 4))), ("7.1", ((0, 5), (4, 5), (4, 8))))}
    assert files.ground_outlines(files.read_floor_plans(spark, str(tmp_path / "a.xml"))).first().points[1].x == 4
    (tmp_path / "c.xml").write_text('<svg xmlns="http://www.w3.org/2000/svg"/>')
    with pytest.raises(Exception, match="no ground outline"):
        files.ground_outlines(files.read_floor_plans(spark, str(tmp_path / "c.xml"))).collect()
    assert {r.k: r.m for r in spark.createDataFrame([("a", "x=1, y=2=3"), ("b", "")], "k string, t string").select("k", files.key_values(F.col("t")).alias("m")).collect()} == {"a": {"x": "1", "y": "2=3"}, "b": None}
    sinks.write_metadata({"blocks": standin.spine(spark)}, {"interval": 30}, str(tmp_path / "meta"))
    assert spark.read.text(str(tmp_path / "meta" / "settings")).first().value == '{"interval": 30}' and spark.read.parquet(str(tmp_path / "meta" / "blocks")).count() == 104
    files.snapshot({"rooms": standin.rooms(spark, SF)}, str(tmp_path / "snap"))
    assert files.load_snapshot(spark, str(tmp_path / "snap"), ["rooms"], [1])["rooms"].count() == 5
    a = spark.createDataFrame([(1, "x")], "k int, v string")
    assert files.last_wins([a, a.withColumn("v", F.lit("y"))], ["k"]).first().v == "y"
    assert files.dataset_name("dataframe", "30m", "tabular", task="consumption_forecast") == "tabular_consumption_30m"
    assert files.dataset_name("metadata", "1h", weather="node") == "metadata_1h_Wnode" and files.dataset_name("hetero_input", "1h") == "hetero_input_1h"
    with pytest.raises(ValueError):
        files.dataset_name("metadata", "1h")


def test_models_and_reports(spark):
    out = queries.QUERIES["boosted_forecast"](spark, SF).first()
    assert out.n > 0 and out.rmse > 0
    assert reports._two_sided(2.0, 10.0) == pytest.approx(0.07338803, abs=1e-7)
    df = spark.createDataFrame([(1.0, 1.0, 0.5), (0.0, 0.0, 0.0)], "y double, p double, mask double")
    assert metrics.masked_loss(df).first().loss == 0
    rooms, devices = standin.rooms(spark, SF), standin.devices(spark, SF)
    nodes = graph_tables.node_maps(rooms, devices, standin.property_level(spark, SF))
    dense = graph_tables.dense_rows(standin.series(spark, SF), nodes["room"], standin.spine(spark), ["clicks"])
    assert dense.count() == 104 and all(len(r.rooms) == 25 for r in dense.take(3))
    s = standin.series(spark, SF)
    assert graph_tables.weather_as_node(s, standin.spine(spark).select("bucket_idx")).where("room_uri = 'outside'").count() == 104
    t = forecast.prepared(s, "clicks", [1], delta=True, extra=["room_uri"])
    assert t.where("target_h_1 is null").count() == 0
    lost = spark.createDataFrame([("1", "room0"), ("2", "nowhere")], "device_uri string, room_uri string")
    with pytest.raises(Exception, match="device without a room on a floor: 2"):
        levels.with_rooms(spark.createDataFrame([("1",), ("2",)], "device_uri string"), lost, rooms).collect()
    with pytest.raises(ValueError):
        levels.require_rows(s.where("false"), "rows")


def test_boosted_classes_and_stopping(spark, tmp_path):
    rnd = np.random.default_rng(3)
    rows = [(float(a), float(b), float(a + 0.3 * c > 0.5)) for a, b, c in rnd.random((400, 3)) - [0, 0, 0.5]]
    df = spark.createDataFrame(rows, "a double, b double, y1 double").repartition(2)
    model, got = forecast.boosted(df.limit(200), df, ["a", "b"], "y1", rounds=15, depth=2, classify=True, validation=df)
    assert metrics.ranking(got.withColumn("y", F.col("y").cast("int"))).first().roc_auc > 0.9 and model.getNumTrees <= 15
    forecast.save_model(model, str(tmp_path / "m"))
    again = forecast.load_model(str(tmp_path / "m"), classify=True)
    assert again.getNumTrees == model.getNumTrees and forecast.importance(again, ["a", "b"], spark).orderBy(F.desc("importance")).first().feature == "a"


def test_stream_matches_batch(spark, tmp_path):
    schema = "timestamp timestamp_ntz, device_uri string, property_type string, value double"
    rows = standin.property_level(spark, SF)
    rows.select("timestamp", "device_uri", "property_type", "value").orderBy("timestamp").coalesce(1).write.parquet(str(tmp_path / "in"))
    q = device_levels.write_levels(device_levels.device_stats(device_levels.read_stream(spark, str(tmp_path / "in"), schema), "6 hours"), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    batch = rows.groupBy(F.window(F.col("timestamp").cast("timestamp"), "6 hours").start.alias("start"), "device_uri", "property_type").agg(F.count("value").alias("n"))
    both = got.join(batch, ["start", "device_uri", "property_type"])
    assert both.count() == got.count() > 0 and both.where(F.col("n") != F.col("count")).count() == 0


def test_geodesy(spark):
    df = spark.createDataFrame([(48.8582, 2.2945)], "lat double, lon double")
    u = df.select(geodesy.to_utm(F.col("lat"), F.col("lon")).alias("u"))
    east, north = u.select("u.*").first()
    assert abs(east - 448251.8) < 2 and abs(north - 5411932.7) < 2
    lat, lon = u.select(geodesy.from_utm(F.col("u.east"), F.col("u.north")).alias("x")).select("x.*").first()
    assert abs(lat - 48.8582) < 1e-8 and abs(lon - 2.2945) < 1e-8
    p = spark.createDataFrame([([(0.0, 10.0), (20.0, 0.0)],)], standin.T.StructType([standin.T.StructField("p", g.POINTS)]))
    a, b = p.select(geodesy.placed(F.col("p"), 20, 10, 100.0, 200.0, 40.0, 20.0, 90.0)).first()[0]
    assert (a.x, a.y) == (100, 200) and (round(b.x), round(b.y)) == (120, 160)


def test_emitted_triples_come_back(spark):
    rooms = standin.rooms(spark, SF).withColumn("floor_uri", F.concat(F.lit("urn:floor_"), F.col("floor_number").cast("string")))
    made = triples.graph(emit.topology(rooms), emit.room_flags(rooms.select(F.col("room_uri").alias("URI"), F.lit(True).alias("isRoom"))), emit.windows(rooms.where("has_windows").select(F.col("room_uri").alias("URI"), F.lit("front").alias("direction"), F.lit(27.0).alias("heading"))))
    back = entities.rooms(made)
    assert back.count() == 25 and back.where("is_proper_room").count() == 25 and back.where("has_windows").count() == 13
    shapes = entities.polygons(made, document=True).select("room_uri", g.area(g.parse_wkt(F.col("wkt"))).alias("a")).join(rooms.select("room_uri", g.area(F.col("points")).alias("b")), "room_uri")
    assert shapes.where("abs(a - b) > 1e-9").count() == 0 and shapes.count() == 25
    assert entities.windows(made).where("has_front_windows").count() == 13


def test_sinks(spark, tmp_path):
    m = spark.createDataFrame([(1.0, 2.0), (3.0, 3.5)], "y double, p double")
    rep = sinks.metric_report({"overall": m.agg(*metrics.regression()), "by": m.withColumn("horizon", F.lit(1)).groupBy("horizon").agg(*metrics.regression())})
    assert rep.columns == list(sinks.REPORT) and rep.count() == 2
    sinks.write_csv(rep, str(tmp_path / "experiment_1" / "results_test.csv"))
    assert files.read_results(spark, str(tmp_path)).count() == 2
    sinks.write_splits(splits.BlockSplitter(list(range(10))).table(spark), str(tmp_path / "splits"), 1)
    assert spark.read.json(str(tmp_path / "splits")).where("fold = -1").count() == 2
    t = spark.createDataFrame([(0, 2.0), (1, 1.0)], "trial int, value double")
    assert sinks.merge_trials([t, t]).where("place = 1").first().trial == 1
    assert sinks.combine_experiments(t, ["value"]).first().mean == 1.5
    c = metrics.confusion(spark.createDataFrame([(1, 0.9), (0, 0.1), (0, 0.2)], "y int, p double"))
    assert round(sinks.classification_report(c).first().majority_accuracy, 3) == 0.667
