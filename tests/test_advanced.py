"""Operators over graphs, ranks, targets, files' heads, snapshots, whole buildings and searches, against restatements."""

from __future__ import annotations

import math
import os
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from sensorium import session
from sensorium.operators import adjacency, assembly, concordance, graph_tables, levels, metrics, quantiles, scaling, snapshots, spectral, splits, windows
from sensorium.plans import advanced, forecast, results, search
from sensorium.plans import standin as t
from sensorium.sources import building, heads, sinks, triples

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def graph(spark):
    rnd = random.Random(6)
    edges = [(f"n{rnd.randrange(9)}", f"n{rnd.randrange(9)}", round(rnd.random(), 3)) for _ in range(30)]
    matrix = np.zeros((11, 11))
    for a, b, w in edges:
        matrix[int(a[1:]), int(b[1:])] += w
    nodes = spark.createDataFrame([(f"n{k}",) for k in range(11)], "room_uri string")
    return spark.createDataFrame(edges, "src string, dst string, weight double"), matrix, nodes


def dense(edges, n=11):
    out = np.zeros((n, n))
    for r in edges.collect():
        out[int(r.src[1:]), int(r.dst[1:])] += r.weight
    return out


def plain_operator(matrix, kind):
    by, loop, result = kind.split("_")
    a = np.maximum(matrix, matrix.T)
    a = a + np.eye(len(a)) if loop == "renorm" else a
    d = a.sum(axis=1)
    part = np.divide(1.0, d, out=np.zeros_like(d), where=d > 0)
    a = np.sqrt(part)[:, None] * a * np.sqrt(part)[None, :] if by == "sym" else part[:, None] * a
    return np.eye(len(a)) - a if result == "lap" else a


@pytest.mark.parametrize("kind", [f"{b}_{n}_{r}" for b in ("sym", "rw") for n in ("norm", "renorm") for r in ("adj", "lap")])
def test_normalised_operator(graph, kind):
    edges, matrix, nodes = graph
    assert np.allclose(dense(spectral.normalised_operator(edges, kind, nodes)), plain_operator(matrix, kind))


def test_largest_singular_value_and_chebyshev(spark, graph):
    edges, matrix, nodes = graph
    value, rounds = spectral.largest_singular_value(edges)
    assert math.isclose(value, np.linalg.norm(matrix, 2), rel_tol=1e-7) and rounds < 200
    assert spectral.largest_singular_value(edges, tolerance=0.0, rounds=3)[1] == 3
    assert spectral.largest_singular_value(edges.limit(0)) == (0.0, 1)
    small = edges.withColumn("weight", F.col("weight") / 10)
    for given, m in ((small, matrix / 10), (edges.withColumn("weight", F.col("weight") * 9), matrix * 9)):
        s = np.linalg.norm(m, 2)
        assert np.allclose(dense(spectral.chebyshev_operator(given, nodes)), m * (1 if s >= 2 else 2 / s) - np.eye(11), atol=1e-6)
    with pytest.raises(ValueError):
        spectral.chebyshev_operator(edges.limit(0), nodes)
    with pytest.raises(ValueError):
        spectral.normalised_operator(edges, "sym_lap", nodes)


def shuffled_rows(spark):
    """Rows that all stages so far have written for shuffles."""
    context = spark.sparkContext
    stages = context._jsc.sc().statusStore().stageList(None, False, False, context._gateway.new_array(context._jvm.double, 0), context._jvm.java.util.ArrayList())
    return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))


def test_power_iteration_shuffles_nodes_only(spark):
    many = spark.range(8000).select(F.concat(F.lit("u"), F.col("id") % 20).alias("src"), F.concat(F.lit("p"), (F.col("id") / 20).cast("long")).alias("dst"), (F.col("id") % 13 + 1.0).alias("weight"))
    counts, values = [], []
    with session.setting(spark, "spark.sql.autoBroadcastJoinThreshold", "-1"):
        for rounds in (2, 5):
            before = shuffled_rows(spark)
            values.append(spectral.largest_singular_value(many, tolerance=0.0, rounds=rounds)[0])
            counts.append(shuffled_rows(spark) - before)
    # a round: 20 sums of each cell, there and back, and a few sums of sums; the edges would be 16,000
    assert counts[1] - counts[0] < 3 * (2 * 20 * spark.sparkContext.defaultParallelism + 40)
    matrix = np.array([(k % 13) + 1.0 for k in range(8000)]).reshape(400, 20)
    assert math.isclose(values[1], np.linalg.norm(matrix, 2), rel_tol=1e-6)
    assert not [x for x in spark.catalog.listTables() if x.name.startswith(("cells_", "vector_"))]
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == "true"


def test_power_iteration_without_names(spark):
    """Nodes without a name get products, but are joined with nothing, as in SQL; edges given twice are added up."""
    rows = [("a", "x", 2.0), ("a", "x", 1.0), (None, "x", 4.0), ("b", "y", 5.0), ("b", None, 7.0), ("a", "y", None), ("b", "x", 0.5)]
    edges = spark.createDataFrame(rows, "src string, dst string, weight double")
    start = spark.createDataFrame([("x", 1.0), ("y", 2.0), ("z", 3.0)], "node string, x double")
    m, lost, x = np.array([[3.0, 0.0], [0.5, 5.0]]), np.array([4.0, 0.0]), np.array([1.0, 2.0])
    size = math.sqrt(14.0)
    for rounds in (1, 2, 3):
        y = m @ x
        want = math.sqrt(y @ y + (lost @ x) ** 2) / size
        assert math.isclose(spectral.largest_singular_value(edges, start, 0.0, rounds)[0], want, rel_tol=1e-12)
        x = m.T @ y
        size = math.sqrt(x @ x + (7.0 * y[1]) ** 2)


def test_cells_have_partitions_of_their_own(spark):
    for n in (1, 7, 40):
        numbers = spectral.cell_numbers(spark, n)
        rows = spark.createDataFrame([(k,) for k in numbers], "cell long").repartition(n, "cell").select(F.spark_partition_id()).collect()
        assert sorted(r[0] for r in rows) == list(range(n))


def test_quantiles(spark):
    rnd = random.Random(2)
    # a third of the values are equal
    rows = [(g, None if rnd.random() < 0.1 else 0.0 if rnd.random() < 0.4 else round(rnd.gauss(0, 5), 2)) for g in "abc" for _ in range(rnd.randrange(50, 900))] + [("none", None), ("one", 4.0)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(6)
    shares = [0, 0.1, 1 / 3, 0.5, 0.75, 0.999, 1]
    got = {(r.g, r.p): r.quantile for r in quantiles.quantiles(df.where("v is not null"), "g", shares, "v").collect()}
    want = {(g, float(p)): np.quantile([v for x, v in rows if x == g and v is not None], p) for g in ("a", "b", "c", "one") for p in shares}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], abs_tol=1e-9) for k in want)
    by_group = quantiles.quantiles(df.where("v is not null"), "g", {"a": [0.2], "one": [0.0, 0.7], "none": [0.5]}, "v")
    assert sorted((r.g, r.p) for r in by_group.collect()) == [("a", 0.2), ("one", 0.0), ("one", 0.7)]
    wide = spark.createDataFrame([(1.0, math.nan), (None, 2.0), (3.0, None)], "a double, b double")
    assert quantiles.of_columns(wide, {"a": [0.5], "b": [0.5]}) == {"a": {0.5: 2.0}, "b": {0.5: 2.0}}
    assert quantiles.of_columns(wide.limit(0), {"a": [0.5]}) == {} == quantiles.of_columns(wide, {})


def plain_tau(rows):
    s = lambda a, b: (a > b) - (a < b)
    pairs = [(s(a[0], b[0]), s(a[1], b[1])) for k, a in enumerate(rows) for b in rows[:k]]
    in_x, in_y = (sum(p[k] != 0 for p in pairs) for k in (0, 1))
    return sum(x * y for x, y in pairs) / math.sqrt(in_x * in_y)


@pytest.mark.parametrize("fan", [2, 3, 16])
def test_kendall(spark, fan):
    rnd = random.Random(fan)
    rows = [(float(rnd.randrange(25)), float(rnd.randrange(12))) for _ in range(260)] + [(7.0, float(k)) for k in range(90)]
    df = spark.createDataFrame([*rows, (None, 1.0), (2.0, None), (math.nan, 3.0)], "x double, y double").repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so that there are several ranges
    try:
        assert math.isclose(concordance.kendall(df, "x", "y", fan), plain_tau(rows), rel_tol=1e-12)
        straight = spark.createDataFrame([(float(k), float(-k)) for k in range(40)], "x double, y double")
        assert concordance.kendall(straight, "x", "y", fan) == -1.0
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_kendall_without_variation(spark):
    same = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "x double, y double")
    assert concordance.kendall(same, "x", "y") is None and concordance.kendall(same.limit(0), "x", "y") is None
    assert [r.r for r in concordance.kendall_matrix(same, ["x", "y"]).collect()] == [None]


def test_inversions():
    rnd = random.Random(1)
    for _ in range(100):
        y, n = [rnd.randrange(9) for _ in range(rnd.randrange(20))], [rnd.randrange(1, 5) for _ in range(20)]
        want = sum(n[i] * n[j] for j in range(len(y)) for i in range(j) if y[i] > y[j])
        assert concordance.inversions(np.array(y), np.array(n[: len(y)])) == want


def test_target_scalers(spark):
    rnd = random.Random(8)
    rows = [(k, *(None if rnd.random() < 0.1 else rnd.gauss(h * 10, h) for h in (1, 2)), *(float(rnd.random() < 0.6) for _ in "ab")) for k in range(300)]
    df = spark.createDataFrame(rows, "k int, target_h_1 double, target_h_2 double, m1 double, m2 double")
    names, masks = ["target_h_1", "target_h_2"], ["m1", "m2"]
    values = [[r[h] for r in rows if r[h] is not None and r[h + 2] > 0] for h in (1, 2)]
    each = scaling.fit_targets(df, names, "robust", True, masks)
    for name, v in zip(names, values, strict=True):
        assert math.isclose(each[name].center, np.median(v)) and math.isclose(each[name].scale, np.quantile(v, 0.75) - np.quantile(v, 0.25))
    one = scaling.fit_targets(df, names, "standard", False, masks)
    assert one["target_h_1"] is one["target_h_2"] and math.isclose(one["target_h_1"].center, np.mean(sum(values, []))) and math.isclose(one["target_h_1"].scale, np.std(sum(values, [])))
    assert math.isclose(scaling.fit_targets(df, names, "maxabs")["target_h_1"].scale, max(abs(r[h]) for r in rows for h in (1, 2) if r[h] is not None))
    assert scaling.fit_targets(df, names, "none")["target_h_1"].kind == "none"
    for kind in ("robust", "quantile_uniform", "yeo-johnson_std"):
        fitted = scaling.fit_targets(df, names, kind, True)
        there = scaling.transform(df, fitted)
        long = there.select("k", F.inline(F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"target_h_{h}").alias("p")) for h in (1, 2)])))
        back = {(r.k, r.horizon): r.p for r in scaling.invert_predictions(long, fitted, ["p"]).collect()}
        for k, a, b, *_ in rows:
            for h, v in ((1, a), (2, b)):
                assert back[k, h] is None if v is None else math.isclose(back[k, h], v, rel_tol=1e-4, abs_tol=1e-4)
    with pytest.raises(PySparkException, match="no scaler for horizon 7"):
        scaling.invert_predictions(long.withColumn("horizon", F.lit(7)), each, ["p"]).collect()
    none = df.withColumn("m2", F.lit(0.0))
    with pytest.raises(ValueError, match="target_h_2"):
        scaling.fit_targets(none, names, "robust", True, masks)
    assert scaling.fit_targets(none, names, "robust", False, masks)["target_h_2"].center == each["target_h_1"].center
    with pytest.raises(ValueError):
        scaling.fit_targets(none.withColumn("m1", F.lit(None).cast("double")), names, "robust", False, masks)


TURTLE = """@prefix ic: <https://interconnectproject.eu/example/> .
@prefix s4ener: <https://saref.etsi.org/saref4ener/> .
ic:{name} a s4ener:Device ;
    ic:hasParentSerialNumber "{serial}" .
"""


def test_device_headers(spark, tmp_path):
    places = {"a/one.ttl": ("Sensor_1", "urn:Device:SmartThings:11"), "a/two.ttl": ("Sensor_2", "s2"), "b/three.ttl": ("Sensor_3", "é3")}
    for path, (name, serial) in places.items():
        (tmp_path / "devices" / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "devices" / path).write_text(TURTLE.format(name=name, serial=serial))
    (tmp_path / "devices" / "late.ttl").write_text("# none\n" * 20 + TURTLE.format(name="Late", serial="late"))
    (tmp_path / "devices" / "empty.ttl").write_text("")
    (tmp_path / "devices" / "note.txt").write_text("ic:No a s4ener:Device\n")
    got = {os.path.basename(r.file): (r.device_id, r.parent_serial) for r in triples.device_headers(spark, str(tmp_path / "devices"), filesPerPartition=2).collect()}
    assert got == {"one.ttl": ("ic:Sensor_1", "urn:Device:SmartThings:11"), "two.ttl": ("ic:Sensor_2", "s2"), "three.ttl": ("ic:Sensor_3", "é3"), "late.ttl": (None, None), "empty.ttl": (None, None)}
    index = triples.device_index(triples.device_ids(triples.device_headers(spark, f"file://{tmp_path}/devices")))
    uris = {r.uri: [os.path.basename(f.file) for f in r.files] for r in index.collect()}
    assert uris["https://interconnectproject.eu/example/device_urn:Device:SmartThings:11"] == ["one.ttl"] == uris["https://interconnectproject.eu/example/Sensor_1"]
    wanted = spark.createDataFrame([("https://interconnectproject.eu/example/Sensor_3",)], "uri string")
    assert {r.s for r in triples.read_devices_of(spark, str(tmp_path), wanted).collect()} == {"https://interconnectproject.eu/example/Sensor_3"}
    assert triples.read_devices_of(spark, str(tmp_path), wanted.limit(0)).count() == 0
    assert triples.read_devices(spark, str(tmp_path)).select("s").distinct().count() == 3 and triples.read_devices(spark, str(tmp_path / "nothing")).count() == 0


def test_heads_read_only_heads(spark, tmp_path):
    with open(tmp_path / "large.ttl", "wb") as f:
        f.write(TURTLE.format(name="Large", serial="l").encode() + b"line\n" * 30)
        f.truncate(1 << 30)  # a gigabyte, of which no block is stored
    with open(tmp_path / "endless.ttl", "wb") as f:
        f.truncate(1 << 30)
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "x.ttl").write_text("one\ntwo\nthree")
    got = {os.path.basename(r.file): r for r in heads.read_heads(spark, str(tmp_path), "*.ttl", maxBytes=100_000).collect()}
    assert got["large.ttl"].bytes_read <= 8192 and got["large.ttl"].head.count("\n") == 19
    assert got["endless.ttl"].bytes_read == 100_000
    assert got["x.ttl"].head == "one\ntwo\nthree" and got["x.ttl"].bytes_read == 13
    assert [r.head for r in heads.read_heads(spark, str(tmp_path / "sub" / "x.ttl"), lines=2).collect()] == ["one\ntwo"]
    assert heads.read_heads(spark, str(tmp_path), "*.none").count() == 0
    assert {os.path.basename(r.file) for r in heads.read_heads(spark, str(tmp_path), recursiveFileLookup="false").collect()} == {"large.ttl", "endless.ttl"}
    with pytest.raises(PySparkException):
        heads.read_heads(spark, str(tmp_path / "gone")).collect()


def test_missing_floors_warn(spark, tmp_path):
    (tmp_path / "floor_1_polygons.ttl").write_text(TURTLE.format(name="R", serial="s"))
    with pytest.warns(UserWarning, match="floor_2_polygons"):
        got = triples.read_floors(spark, str(tmp_path), [1, 2], "polygons")
    assert {r.floor for r in got.collect()} == {1}


def test_snapshots(spark):
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    lists = [[("t", 0, "b"), ("t", 1, "a"), ("u", 0, "x")], [("t", 0, "c"), ("t", 1, "b"), ("t", 2, None)], [("t", 0, None), ("u", 0, "x")]]
    rooms = [[("r1", 1, 5.0), ("r2", 1, None)], [("r1", 2, None)], []]
    made = [{"property_types": frame(a, "property_type string, seq int, item string"), "rooms": frame(b, "room_uri string, floor_number int, area double")} for a, b in zip(lists, rooms, strict=True)]
    made[1]["sequences"] = frame([("d", "p", 0, 1.5), ("d", "p", 1, 1.5)], "device_uri string, property_type string, seq int, value double")
    made.append({"sequences": frame([("d", "p", 0, 0.5), ("e", "p", 0, 9.0)], "device_uri string, property_type string, seq int, value double")})
    got = snapshots.merged(made)
    assert sorted(map(tuple, got["property_types"].collect()), key=repr) == sorted([("t", 0, "b"), ("t", 1, "a"), ("t", 2, "c"), ("t", 3, None), ("u", 0, "x")], key=repr)
    assert sorted(map(tuple, got["rooms"].collect())) == [("r1", 2, None), ("r2", 1, None)]
    assert sorted(map(tuple, got["sequences"].collect())) == [("d", "p", 0, 1.5), ("d", "p", 1, 1.5), ("d", "p", 2, 0.5), ("e", "p", 0, 9.0)]
    short = {r.property_type: r.item for r in snapshots.as_lists(got["property_types"], ["property_type"], "item").collect()}
    assert short == {"t": ["b", "a", "c", None], "u": ["x"]}
    with pytest.raises(ValueError, match="unknown"):
        snapshots.merged([{"gardens": made[0]["rooms"]}])
    with pytest.raises(ValueError):
        snapshots.loaded([])


def square(x, n=4):
    return [{"x": x + a, "y": b} for a, b in ((0.0, 0.0), (2.0, 0.0), (2.0, 3.0), (0.0, 3.0))][:n]


def test_complete_rooms(spark):
    schema = "room_uri string, floor_number int, points array<struct<x:double,y:double>>, given double"
    good = [("a", 1, square(0.0), 6.5), ("b", 2, square(9.0), 1.0)]
    ok = assembly.complete_rooms(spark.createDataFrame(good, schema))
    assert sorted((r.room_uri, r.area) for r in ok.collect()) == [("a", 6.0), ("b", 6.0)]
    bare = spark.createDataFrame([*good, ("c", 1, square(0.0, 2), 3.0), ("d", 1, None, 2.0)], schema)
    assert sorted((r.room_uri, r.area) for r in assembly.complete_rooms(bare, "given").collect()) == [("a", 6.5), ("b", 1.0)]
    for extra, area, said in ((("c", 1, square(0.0, 2), 3.0), None, "room c has no area"), (("d", 1, square(0.0), None), "given", "room d has no area"), (("e", None, square(0.0), 1.0), None, "room e has no floor")):
        lost = assembly.complete_rooms(spark.createDataFrame([*good, extra], schema), area)
        for job in (lambda: lost.count(), lambda: lost.select("floor_number").collect(), lambda: lost.where("room_uri = 'a'").collect()):  # noqa: B023
            with pytest.raises(PySparkException, match=said):
                job()


def test_block_diagonal(spark):
    rooms = lambda *names: spark.createDataFrame([(n,) for n in names], "room_uri string")
    edges = lambda *rows: spark.createDataFrame(list(rows), "src string, dst string, weight double")
    floors = {1: (rooms("a", "b", "c"), edges(("a", "b", 1.0), ("b", "a", 0.5))), 2: (rooms("d"), edges().limit(0))}
    whole = assembly.block_diagonal(floors, rooms("a", "b", "c", "d"))
    assert sorted(map(tuple, whole.collect())) == [("a", "b", 1.0), ("b", "a", 0.5)]
    for bad, asked, said in (
        (floors, rooms("a", "zz"), "room zz is in no floor's matrix"),
        (floors | {3: (rooms("a"), edges().limit(0))}, rooms("a"), "room a is in several floors' matrices"),
        (floors | {2: (rooms("d"), edges(("d", "a", 1.0)))}, rooms("a"), "an edge of floor 2 ends at a"),
    ):
        with pytest.raises(PySparkException, match=said):
            assembly.block_diagonal(bad, asked).count()
    with pytest.raises(ValueError):
        assembly.block_diagonal({}, rooms("a"))


def test_export_bundle(spark, tmp_path):
    frames, settings = advanced.bundle_of(spark, SF)
    assert settings["feature_names"]["prop_view"] == ["view_mean", "view_has_measurement"] and settings["feature_names"]["device"] == ["embedding_index"]
    sinks.write_metadata(frames, settings, str(tmp_path / "bundle"))
    back, told = sinks.read_metadata(spark, str(tmp_path / "bundle"), list(frames))
    assert told == settings and {k: df.count() for k, df in back.items()} == {k: df.count() for k, df in frames.items()}
    one = back["temporal"].where("node_type = 'prop_click' and bucket_idx = 3").orderBy("node_idx").collect()
    assert [r.node_idx for r in one] == list(range(len(one))) and len(one) > 1
    none = graph_tables.temporal_nodes({k: v for k, v in graph_tables.type_numbers(graph_tables.node_maps(t.rooms(spark, SF), t.devices(spark, SF), t.property_level(spark, SF)), []).items()}, t.spine(spark), t.device_level(spark, SF), t.consumption(spark, SF), t.hours(spark), ["mean"])
    assert {r.node_type for r in none.select("node_type").distinct().collect()} == {"outside", "time"}
    sinks.write_settings(spark, {"rate": 0.1, "name": "x"}, str(tmp_path / "args"))
    assert sinks.read_settings(spark, str(tmp_path / "args")) == {"rate": 0.1, "name": "x"}


SPACE = {"x": search.Span(-4.0, 4.0), "k": search.Span(1, 9, whole=True), "r": search.Span(1e-4, 1.0, log=True), "c": search.Choice(("red", "blue"))}


def bowl(params, fold):
    return (params["x"] - 1) ** 2 + abs(params["k"] - 3) + abs(math.log10(params["r"]) + 2) + (params["c"] == "red") + fold / 100


def test_search_is_repeatable_and_stops_poor_trials():
    fits = []

    def counted(params, fold):
        fits.append(fold)
        return bowl(params, fold)

    found = search.run_trials(SPACE, [0, 1, 2, 3], counted, 40, seed=5)
    assert found == search.run_trials(SPACE, [0, 1, 2, 3], bowl, 40, seed=5)
    assert found == search.run_trials(SPACE, [0, 1, 2, 3], bowl, 40, seed=5, before=found[:17])
    assert found != search.run_trials(SPACE, [0, 1, 2, 3], bowl, 40, seed=6)
    assert len(fits) < 4 * 40 and {t.state for t in found} == {"whole", "stopped"} and all(len(t.errors) == 4 for t in found if t.state == "whole")
    for trial in found:
        p = trial.params
        assert -4 <= p["x"] <= 4 and p["k"] in range(1, 10) and 1e-4 <= p["r"] <= 1 and p["c"] in ("red", "blue")


def test_search_beats_even_draws():
    best = lambda rules, seed: min(t.value for t in search.run_trials(SPACE, [0], bowl, 40, seed, rules))
    ours, even = (np.mean([best(search.Rules(startup=s), seed) for seed in range(12)]) for s in (5, 1000))
    assert ours < 0.8 * even


def test_median_rule():
    whole = [search.Trial(k, {}, [float(k), float(k)]) for k in range(5)]
    assert search.poor(search.Trial(9, {}, [2.5]), whole) and not search.poor(search.Trial(9, {}, [2.0]), whole)
    assert not search.poor(search.Trial(9, {}, [9.0]), whole[:4]) and not search.poor(search.Trial(9, {}, [9.0]), whole, search.Rules(warmup=2))
    with pytest.raises(ValueError):
        search.Span(0.0, 1.0, log=True)


def test_search_on_spark(spark):
    rnd = random.Random(3)
    rows = [(b, x := rnd.random(), 3 * x + rnd.random() / 10) for b in range(8) for _ in range(20)]
    df = spark.createDataFrame(rows, "block_id int, x double, y double")
    table = splits.BlockSplitter(list(range(8)), stratum=4, seed=1).table(spark)
    space = {"rounds": search.Span(1, 3, whole=True), "depth": search.Span(1, 2, whole=True)}
    got = search.search(df, table, [0, 1], ["x"], "y", space, number=4, seed=2, rules=search.Rules(startup=2))
    trials = got.collect()
    assert len(trials) == 4 and trials[0].value == min(r.value for r in trials if r.state == "whole") and all(math.isfinite(r.value) for r in trials)
    assert [t.params for t in search.read_trials(got)][:2] == [search.propose(space, [], random.Random(f"2-{k}")) for k in range(2)]
    assert {len(r.errors) for r in trials} <= {1, 2}


def test_moving_averages_across_chunks(spark, monkeypatch):
    """As a rolling mean over the sorted table, wherever chunks end."""
    rnd = random.Random(4)
    rows = [(b, f"r{r}", b * 10 + k, None if rnd.random() < 0.2 else float(rnd.randrange(50))) for b in range(4) for r in range(3) for k in range(rnd.randrange(2, 9))]
    df = spark.createDataFrame(rows, "block_id int, room_uri string, bucket_idx int, v double").repartition(3)
    table = pd.DataFrame(sorted(rows), columns=["block_id", "room_uri", "bucket_idx", "v"])
    shifted = table.groupby(["block_id", "room_uri"])["v"].shift(1)
    for chunk in (1, 5, 1 << 16):
        monkeypatch.setattr(windows, "CHUNK", chunk)
        got = windows.moving_averages(df, [2, 6], 1, ["v"], ["room_uri"], across_blocks=True).orderBy("block_id", "room_uri", "bucket_idx").toPandas()
        assert list(got.columns) == ["block_id", "room_uri", "bucket_idx", "v", "v_ma_2_sh1", "v_ma_6_sh1"]
        for w in (2, 6):
            assert np.allclose(got[f"v_ma_{w}_sh1"].astype(float), shifted.rolling(w, min_periods=1).mean(), equal_nan=True)


def test_top_with_ties(spark):
    top = lambda values, n: sorted((r.place, r.v) for r in metrics.top_keep_ties(spark.createDataFrame([(v,) for v in values], "v double"), "v", n).collect())
    assert top([1.0, 5.0, 5.0, 3.0, 3.0, 2.0], 3) == [(1, 5.0), (1, 5.0), (3, 3.0), (3, 3.0)]
    assert top([1.0, None], 1) == [(1, 1.0)] and top([], 3) == []
    few = metrics.top_keep_ties(spark.createDataFrame([(2.0,), (None,), (None,)], "v double"), "v", 2).collect()
    assert sorted((r.place, r.v is None) for r in few) == [(1, False), (2, True), (2, True)]


def test_least_weights_and_far_rooms(spark):
    rooms = t.rooms(spark, SF)
    every = {(r.src, r.dst): r.weight for r in adjacency.vertical(rooms, weighted=True, min_weight=0.2).collect()}
    some = {(r.src, r.dst): r.weight for r in adjacency.vertical(rooms, weighted=True).collect()}
    floor = {r.room_uri: r.floor_number for r in rooms.collect()}
    assert {k: v for k, v in every.items() if k in some} == some and all(v == 0.2 for k, v in every.items() if k not in some)
    assert every.keys() == {(a, b) for a in floor for b in floor if abs(floor[a] - floor[b]) == 1}


def test_histories_and_masks(spark):
    df = spark.createDataFrame([(0, 0, 1.0, 1), (0, 1, None, 0), (0, 2, 3.0, 1), (1, 3, 4.0, 0)], "block_id int, bucket_idx int, v double, is_workhour int")
    first = {r.bucket_idx: ([x.v for x in r.history], r.padded) for r in windows.histories(df, ["v"], 3, 0, replicate=True).collect()}
    assert first == {0: ([1.0, 1.0, 1.0], 2), 1: ([1.0, 1.0, None], 1), 2: ([1.0, None, 3.0], 0), 3: ([4.0, 4.0, 4.0], 2)}
    zeros = {r.bucket_idx: [x.v for x in r.history] for r in windows.histories(df, ["v"], 3, 1).collect()}
    assert zeros == {0: [0.0, 0.0, 1.0], 1: [0.0, 1.0, None], 2: [1.0, None, 3.0], 3: [0.0, 0.0, 4.0]}
    assert [r.v_mask for r in windows.masks_from(df, ["v"], F.col("is_workhour")).orderBy("bucket_idx").collect()] == [1.0, 0.0, 1.0, 0.0]
    wide = df.withColumns({"b": F.lit(1), "a": F.lit(1), "target_h_1": F.lit(1.0), "mask_h_1": F.col("is_workhour")})
    assert windows.feature_columns(wide) == ["a", "b", "is_workhour", "v"]
    hours = df.select("bucket_idx", "is_workhour")
    kept = forecast.prepared(df.select("block_id", "bucket_idx", F.col("bucket_idx").cast("double").alias("v")), "v", [1], hours=hours, drop_outside_hours=True)
    assert [r.bucket_idx for r in kept.collect()] == [1]  # of the others the next row is none, or outside work hours


def test_levels_put_together(spark, tmp_path):
    device = t.device_level(spark, SF)
    listed = levels.clean_anomalies(device, period=None, buckets=[3, 4], clear_high_counts=False)
    assert listed.where("bucket_idx in (3, 4) and (mean is not null or count > 0 or has_measurement > 0)").count() == 0
    assert listed.where("mean is not null").count() == device.where("mean is not null and bucket_idx not in (3, 4)").count()
    kept = levels.with_rooms(levels.drop_high_missingness(device, 0.9), t.devices(spark, SF), t.rooms(spark, SF))
    by_floor = kept.groupBy("floor_number").agg(F.countDistinct("device_uri").alias("n"))
    assert 0 < sum(r.n for r in by_floor.collect()) <= 15
    sinks.write_level(listed, str(tmp_path / "level"), ["property_type"])
    assert spark.read.parquet(str(tmp_path / "level")).count() == device.count()
    runs = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 2.0)], "name string, mae double")
    assert {r["name"]: (r.mae_mean, r.mae_std) for r in metrics.summary(runs, ["name"], ["mae"]).collect()} == {"a": (2.0, math.sqrt(2)), "b": (2.0, None)}
    table = splits.BlockSplitter(list(range(5)), seed=3).table(spark)
    blocks = {r.block_id for r in table.where("fold = -1 and role = 'test'").collect()}
    assert {r.block_id for r in splits.part(t.series(spark, SF), table, -1, "test").select("block_id").distinct().collect()} <= blocks and len(blocks) == 1


SENSOR = """@prefix ic: <https://interconnectproject.eu/example/> .
@prefix saref: <https://saref.etsi.org/core/> .
@prefix s4ener: <https://saref.etsi.org/saref4ener/> .
ic:{name} a s4ener:Device ;
    saref:hasModel "m-{name}" .
ic:property_{name} a saref:Temperature .
{readings}
"""
READING = "ic:{name} saref:makesMeasurement ic:{name}_{k} .\nic:{name}_{k} saref:hasTimestamp \"2022-03-07T1{k}:00:00\" ; saref:hasValue \"{v}\" ; saref:relatesToProperty ic:property_{name} ."


def building_folder(tmp_path):
    """Two floors with two rooms each; a sensor in each room, one that two floors claim, and one on a third floor."""
    p = triples.PREFIXES
    place = []
    for floor, rooms in ((1, ("a", "b")), (2, ("c", "d")), (3, ("e",))):
        lines = []
        for k, r in enumerate(rooms):
            uri, shape = f"<urn:roomname_{r}>", f"<urn:roomname_{r}/outline>"
            wkt = f"POLYGON Z(({k * 5} 0 {floor}, {k * 5 + 4} 0 {floor}, {k * 5 + 4} 3 {floor}, {k * 5} 3 {floor}, {k * 5} 0 {floor}))"
            lines += [f"{uri} a <{p['s4bldg']}BuildingSpace> .", f"{uri} <{p['s4bldg']}isSpaceOf> <urn:floor_{floor}> .", f"{uri} <{p['ex-ont']}hasDocumentGeometry> {shape} .", f'{shape} <{p["geosparql"]}asWKT> "{wkt}" .']
            place.append(f"{uri} <{p['s4bldg']}contains> <{p['ic']}S{r}> .")
        (tmp_path / f"floor_{floor}_polygons.ttl").write_text("\n".join(lines))
        (tmp_path / f"floor_{floor}_enrichment.ttl").write_text("" if floor > 1 else f"<urn:roomname_a> <{p['ex-ont']}hasWindow> <urn:w> .\n<urn:w> <{p['ex-ont']}hasFacingDirection> 90 ; <{p['ex-ont']}facingRelativeDirection> \"front\" .")
    place += [f"<urn:roomname_{r}> <{p['s4bldg']}contains> <{p['ic']}Twice> ." for r in "ac"]
    (tmp_path / "devices_in_rooms.ttl").write_text("\n".join(place))
    for name in ("Sa", "Sb", "Sc", "Sd", "Se", "Twice"):
        (tmp_path / "devices" / name[0]).mkdir(parents=True, exist_ok=True)
        (tmp_path / "devices" / name[0] / f"{name}.ttl").write_text(SENSOR.format(name=name, readings="\n".join(READING.format(name=name, k=k, v=k + 0.5) for k in range(3))))
    return str(tmp_path)


def test_building_out_of_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    folder = building_folder(tmp_path / "in")
    both = building.read_building(spark, folder, [1, 2])
    assert {r.room_uri[-1]: (r.floor_number, len(r.points), r.has_front_windows) for r in both["rooms"].collect()} == {"a": (1, 4, True), "b": (1, 4, False), "c": (2, 4, False), "d": (2, 4, False)}
    assert {(r.device_uri.rsplit("/", 1)[1], r.room_uri[-1], r.model) for r in both["devices"].collect()} == {(f"S{r}", r, f"m-S{r}") for r in "abcd"}
    assert both["measurements"].count() == 12 and both["property_types"].count() == 4
    assert [(r.seq, r.value) for r in both["sequences"].where("device_uri like '%Sc'").orderBy("seq").collect()] == [(1, 0.5), (2, 1.5), (3, 2.5)]
    assert {r["name"]: r.rows for r in building.metadata(both).collect()} == {"floors": 2, "rooms": 4, "devices": 4, "measurements": 12, "property_types": 4, "sequences": 12}
    one = building.read_building(spark, folder, [1])  # a device that no other floor read holds is on it
    assert {r.device_uri.rsplit("/", 1)[1] for r in one["devices"].collect()} == {"Sa", "Sb", "Twice"}
    building.write_floors(spark, folder, [1, 2], str(tmp_path / "out"))
    loaded = building.load_floors(spark, str(tmp_path / "out"), [1, 2])
    assert loaded["rooms"].count() == 4 and loaded["floors"].count() == 2 and loaded["devices"].where("device_uri like '%Twice'").count() == 1
    # the sequence of the device that both floors hold by themselves is there twice, one after the other
    twice = loaded["sequences"].where("device_uri like '%Twice'").orderBy("seq").collect()
    assert [r.seq for r in twice] == list(range(6)) and [r.value for r in twice] == [0.5, 1.5, 2.5] * 2
    assert sorted(r.seq for r in loaded["property_types"].collect()) == list(range(5))
    with pytest.warns(UserWarning, match="floor_9"):
        assert building.read_triples(spark, folder, [9]).count() == 0


def test_recorded_tables_can_be_deleted(spark):
    with session.recorded() as outer:
        kept = session.stash(spark.range(3), "kept")
        with session.recorded() as inner:
            session.stash(spark.range(4), "gone")
    after = session.stash(spark.range(5), "after")
    assert len(outer) == len(inner) == 1 and outer[0] is kept
    session.unstash(*inner)
    assert not triples.there(spark, inner[0]._stashed) and kept.count() == 3 and after.count() == 5
    session.unstash(*inner, kept, after)


def test_reports_of_tasks(spark):
    one = spark.createDataFrame([(1, 5.0, 4.0, 4.0), (2, 9.0, 9.5, 9.0), (2, 400.0, 300.0, 100.0)], "horizon int, y double, p double, source double")
    got = {(r.scope, r.horizon, r.strategy, r.category, r.bin_label): r.n for r in results.report("measurement_forecast", one, "CO2Level").collect()}
    assert got[("overall", None, None, None, None)] == 3 and got[("per_horizon", 2, None, None, None)] == 2
    assert got[("binned", 2, "hardcoded", "Positive", "+(> 250)")] == 1 == got[("binned", 2, "hardcoded", "Overall", "(0 - 10)")]
    assert got[("binned", 1, "hardcoded", "Positive", "+(0 - 10)")] == 1 and not any(k[1] == 1 and k[2] == "std" for k in got)  # one row has no deviation
    assert got[("binned", None, "std", "Overall", "(1.0std - 3.0std)")] == 1 and got[("binned", None, "std", "Overall", "(0.0std - 0.1std)")] == 2
    assert {r.scope for r in results.report("consumption_forecast", one).collect()} == {"overall", "per_horizon"} == {r.scope for r in results.report("measurement_forecast", one, "Humidity").collect()}
    labels = spark.createDataFrame([(1, 0.9), (0, 0.2), (0, 0.6), (1, 0.7), (0, 0.1)], "y int, p double")
    best = results.report("workhour_classification", labels).first()
    assert (best.threshold, best.accuracy, best.majority_accuracy, best.roc_auc) == (0.7, 1.0, 0.6, 1.0) and math.isclose(best.improvement, 200 / 3)
    assert results.report("workhour_classification", labels, threshold=0.5).first().fp == 1
    with pytest.raises(ValueError, match="gardening"):
        results.report("gardening", one)
    trials = spark.createDataFrame([("a", 1, 3.0), ("a", 0, 5.0), ("a", 2, 3.0), ("b", 0, None), ("b", 1, 1.0)], "study string, trial int, value double")
    assert [(r.trial, r.best) for r in results.history(trials).where("study = 'a'").orderBy("trial").collect()] == [(0, 5.0), (1, 3.0), (2, 3.0)]
    assert {(r.study, r.trial) for r in results.champions(trials).collect()} == {("a", 1), ("b", 1)} and results.champions(trials, minimise=False).where("study = 'a'").first().trial == 0


# --- rooms in cells
def scattered(spark, n=60):
    """Boxes and Ls of three floors."""
    rnd = random.Random(8)
    rows = []
    for k in range(n):
        x, y, w, h = rnd.randrange(60), rnd.randrange(40), rnd.randrange(3, 12), rnd.randrange(3, 9)
        pts = [(x, y), (x + w, y), (x + w, y + h), (x, y + h)] if k % 3 else [(x, y), (x + w, y), (x + w, y + h / 2), (x + w / 2, y + h / 2), (x + w / 2, y + h), (x, y + h)]
        rows.append((f"r{k}", rnd.randrange(3), [{"x": float(a), "y": float(b)} for a, b in pts]))
    return spark.createDataFrame(rows, "room_uri string, floor_number int, points array<struct<x: double, y: double>>")


def refused():
    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        raise ValueError("two boxes need no Arrow function")

    return run


def test_vertical_joins_on_cells(spark, monkeypatch):
    from sensorium.functions import geometry

    rooms = scattered(spark)
    both = {(a, b): x for (a, fa, p) in rooms.collect() for (b, fb, q) in rooms.collect() if abs(fa - fb) == 1 and (x := geometry.overlap_area(geometry.ring(p), geometry.ring(q))) > 0.05}
    area = {r.room_uri: r.a for r in rooms.select("room_uri", geometry.area(F.col("points")).alias("a")).collect()}
    got = {(r.src, r.dst): r.weight for r in adjacency.vertical(rooms, weighted=True).collect()}
    assert both and got.keys() == both.keys() and all(abs(got[k] - v / area[k[0]]) < 1e-9 for k, v in both.items())
    monkeypatch.setattr(geometry, "polygon_overlap", refused())
    up = adjacency.vertical(rooms.where("size(points) = 4"))
    assert up.count() and "cx" in up._jdf.queryExecution().optimizedPlan().toString()  # not all pairs of two floors


def test_horizontal_of_boxes_is_an_expression(spark, monkeypatch):
    from sensorium.functions import geometry

    rooms = scattered(spark)
    near = {(a, b) for (a, fa, p) in rooms.collect() for (b, fb, q) in rooms.collect() if a != b and fa == fb and geometry.ring_distance(geometry.ring(p), geometry.ring(q)) <= 5}
    assert near and {(r.src, r.dst) for r in adjacency.horizontal_binary(rooms).collect()} == near
    monkeypatch.setattr(geometry, "polygon_distance", refused())
    assert adjacency.horizontal_binary(rooms.where("size(points) = 4")).count()


def test_reached_makes_no_edges(spark, monkeypatch):
    rooms = scattered(spark)
    seeds = rooms.where("room_uri in ('r0', 'r31')")
    edges = adjacency.combined(adjacency.horizontal_binary(rooms), adjacency.vertical(rooms))
    for rounds in (1, 3, None):
        plain = {r.room_uri: r.activation_step for r in adjacency.propagation(edges, seeds, rounds).collect()}
        assert {r.room_uri: r.activation_step for r in adjacency.reached(rooms, seeds, rounds).collect()} == plain
    assert max(plain.values()) > 2
    monkeypatch.setattr(adjacency, "horizontal_binary", None)
    monkeypatch.setattr(adjacency, "vertical", None)
    assert advanced.many_rooms_reached(spark, "/root/testdata/sf0.01").count() == 35


# --- labels of one class
@pytest.mark.parametrize("name", ["classification_metrics", "ranking_metrics", "classification_scores"])
@pytest.mark.parametrize("value", [500.0, 1.0])
def test_scores_of_one_class_as_in_sql(spark, tmp_path, name, value):
    import duckdb

    from sensorium.plans.registry import QUERIES, SQL

    path = f"{tmp_path}/events.parquet"
    duck = duckdb.connect()
    duck.execute(f"COPY (SELECT TIMESTAMP '2024-01-01' + INTERVAL 6 HOUR * i AS ts, u AS user_id, 'click' AS event_type, {value} + i AS value FROM range(12) r(i), range(3) s(u)) TO '{path}'")
    duck.execute(f"CREATE VIEW events AS SELECT * FROM '{path}'")
    got, want = QUERIES[name](spark, str(tmp_path)).first().asDict(), duck.execute(SQL[name]).fetchall()[0]
    names = [c[0] for c in duck.description]
    assert any(isinstance(v, float) and math.isnan(v) for v in want)
    assert [repr(float(got[n])) for n in names] == [repr(float(v)) for v in want]


@pytest.mark.parametrize("name", ["kendall_by_device", "kendall_by_bucket"])
def test_ranks_need_no_grid(spark, monkeypatch, name):
    whole = getattr(advanced, name)(spark, SF).collect()
    monkeypatch.setattr(levels, "device_grid", None)
    assert getattr(advanced, name)(spark, SF).collect() == whole


def test_typed_nodes_need_no_grid(spark, monkeypatch):
    monkeypatch.setattr(levels, "device_grid", None)
    rows = advanced.typed_nodes(spark, SF).where("node_type like 'prop%'").collect()
    assert len(rows) == len({(r.bucket_idx, r.node_type, r.node_idx) for r in rows}) and {r.x1 for r in rows} == {0.0, 1.0}
    assert all((r.x0 is None) == (r.x1 == 0) for r in rows)
