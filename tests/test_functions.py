"""Filters, casts, projection, text formats and the change stream on small rows."""

import pytest
from pyspark.sql import functions as F

from chronoterra.functions import columns, cql2
from chronoterra.operators import governance, grids, linear, network
from chronoterra.sources import text_formats
from chronoterra.streaming import change_feed


@pytest.fixture
def rows(spark):
    data = [
        (1, '{"n": 5, "s": "ab"}', 0.5, 0.5),
        (2, '{"n": "5", "s": null}', 1.5, 0.5),
        (3, '{"n": " 5 ", "s": "b%"}', 0.5, 3.0),
        (4, None, None, None),
    ]
    return spark.createDataFrame(data, "id int, properties string, lng double, lat double")


def ids(df, node):
    return [r.id for r in df.filter(cql2.to_column(node)).orderBy("id").collect()]


P = {"property": "n"}
S = {"property": "s"}
SQUARE = {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 1], [0, 0]]]}


@pytest.mark.parametrize(
    ("node", "want"),
    [
        ({"op": "=", "args": [P, 5]}, [1, 2]),
        ({"op": "eq", "args": [P, "5"]}, [1, 2]),
        ({"op": ">", "args": [P, 5]}, []),
        ({"op": "between", "args": [P, 4, 6]}, [1, 2]),
        ({"op": "isNull", "args": [S]}, [2, 4]),
        ({"op": "in", "args": [S, ["ab", "x"]]}, [1]),
        ({"op": "in", "args": [S, []]}, []),
        ({"op": "like", "args": [S, "%b"]}, [1]),
        ({"op": "not", "args": [{"op": "isNull", "args": [S]}]}, [1, 3]),
        ({"op": "and", "args": [{"op": "=", "args": [P, 5]}, {"op": "s_intersects", "args": [{"property": "geometry"}, SQUARE]}]}, [1]),
        ({"op": "or", "args": [{"op": "=", "args": [S, "ab"]}, {"op": "=", "args": [S, "b%"]}]}, [1, 3]),
    ],
)
def test_cql2(rows, node, want):
    assert ids(rows, node) == want


@pytest.mark.parametrize("node", [{}, {"op": "near", "args": []}, {"op": "=", "args": ["n", 1]}, {"op": "and", "args": []}, {"op": "between", "args": [P, "a", "b"]}])
def test_bad_filters_are_refused(node):
    with pytest.raises(cql2.FilterError):
        cql2.to_column(node)


def test_guarded_cast(spark):
    data = [("5",), ("-1.5e3",), (" 5",), ("NaN",), ("",), (None,)]
    got = [r.x for r in spark.createDataFrame(data, "t string").select(columns.number(F.col("t")).alias("x")).collect()]
    assert got == [5.0, -1500.0, None, None, None, None]


def test_mercator_and_back(spark):
    x, y = columns.mercator(F.lit(10.0), F.lit(50.0))
    r = spark.range(1).select(*columns.inverse_mercator(x, y)).first()
    assert r[0] == pytest.approx(10.0) and r[1] == pytest.approx(50.0)


def test_distance_to_nowhere_is_null(spark):
    n = F.lit(None).cast("double")
    assert spark.range(1).select(columns.haversine(n, F.lit(0.0), F.lit(1.0), F.lit(1.0))).first()[0] is None


def test_events_along_a_route(spark):
    route = spark.createDataFrame([(1, 1, 0.0, 0.0), (1, 2, 0.0, 1.0), (1, 3, None, 5.0), (1, 4, 0.0, 1.0), (1, 5, 0.0, 3.0)], "route int, seq int, lng double, lat double")
    degree = 2 * 3.141592653589793 * columns.EARTH_RADIUS / 360
    assert [r.measure / degree for r in linear.measured(route).orderBy("seq").collect()] == pytest.approx([0, 1, 1, 3])
    data = [(1, "start", 0.0), (1, "half", 0.5 * degree), (1, "late", 2.0 * degree), (1, "off", 9e9), (1, "below", -1.0), (1, "none", None), (2, "nowhere", 1.0)]
    events = spark.createDataFrame(data, "route int, event string, measure double")
    got = {r.event: r.lat for r in linear.locate_along(route, events).collect()}
    assert got == {"start": pytest.approx(0), "half": pytest.approx(0.5), "late": pytest.approx(2.0)}


def test_grids_at_their_edges(spark):
    points = spark.createDataFrame([(1, 180.0, -90.0), (2, -180.0, 90.0), (3, None, 0.0)], "feature_id int, lng double, lat double")
    assert sorted((r.feature_id, r.tx, r.ty) for r in grids.tile_points(points, 3).collect()) == [(1, 7, 7), (2, 0, 0)]
    around = grids.grid_disk(spark.createDataFrame([(0,)], "cell long"), 2, 1).collect()
    assert sorted(r.neighbour for r in around) == [0, 1, 3, 4, 5, 7]
    values = grids.raster_values(points, spark.createDataFrame([(1, 2, 5.0)], "zoom int, cell long, value double"), [0, 1])
    assert {r.feature_id: r.value for r in values.collect()} == {1: None, 2: 5.0, 3: None}


def test_trace_access_and_schema(spark, rows):
    edges = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (3, 1, 1.0), (3, 4, 1.0)], "from_id int, to_id int, cost double")
    assert {r.id: r.depth for r in network.trace(edges, 1, 2).collect()} == {1: 0, 2: 1, 3: 2}
    assert {r.id for r in network.trace(edges, 4, direction="upstream").collect()} == {1, 2, 3, 4}
    branches = spark.createDataFrame([("a", "d"), ("b", "d")], "branch string, dataset string")
    of = lambda k, *data: spark.createDataFrame(list(data), f"{k} string, user string, permission string")
    got = governance.access_levels(branches, of("dataset", ("d", "u", "write"), ("d", "u", "read")), of("branch", ("b", "v", "admin"), ("b", "w", "odd")))
    assert {(r.branch, r.user): r.level for r in got.collect()} == {("a", "u"): 2, ("b", "v"): 3, ("b", "w"): 0}
    found = governance.schema_errors(rows.withColumnRenamed("id", "feature_id"), [{"name": "n", "type": "number", "max": 4, "required": True}, {"name": "s", "allowed": ["ab"]}])
    assert sorted(map(tuple, found.collect())) == [(1, "n", "max"), (2, "n", "max"), (3, "n", "type"), (3, "s", "allowed"), (4, "n", "required")]
    assert governance.property_search(rows, "s", "B%").count() == 1


def test_text_formats_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("a", '{"k":"v"}', 1.5, 2.5)], "feature_id string, properties string, lng double, lat double")
    line = text_formats.geojson_lines(rows).first()[0]
    (tmp_path / "f.json").write_text('{"type":"FeatureCollection","features":[' + line + "]}")
    back = text_formats.read_geojson(spark, str(tmp_path / "f.json")).first()
    assert (back.id, back.lng, back.lat) == ("a", 1.5, 2.5)
    (tmp_path / "f.csv").write_text("name,lon,lat\nx,1,2\ny,,3\n")
    assert [(r.lng, r.lat) for r in text_formats.read_csv(spark, str(tmp_path / "f.csv")).collect()] == [(1.0, 2.0)]


def test_stream_keeps_the_newest_version(spark, tmp_path):
    schema = "feature_id long, created_at long, version_id long, v string"
    for i, data in enumerate(([(1, 1, 1, "old"), (2, 1, 2, "two")], [(1, 2, 3, "new")])):
        spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    stream = change_feed.latest_per_feature(change_feed.read_log(spark, str(tmp_path / "log"), schema))
    q = stream.writeStream.format("memory").queryName("latest").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(120)
    assert sorted((r.feature_id, r.v) for r in spark.table("latest").collect()) == [(1, "new"), (2, "two")]


def test_within_has_no_sides(spark):
    shape = {"type": "Polygon", "coordinates": [[[-8, -2], [8, -2], [0, 6], [-8, 6], [-8, -2]]]}
    rows = spark.createDataFrame([(1, -8.0, 1.0), (2, 3.0, 3.0), (3, 0.0, 0.0), (4, -8.0, -2.0), (5, -7.0, 6.0), (6, 0.0, -2.0), (7, 2.5, 3.0)], "feature_id long, lng double, lat double")
    found = rows.filter(cql2.to_column({"op": "s_within", "args": [{"property": "geometry"}, shape]}))
    assert sorted(r.feature_id for r in found.collect()) == [3, 6, 7]  # a level lower edge belongs to the polygon
