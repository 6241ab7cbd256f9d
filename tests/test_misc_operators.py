"""JDBC arguments (S3, S6), metadata snapshot fall-through (S5), type map and
replica schema (K6), cascading facets (F10), channel map (U5, E11)."""

from datetime import datetime

from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorframe import model
from sensorframe.functions.expressions import target_type_name
from sensorframe.operators import facets
from sensorframe.plans import snapshot
from sensorframe.session import work_dir
from sensorframe.sources import jdbc, metadata, schema


def test_jdbc_arguments():
    args = jdbc.jdbc_read_args("jdbc:postgresql://db/x", "nodes_history", [1, 2], ["occupancy"],
                               datetime(2024, 1, 1), datetime(2024, 1, 3), partitions=2)
    assert args["predicates"] == [
        '"timestamp" >= \'2024-01-01 00:00:00.000000\' AND "timestamp" < \'2024-01-02 00:00:00.000000\'',
        '"timestamp" >= \'2024-01-02 00:00:00.000000\' AND "timestamp" < \'2024-01-03 00:00:00.000000\'']
    assert '"ID" IN (1, 2)' in args["table"] and "\"type\" IN ('occupancy')" in args["table"]
    assert args["properties"]["fetchsize"] == "50000"


def test_metadata_snapshot_fall_through(spark):
    root = work_dir(spark, "metasnap")
    src = spark.createDataFrame([(5, "V")], "id long, vanity string")
    # no snapshot -> source; snapshot only -> empty
    assert metadata.load_metadata(spark, src, root + "/meta/v=1").first()["vanity"] == "V"
    assert metadata.load_metadata(spark, src, root + "/none", snapshot_only=True).count() == 0
    snapshot.write_meta(spark, root, spark.createDataFrame([(9, "W")], "id long, vanity string"))
    snap = snapshot.read_meta(spark, root)
    assert snap.first()["id"] == 9


def test_type_map_and_replica_schema(spark):
    rows = [("a", "timestamp without time zone", ""), ("b", "character varying", ""), ("c", "x", "int8"),
            ("d", "numeric", ""), ("e", "decimal(10,2)", ""), ("f", "json", ""), ("g", "timestamp_ntz", ""),
            ("h", "REAL", "")]
    df = spark.createDataFrame(rows, "column_name string, data_type string, udt_name string")
    got = {r[0]: r[1] for r in df.select("column_name", target_type_name("data_type", "udt_name")).collect()}
    assert got == {"a": "TIMESTAMP WITHOUT TIME ZONE", "b": "TEXT", "c": "BIGINT", "d": "NUMERIC",
                   "e": "NUMERIC", "f": "TEXT", "g": "TIMESTAMP WITHOUT TIME ZONE", "h": "REAL"}
    src = spark.createDataFrame([], "ts timestamp_ntz, v double, id bigint, s string")
    described = schema.with_target_types(schema.describe(spark, {"t": src}))
    st = schema.target_schema(described.orderBy("ordinal_position").collect())
    assert [f.dataType for f in st.fields] == [T.TimestampNTZType(), T.DoubleType(), T.LongType(), T.StringType()]


def test_facet_cascade(spark):
    meta = spark.createDataFrame([(1, "ers_eye", "HQ", "1", "West", "D1"), (2, "ers_co2", "HQ", "2", "East", "D2"),
                                  (3, "ems_desk", "B2", "1", "", "D3")], model.META_SCHEMA)
    sel = facets.Selection(building=["HQ"], floor=["1"])
    got = {(r["facet"], r["value"]) for r in facets.facet_options(meta, sel).collect()}
    assert got == {("building", "HQ"), ("building", "B2"), ("floor", "1"), ("floor", "2"), ("area", "West"),
                   ("nodeTypeName", "ers_eye"), ("vanity", "D1")}
    assert facets.facet_count(meta, facets.Selection(building=["HQ"])).first()["n_sensors"] == 2
    assert facets.scope_ids(meta, sel, "all").count() == 3


def test_channels_for_types_fixed_map(spark):
    types = spark.createDataFrame([("ers_co2",), ("ems_desk",), ("unknown",)], "sensor_type string")
    got = sorted(r[0] for r in facets.channels_for_types(types).collect())
    assert got == ["co2", "hum", "occupancy", "tempc"]
    cm = facets.channel_map_frame(spark)
    got2 = sorted(r[0] for r in facets.channels_for_types(types, cm).collect())
    assert got2 == got
    all_channels = sorted(r[0] for r in facets.channels_for_types(
        spark.createDataFrame([(k,) for k in model.SENSOR_CHANNELS], "sensor_type string")).collect())
    assert all_channels == sorted(model.DEFAULT_CHANNELS)


def test_empty_jdbc_lists_read_nothing():
    from sensorframe.sources.jdbc import fact_query
    assert "1 = 0" in fact_query("t", [], ["a"]) and "1 = 0" in fact_query("t", [1], [])
    assert "1 = 0" not in fact_query("t", None, ["a"])


def test_rolling_mean_counts_rows_of_repeated_metadata(spark):
    from datetime import datetime

    from sensorframe.operators.smooth import rolling_mean_dense
    rows = [(datetime(2024, 1, d), float(d - 1), 1, "a", b) for d in (1, 2, 3) for b in ("x", "y")]
    df = spark.createDataFrame(rows, "timestamp timestamp_ntz, value double, ID long, type string, building string")
    got = sorted((r.timestamp.day, round(r.value, 3)) for r in rolling_mean_dense(df, 3, "D").collect())
    assert got == [(1, 0.0), (1, 0.0), (2, 0.333), (2, 0.667), (3, 1.333), (3, 1.667)]
