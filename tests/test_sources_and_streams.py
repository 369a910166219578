import json
from datetime import datetime, timedelta

from tidemark.sources import feeds
from tidemark.streaming import messages as M

T0 = datetime(2024, 1, 1)


def bodies(spark, *values):
    return spark.createDataFrame([(v if isinstance(v, str) else json.dumps(v, ensure_ascii=False),) for v in values], "body string")


def test_an_alert_is_parsed_once(spark, small):
    """The last one of a field that comes twice counts, as in a parser of whole objects; bodies are dealt to all tasks."""
    from tidemark.plans import rule_queries

    rows = feeds.alert_snapshot(spark.createDataFrame([('[{"id": "1", "id": "2", "alerts": [{"type": "A", "type": "B"}]}]',), ("[7]",), (None,)], "body string"))
    assert [(r.location_key, r.alert_type, r.active) for r in rows.collect()] == [("2", "b", True)]
    assert rule_queries.feed_alerts(spark, small).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_alert_snapshots_of_every_shape(spark):
    region = {"regionId": 7, "regionName": "Сумська", "activeAlerts": [{"type": "AIR", "lastUpdate": "2024-01-01T00:00:00Z"}, {"type": "ARTILLERY", "active": False}]}
    flat = {"id": "9", "name": "Київ", "status": "Ongoing", "parent_name": " Область "}
    got = feeds.alert_snapshot(bodies(spark, [region], {"states": [flat]}, {"alerts": [flat]}, {"data": [region, {"x": 1}, 5]}, "not json", {"other": []}, None or "null")).collect()
    assert sorted((r.location_key, r.alert_type, r.active) for r in got) == [("7", "air", True)] * 2 + [("7", "artillery", False)] * 2 + [("9", "air", True)] * 2
    assert {r.parent_name for r in got if r.location_key == "9"} == {"Область"}
    assert all(r.started_at == T0 for r in got if r.location_key == "7" and r.alert_type == "air") and len({r.external_id for r in got}) >= 3


def test_maps(spark):
    rows = feeds.PARSERS["region_map"](bodies(spark, {"1": {"alert": True, "districts": [{"name": "a", "alert": True}], "community": [{"name": "b", "alert": False}]}, "2": {}})).collect()
    assert sorted(tuple(r) for r in rows) == [("1", "district", "a", True), ("1", "hromada", "b", False)]
    assert sorted(tuple(r) for r in feeds.name_map(bodies(spark, {"x": "active", "y": "none"})).collect()) == [("x", True), ("y", False)]


def test_fresh_bodies(spark):
    df = spark.createDataFrame([(i, T0 - timedelta(seconds=s)) for i, s in enumerate((0, 60, 61, -1))], "i int, cached_at timestamp")
    assert [r.i for r in feeds.fresh_bodies(df, T0, 60).orderBy("i").collect()] == [0, 1]


def test_geojson(spark):
    square = [[[0, 0], [1, 0], [1, 1], [0, 0]]]
    body = {"features": [{"properties": {"name": "a"}, "geometry": {"type": "Polygon", "coordinates": square}}, {"properties": {}, "geometry": {"type": "MultiPolygon", "coordinates": [square, square]}}, {"properties": {}, "geometry": {"type": "Point", "coordinates": [0, 0]}}]}
    got = feeds.geojson_features(bodies(spark, body)).orderBy("n").collect()
    assert [(r.kind, len(r.rings)) for r in got] == [("Polygon", 1), ("MultiPolygon", 2)] and got[0].properties == {"name": "a"} and got[0].rings[0][1] == [1.0, 0.0]


def test_carried_codes(spark):
    df = spark.createDataFrame([("s", 1, "A", None), ("s", 2, None, "b"), ("s", 3, None, None), ("s", 4, "C", None)], "sheet string, n int, first string, second string")
    assert [(r.first, r.second) for r in feeds.carried_codes(df, "n", ["first", "second"]).orderBy("n").select("first", "second").collect()] == [("A", None), ("A", "b"), ("A", "b"), ("C", "b")]


SCHEMA = "source_id string, external_id string, text string, published_at timestamp, received_at timestamp"


def rows(*seconds, text="t"):
    return [("s", str(i), text, T0 + timedelta(seconds=s), T0 + timedelta(seconds=s + 3600 * (i % 2))) for i, s in enumerate(seconds)]


def test_stream_dedup_and_idempotent_append(spark, tmp_path):
    source, target = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    spark.createDataFrame(rows(0, 10) + rows(0, 10), SCHEMA).write.parquet(source)
    write = M.idempotent_append(target, ["source_id", "external_id", "content_hash"])
    stream = lambda: M.with_lateness(M.deduplicated(M.message_stream(spark, source, SCHEMA)))
    M.run_available(stream(), f"file://{tmp_path}/ck", write)
    assert sorted((r.external_id, r.late) for r in spark.read.parquet(target).collect()) == [("0", False), ("1", True)]
    M.run_available(stream(), f"file://{tmp_path}/ck-lost", write)  # all over again
    assert spark.read.parquet(target).count() == 2
    spark.createDataFrame(rows(20, 30, 40), SCHEMA).write.mode("append").parquet(source)
    M.run_available(stream(), f"file://{tmp_path}/ck", write)
    assert spark.read.parquet(target).count() == 3


def test_stream_coalescing_keeps_state_between_batches(spark, tmp_path):
    source, target = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    stream = lambda: M.coalesced(M.message_stream(spark, source, SCHEMA), ["source_id"])
    for seconds in ((0, 100, 120), (239, 240)):
        spark.createDataFrame(rows(*seconds), SCHEMA).coalesce(1).write.mode("append").parquet(source)
        M.run_available(stream(), f"file://{tmp_path}/ck", lambda b, _: b.write.mode("append").parquet(target))
    got = spark.read.parquet(target).orderBy("published_at").collect()
    assert [r.kept for r in got] == [True, False, True, False, True]
