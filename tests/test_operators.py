"""Rules that the queries over the driver's tables don't reach."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.functions import numbers as N, speech as G, texts as X
from tidemark.functions.folds import ordered_fold
from tidemark.operators import delivery as D, evaluation as E, hierarchy as H, movement as M, places as P, records as W, states as S
from tidemark.params import AnalyticsWindow, hour_band

T0 = datetime(2024, 1, 1)


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_windows():
    w = AnalyticsWindow.resolve(T0)
    assert (w.end - w.start).days == 30 and w.bucket == "day" and w.previous_start == T0 - timedelta(days=60)
    assert AnalyticsWindow.resolve(T0, T0 - timedelta(days=36)).bucket == "week" and AnalyticsWindow.resolve(T0, T0 - timedelta(days=121)).bucket == "month"
    for bad in ({"start": T0}, {"start": T0 - timedelta(days=401)}, {"bucket": "hour"}, {"limit": 0}, {"versions": ("a b",)}):
        with pytest.raises(ValueError):
            AnalyticsWindow.resolve(T0, **bad)
    assert hour_band("next12h", datetime(2024, 7, 1, 22))[:3] == [1, 2, 3]


def test_numbers(spark):
    assert value(spark, N.rounded(F.lit(-2.5), 0)) == -2.0 and value(spark, N.share(F.lit(1), F.lit(0))) == 0.0
    assert value(spark, N.clock_distance(F.lit(23), F.lit(2))) == 3 and value(spark, N.delta_percent(F.lit(3), F.lit(0))) is None
    assert [value(spark, N.plural(F.lit(n), "one", "few", "many")) for n in (1, 2, 5, 11, 12, 21, 22)] == ["one", "few", "many", "many", "many", "one", "few"]


def test_cyclic_tree_ends(spark):
    places = spark.createDataFrame([("a", "b", "city", "A"), ("b", "a", "oblast", "B"), ("c", None, "country", "C")], "id string, parent_id string, type string, name string")
    assert {tuple(r) for r in H.closure(places).collect()} == {("a", "a", 0), ("a", "b", 1), ("b", "b", 0), ("b", "a", 1), ("c", "c", 0)}


def test_upsert_is_monotone(spark):
    old = spark.createDataFrame([(1, T0, "old"), (2, T0, "old")], "k int, at timestamp, v string")
    new = spark.createDataFrame([(1, T0 - timedelta(1), "late"), (2, T0, "equal"), (3, T0, "fresh")], "k int, at timestamp, v string")
    assert {r.k: r.v for r in S.monotone_upsert(old, new, ["k"], "at").collect()} == {1: "old", 2: "equal", 3: "fresh"}
    assert [r.k for r in S.insert_new(old, new.union(new), ["k"]).collect()] == [3]


def test_snapshots(spark):
    rows = spark.createDataFrame([("a", "x", True, T0), ("a", "x", False, T0 - timedelta(1)), ("b", "x", False, T0)], "location_id string, alert_type string, active boolean, started_at timestamp")
    assert {r.location_id: (r.active, r.started_at) for r in S.fold_snapshot(rows).collect()} == {"a": (True, T0), "b": (False, None)}
    later = rows.where("location_id = 'a'").withColumn("location_id", F.lit("c"))
    assert {tuple(r) for r in S.snapshot_changes(rows.dropDuplicates(["location_id"]), later.limit(1)).collect()} == {("a", "x", "missing"), ("b", "x", "missing"), ("c", "x", "appeared")}


def test_promotion_and_freshness(spark):
    e = spark.createDataFrame([("e", "A", "rule", "g1", False), ("e", "B", "rule", "g2", False), ("f", "A", "model", "g1", False), ("f", "C", "rule", "g2", False), ("g", "C", "rule", "g", True)], "event_id string, tier string, origin string, independence_group string, official boolean")
    assert {r.event_id: r.level for r in S.promotion(e).collect()} == {"e": "confirmed", "f": "unverified", "g": "official"}
    s = spark.createDataFrame([(1, True, T0), (2, True, T0 - timedelta(1)), (3, False, T0), (4, True, None)], "id int, enabled boolean, last_success_at timestamp")
    assert {r.id: r.status for r in S.freshness(s, T0 + timedelta(seconds=5), 60).collect()} == {1: "fresh", 2: "stale", 3: "disabled", 4: "never"}


def test_threat_decisions(spark):
    def row(i, level, kind, places, minutes):
        return (1, "e", i, T0 + timedelta(minutes=i), level, kind, places, T0 + timedelta(minutes=minutes))

    rows = [row(0, "monitoring", "uav", ["a"], 30), row(1, "monitoring", "uav", ["a"], 40), row(2, "monitoring", "uav", ["a"], 46), row(3, "confirmed", "uav", ["a"], 46), row(4, "confirmed", "uav", ["a", "b"], 46), row(5, "confirmed", "uav", ["b"], 46), row(6, "confirmed", "mlrs", ["b"], 46)]
    df = spark.createDataFrame(rows, "chat_id int, event_id string, n int, at timestamp, evidence_level string, threat_type string, location_ids array<string>, valid_until timestamp")
    got = [r.action for r in D.threat_decisions(df, "n").orderBy("n").collect()]
    assert got == ["initial", "skip", "soft", "escalation", "change", "skip", "change"]


def test_coalescing_compares_with_the_last_kept_row(spark):
    rows = spark.createDataFrame([(1, i, T0 + timedelta(seconds=s)) for i, s in enumerate((0, 100, 120, 239, 240))], "k int, n int, at timestamp")
    assert [r.kept for r in D.kept_after_coalescing(rows, ["k"], "at", 120, "n").orderBy("n").collect()] == [True, False, True, False, True]


def test_withdrawal_candidates(spark):
    events = spark.createDataFrame([(i, o, s, "unverified", T0 - timedelta(days=i)) for i, (o, s) in enumerate([("model", "active"), ("model", "active"), ("rule", "active"), ("model", "ended"), ("model", "active")])], "event_id int, origin string, status string, evidence_level string, created_at timestamp")
    evidence = spark.createDataFrame([(1, "rule"), (4, "model")], "event_id int, origin string")
    assert [r.event_id for r in E.withdrawal_candidates(events, evidence, T0).collect()] == [4]


def test_geometry(spark):
    lat, lon = M.destination(F.lit(50.0), F.lit(30.0), F.lit(90.0), F.lit(100.0))
    assert value(spark, M.distance_km(F.lit(50.0), F.lit(30.0), lat, lon)) == pytest.approx(100, abs=1e-6)
    assert value(spark, M.bearing(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(-1.0))) == pytest.approx(270)
    assert value(spark, M.angle_between(F.lit(10.0), F.lit(350.0))) == 20
    legs = spark.createDataFrame([(50.0, 30.0, 50.1, 30.0, 600), (50.0, 30.0, 50.0, 30.0, 600), (50.0, 30.0, 51.0, 30.0, 0), (50.0, 30.0, 59.0, 30.0, 60)], "lat1 double, lon1 double, lat2 double, lon2 double, seconds int")
    assert [r.refused for r in M.extrapolated(legs, 10, 1000).collect()] == [None, "no_leg", "no_elapsed", "implausible_speed"]


def test_texts(spark):
    assert value(spark, X.json_block(F.lit('so:\n```json\n{"a": {"b": 1}}\n``` ok'))) == '{"a": {"b": 1}}' and value(spark, X.json_block(F.lit("none"))) is None
    assert value(spark, X.ungrounded_numbers(F.lit("12 of 30, 4.5"), F.array(F.lit("12"), F.lit("4.5")))) == ["30"]
    assert value(spark, X.normalised_name(F.lit(" Кам'янка  Бузька "))) == "камянка бузька"
    assert value(spark, X.rejection(F.lit(False), F.lit(True), F.array(F.lit("uav")), F.array())) == "no_location"
    assert value(spark, X.threat_classes(F.lit(None).cast("string"))) == []


def test_messages_merge_into_the_event_seen_last(spark):
    """Against a loop over all messages with all events."""
    import random

    rng = random.Random(3)
    rows, at = [], T0
    for i in range(400):
        at += timedelta(minutes=rng.choice([0, 1, 3, 29, 30, 31]))
        rows.append((f"m{i:03}", rng.choice("ab"), at, rng.sample("pqrst", rng.randint(1, 2)) if rng.random() < 0.9 else None))
    events, want = [], {}
    for i, kind, t, places in rows:
        near = [e for e in events if e[1] == kind and t - e[2] < timedelta(minutes=30) and e[3] & set(places or ())]
        if near:
            best = max(near, key=lambda e: (e[2], e[0]))
            best[2], want[i] = t, (best[0], False)
            best[3] |= set(places)
        else:
            events.append([i, kind, t, set(places or ())])
            want[i] = (i, True)
    df = spark.createDataFrame(rows, "id string, threat_type string, published_at timestamp, places array<string>")
    got = {r.id: (r.event_key, r.created) for r in W.merged_events(df).collect()}
    assert got == want and 0 < sum(c for _, c in want.values()) < len(rows)
    assert W.merged_events(df.limit(0)).count() == 0


def test_null_is_a_key_of_a_fold(spark):
    df = spark.createDataFrame([(1, 1), (None, 1), (None, 2), (None, 3), (2, 1)], "k long, at int")
    out = ordered_fold(df, ["k"], ["at"], lambda state, row: ((state or 0) + 1, ((state or 0) + 1,)), "n long")
    assert sorted((str(r.k), r.n) for r in out.collect()) == [("1", 1), ("2", 1), ("None", 1), ("None", 2), ("None", 3)]


def test_stances_of_odd_texts(spark):
    """Texts whose clauses matter, nulls and empty ones; a class that is both denied and asserted."""
    rows = lambda t: G.with_stances(spark.createDataFrame([(t,)], "text string"))
    stance = lambda t: rows(t).first().stances
    s = stance("БпЛА не фіксуємо, але БпЛА курсом на Київ")
    assert s.asserted == ["uav"] and s.withdrawn == ["uav"]
    s = stance("БпЛА в Полтавській області на південь звідси, вибухів не зафіксовано")
    assert s.asserted == ["uav"] and s.withdrawn == []
    for t in (None, "", "!!"):
        assert stance(t).asserted == [] and rows(t).select(G.intent(F.col("text"), F.col("stances"))).first()[0] == "none"
    tokens = lambda t: [tuple(x) for x in G.with_tokens(spark.createDataFrame([(t,)], "text string")).first().tokens]
    assert tokens("М'ята 5 x") == [("мята", 0, 5), ("5", 6, 7), ("x", 8, 9)] and tokens("") == tokens(None) == []
    assert tokens("Південно-західний, Івано-Франківськ- -о Зазим´я") == [("південно-західний", 0, 17), ("івано-франківськ", 19, 35), ("о", 38, 39), ("зазимя", 40, 47)]


def test_stances_and_intent_take_any_case(spark, small):
    """Old letters and signs that fold to others too; and sentences are dealt to all tasks, however few bytes they come from."""
    from tidemark.plans import speech_queries

    rows = spark.createDataFrame([("БПЛА НЕ ФІКСУЄМО, АЛЕ KN-23 НА СУМИ",), ("\u212an-23 над \u1c82десою",), ("ЧИСТЕ НЕБО",)], "text string").coalesce(1)
    got = G.with_stances(rows).select("stances", G.intent(F.col("text"), F.col("stances"))).collect()
    assert [tuple(map(tuple, (r[0].asserted, r[0].withdrawn))) + (r[1],) for r in got] == [(("ballistic_missile",), ("uav",), "assertion"), (("ballistic_missile",), (), "assertion"), ((), (), "de_escalation")]
    assert speech_queries.sentences(spark, small).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_lifecycles_of_odd_keys_in_more_tasks_for_more_rows(spark, small, monkeypatch):
    """Null keys meet no withdrawal, keys without a claim have no row; a larger table is sorted in more tasks."""
    from tests.comparing import same
    from tidemark.operators import states
    from tidemark.plans import binding, state_queries

    at = lambda *rows: spark.createDataFrame([(k, n and datetime(2024, 1, n)) for k, n in rows], "k string, at timestamp")
    claims, withdrawals = at(("a", 1), ("a", 3), (None, 1), ("b", 2), ("e", None)), at(("a", 2), ("a", 5), ("a", 4), (None, 9), ("b", 1), ("c", 1), ("b", None))
    for tasks in (None, 20):
        got = {r.k: (r.asserted_at and r.asserted_at.day, r.withdrawn_at and r.withdrawn_at.day) for r in states.lifecycle(claims, withdrawals, ["k"], 60, tasks).collect()}
        assert got == {"a": (3, 4), None: (1, None), "b": (2, None), "e": (None, None)}
    monkeypatch.setattr(binding, "ROWS_PER_TASK", 300)
    query, sql = state_queries.QUERIES["assertion_lifecycle"]
    assert query(spark, small).rdd.getNumPartitions() == -(-binding.load(spark, small, "lineitem").count() // 300) > 8
    same(query, sql, spark, small)


def test_tokens_of_a_long_text_take_time_in_proportion(spark):
    import time

    text = "слово-друге  it's " * 100_000
    began = time.perf_counter()
    (row,) = G.with_tokens(spark.createDataFrame([(text,)], "text string")).select("tokens").collect()
    assert time.perf_counter() - began < 40 and len(row.tokens) == 200_000 and all(t.end - t.start == len(t.key) + (t.key == "its") for t in row.tokens[-4:])
    assert text[row.tokens[-1].start : row.tokens[-1].end] == "it's"


def test_outlines_of_odd_rings(spark):
    ring = lambda *p: F.lit(None).cast("array<struct<x:double,y:double>>") if not p else F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in p))
    assert value(spark, P.centroid(ring((3, 4), (3, 4)))) == (3.0, 4.0) and value(spark, P.centroid(ring())) is None
    assert value(spark, P.sane_ring(ring((0, 0), (1, 1)))) is None and value(spark, P.sane_ring(ring((200, 0)))) is None
    assert len(value(spark, P.sane_ring(ring((0, 0), (0, 0), (1, 0), (1, 1))))) == 4


def test_outlines_of_long_rings_take_time_in_proportion(spark):
    """A ring that is an expression is computed once, not for each of its points."""
    import time

    n, began = 4000, time.perf_counter()
    angle = lambda i: i * 2 * 3.141592653589793 / n
    ring = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct(F.cos(angle(i)).alias("x"), F.sin(angle(i)).alias("y")))
    row = spark.range(1, 2).select(P.ring_area(ring).alias("a"), P.centroid(ring).alias("c"), F.size(P.sane_ring(ring)).alias("n"), P.bounds_overlap(P.bounds(ring), P.bounds(ring)).alias("o")).first()
    assert abs(row.a - 3.1415913) < 1e-5 and abs(row.c.x) < 1e-9 and row.n == n + 1 and row.o and time.perf_counter() - began < 20


def test_prior_context_of_a_dense_source_takes_time_in_proportion(spark):
    """A message each second: what is before is no sum of the whole reach for each; messages without a time are peers."""
    import time

    rows = spark.range(400_000).select("id", F.lit("s").alias("source_id"), F.timestamp_seconds(F.col("id")).alias("published_at"))
    odd = spark.createDataFrame([(-1, "s", None), (-2, "s", None), (-3, None, T0), (-4, None, T0 + timedelta(seconds=5))], "id long, source_id string, published_at timestamp")
    began = time.perf_counter()
    out = E.prior_context(rows.unionByName(odd), 50_000, 40_000)
    assert {r.id: r.prior for r in out.where("id IN (-1, -2, -3, -4, 0, 7, 39999, 40005, 399999)").collect()} == {-1: 2, -2: 2, -3: 0, -4: 1, 0: 0, 7: 7, 39999: 39999, 40005: 40000, 399999: 40000}
    assert out.count() == 400_004 and time.perf_counter() - began < 45


def test_hot_keys_are_cut(spark):
    """One class in most rows: stretches by slots as by one window over the class; the newest events of a territory are
    limited before they are shuffled."""
    from pyspark.sql import Window

    rows = spark.range(3000).select(F.when(F.col("id") % 3 > 0, F.lit("hot")).when(F.col("id") % 7 > 0, F.concat(F.lit("t"), F.col("id") % 5)).alias("threat_type"), ((F.col("id") * F.col("id") * 7919) % 90_000_000).alias("us_at"), F.col("id").cast("string").alias("id"))
    order = Window.partitionBy("threat_type").orderBy("us_at", "id")
    new = F.coalesce(F.col("us_at") - F.lag("us_at").over(order) >= 60_000, F.lit(True))
    want = rows.withColumn("n", F.when(new, 1).otherwise(0)).withColumn("stretch", F.sum("n").over(order)).select("id", "stretch")
    got = W._with_stretches(rows, 60_000, 1_000_000).select("id", "stretch")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.select("stretch").distinct().count() > 50
    threats = spark.createDataFrame([(f"e{i}", "c", "uav", "mentioned", "official", None, T0 + timedelta(minutes=i)) for i in range(40)], "event_id string, location_id string, threat_type string, relation string, evidence string, direction string, observed_at timestamp")
    tree = spark.createDataFrame([("c", "c", 0), ("c", "ua", 1)], "descendant_id string, ancestor_id string, depth int")
    state = P.territory_state(threats, tree)
    assert state._jdf.queryExecution().executedPlan().toString().count("WindowGroupLimit") == 2
    assert [(r.territory_id, r.events, r.event_ids[0], len(r.event_ids)) for r in state.orderBy("territory_id").collect()] == [("c", 40, "e39", 8), ("ua", 40, "e39", 8)]
