from datetime import datetime, timedelta

from tidemark.operators import hierarchy as H, territories as T

T0 = datetime(2024, 1, 1)
NODES = [("ua", None, "country"), ("o", "ua", "oblast"), ("r", "o", "raion"), ("h", "r", "hromada"), ("c", "h", "city"), ("d", "o", "city")]
ALERT, THREAT = "id string, location_id string, started_at timestamp", "event_id string, location_id string, threat_type string, relation string, evidence string, timing string, probability double"
ASSESSED = "id string, location_id string, threat_type string, risk_level string, risk_score double"


def test_states_of_territories(spark):
    nodes = spark.createDataFrame(NODES, "id string, parent_id string, type string")
    tree = H.closure(nodes)
    reach = sorted(tuple(r) for r in T.reach(nodes, tree).collect())
    assert reach == sorted([("o", "o", "direct"), ("r", "r", "direct"), ("r", "o", "partial"), ("h", "r", "unmapped"), ("h", "o", "partial"), ("c", "r", "unmapped"), ("c", "o", "partial"), ("d", "o", "unmapped")])
    alerts = spark.createDataFrame([("1", "c", T0 + timedelta(hours=1)), ("2", "o", T0), ("3", "ua", T0), ("4", None, T0)], ALERT)
    threats = spark.createDataFrame([
        ("e1", "c", "uav", "mentioned", "official", None, None), ("e1", "c", "uav", "aftermath", "official", None, None), ("e2", "r", "uav", "mentioned", "unverified", "now", None), ("e3", "d", "mlrs", "mentioned", "official", "now", None),
        *((f"x{i}", "d", "uav", "mentioned", "official", "evening" if i % 2 else "within_hour", i / 10) for i in range(8)),
    ], THREAT)
    assessments = spark.createDataFrame([("b", "o", "uav", "high", 5.0), ("a", "c", "uav", "high", 5.0), ("c", "c", "uav", "elevated", 5.0), ("z", "r", "uav", "background", 1.0)], ASSESSED)
    got = {r.territory_id: r for r in T.composed_states(nodes, tree, alerts, threats, assessments).collect()}
    assert set(got) == {"o", "r"}
    o, r = got["o"], got["r"]
    assert (o.coverage, o.alerts, o.alert_since, o.assessment_id, o.analytic) == ("direct", 2, T0, "a", "high") and (r.coverage, r.alerts, r.alert_since, r.assessment_id) == ("direct", 1, T0 + timedelta(hours=1), "a")
    assert [tuple(x) for x in r.threats] == [("uav", "aftermath", "official", "direct", 2, True, True)] and r.expected == []
    assert [(x.threat_type, x.coverage, x.events, x.asserted) for x in o.threats] == [("mlrs", "unmapped", 1, False), ("uav", "partial", 2, True)]
    assert o.expected == ["x6", "x4", "x2", "x0", "x7", "x5"] and o.threat_active and o.consequences
    none = T.composed_states(nodes, tree, alerts.limit(0), threats.limit(0), assessments.limit(0))
    assert none.count() == 0
    only = T.composed_states(nodes, tree, alerts, threats.limit(0), assessments.limit(0)).where("territory_id = 'o'").first()
    assert (only.threats, only.expected, only.threat_active, only.analytic, only.assessment_id) == ([], [], False, "none", None)
