"""Bulletins, told nights, names, and decisions over many rows. Texts are put together from the parts below, dealt by event;
the SQL reads the parts, never the texts, and so is an independent reading."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import bulletins as T
from ..operators import planning as P
from . import binding as B
from .binding import LOCATIONS_SQL as LOC, r
from .record_queries import EV, _events, _id

NOW = datetime(2024, 1, 30)

#: (text, the circle's meaning)
CIRCLES = [("🔴 ", "alert"), ("🟢", "clear"), ("🟡 ", "partial"), ("🟠 ", "advisory"), ("", None), ("🔴🔴 ", "alert")]
CLOCKS = ["", "14:03 ", "4:15 "]
#: (text, action, place, why it needs no action)
HEADLINES = [
    ("Повітряна тривога в Сумський район", "start", "Сумський район", None),
    ("Відбій тривоги в Сумський район.", "end", "Сумський район", None),
    ("Повітряна тривога в", "start", "", None),
    ("Відбій повітряної тривоги у", "end", "", None),
    ("Буча - повітряна тривога!", "start", "Буча", None),
    ("Буча – відбій повітряної тривоги!", "end", "Буча", None),
    ("Загроза БпЛА", None, None, "threat_notice"),
    ("Відбій загрози", None, None, "threat_notice"),
    ("Увага", None, None, "advisory"),
    ("Новини дня", None, None, None),
]
#: (text, places listed, lower-case places still under alert, whether it has such a list)
BODIES = [
    ("", [], [], False),
    ("\n• Буча\n• Сумський  район.", ["Буча", "Сумський район"], [], False),
    ("\nтривога ще триває у:\n- Сумський район", [], ["сумський район"], True),
    ("\n#тег\n· Буча\nТривога досі триває у\n- БУЧА", ["Буча"], ["буча"], True),
]
#: (text, how it tells)
TELLINGS = [("", ""), ("За ніч ", "summary"), ("Вчора ", "summary"), ("Цієї ночі було гучно. ", "narration"), ("Цієї ночі гучно. ", "narration with past"), ("Раніше тихо, тепер інакше. ", "narration")]
#: (text, how it stands to the present)
PRESENTS = [("шахеди в області", ""), ("курсом на Київ", "strong"), ("зараз тихо", "weak"), ("пуски з моря", "weak"), ("5 хв до міста", "strong"), ("негайно додому", "strong"), ("→ Суми", "strong")]
#: (text, whether it is in the past tense)
ENDS = [("", False), (". Ворог атакував", True)]
STEMS = ["Сум", "Харків", "Полтав", "Черніг"]
SUFFIXES = ["ська область", "щина", "ський район", "ою", "і", ""]
MARKS = ["", "м. ", "«"]
#: (key as printed, status, since, reason, key as told)
KEYS = [
    ("geoJSON.status.occupied", "occupied", None, None, "geoJSON.status.occupied"),
    ("geoJSON.territories.kuril", None, None, "non_ukrainian_territory", "geoJSON.territories.kuril"),
    ("geoJSON.status.dismissed_at {{at: 2022-04-01 }}", "liberated", "2022-04-01", None, "geoJSON.status.dismissed_at"),
    ("geoJSON.status.dismissed_at", "liberated", None, None, "geoJSON.status.dismissed_at"),
    ("geoJSON.other", None, None, "unknown_status_key", "geoJSON.other"),
    ("status", None, None, "missing_status_key", None),
]
LAYERS = ["Назва /// Name /// ", "", "x///"]


def _dealt(spark: SparkSession, sf_dir: str, *parts: list) -> DataFrame:
    """(event_id, i0, i1, ..): which of each part an event gets."""
    e, rest = B.load(spark, sf_dir, "events").select("event_id"), F.col("event_id")
    for n, part in enumerate(parts):
        e, rest = e.withColumn(f"i{n}", (rest % len(part)).cast("int")), F.floor(rest / len(part))
    return e


def _of(values, n: int) -> Column:
    return F.get(F.array(*(F.lit(v).cast("string") for v in values)), F.col(f"i{n}"))


def _literal(v) -> str:
    if isinstance(v, list):
        return "[" + ", ".join(map(_literal, v)) + "]"
    return "NULL" if v is None else str(v) if isinstance(v, bool) else f"'{v}'"


def _dealt_sql(*parts: dict[str, list]) -> str:
    """The same deal, with the columns of each part by name."""
    columns, own, divisor = [], [], 1
    for n, part in enumerate(parts):
        size = len(next(iter(part.values())))
        columns.append(f"event_id // {divisor} % {size} + 1 AS i{n}")
        own += [f"{_literal(list(values))}[i{n}] AS {name}" for name, values in part.items()]
        divisor *= size
    return f"d AS (SELECT event_id, {', '.join(own)} FROM (SELECT event_id, {', '.join(columns)} FROM events))"


def _column(part: list[tuple], n: int) -> list:
    return [x[n] for x in part]


# --- texts


def bulletins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _dealt(spark, sf_dir, CIRCLES, CLOCKS, HEADLINES, BODIES)
    text = F.concat(_of(_column(CIRCLES, 0), 0), _of(CLOCKS, 1), _of(_column(HEADLINES, 0), 2), _of(_column(BODIES, 0), 3))
    out = T.with_bulletin(rows.select("event_id", text.alias("text")))
    return out.select("event_id", "bulletin.kind", "bulletin.reason", "bulletin.action", "bulletin.clock", F.array_join("bulletin.names", "|").alias("names"))


BULLETINS = f"""WITH {_dealt_sql({"circle": _column(CIRCLES, 1)}, {"clock": [c.strip() or None for c in CLOCKS]}, {"action": _column(HEADLINES, 1), "place": _column(HEADLINES, 2), "why": _column(HEADLINES, 3)}, {"listed": _column(BODIES, 1), "still": _column(BODIES, 2), "has_still": _column(BODIES, 3)})},
n AS (SELECT *, CASE WHEN place <> '' THEN [place] ELSE listed END AS named FROM d),
k AS (SELECT *, CASE WHEN action = 'end' THEN list_filter(named, lambda x: NOT list_contains(still, lower(x))) ELSE named END AS names,
  coalesce(CASE WHEN action = 'end' THEN circle IN ('clear', 'partial') ELSE circle = 'alert' END, false) AS agrees FROM n),
w AS (SELECT *, CASE WHEN circle = 'advisory' THEN 'advisory'
  WHEN action IS NULL THEN coalesce(why, CASE WHEN has_still THEN 'still_active_notice' END, CASE WHEN circle IS NULL THEN 'unrelated' END)
  WHEN agrees AND len(named) > 0 AND len(names) = 0 THEN 'partial_all_clear_still_active' END AS reason FROM k),
z AS (SELECT *, CASE WHEN reason IS NOT NULL THEN 'ignored' WHEN action IS NOT NULL AND agrees AND len(names) > 0 THEN 'event' ELSE 'unrecognized' END AS kind FROM w)
SELECT event_id, kind, reason, CASE WHEN kind = 'event' THEN action END AS action, CASE WHEN kind = 'event' THEN clock END AS clock,
  CASE WHEN kind = 'event' THEN array_to_string(names, '|') END AS names FROM z"""


def told_nights(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _dealt(spark, sf_dir, TELLINGS, PRESENTS, ENDS)
    text = F.concat(_of(_column(TELLINGS, 0), 0), _of(_column(PRESENTS, 0), 1), _of(_column(ENDS, 0), 2))
    return rows.select("event_id", T.retrospective(text)["verdict"].alias("verdict"))


TOLD = f"""WITH {_dealt_sql({"telling": _column(TELLINGS, 1)}, {"present": _column(PRESENTS, 1)}, {"past": _column(ENDS, 1)})}
SELECT event_id, CASE WHEN telling = '' OR (telling = 'narration with past' AND NOT past) OR present = 'strong' THEN 'none'
  WHEN telling = 'summary' OR present = '' THEN 'vetoed' ELSE 'suspect' END AS verdict FROM d"""


def place_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _dealt(spark, sf_dir, STEMS, SUFFIXES, MARKS)
    return rows.select("event_id", T.place_stem(F.concat(_of(MARKS, 2), _of(STEMS, 0), _of(SUFFIXES, 1))).alias("stem"))


PLACE_STEMS = f"WITH {_dealt_sql({'stem': STEMS})} SELECT event_id, lower(stem) AS stem FROM d"


def name_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third name is a city and its community."""
    n = B.load(spark, sf_dir, "customer").select("c_custkey", "c_name")
    name = F.when(F.col("c_custkey") % 3 == 0, F.concat("c_name", F.lit("  та Нова територіальна громада."))).otherwise(F.concat(F.lit(" "), "c_name", F.lit("!")))
    return n.select("c_custkey", F.posexplode(T.name_candidates(name)).alias("n", "name"))


CANDIDATES = """SELECT c_custkey, unnest(CASE WHEN c_custkey % 3 = 0 THEN [0, 1, 2] ELSE [0] END) AS n,
  unnest(CASE WHEN c_custkey % 3 = 0 THEN [c_name || ' та Нова територіальна громада', 'Нова територіальна громада', c_name] ELSE [c_name] END) AS name FROM customer"""


def layer_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _dealt(spark, sf_dir, LAYERS, KEYS)
    return rows.withColumn("s", T.status_decision(F.concat(_of(LAYERS, 0), _of(_column(KEYS, 0), 1)))).select("event_id", "s.*")


STATUSES = f"WITH {_dealt_sql({'layer': LAYERS}, {'status': _column(KEYS, 1), 'since': _column(KEYS, 2), 'reason': _column(KEYS, 3), 'status_key': _column(KEYS, 4)})} SELECT event_id, status, status_key, since, reason FROM d"


def age_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ages from five minutes ahead to some hours; half a minute counts up."""
    e = _events(spark, sf_dir).withColumn("s", F.col("event_id") % 997 * 15 - 300)
    return e.select("event_id", T.age_wording(F.col("ts"), F.timestamp_micros(F.unix_micros("ts") + F.col("s") * 1_000_000)).alias("age"))


AGES = """WITH a AS (SELECT event_id, floor((event_id % 997 * 15 - 300 + 30) / 60)::BIGINT AS m FROM events)
SELECT event_id, CASE WHEN m < 0 THEN 'щойно (мітка часу джерела попереду нашого годинника)' WHEN m = 0 THEN 'менше хвилини тому' WHEN m < 60 THEN m || ' хв тому'
  WHEN m % 60 = 0 THEN m // 60 || ' год тому' ELSE m // 60 || ' год ' || m % 60 || ' хв тому' END AS age FROM a"""


# --- decisions


def catch_up_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = B.load(spark, sf_dir, "supplier").withColumn("k", F.col("s_suppkey"))
    ago = lambda minutes: F.timestamp_micros(F.unix_micros(F.lit(NOW)) - minutes.cast("long") * 60_000_000)
    return P.catch_up(s.select(F.col("k").alias("source_id"), (F.col("k") % 7 != 0).alias("enabled"), F.when(F.col("k") % 5 != 0, ago(F.col("k") * F.col("k") - 20)).alias("cursor_at"), F.when(F.col("k") % 2 == 0, ago(F.col("k") * 10)).alias("last_run_at"), (F.col("k") % 6).alias("failures")), NOW)


CATCH_UP = """WITH s AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 5 <> 0 THEN greatest((s_suppkey * s_suppkey - 20) * 60, 0) ELSE 0 END AS gap FROM supplier)
SELECT k AS source_id, gap AS gap_seconds, CASE WHEN k % 7 = 0 THEN 'skipped_disabled' WHEN k % 5 = 0 THEN 'no_cursor'
  WHEN k % 2 = 0 AND k * 10 < 10 * least(2 ** (k % 6), 24) THEN 'skipped_recent' WHEN gap <= 3600 THEN 'skipped_small_gap' ELSE 'run' END AS action FROM s"""


def missed_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cursor is a source's newest message whose id 13 divides, 60 messages are read and 25 kept at most."""
    e = B.load(spark, sf_dir, "events")
    m = e.select((F.col("user_id") % 20).alias("source_id"), F.col("event_id").alias("id"), F.date_trunc("hour", "ts").alias("at"), F.when(F.col("event_type") != "click", F.col("event_type")).otherwise(" ").alias("text"))
    c = m.where("id % 13 = 0").groupBy("source_id").agg(F.max(F.struct("at", "id")).alias("c")).select("source_id", F.col("c.at").alias("cursor_at"), F.col("c.id").alias("cursor_id"))
    return P.missed_messages(m, c, 60, 25)


MISSED = """WITH m AS (SELECT user_id % 20 AS s, event_id AS id, date_trunc('hour', ts) AS t, event_type FROM events),
c AS (SELECT s, t AS c_t, id AS c_id FROM m WHERE id % 13 = 0 QUALIFY row_number() OVER (PARTITION BY s ORDER BY t DESC, id DESC) = 1),
x AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY s ORDER BY t DESC, id DESC) <= 60),
y AS (SELECT s, id, t FROM x JOIN c USING (s) WHERE (t > c_t OR (t = c_t AND id > c_id)) AND event_type <> 'click' QUALIFY row_number() OVER (PARTITION BY s ORDER BY t DESC, id DESC) <= 25)
SELECT s AS source_id, id, row_number() OVER (PARTITION BY s ORDER BY t, id) AS n FROM y"""


def delivery_allowances(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    return P.allowances(e.select((F.col("user_id") % 20).alias("bucket"), F.col("event_id").alias("id"), F.date_trunc("second", "ts").alias("at"), (F.col("k") % 40).alias("wanted")), 0.0009765625, 30)


ALLOWANCES = f"""WITH RECURSIVE {EV}, c AS (SELECT user_id % 20 AS b, event_id AS id, epoch(date_trunc('second', ts)) AS s, k % 40 AS w,
    row_number() OVER (PARTITION BY user_id % 20 ORDER BY date_trunc('second', ts), event_id) AS n FROM ev),
f AS (SELECT b, id, n, s, least(25, 30, w)::INT AS allowed, 30.0::DOUBLE - least(25, 30, w) AS left_over FROM c WHERE n = 1
  UNION ALL SELECT b, id, n, s, a, t - a FROM (
    SELECT c.b, c.id, c.n, c.s, least(30, f.left_over + (c.s - f.s) * 0.0009765625::DOUBLE) AS t, least(25, floor(least(30, f.left_over + (c.s - f.s) * 0.0009765625::DOUBLE)), c.w)::INT AS a
    FROM f JOIN c ON c.b = f.b AND c.n = f.n + 1))
SELECT b AS bucket, id, allowed FROM f"""


def array_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    arrays = e.select("event_id", F.sequence(F.lit(0), F.col("k") % 3).alias("number"), F.when(F.col("k") % 2 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("c"))).alias("label"))
    return P.array_rows(arrays, ["event_id"], ["number", "label"])


ARRAY_ROWS = f"WITH {EV} SELECT event_id, unnest(range(0, k % 3 + 1)) AS number, unnest(CASE WHEN k % 2 = 0 THEN ['a', 'b'] ELSE ['c'] END) AS label FROM ev"


def chosen_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers under a customer where that one exists, else their nation; every fourth is there, under another nation or its own."""
    c = B.load(spark, sf_dir, "customer")
    codes = F.array(_id("c", F.col("c_custkey") * 2), _id("n", F.col("c_nationkey")), F.lit("r0"))
    present = c.where("c_custkey % 4 = 0").select(_id("c", F.col("c_custkey")).alias("code"), _id("n", F.col("c_custkey") % 25).alias("parent_code"))
    nations = B.load(spark, sf_dir, "nation").where("n_nationkey % 3 <> 0").select(_id("n", F.col("n_nationkey")).alias("code"), F.lit("r0").alias("parent_code"))
    return P.chosen_parents(c.select(_id("c", F.col("c_custkey")).alias("code"), codes.alias("parent_codes")), present.union(nations))


PARENTS = """WITH p AS (SELECT c.c_custkey AS k, CASE WHEN o.c_custkey IS NOT NULL THEN 'c' || o.c_custkey WHEN c.c_nationkey % 3 <> 0 THEN 'n' || c.c_nationkey END AS parent
  FROM customer c LEFT JOIN customer o ON o.c_custkey = c.c_custkey * 2)
SELECT 'c' || k AS code, parent AS parent_code, k % 4 = 0 AND parent IS DISTINCT FROM 'n' || (k % 25) AS moved FROM p"""


def context_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, loc = _events(spark, sf_dir), B.locations(spark, sf_dir)
    m = e.select(F.col("event_id").alias("message_id"), F.posexplode(F.array(_id("c", F.col("event_id") % 150), _id("n", F.col("k") % 25), _id("c", F.col("k") % 30))).alias("n", "location_id"))
    regions = loc.where("type = 'city'").select(F.col("id").alias("location_id"), F.col("parent_id").alias("region_id")).union(loc.where("type = 'oblast'").select("id", "id"))
    return P.context_places(m, regions, "ua").select("message_id", F.array_join("places", ",").alias("places"))


CONTEXT = f"""WITH {EV}, {LOC}, m AS (SELECT event_id, unnest([0, 1, 2]) AS n, unnest(['c' || (event_id % 150), 'n' || (k % 25), 'c' || (k % 30)]) AS id FROM ev),
x AS (SELECT event_id, 0 AS tier, n, id FROM m UNION ALL SELECT event_id, 1, 0, CASE WHEN type = 'city' THEN parent_id ELSE loc.id END FROM m JOIN loc USING (id) WHERE type IN ('city', 'oblast')),
y AS (SELECT event_id, id, min(tier * 10 + n) AS o FROM x GROUP BY ALL)
SELECT event_id AS message_id, string_agg(id, ',' ORDER BY o, id) || ',ua' AS places FROM y GROUP BY 1"""


def model_additions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    k, u, n = F.col("k"), F.col("user_id"), F.col("event_id")
    verdicts = e.select("event_id", (n % 5 != 0).alias("significant"), B.pick(("asserted", "redirected", "withdrawn"), k).alias("state"), (k % 10 / 10).alias("confidence"), B.pick(P.SEVERITY, n).alias("threat_type"), B.pick(("", " на  північ ", None), u).alias("direction"), F.array(_id("p", u % 6), _id("p", k % 6)).alias("destinations"), F.array(_id("p", n % 6), _id("p", n % 4), F.lit("?")).alias("places"))
    published = e.select("event_id", B.pick(P.SEVERITY, u).alias("threat_type"), B.pick((None, "на захід"), n).alias("direction"), (n % 7 == 0).alias("national"), F.array(_id("q", k % 4)).alias("location_ids"))
    names = spark.range(6).select(_id("p", F.col("id")).alias("name"), _id("q", F.col("id")).alias("location_id"))
    return P.additions(verdicts, published, names, 0.4)


_SEVERITY = _literal(list(P.SEVERITY))
ADDITIONS = f"""WITH {EV}, s AS (SELECT *, event_id % 10 AS new, user_id % 10 AS old FROM ev WHERE event_id % 5 <> 0 AND k % 3 < 2 AND k % 10 >= 4 AND event_id % 10 > 0),
p AS (SELECT event_id, k, unnest([0, 1, 2, 3]) AS n, unnest([user_id % 6, k % 6, event_id % 6, event_id % 4]) AS place FROM s WHERE event_id % 7 <> 0),
q AS (SELECT event_id, place, min(n) AS n FROM p WHERE place <> k % 4 GROUP BY ALL)
SELECT event_id, 'direction' AS kind, 'на північ' AS value, 1 AS n FROM s WHERE user_id % 3 = 1 AND event_id % 2 = 0
UNION ALL SELECT event_id, 'threat_class', {_SEVERITY}[new + 1], 1 FROM s WHERE new > old
UNION ALL SELECT event_id, 'additional_location', 'q' || place, row_number() OVER (PARTITION BY event_id ORDER BY n) AS m FROM q QUALIFY m <= 3"""


def cone_angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n, u = F.col("k"), F.col("event_id"), F.col("user_id")
    return _events(spark, sf_dir).select("event_id", P.cone_half_angle(k % 3, n % 2 == 0, n % 3 == 0, u % 100, n % 5 == 0, n % 40 * 60).alias("half_angle"))


CONE_ANGLES = f"""WITH {EV} SELECT event_id, least(60, 12.0 + CASE WHEN k % 3 < 2 THEN 8 ELSE 0 END + CASE WHEN event_id % 2 = 0 THEN 10 ELSE 0 END + CASE WHEN event_id % 3 = 0 THEN 8 ELSE 0 END
  + CASE WHEN user_id % 100 BETWEEN 1 AND 59 THEN 6 ELSE 0 END + CASE WHEN event_id % 5 = 0 THEN 6 ELSE 0 END + CASE WHEN event_id % 40 > 5 THEN least(20, event_id % 40 // 5 * 5) ELSE 0 END)::DOUBLE AS half_angle FROM ev"""


def cone_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers are places; every fifth has a nation's name at its point."""
    c = B.load(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("x"))
    lat, lon = 45 + F.col("x") * 37 % 700 / 100, 22 + F.col("x") * 91 % 1800 / 100
    places = c.select(_id("c", F.col("x")).alias("id"), F.lit("city").alias("type"), lat.alias("lat"), lon.alias("lon")).union(c.where("x % 5 = 0").select(_id("b", F.col("x")), F.lit("oblast"), lat, lon))
    s = B.load(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("y"))
    origins = s.select(F.col("y").alias("event_id"), (46.03 + F.col("y") % 5).alias("lat0"), (25.07 + F.col("y") % 11).alias("lon0"), (F.col("y") * 29 % 360).cast("double").alias("towards"), (60 + F.col("y") % 90).cast("double").alias("horizon_km"), (12 + F.col("y") % 30).cast("double").alias("half_angle"), F.lit(180.0).alias("speed_kmh"))
    return P.cone_candidates(origins, places).select("event_id", "rank", "id", "km")


CONE_PLACES = f"""WITH pl AS (SELECT c_custkey AS x, 45 + c_custkey * 37 % 700 / 100 AS lat, 22 + c_custkey * 91 % 1800 / 100 AS lon FROM customer),
o AS (SELECT s_suppkey AS y, 46.03 + s_suppkey % 5 AS lat0, 25.07 + s_suppkey % 11 AS lon0, s_suppkey * 29 % 360 AS t, 60 + s_suppkey % 90 AS h, 12 + s_suppkey % 30 AS a FROM supplier),
m AS (SELECT *, 2 * 6371.0088 * asin(least(1, sqrt(sin(radians(lat - lat0) / 2) ** 2 + cos(radians(lat0)) * cos(radians(lat)) * sin(radians(lon - lon0) / 2) ** 2))) AS km,
  degrees(atan2(sin(radians(lon - lon0)) * cos(radians(lat)), cos(radians(lat0)) * sin(radians(lat)) - sin(radians(lat0)) * cos(radians(lat)) * cos(radians(lon - lon0)))) AS b FROM o, pl),
n AS (SELECT *, least((b - t + 720) % 360, 360 - (b - t + 720) % 360) AS f FROM m),
w AS (SELECT * FROM n WHERE km >= greatest(1, h * 0.65 * 0.6) AND km <= h * 1.35 * 1.15 AND f <= a * 1.5 QUALIFY row_number() OVER (PARTITION BY y, lat, lon ORDER BY f, km, 'c' || x) = 1)
SELECT y AS event_id, row_number() OVER (PARTITION BY y ORDER BY f, km, 'c' || x) AS rank, 'c' || x AS id, {r("km", 1)} AS km FROM w QUALIFY rank <= 6"""


def checked_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n = F.col("k"), F.col("event_id")
    intervals = F.when(n % 7 == 0, F.array().cast("array<double>")).otherwise(F.array((k % 5).cast("double"), (k % 3 + 1).cast("double"), F.lit(-1.0)))
    chances = F.when(n % 11 == 0, F.array().cast("array<double>")).otherwise(F.array(n % 10 / 10, k % 10 / 10))
    return _events(spark, sf_dir).select("event_id", P.checked_report(intervals, F.when(n % 3 > 0, k % 8 / 8), chances).alias("c")).select("event_id", "c.verdict", F.array_join("c.issues", ",").alias("issues"), "c.rate", "c.median")


CHECKED = f"""WITH {EV}, b AS (SELECT event_id, CASE WHEN event_id % 7 > 0 THEN (k % 5 + k % 3 + 1) / 2 END AS mean, CASE WHEN event_id % 3 > 0 THEN k % 8 / 8 END AS own,
    CASE WHEN event_id % 11 > 0 THEN (event_id % 10 / 10 + k % 10 / 10) / 2 END AS middle FROM ev),
c AS (SELECT *, {r("1 / mean")} AS rate, {r("1 - exp(-1 / mean)")} AS p FROM b),
i AS (SELECT *, list_filter([CASE WHEN rate IS NULL THEN 'intervals_missing' END, CASE WHEN middle IS NULL THEN 'forecast_outside_period' END, CASE WHEN abs(own - rate) > greatest(0.05, rate * 0.15) THEN 'lambda_mismatch' END,
  CASE WHEN abs(middle - p) > 0.15 THEN 'p_mismatch' END], lambda x: x IS NOT NULL) AS issues FROM c)
SELECT event_id, CASE WHEN middle IS NULL THEN 'rejected' WHEN len(issues) > 0 THEN 'inconsistent' ELSE 'passed' END AS verdict, array_to_string(issues, ',') AS issues, rate, {r("middle")} AS median FROM i"""


QUERIES = {
    "bulletins": (bulletins, BULLETINS),
    "told_nights": (told_nights, TOLD),
    "place_stems": (place_stems, PLACE_STEMS),
    "name_candidates": (name_candidates, CANDIDATES),
    "layer_statuses": (layer_statuses, STATUSES),
    "age_words": (age_words, AGES),
    "catch_up_actions": (catch_up_actions, CATCH_UP),
    "missed_replay": (missed_replay, MISSED),
    "delivery_allowances": (delivery_allowances, ALLOWANCES),
    "array_rows": (array_rows, ARRAY_ROWS),
    "chosen_parents": (chosen_parents, PARENTS),
    "context_places": (context_places, CONTEXT),
    "model_additions": (model_additions, ADDITIONS),
    "cone_angles": (cone_angles, CONE_ANGLES),
    "cone_places": (cone_places, CONE_PLACES),
    "checked_reports": (checked_reports, CHECKED),
}
