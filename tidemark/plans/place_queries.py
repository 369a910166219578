"""Places named in the documents, and what messages with indicators say."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.speech import token_keys
from ..operators import gazetteer as G, scoped as C
from . import binding as B


#: Documents whose places a task links at the most, about.
DOCUMENTS_PER_TASK = 20_000


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places named after the benchmark's items: an item of every three is an oblast, called by the item's first word; the
    others lie in the oblast before them and are called by its second and third words, by its fourth to ninth, and, as an
    alias, by its second alone. Words of items are shared, so several places bear a name, and shorter names lie in longer
    ones."""
    i = F.col("item_id")
    rows = B.load(spark, sf_dir, "benchmark").select(i, token_keys(F.col("text")).alias("w")).where(F.size("w") >= 9)
    some = lambda a, n: F.array_join(F.slice("w", a, n), " ")
    region = i % 3 == 0
    name = F.when(region, some(1, 1)).otherwise(some(2, 2))
    aliases = F.when(region, F.array().cast("array<string>")).otherwise(F.array(some(4, 6), some(2, 1)))
    return rows.select(
        F.concat(F.lit("p"), i.cast("string")).alias("location_id"), name.alias("name"), aliases.alias("aliases"), F.when(region, "oblast").otherwise("city").alias("type"),
        F.concat(F.lit("p"), (i - i % 3).cast("string")).alias("oblast_id"), (i % 4 == 1).alias("geocoded"), i.alias("ord"),
    )


def place_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of the catalogue in all documents. Texts are dealt to all tasks, however many files they come from."""
    documents = B.load(spark, sf_dir, "documents")
    n, messages = B.tasks(documents, DOCUMENTS_PER_TASK), documents.select(F.col("doc_id").alias("id"), "text")
    messages = messages.repartition(n, "id") if n else B.dealt(messages, "id")
    return G.linked_places(messages, catalogue(spark, sf_dir), tasks=n).select(F.col("id").alias("doc_id"), "location_id", F.col("start").alias("start_at"), F.col("end").alias("end_at"))


#: Words end where neither a letter, a digit nor an apostrophe or hyphen between two of them follows; Latin names have one form.
LINKS = r"""
WITH words AS (
  SELECT doc_id, generate_subscripts(w, 1) AS n, unnest(w) AS word, unnest(g[1:len(w)]) AS gap
  FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{Nd}]+([''‘’ʼ`´-][\p{L}\p{Nd}]+)*') AS w, regexp_split_to_array(lower(text), '[\p{L}\p{Nd}]+([''‘’ʼ`´-][\p{L}\p{Nd}]+)*') AS g FROM documents)
), tokens AS (
  SELECT doc_id, n, translate(word, '''‘’ʼ`´', '') AS key, sum(length(gap) + length(word)) OVER (PARTITION BY doc_id ORDER BY n) AS stop, length(word) AS size FROM words
), items AS (
  SELECT item_id, list_transform(regexp_extract_all(lower(text), '[\p{L}\p{Nd}]+([''‘’ʼ`´-][\p{L}\p{Nd}]+)*'), lambda x: translate(x, '''‘’ʼ`´', '')) AS w FROM benchmark
), names AS (
  SELECT item_id, unnest(CASE WHEN item_id % 3 = 0 THEN [w[1:1]] ELSE list_distinct([w[2:3], w[4:9], w[2:2]]) END) AS name FROM items WHERE len(w) >= 9
), spans AS (
  SELECT t.doc_id, t.n, len(name) AS size, t.stop - t.size AS start, item_id, item_id % 3 = 0 AS region, item_id - item_id % 3 AS within, item_id % 4 = 1 AS placed, name
  FROM tokens t JOIN names ON t.key = name[1]
), met AS (
  SELECT s.doc_id, s.n, s.size, s.start, max(t.stop) AS stop, item_id, region, within, placed
  FROM spans s JOIN tokens t ON s.doc_id = t.doc_id AND t.n BETWEEN s.n AND s.n + s.size - 1 AND t.key = name[t.n - s.n + 1]
  GROUP BY ALL HAVING count(*) = s.size
), borne AS (
  SELECT *, count(DISTINCT item_id) OVER (PARTITION BY doc_id, start, stop) AS bearers FROM met
), sure AS (
  SELECT DISTINCT doc_id, within FROM borne WHERE bearers = 1
), judged AS (
  SELECT b.*, EXISTS (SELECT 1 FROM sure s WHERE s.doc_id = b.doc_id AND s.within = b.within) AS near FROM borne b
), one AS (SELECT *, region OR NOT bool_or(region) OVER s AS k FROM judged WINDOW s AS (PARTITION BY doc_id, start, stop)
), two AS (SELECT * EXCLUDE (k), k AND (near OR NOT bool_or(k AND near) OVER s) AS k FROM one WINDOW s AS (PARTITION BY doc_id, start, stop)
), three AS (SELECT * EXCLUDE (k), k AND (placed OR NOT bool_or(k AND placed) OVER s) AS k FROM two WINDOW s AS (PARTITION BY doc_id, start, stop)
), clear AS (
  SELECT * FROM (SELECT *, count(DISTINCT CASE WHEN k THEN item_id END) OVER (PARTITION BY doc_id, start, stop) AS finalists FROM three) WHERE k AND finalists = 1
), ranked AS (
  SELECT c.doc_id, c.start, c.stop, c.item_id, r.place FROM clear c JOIN (
    SELECT doc_id, item_id, row_number() OVER (PARTITION BY doc_id ORDER BY size DESC, length DESC, item_id) AS place
    FROM (SELECT doc_id, item_id, max(stop - start) AS length, arg_max(size, stop - start) AS size FROM clear GROUP BY ALL)) r USING (doc_id, item_id)
), free AS (
  SELECT * FROM ranked c WHERE NOT EXISTS (SELECT 1 FROM ranked o WHERE o.doc_id = c.doc_id AND o.place < c.place AND o.start <= c.start AND o.stop >= c.stop)
)
SELECT doc_id, 'p' || item_id AS location_id, arg_min(start, (start - stop, start))::INT AS start_at, arg_min(stop, (start - stop, start))::INT AS end_at FROM free GROUP BY doc_id, item_id
"""

#: (text, whether it jokes, warns the country, anticipates)
OPENINGS = [("", ""), ("Жарт: ", "jokes"), ("Загроза застосування! ", "country"), ("Очікуємо тишу. ", "anticipates")]
#: (text, indicator, its classes, its scope, a class named besides, whether what it names is denied)
SUBJECTS = [
    ("Зліт Ту-95", "зліт стратегічної авіації", ["cruise_missile"], "launch", None, False),
    ("Робота ворожої ППО", "робота ворожої ППО", ["ballistic_missile", "cruise_missile"], "ambient", None, False),
    ("Шахеди", None, [], "", "uav", False),
    ("Не фіксуємо шахедів", None, [], "", "uav", True),
    ("Не фіксуємо зльоту: у повітрі Ту-160", "зліт стратегічної авіації", ["cruise_missile"], "launch", None, True),
    ("МіГ-31К здійснив посадку", "посадка МіГ-31К", ["ballistic_missile"], "ambient", None, False),
    ("Цілі", None, [], "", None, False),
]
#: (text, the place of the catalogue, whether one beyond the border)
WHERE = [(", Суми", "sumy", False), (" біля Курська", None, True), ("", None, False), (" біля Івано-Франківська", "ivano", False), (" у Київській та Сумській областях", "kyiv_o,sumy_o", False)]
#: (text, indicators of context, their classes)
ENDINGS = [("", [], []), (" → далі", ["рух цілі за напрямком"], []), (", дрони, увага", ["дрони без уточнення типу"], ["uav"]), (", ракета, увага", ["ракета без уточнення типу"], []), (", дорозвідка", ["розвідувальна активність БпЛА"], ["uav"])]


def message_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences put together from the parts above, by event."""
    e = B.load(spark, sf_dir, "events").select(F.col("event_id").alias("id")).repartition("id")
    text, rest = F.lit(""), F.col("id")
    for part in (OPENINGS, SUBJECTS, WHERE, ENDINGS):
        text = F.concat(text, F.get(F.array(*(F.lit(x[0]) for x in part)), (rest % len(part)).cast("int")))
        rest = F.floor(rest / len(part))
    places = [("sumy", "Суми", [], "city", "sumy_o", True, 1), ("ivano", "Івано-Франківськ", [], "city", None, True, 2), ("kyiv", "Київ", [], "special_city", None, True, 3), ("kyiv_o", "Київська область", ["Київщина"], "oblast", "kyiv_o", True, 4), ("sumy_o", "Сумська область", [], "oblast", "sumy_o", True, 5)]
    known = spark.createDataFrame(places, "location_id string, name string, aliases array<string>, type string, oblast_id string, geocoded boolean, ord int")
    out = C.scoped_verdicts(e.select("id", text.alias("text")), known, 2)
    joined = lambda c: F.array_join(c, ",").alias(c)
    return out.select(F.col("id").alias("event_id"), "intent", "threat_type", joined("threat_types"), "scope", joined("indicators"), joined("places"))


def _list(values) -> str:
    return "[" + ", ".join("NULL" if v is None else str(v).lower() if isinstance(v, bool) else _list(v) + "::VARCHAR[]" if isinstance(v, list) else f"'{v}'" for v in values) + "]"


def _scopes_sql() -> str:
    columns, divisor = [], 1
    for n, (part, names) in enumerate(((OPENINGS, ("opening",)), (SUBJECTS, ("sign", "sign_classes", "sign_scope", "named", "denied")), (WHERE, ("place", "abroad")), (ENDINGS, ("near", "near_classes")))):
        columns += [f"{_list(x[c] for x in part)}[event_id // {divisor} % {len(part)} + 1] AS {name}" for c, name in enumerate(names, 1)]
        divisor *= len(part)
    return f"""WITH parts AS (SELECT event_id, {", ".join(columns)} FROM events),
told AS (SELECT *, place IS NOT NULL AS located, opening = 'country' AS country, CASE WHEN sign IS NOT NULL AND NOT denied THEN [sign] ELSE [] END AS signs,
  CASE WHEN place IS NOT NULL THEN near ELSE [] END AS beside,
  list_sort(list_distinct(list_concat(CASE WHEN denied THEN [] ELSE list_concat(sign_classes, CASE WHEN named IS NULL THEN [] ELSE [named] END) END, CASE WHEN place IS NULL THEN []::VARCHAR[] ELSE near_classes END))) AS classes FROM parts),
read AS (SELECT *, CASE WHEN opening = 'jokes' AND sign IS DISTINCT FROM 'зліт стратегічної авіації' THEN 'none' WHEN opening = 'jokes' AND denied THEN 'none'
    WHEN NOT located AND abroad AND sign_scope <> 'launch' AND NOT country THEN 'none'
    WHEN denied AND opening <> 'anticipates' THEN 'de_escalation'
    WHEN len(classes) > 0 OR len(beside) > 0 OR NOT located AND (len(signs) > 0 OR country) THEN 'threat' ELSE 'none' END AS intent FROM told)
SELECT event_id, intent, CASE WHEN intent = 'threat' THEN CASE len(classes) WHEN 0 THEN 'unknown' WHEN 1 THEN classes[1] ELSE 'combined' END END AS threat_type,
  CASE intent WHEN 'threat' THEN CASE WHEN len(classes) = 0 THEN 'unknown' ELSE array_to_string(classes, ',') END WHEN 'de_escalation' THEN coalesce(named, sign_classes[1]) ELSE '' END AS threat_types,
  CASE WHEN intent = 'none' THEN 'none' WHEN located THEN 'located' WHEN intent = 'threat' AND (len(signs) > 0 OR country) THEN 'national' ELSE 'none' END AS scope,
  CASE WHEN intent = 'threat' THEN array_to_string(list_concat(signs, beside), ',') ELSE '' END AS indicators, CASE WHEN intent <> 'none' THEN coalesce(place, '') ELSE '' END AS places FROM read"""


QUERIES = {"place_links": (place_links, LINKS), "message_scopes": (message_scopes, _scopes_sql())}
