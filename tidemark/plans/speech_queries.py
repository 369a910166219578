"""What messages say, over sentences put together from the parts below: every event deals its own mix of them. The SQL reads
the parts, never the sentences, and so is an independent reading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import speech as S, texts as X, timing as T
from ..operators import places as P, verdicts as V
from . import binding as B

#: (text, how it stands to what follows)
LEADS = [("", "plain"), ("Не фіксуємо: ", "denies"), ("Відбій загрози ", "denies"), ("Увага! ", "plain"), ("Очікуємо вночі. Зараз ", "anticipates"), ("Немає балістики, але ", "denies ballistics"), ("Пильність! ", "anticipates")]
WEAPONS = [("шахеди", "uav"), ("балістика", "ballistic_missile"), ("крилаті ракети", "cruise_missile"), ("КАБи", "guided_air_bomb"), ("вантажівки", None)]
COURSES = [(" курсом на ", "reported_direction"), (" повз Суми на ", "reported_direction"), (" у бік ", "reported_direction"), (" біля ", "mentioned"), (" → ", "reported_direction"), (", є загроза для ", "explicit_threat")]
PLACES = ["NATION_4", "Nation_12", "NATION_7 East", "Бучу"]
#: (text, its class if it names one, how it stands to what is before)
TAILS = [("", None, ""), (", але БпЛА летять", "uav", ""), (". Балістики немає", "ballistic_missile", "denied"), (" не зафіксовано", None, "denies"), (". Чисте небо", None, "absence"), (" з акваторії Чорного моря", None, ""), ("; вибухи у місті", None, "aftermath")]
PARTS = (LEADS, WEAPONS, COURSES, PLACES, TAILS)


def _pick(values: list, column: int | None, i: Column) -> Column:
    return F.get(F.array(*(F.lit(v if column is None else v[column]).cast("string") for v in values)), i.cast("int"))


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, i0 .. i4, text), dealt by event, as few bytes of a file make many sentences."""
    e, rest = B.dealt(B.load(spark, sf_dir, "events").select("event_id"), "event_id"), F.col("event_id")
    for n, part in enumerate(PARTS):
        e = e.withColumn(f"i{n}", rest % len(part))
        rest = F.floor(rest / len(part))
    text = F.concat(*(_pick(part, None if n == 3 else 0, F.col(f"i{n}")) for n, part in enumerate(PARTS)))
    return e.withColumn("text", text)


def _list(values) -> str:
    return "[" + ", ".join("NULL" if v is None else "'{}'".format(v) for v in values) + "]"


def _sentences_sql() -> str:
    columns, divisor = [], 1
    for n, part in enumerate(PARTS):
        columns.append(f"event_id // {divisor} % {len(part)} AS i{n}")
        divisor *= len(part)
    texts = [_list(p if n == 3 else (x[0] for x in p)) + f"[i{n} + 1]" for n, p in enumerate(PARTS)]
    own = lambda n, c, name: f"{_list(x[c] for x in PARTS[n])}[i{n} + 1] AS {name}"
    return f"""se AS (SELECT *, {" || ".join(texts)} AS text, {own(0, 1, "lead_kind")}, {own(1, 1, "weapon")}, {own(2, 1, "course")}, {texts[2]} AS course_text, {texts[3]} AS place, {texts[4]} AS tail, {own(4, 1, "tail_class")}, {own(4, 2, "tail_kind")}
  FROM (SELECT event_id, {", ".join(columns)} FROM events)
), st AS (SELECT *,
    lead_kind = 'denies' OR (tail_kind = 'denies' AND length(course_text || place || ' не зафіксов') <= 30) AS denied,
    list_filter([CASE WHEN lead_kind = 'denies ballistics' THEN 'ballistic_missile' END, CASE WHEN tail_kind = 'denied' THEN tail_class END], lambda x: x IS NOT NULL) AS others FROM se
), ju AS (SELECT *,
    list_sort(list_distinct(list_filter([CASE WHEN NOT denied THEN weapon END, CASE WHEN tail_kind = '' THEN tail_class END], lambda x: x IS NOT NULL))) AS asserted,
    list_sort(list_distinct(list_filter(list_append(others, CASE WHEN denied THEN weapon END), lambda x: x IS NOT NULL))) AS withdrawn FROM st
)"""


SE = f"WITH {_sentences_sql()} "


def clause_stances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes asserted and withdrawn, and the intent of each sentence."""
    rows = S.with_stances(sentences(spark, sf_dir), to="s")
    return rows.select("event_id", F.array_join("s.asserted", ",").alias("asserted"), F.array_join("s.withdrawn", ",").alias("withdrawn"), S.intent(F.col("text"), F.col("s")).alias("intent"))


STANCES = SE + """SELECT event_id, array_to_string(asserted, ',') AS asserted, array_to_string(withdrawn, ',') AS withdrawn,
  CASE WHEN len(asserted) > 0 THEN 'assertion' WHEN (len(withdrawn) > 0 OR lead_kind LIKE 'denies%' OR tail_kind = 'absence') AND lead_kind <> 'anticipates' THEN 'de_escalation' ELSE 'none' END AS intent FROM ju"""


def redirects(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sentences(spark, sf_dir).withColumn("r", S.redirect(F.col("text"))).where("r IS NOT NULL")
    return rows.select("event_id", "r.passed", "r.towards")


REDIRECTS = SE + "SELECT event_id, 'Суми' AS passed, place || regexp_replace(tail, '[.].*', '') AS towards FROM se WHERE course_text LIKE ' повз%'"


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sentences(spark, sf_dir)
    return rows.select("event_id", S.relation(F.col("text"), _pick(PLACES, None, F.col("i3"))).alias("relation"))


RELATIONS = SE + "SELECT event_id, CASE WHEN course <> 'mentioned' THEN course WHEN tail_kind = 'aftermath' THEN 'aftermath' ELSE 'mentioned' END AS relation FROM se"


def origin_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences(spark, sf_dir).select("event_id", S.origin_zone(F.col("text")).alias("origin_zone"))


ORIGINS = SE + "SELECT event_id, CASE WHEN tail LIKE '%Чорного%' THEN 'black_sea' END AS origin_zone FROM se"


def place_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations by name; "nation 7 east" is a longer name, and every name that ends in 2 is borne by two places."""
    n = B.load(spark, sf_dir, "nation").select(F.lower("n_name").alias("name"), F.col("n_nationkey").alias("k"))
    spaced = F.translate("name", "_", " ")
    forms = n.select(spaced.alias("form"), F.concat(F.lit("n"), F.col("k").cast("string")).alias("location_id"), F.lit("oblast").alias("type"))
    forms = forms.unionByName(n.where("k = 7").select(F.concat(spaced, F.lit(" east")).alias("form"), F.lit("east").alias("location_id"), F.lit("city").alias("type")))
    forms = forms.unionByName(n.where("k % 10 = 2").select(spaced.alias("form"), F.lit("twin").alias("location_id"), F.lit("oblast").alias("type")))
    return P.place_mentions(sentences(spark, sf_dir).select(F.col("event_id").alias("id"), "text"), forms).withColumnRenamed("id", "event_id").select("event_id", F.col("start").alias("start_at"), F.col("end").alias("end_at"), "location_id")


MENTIONS = SE + """SELECT event_id, position(place IN text) - 1 AS start_at, position(place IN text) - 1 + length(place) AS end_at,
  CASE i3 WHEN 0 THEN 'n4' WHEN 2 THEN 'east' END AS location_id FROM se WHERE i3 < 3"""


#: (name, a form that it has in a text, whether the form is the name's)
INFLECTED = [("буча", "бучу", True), ("буча", "бучі", True), ("суми", "сумах", True), ("київ", "києва", True), ("харків", "харкові", True), ("харків", "харкова", True), ("одеса", "одесою", True), ("ворзель", "ворзеля", True), ("ніс", "носа", False), ("лиман", "лимані", True), ("суми", "сумська", False), ("канівець", "канівцю", True)]


def inflected_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a form is one of the name's."""
    e, at = B.load(spark, sf_dir, "events").select("event_id"), F.col("event_id") % len(INFLECTED)
    return e.select("event_id", F.array_contains(V.inflections(_pick(INFLECTED, 0, at)), _pick(INFLECTED, 1, at)).alias("known"))


INFLECTED_FORMS = f"SELECT event_id, {[x[2] for x in INFLECTED]}[event_id % {len(INFLECTED)} + 1] AS known FROM events"

#: (text, whether it tells of a finished night)
TALES = [("", False), ("За ніч ", True)]


def message_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences, every ninth of them told of a night, over the nations' names and two cities."""
    n = B.load(spark, sf_dir, "nation").where("n_nationkey IN (4, 12)").select(F.translate("n_name", "_", " ").alias("name"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("location_id"), F.lit("oblast").alias("type"))
    cities = spark.createDataFrame([("Суми", "sumy", "city"), ("Буча", "bucha", "city")], n.schema)
    rows = sentences(spark, sf_dir).select(F.col("event_id").alias("id"), F.when(F.col("event_id") % 9 == 0, F.concat(F.lit(TALES[1][0]), "text")).otherwise(F.col("text")).alias("text"))
    out = V.verdicts(rows, V.spellings(n.union(cities)))
    return out.select(F.col("id").alias("event_id"), "intent", "threat_type", F.array_join("places", ",").alias("places"), F.array_join("passed", ",").alias("passed"), "told")


#: The parts that say that something goes on now: headings, arrows, and flying drones; passing a place is not among the marks.
MESSAGE_VERDICTS = SE + """, p AS (SELECT *, course_text LIKE ' повз%' AS passes, CASE i3 WHEN 0 THEN 'n4' WHEN 1 THEN 'n12' WHEN 3 THEN 'bucha' END AS target,
    i2 IN (0, 2, 4) OR i4 = 1 AS strong, len(asserted) > 0 AS asserts FROM ju),
v AS (SELECT *, CASE WHEN event_id % 9 = 0 AND NOT strong THEN true ELSE false END AS vetoed FROM p),
w AS (SELECT *, CASE WHEN asserts AND NOT vetoed AND passes AND target IS NOT NULL THEN 'redirect' WHEN asserts AND NOT vetoed THEN 'threat'
    WHEN NOT asserts AND (len(withdrawn) > 0 OR lead_kind LIKE 'denies%' OR tail_kind = 'absence') AND lead_kind <> 'anticipates' THEN 'de_escalation' ELSE 'none' END AS intent FROM v)
SELECT event_id, intent, CASE WHEN intent IN ('threat', 'redirect') THEN CASE WHEN len(asserted) > 1 THEN 'combined' ELSE asserted[1] END END AS threat_type,
  CASE WHEN intent = 'none' THEN '' ELSE array_to_string(list_sort(list_filter([target, CASE WHEN passes THEN 'sumy' END], lambda x: x IS NOT NULL)), ',') END AS places,
  CASE WHEN intent = 'redirect' THEN 'sumy' ELSE '' END AS passed, CASE WHEN asserts AND vetoed THEN 'vetoed' END AS told FROM w"""


def forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of sentences that go on with one of three endings."""
    ending = _pick([". Ймовірні нові удари", ". Планують обід", ". Все тихо"], None, F.col("event_id") % 3)
    return sentences(spark, sf_dir).select("event_id", S.forecast_lexeme(F.concat("text", ending)).alias("lexeme"))


FORECASTS = SE + "SELECT event_id, CASE WHEN i0 = 4 THEN 'очікуєм' WHEN event_id % 3 = 1 THEN 'планують' END AS lexeme FROM se"


def comment_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comments with a number, a forecast, a class and a place, each of which may be unfounded."""
    rows, n = sentences(spark, sf_dir), F.col("event_id")
    text = F.concat(F.lit("За ніч "), (n % 5).cast("string"), F.lit(" цілей"), F.when(n % 3 == 0, F.lit(", прогноз тихий")).otherwise(F.lit("")))
    known = lambda *x: F.array(*(F.lit(v) for v in x))
    classes, places = F.array_compact(F.array(_pick(WEAPONS, 1, F.col("i1")))), F.array(_pick(PLACES, None, F.col("i3")))
    fault = S.commentary_fault(text, known("0", "1", "2", "3"), classes, known("uav", "guided_air_bomb", "ballistic_missile"), places, known("NATION_4", "Бучу"))
    return rows.select("event_id", fault.alias("fault"))


FAULTS = SE + """SELECT event_id, CASE WHEN event_id % 5 = 4 THEN 'number: 4' WHEN event_id % 3 = 0 THEN 'forecast: прогноз' WHEN weapon = 'cruise_missile' THEN 'class: cruise_missile'
  WHEN i3 IN (1, 2) THEN 'place: ' || place END AS fault FROM se"""


def token_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.load(spark, sf_dir, "documents").select("doc_id", T.estimated_tokens(F.col("text")).alias("tokens"))


ESTIMATES = r"""SELECT doc_id, coalesce(ceil(c / 2.8 + l / 4 + (n - c - l) / 1.5), 0)::INT AS tokens FROM (
  SELECT doc_id, length(text) AS n, length(regexp_replace(text, '[^\x{400}-\x{52F}]', '', 'g')) AS c, length(regexp_replace(text, '[^0-9A-Za-z]', '', 'g'))::DOUBLE AS l FROM documents)"""


def token_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many tokens the texts of conversations have, and the sum of their ends."""
    rows = S.with_tokens(B.load(spark, sf_dir, "conversations").select("conv_id", "turn", "text"))
    return rows.select("conv_id", "turn", F.size("tokens").alias("tokens"), F.aggregate("tokens", F.lit(0).cast("long"), lambda a, x: a + x["end"]).alias("ends"))


#: A word goes on while letters and digits do, over one apostrophe or hyphen at a time.
TOKENS = r"""SELECT conv_id, turn, len(w)::INT AS tokens, coalesce(list_sum(list_transform(range(1, len(w) + 1), lambda k: list_sum(list_transform(w[1:k], lambda x: length(x))) + list_sum(list_transform(g[1:k], lambda x: length(x))))), 0)::BIGINT AS ends
FROM (SELECT conv_id, turn, regexp_extract_all(lower(text), '[\p{L}\p{Nd}]+([''‘’ʼ`´-][\p{L}\p{Nd}]+)*') AS w, regexp_split_to_array(lower(text), '[\p{L}\p{Nd}]+([''‘’ʼ`´-][\p{L}\p{Nd}]+)*') AS g FROM conversations)"""


def name_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers whose normalised names, aliases or prefixes a query meets."""
    s = B.load(spark, sf_dir, "supplier").select("s_suppkey", X.normalised_name(F.concat(F.lit("  O’"), "s_name", F.lit("  of "), F.col("s_nationkey").cast("string"))).alias("name"))
    aliases = F.array(F.concat(F.lit("alias "), (F.col("s_suppkey") % 3).cast("string")))
    return s.select("s_suppkey", "name", X.match_rank(F.concat(F.lit("o"), F.substring("name", 2, 14)), F.col("name"), aliases).alias("by_prefix"), X.match_rank(F.lit("alias 1"), F.col("name"), aliases).alias("by_alias"))


NAMES = """SELECT s_suppkey, name, 2 - (length(name) <= 15)::INT * 2 AS by_prefix, CASE WHEN s_suppkey % 3 = 1 THEN 1 END AS by_alias
FROM (SELECT s_suppkey, 'o' || lower(s_name) || ' of ' || s_nationkey AS name FROM supplier)"""


def reply_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The JSON block of replies: fenced, loose or missing; and whether their numbers are grounded."""
    n = F.col("event_id")
    body = F.concat(F.lit('{"n": '), (n % 7).cast("string"), F.lit("}"))
    reply = F.when(n % 3 == 0, F.concat(F.lit("Here:\n```json\n"), body, F.lit("\n```\nDone {}"))).when(n % 3 == 1, F.concat(F.lit("so "), body, F.lit(" it is"))).otherwise(F.lit("no reply"))
    block = X.json_block(reply)
    return B.load(spark, sf_dir, "events").select("event_id", block.alias("block"), F.array_join(X.ungrounded_numbers(F.coalesce(block, F.lit("")), F.array(F.lit("1"), F.lit("2"), F.lit("3"))), ",").alias("ungrounded"))


REPLIES = """SELECT event_id, CASE WHEN event_id % 3 < 2 THEN '{"n": ' || (event_id % 7) || '}' END AS block,
  CASE WHEN event_id % 3 < 2 AND event_id % 7 NOT IN (1, 2, 3) THEN (event_id % 7)::VARCHAR ELSE '' END AS ungrounded FROM events"""

QUERIES = {
    "inflected_forms": (inflected_forms, INFLECTED_FORMS),
    "message_verdicts": (message_verdicts, MESSAGE_VERDICTS),
    "clause_stances": (clause_stances, STANCES),
    "redirect_parts": (redirects, REDIRECTS),
    "place_relations": (relations, RELATIONS),
    "origin_zones": (origin_zones, ORIGINS),
    "place_mentions": (place_mentions, MENTIONS),
    "forecast_lexemes": (forecasts, FORECASTS),
    "comment_faults": (comment_faults, FAULTS),
    "token_estimates": (token_estimates, ESTIMATES),
    "token_places": (token_places, TOKENS),
    "name_matches": (name_matches, NAMES),
    "reply_json": (reply_json, REPLIES),
}
