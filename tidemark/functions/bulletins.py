"""Bulletins of an alert channel, told nights, names as printed and status keys. All are columns over the text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .speech import ARROW

# The circles of a headline, its two word orders, bullets, what needs no action.
CIRCLES = {"🔴": "alert", "🟠": "advisory", "🟡": "partial", "🟢": "clear"}
ALARM = r"повітрян[а-яіїєґ]*\s+тривог[а-яіїєґ]*"
START_FIRST = rf"^{ALARM}\s+[ву](?:\s+(.*))?$"
END_FIRST = r"^відбій\s+(?:повітрян[а-яіїєґ]*\s+)?тривог[а-яіїєґ]*\s+[ву](?:\s+(.*))?$"
START_LAST = rf"^(.{{1,120}}?)\s+[-–—]\s+{ALARM}\s*[!.…]*$"
END_LAST = rf"^(.{{1,120}}?)\s+[-–—]\s+відбій\s+{ALARM}\s*[!.…]*$"
STILL_ACTIVE = r"тривог[а-яіїєґ]*\s+(?:ще|досі)\s+трива"
PLACE_BULLET = r"^[•·]\s*(.+)$"
STILL_BULLET = r"^[•·\-–—]\s*(.+)$"
NO_ACTION: list[tuple[str, str]] = [
    ("threat_notice", r"загроз"),
    ("threat_notice", r"^відбій\s+(?:загроз|атак|по(?![а-яіїєґ]))"),
    ("threat_notice", r"^атак"),
    ("threat_notice", r"^каб(?![а-яіїєґa-z])"),
    ("advisory", r"^ув[аa]г[аa]"),
    ("advisory", r"^безкоштовн"),
    ("advisory", r"^евакуац"),
]
APOSTROPHES = "'‘’ʼ`´"

# Past tenses, marks of a summary, of a narration (with what must stand beside it), of the present.
PAST = r"(?<!\p{L})(?:був|була|було|були|(?:ночува|атакува|застосува|працюва|дава|трива|відбива|проводи|влучи|запусти|вдари|удари|загину|постражда|фіксува|спостеріга)(?:в|ла|ло|ли)|(?:при|про|від)?лет(?:ів|іла|іло|іли)|ста(?:лося|лася|лись|лися)|збито|подавлено|знищено|пошкоджено|зруйновано|зафіксовано|застосовано|виявлено|уражено|оголошено)(?!\p{L})"
SUMMARY_MARKS: list[tuple[str, str]] = [
    ("night_summary", r"(?<!\p{L})(?:підсум[а-яіїєґ]*|у\s+ніч\s+на(?!\p{L})|протягом\s+(?:ноч[іи]|доби)|за\s+(?:ніч|добу|ночі|доби)(?!\p{L})|за\s+попередн[а-яіїєґ]*\s+дан)"),
    ("since_hour", r"(?<!\p{L})починаючи\s+з\s+\d{1,2}[:.]\d{2}"),
    ("downed_report", r"(?<!\p{L})(?:збито|знищено)\s*(?:\/|та\s+|і\s+)\s*подавлено"),
    ("yesterday", r"(?<!\p{L})(?:вчора|учора|позавчора|напередодні)(?!\p{L})"),
    ("last_night", r"(?<!\p{L})мину(?:лої|лу|лою)\s+(?:ноч[іи]|доб[иу])"),
]
THIS_NIGHT = r"(?<!\p{L})(?:ці(?:єї|ю)\s+(?:ноч[іи]|доб[иу])|сьогодні\s+(?:вночі|вранці|зранку)|цього\s+ранку)"
EARLIER_NOW = r"(?<!\p{L})раніше(?!\p{L})[\s\S]{0,600}?(?<!\p{L})(?:тепер|нині)(?!\p{L})"
STRONG_NOW: list[tuple[str, str]] = [
    ("course", r"(?<!\p{L})курс(?:ом)?\s+(?:на|до|у|в)(?!\p{L})|(?<!\p{L})курс(?:ом)?\s+(?:північн|південн|східн|західн)|[ув]\s+напрямку|(?<!\p{L})[ув]\s+бік|прямує\s+(?:до|на|у|в)(?!\p{L})|руха(?:ється|ються)\s+(?:до|на)(?!\p{L})|трима(?:є|ють|ємо)\s+курс"),
    ("arrow", rf"(?:{ARROW})\s*\p{{L}}"),
    ("national_warning", r"загроз[а-яіїєґ]*\s+застосуванн"),
    ("minutes_away", r"(?<!\p{L})\d+\s*хв"),
    ("counted_targets", r"(?<!\p{L})\d+\s*х(?!\p{L})"),
    ("shelter", r"(?<!\p{L})(?:[ув]|до)\s+укритт|(?<!\p{L})(?:негайно|терміново)(?!\p{L})"),
    ("present_motion", r"(?<!\p{L})(?:лет(?:ить|ять)|йд(?:е|уть)|заход(?:ить|ять)|наближ[а-яіїєґ]*|прямує|руха(?:ється|ються))(?!\p{L})"),
]
WEAK_NOW: list[tuple[str, str]] = [
    ("this_moment", r"(?<!\p{L})(?:зараз|наразі|щойно|цієї\s+хвилини|у\s+цю\s+хвилину|у\s+цей\s+момент)(?!\p{L})"),
    ("going_on", r"(?<!\p{L})трива(?:є|ють)(?!\p{L})"),
    ("in_the_air", r"(?<!\p{L})(?:[ув]\s+повітр[а-яіїєґ]*|повітряному\s+просторі)"),
    ("launches", r"(?<!\p{L})(?:за)?пуск[а-яіїєґ]*"),
    ("attention", r"(?<!\p{L})увага(?!\p{L})"),
]
#: An essay has so many characters and sentences, and its sentences are so long on average.
ESSAY = {"characters": 400, "sentences": 3, "mean": 45}

# Words that say what kind of place a name is, endings of regions and of cases.
KINDS_OF_PLACE = r"(?<!\p{L})(?:м|смт|с|селище|місто|області|область|обл|району|районі|район|громаді|громада)(?!\p{L})"
REGION_ENDING = r"(?:ська|ський|ське|ській|ською|щина|щині|щину|щини|щиною)$"
CASE_ENDING = r"(?:ою|ею|ами|ями|ові|еві|ої|ій|ий|ом|а|я|и|і|у|ю|е|ь|й)$"
COMMUNITY = r"^(.+?)\s+та\s+(.+територіальн[а-яіїєґ]*\s+громад[а-яіїєґ]*)$"

# Keys of a layer's statuses; other keys are refused.
STATUSES = {
    "geoJSON.status.occupied": "occupied",
    "geoJSON.territories.crimea": "occupied",
    "geoJSON.territories.ordlo": "occupied",
    "geoJSON.territories.tuzla": "occupied",
    "geoJSON.status.unknown": "contested",
    "geoJSON.status.dismissed": "liberated",
    "geoJSON.zmiinyi_island": "liberated",
}
ELSEWHERE = tuple(f"geoJSON.territories.{x}" for x in ("prussia", "abkhazia", "karelia", "ichkeria", "petsamo", "salla", "estonia", "pechorsky-district", "latvia", "kuril", "tskhinvali-district", "transnistria"))
DISMISSED_AT = "geoJSON.status.dismissed_at"


def _any(pattern: str) -> str:
    return f"(?iuU){pattern}"


def _spaced(text: Column) -> Column:
    return F.btrim(F.regexp_replace(text, r"(?U)\s+", " "))


def _empty() -> Column:
    return F.array().cast("array<string>")


def _bare(name: Column) -> Column:
    """A name without its bullet and the punctuation behind it."""
    return F.btrim(F.regexp_replace(F.regexp_replace(_spaced(name), r"^[•·\-–—\s]+", ""), r"[.,;:!\s]+$", ""))


def _place_key(name: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(F.translate(name, APOSTROPHES, "")), r"[?\s]+$", ""))


def _captured(lines: Column, pattern: str) -> Column:
    """What the pattern's first group holds in the lines that match it, as bare names."""
    return F.transform(F.filter(lines, lambda x: x.rlike(_any(pattern))), lambda x: _bare(F.regexp_extract(x, _any(pattern), 1)))


def with_bulletin(messages: DataFrame, text_col: str = "text", to: str = "bulletin") -> DataFrame:
    """messages with struct<kind, reason, action, clock, names, still_active, headline>. kind is event (action start or end
    of the named places), ignored (with a reason) or unrecognized. Circle and wording must agree; places that the text lists
    as still under alert are not ended. A null text is an empty one. Other columns stay as they are; columns named like the
    helpers `_lines`, `_rest` and so on must not be there."""
    lines = F.filter(F.transform(F.split(F.coalesce(F.col(text_col), F.lit("")), r"\r?\n", -1), _spaced), lambda x: (x != "") & ~x.rlike(r"^#\S"))
    circles = "".join(CIRCLES)
    rows = messages.withColumn("_lines", lines).withColumn("_head", F.coalesce(F.get("_lines", F.lit(0)), F.lit("")))
    rows = rows.withColumns({
        "_circles": F.regexp_extract("_head", rf"^((?:[{circles}]|\x{{FE0F}}|\s)*)", 1),
        "_rest": F.btrim(F.regexp_replace("_head", rf"^(?:[{circles}]|\x{{FE0F}}|\s)*", "")),
        "_below": F.when(F.size("_lines") > 1, F.slice("_lines", F.lit(2), F.size("_lines"))).otherwise(_empty()),
    })
    clock = r"^(\d{1,2}:\d{2})(?![\p{L}\d_])\s*"
    rows = rows.withColumns({
        "_clock": F.nullif(F.regexp_extract("_rest", clock, 1), F.lit("")),
        "_headline": F.btrim(F.regexp_replace("_rest", clock, "")),
        "_turn": F.array_position(F.transform("_below", lambda x: x.rlike(_any(STILL_ACTIVE))), F.lit(True)),
    })
    # an all-clear is looked for before a start in either order, as its words hold those of a start
    forms = (("end", END_FIRST), ("start", START_FIRST), ("end", END_LAST), ("start", START_LAST))
    says = lambda value: reduce(lambda c, f: c.when(F.col("_headline").rlike(_any(f[1])), value(*f)), forms[1:], F.when(F.col("_headline").rlike(_any(forms[0][1])), value(*forms[0])))
    rows = rows.withColumns({
        "_action": says(lambda action, _: F.lit(action)),
        "_inline": says(lambda _, form: _bare(F.regexp_extract("_headline", _any(form), 1))),
        "_listed": _captured(F.when(F.col("_turn") > 0, F.slice("_below", F.lit(1), (F.col("_turn") - 1).cast("int"))).otherwise(F.col("_below")), PLACE_BULLET),
        "_still": F.when(F.col("_turn") > 0, _captured(F.filter(F.slice("_below", (F.col("_turn") + 1).cast("int"), F.size("_below")), lambda x: ~x.rlike(_any(STILL_ACTIVE))), STILL_BULLET)).otherwise(_empty()),
    })
    has = lambda *kinds: reduce(lambda a, b: a | b, (F.col("_circles").contains(c) for c, kind in CIRCLES.items() if kind in kinds))
    ending = F.col("_action") == "end"
    kept = F.filter("_named", lambda x: ~F.exists("_still", lambda y: _place_key(y) == _place_key(x)))
    rows = rows.withColumn("_named", F.when(F.col("_inline") != "", F.array("_inline")).otherwise(F.col("_listed")))
    rows = rows.withColumn("_names", F.when(ending, kept).otherwise(F.col("_named")))
    ignorable = reduce(lambda c, n: c.when(F.col("_headline").rlike(_any(n[1])), n[0]), NO_ACTION[1:], F.when(F.col("_headline").rlike(_any(NO_ACTION[0][1])), NO_ACTION[0][0]))
    no_action = F.coalesce(ignorable, F.when(F.col("_turn") > 0, "still_active_notice"), F.when(~has(*CIRCLES.values()), "unrelated"))
    agrees = F.when(ending, has("clear", "partial")).otherwise(has("alert"))
    reason = (
        F.when(F.size("_lines") == 0, "empty")
        .when(has("advisory") & ~has("alert", "clear", "partial"), "advisory")
        .when(F.col("_action").isNull(), no_action)
        .when(agrees & (F.size("_named") > 0) & (F.size("_names") == 0), "partial_all_clear_still_active")
    )
    event = F.col("_action").isNotNull() & agrees & (F.size("_names") > 0)
    rows = rows.withColumn("_reason", reason)
    rows = rows.withColumn("_kind", F.when(F.col("_reason").isNotNull(), "ignored").when(event, "event").otherwise("unrecognized"))
    only = lambda c: F.when(F.col("_kind") == "event", c)
    out = F.struct(F.col("_kind").alias("kind"), F.col("_reason").alias("reason"), only(F.col("_action")).alias("action"), only(F.col("_clock")).alias("clock"), only(F.col("_names")).alias("names"), only(F.col("_still")).alias("still_active"), F.col("_headline").alias("headline"))
    return rows.withColumn(to, out).drop("_lines", "_head", "_circles", "_rest", "_below", "_clock", "_headline", "_turn", "_action", "_inline", "_listed", "_still", "_named", "_names", "_reason", "_kind")


def _marks(text: Column, marks: list[tuple[str, str]]) -> Column:
    return F.array_compact(F.array(*(F.when(text.rlike(_any(p)), F.lit(name)) for name, p in marks)))


def reads_as_essay(text: Column) -> Column:
    """A long text in the past tense, of several and long sentences."""
    body = _spaced(text)
    sentences = F.filter(F.transform(F.split(body, r'[.!?…]+[\s"»]', -1), F.btrim), lambda x: x != "")
    long = F.aggregate(sentences, F.lit(0), lambda n, x: n + F.length(x)) >= F.size(sentences) * ESSAY["mean"]
    return text.rlike(_any(PAST)) & (F.length(body) >= ESSAY["characters"]) & (F.size(sentences) >= ESSAY["sentences"]) & long


def retrospective(text: Column) -> Column:
    """struct<verdict, told, now>: none for a text without marks of telling or with a strong mark of the present, vetoed for a
    summary or a narration without any mark of the present, suspect for a narration beside a weak one. Null is a text
    without marks."""
    text = F.coalesce(text, F.lit(""))
    summary = _marks(text, SUMMARY_MARKS)
    narration = F.array_compact(F.array(
        F.when(text.rlike(_any(THIS_NIGHT)) & text.rlike(_any(PAST)), F.lit("this_night")),
        F.when(text.rlike(_any(EARLIER_NOW)), F.lit("earlier_now")),
        F.when(reads_as_essay(text), F.lit("essay")),
    ))
    told, strong, weak = F.concat(summary, narration), _marks(text, STRONG_NOW), _marks(text, WEAK_NOW)
    verdict = F.when((F.size(told) == 0) | (F.size(strong) > 0), "none").when((F.size(summary) > 0) | (F.size(weak) == 0), "vetoed").otherwise("suspect")
    return F.struct(verdict.alias("verdict"), told.alias("told"), F.when(F.size(told) > 0, F.concat(strong, weak)).otherwise(_empty()).alias("now"))


def name_candidates(raw: Column) -> Column:
    """The names to look up for a printed one: itself, then for "a city and its community" the community and the city."""
    base = F.btrim(F.regexp_replace(_spaced(raw), r"[.,;:!?]+$", ""))
    part = lambda n: F.btrim(F.regexp_extract(base, _any(COMMUNITY), n))
    names = F.when(base.rlike(_any(COMMUNITY)), F.array(base, part(2), part(1))).otherwise(F.array(base))
    return F.array_distinct(F.filter(names, lambda x: x != ""))


def lookup_forms(name: Column) -> Column:
    """Lower-case spellings of a name, the literal one first, then without the word for its kind."""
    literal = F.btrim(F.translate(F.lower(name), APOSTROPHES, ""))
    plain = F.btrim(F.regexp_replace(F.regexp_replace(literal, r"^(?:м\.|місто|обл\.|область)\s*", ""), r"\s+(?:обл\.|область)$", ""))
    return F.array_distinct(F.filter(F.array(literal, plain), lambda x: x != ""))


def place_stem(name: Column) -> Column:
    """A name without its kind, its region's ending or else its case's; endings that leave under three letters stay."""
    bare = _spaced(F.regexp_replace(F.regexp_replace(F.lower(name), "[«»\"'’ʼ.,!?()]", ""), f"(?U){KINDS_OF_PLACE}", ""))
    region, case = F.regexp_replace(bare, REGION_ENDING, ""), F.regexp_replace(bare, CASE_ENDING, "")
    return F.when((region != bare) & (F.length(region) >= 3), region).when(F.length(case) >= 3, case).otherwise(bare)


def status_decision(name: Column) -> Column:
    """struct<status, status_key, since, reason> of a layer's name "one /// other /// geoJSON.key": the last part counts. A
    key that isn't known is refused, with the reason."""
    parts = F.filter(F.transform(F.split(F.coalesce(name, F.lit("")), "///", -1), _spaced), lambda x: x != "")
    last = F.get(parts, F.size(parts) - 1)
    key = F.when(last.startswith("geoJSON."), last)
    dated = rf"^{DISMISSED_AT.replace('.', '[.]')}(?:\s*\{{\{{\s*at\s*:([^}}]*)\}}\}})?$"
    is_dated = F.coalesce(key.rlike(dated), F.lit(False))
    known = F.element_at(F.create_map(*(F.lit(x) for kv in STATUSES.items() for x in kv)), F.coalesce(key, F.lit("")))
    status = F.coalesce(known, F.when(is_dated, "liberated"))
    reason = F.when(key.isNull(), "missing_status_key").when(key.isin(*ELSEWHERE), "non_ukrainian_territory").when(status.isNull(), "unknown_status_key")
    since = F.when(is_dated, F.nullif(_spaced(F.regexp_extract(key, dated, 1)), F.lit("")))
    return F.struct(status.alias("status"), F.when(is_dated, DISMISSED_AT).otherwise(key).alias("status_key"), since.alias("since"), reason.alias("reason"))


def age_wording(published: Column, now: Column) -> Column:
    """How long ago, in words: to the minute, hours from the sixtieth on; a stamp ahead of the clock is told as such."""
    minutes = F.floor((F.unix_micros(now) - F.unix_micros(published)) / 60e6 + 0.5)
    hours, rest = F.floor(minutes / 60).cast("string"), minutes % 60
    long = F.concat(hours, F.lit(" год"), F.when(rest > 0, F.concat(F.lit(" "), rest.cast("string"), F.lit(" хв"))).otherwise(""), F.lit(" тому"))
    return F.when(minutes < 0, "щойно (мітка часу джерела попереду нашого годинника)").when(minutes < 1, "менше хвилини тому").when(minutes < 60, F.concat(minutes.cast("string"), F.lit(" хв тому"))).otherwise(long)
