"""Spellings of place names, and what a message is taken to say."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import bulletins as T, speech as S
from .places import place_mentions

LEAST_INFLECTED = 4
#: Endings by how a name ends; the first that fits counts. (end of the name, what it becomes to give a stem,
#: endings of the stems, what else the name becomes)
PARADIGMS: list[tuple[str, list[tuple[str, str]], list[str], list[tuple[str, str]]]] = [
    ("ій$", [("ій$", "")], ["ій", "ього", "ьому", "ім", "їм"], []),
    ("ий$", [("ий$", "")], ["ий", "ого", "ому", "им", "ім"], []),
    ("е$", [("е$", "")], ["е", "ого", "ому", "им", "ім"], []),
    ("я$", [("я$", "")], ["я", "і", "ї", "ю", "ею", "єю", "ям", "ями", "ях", "є"], []),
    ("а$", [("а$", "")], ["а", "и", "і", "у", "ою", "ої", "ій"], [("ка$", "ці"), ("га$", "зі"), ("ха$", "сі")]),
    ("[иі]$", [("[иі]$", "")], ["", "и", "і", "ів", "ам", "ям", "ами", "ями", "ах", "ях"], []),
    ("о$", [("о$", "")], ["о", "а", "у", "ом", "і", "ові"], []),
    ("ець$", [("ець$", "ц"), ("ець$", "ьц")], ["я", "ю", "і", "ем", "еві", "ями", "ях"], []),
    ("ь$", [("ь$", ""), ("іль$", "ол"), ("інь$", "ен")], ["я", "ю", "і", "ем", "еві", "ями", "ях"], []),
    ("й$", [("й$", "")], ["й", "я", "ю", "ї", "єм", "ям", "ях"], []),
    ("[бвгґджзклмнпрстфхцчшщ]$", [("$", ""), ("їв$", "єв"), ("і([бвгґджзклмнпрстфхцчшщ])$", "о$1")], ["", "а", "я", "у", "ю", "ом", "ем", "і", "ові", "еві"], []),
]


def inflections(word: Column) -> Column:
    """The forms in which a lower-case word of a name may stand in a text, itself included; short words have no others."""
    none = F.array().cast("array<string>")

    def changed(rule: tuple[str, str]) -> Column:
        return F.when(word.rlike(rule[0]), F.regexp_replace(word, *rule))

    def ended(rule: tuple[str, str], endings: list[str]) -> Column:
        each = F.transform(F.array(*(F.lit(e) for e in endings)), lambda e: F.concat(F.regexp_replace(word, *rule), e))
        return F.when(word.rlike(rule[0]), each).otherwise(none)

    def forms(stems: list[tuple[str, str]], endings: list[str], others: list[tuple[str, str]]) -> Column:
        return F.concat(*(ended(rule, endings) for rule in stems), F.array_compact(F.array(*(changed(rule) for rule in others))) if others else none)

    found = F.when(F.length(word) < LEAST_INFLECTED, none)
    for pattern, *rest in PARADIGMS:
        found = found.when(word.rlike(pattern), forms(*rest))
    return F.array_distinct(F.concat(F.array(word), found.otherwise(none)))


def spellings(names: DataFrame, most_words: int = 3) -> DataFrame:
    """(form, location_id, type) of (name, location_id, type): every word of a name in each of its forms. A table to be
    built once, so that texts meet names by equality; names of more words are kept as they are."""
    rows = names.select("location_id", "type", S.token_keys(F.col("name")).alias("_w")).where(F.size("_w") > 0)
    few = rows.where(F.size("_w") <= most_words).withColumn("form", F.lit(""))
    for i in range(most_words):
        word = F.get("_w", F.lit(i))
        few = few.withColumn("_f", F.explode(F.when(word.isNull(), F.array(F.lit(""))).otherwise(inflections(word)))).withColumn("form", F.btrim(F.concat_ws(" ", "form", "_f")))
    many = rows.where(F.size("_w") > most_words).withColumn("form", F.array_join("_w", " "))
    return few.select("form", "location_id", "type").unionByName(many.select("form", "location_id", "type")).distinct()


def verdicts(messages: DataFrame, forms: DataFrame) -> DataFrame:
    """(id, intent, threat_type, places, passed, told) of (id, text): intent threat, redirect, de_escalation or none. Without
    indicators and scope; scoped.scoped_verdicts has these.

    A text that asserts a class is a threat (combined, if it asserts several), or a redirect if it names a place that is
    passed and one that comes next; one that only withdraws is a de-escalation. A threat that is told of a finished night
    is none; one that may be stays, with told = suspect. Null and empty texts are none. A message names few places."""
    named = place_mentions(messages, forms).where(F.col("location_id").isNotNull())
    places = named.groupBy("id").agg(F.collect_set(F.struct("start", "location_id")).alias("_p"))
    rows = S.with_stances(messages.select("id", "text"), to="_s").join(places, "id", "left")
    rows = rows.withColumns({"_p": F.coalesce("_p", F.array().cast("array<struct<start:int,location_id:string>>")), "_r": S.redirect(F.col("text")), "_t": T.retrospective(F.col("text"))["verdict"], "_i": F.coalesce(S.intent(F.col("text"), F.col("_s")), F.lit("none"))})

    def within(part: str) -> Column:
        begin = F.expr(f"position(_r.{part}, text) - 1")
        return F.filter("_p", lambda p: (p["start"] >= begin) & (p["start"] < begin + F.length(F.col(f"_r.{part}"))))

    ids = lambda found: F.array_sort(F.array_distinct(F.transform(found, lambda p: p["location_id"])))
    rows = rows.withColumns({"_passed": F.coalesce(ids(within("passed")), F.array().cast("array<string>")), "_next": F.coalesce(F.size(within("towards")), F.lit(0))})
    threat = (F.col("_i") == "assertion") & (F.col("_t") != "vetoed")
    redirected = threat & (F.size("_passed") > 0) & (F.col("_next") > 0)
    intent = F.when(redirected, "redirect").when(threat, "threat").when(F.col("_i") == "de_escalation", "de_escalation").otherwise("none")
    kinds = F.col("_s.asserted")
    return rows.select(
        "id",
        intent.alias("intent"),
        F.when(threat, F.when(F.size(kinds) > 1, "combined").otherwise(F.get(kinds, F.lit(0)))).alias("threat_type"),
        F.when(intent != "none", ids(F.col("_p"))).otherwise(F.array().cast("array<string>")).alias("places"),
        F.when(redirected, F.col("_passed")).otherwise(F.array().cast("array<string>")).alias("passed"),
        F.when((F.col("_i") == "assertion") & (F.col("_t") != "none"), F.col("_t")).alias("told"),
    )
