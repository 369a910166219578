"""What a message is taken to say, with its indicators and whether it is about the whole country."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import bulletins as T, speech as S, values as V
from ..functions.texts import CLASS_PATTERNS, tags
from .gazetteer import linked_places

STRINGS = "array<string>"


def _any(pattern: str) -> str:
    return f"(?iu){pattern}"


def _classes_of(names: Column, table: list[tuple]) -> Column:
    """All classes that the named indicators stand for."""
    each = [F.when(F.array_contains(names, F.lit(row[0])), F.array(*(F.lit(c) for c in row[2])).cast(STRINGS)) for row in table if row[2]]
    return F.flatten(F.array_compact(F.array(*each)))


def _named(names: Column, table: list[tuple]) -> Column:
    """The indicators among the names, in the table's order."""
    return F.filter(F.array(*(F.lit(row[0]) for row in table)), lambda n: F.array_contains(names, n))


def strategic(text: Column) -> Column:
    return tags(text, [(name, pattern) for name, pattern, *_ in V.STRATEGIC])


def context(text: Column) -> Column:
    """Indicators that count beside a place alone; some need the shape of a report besides."""
    shaped = text.rlike(_any(V.REPORT_SHAPE))
    return F.array_compact(F.array(*(F.when(text.rlike(_any(p)) & (shaped if needs else F.lit(True)), F.lit(name)) for name, p, _, needs in V.CONTEXT)))


def scoped_verdicts(messages: DataFrame, places: DataFrame, longest: int | None = None) -> DataFrame:
    """(id, intent, threat_type, threat_types, scope, indicators, places, passed, told) of (id, text).

    intent: threat, redirect, de_escalation or none. scope: located where places of the catalogue are named; national where
    none is and an indicator or a warning to the country is; none else. indicators: strategic ones that aren't denied, then,
    beside a place alone, those of context; then the marks of a finished night. threat_types: the classes asserted, of a
    de-escalation those withdrawn, unknown if none is named.

    Jokes and appeals are none unless they have the marks of a report. A text that names no place of the catalogue, but one
    beyond the border, is none unless a launch or a warning to the country makes it ours: ambient indicators are about
    there. One class that isn't denied makes an assertion. A threat told of a finished night is vetoed: none, with its marks.
    A strategic indicator is read within its clause, and one that goes over a clause's end counts as asserted. Null and empty
    texts are none."""
    found = linked_places(messages, places, longest).groupBy("id").agg(F.collect_list(F.struct("start", "location_id")).alias("_p"))
    rows = S.with_stances(messages.select("id", "text"), to="_s", patterns=[*CLASS_PATTERNS, *((n, p) for n, p, *_ in V.STRATEGIC)])
    text, signs = F.coalesce("text", F.lit("")), [r[0] for r in V.STRATEGIC]
    rows = rows.withColumns({"_told": T.retrospective(F.col("text")), "_r": S.redirect(F.col("text")), "_strategic": strategic(text), "_context": context(text), "_foreign": text.rlike(_any(rf"(?<!\p{{L}})(?:{'|'.join(V.FOREIGN_STEMS)})")), "_country": text.rlike(_any(V.NATIONAL)), "_joke": text.rlike(_any(V.COMMENTARY)) & ~text.rlike(_any(V.OPERATIONAL))})
    rows = rows.join(found, "id", "left").withColumn("_p", F.coalesce("_p", F.array().cast("array<struct<start:int,location_id:string>>")))
    located = F.size("_p") > 0

    asserted, withdrawn = F.col("_s.asserted"), F.col("_s.withdrawn")
    in_clauses = F.array_union(asserted, withdrawn)
    rows = rows.withColumns({
        "_on": F.filter(_named(F.col("_strategic"), V.STRATEGIC), lambda n: F.array_contains(asserted, n) | ~F.array_contains(in_clauses, n)),
        "_off": _named(withdrawn, V.STRATEGIC),
        "_near": F.when(located, F.col("_context")).otherwise(F.array().cast(STRINGS)),
    })
    sorted_set = lambda *x: F.array_sort(F.array_distinct(F.concat(*x)))
    plain = lambda names: F.array_except(names, F.array(*(F.lit(s) for s in signs)))
    rows = rows.withColumns({"_said": sorted_set(plain(asserted), _classes_of(F.col("_on"), V.STRATEGIC)), "_denied": sorted_set(plain(withdrawn), _classes_of(F.col("_off"), V.STRATEGIC))})
    rows = rows.withColumn("_types", sorted_set(F.col("_said"), _classes_of(F.col("_near"), V.CONTEXT)))

    launched = F.arrays_overlap("_strategic", F.array(*(F.lit(r[0]) for r in V.STRATEGIC if r[3] == "launch")))
    elsewhere = ~located & F.col("_foreign") & ~(launched | F.col("_country"))
    takes_back = (F.size("_denied") > 0) | (F.size("_off") > 0) | text.rlike(_any(S.DE_ESCALATION)) | text.rlike(_any(S.ABSENCE))
    quiet = (F.size("_said") == 0) & (F.size("_on") == 0) & takes_back & ~text.rlike(_any(S.ANTICIPATION))
    national = ~located & ((F.size("_on") > 0) | F.col("_country"))
    says = (F.size("_types") > 0) | (F.size("_near") > 0) | national
    rows = rows.withColumn("_i", F.when(F.col("_joke") | elsewhere, "none").when(quiet, "de_escalation").when(says, "threat").otherwise("none"))

    def within(part: str) -> Column:
        begin = F.expr(f"position(_r.{part}, text) - 1")
        return F.filter("_p", lambda p: (p["start"] >= begin) & (p["start"] < begin + F.length(F.col(f"_r.{part}"))))

    ids = lambda x: F.array_sort(F.array_distinct(F.transform(x, lambda p: p["location_id"])))
    none = F.array().cast(STRINGS)
    rows = rows.withColumns({"_passed": F.coalesce(ids(within("passed")), none), "_next": F.coalesce(F.size(within("towards")), F.lit(0))})
    threat = F.col("_i") == "threat"
    # only what would be published is held against the night
    published = threat & (located | national)
    told = F.when(published & (F.col("_told.verdict") != "none"), F.col("_told.verdict"))
    vetoed = F.coalesce(told == "vetoed", F.lit(False))
    redirected = threat & ~vetoed & (F.size("_passed") > 0) & (F.col("_next") > 0)
    alive = threat & ~vetoed
    back = F.col("_i") == "de_escalation"
    intent = F.when(redirected, "redirect").when(alive, "threat").when(back, "de_escalation").otherwise("none")
    types = F.when(F.size("_types") > 0, F.col("_types")).otherwise(F.array(F.lit("unknown")))
    return rows.select(
        "id",
        intent.alias("intent"),
        F.when(alive, F.when(F.size(types) > 1, "combined").otherwise(F.get(types, F.lit(0)))).alias("threat_type"),
        F.when(threat, types).when(back, F.col("_denied")).otherwise(none).alias("threat_types"),
        F.when((alive | back) & located, "located").when(alive & national, "national").otherwise("none").alias("scope"),
        F.when(threat, F.concat("_on", "_near", F.when(told.isNotNull(), F.col("_told.told")).otherwise(none))).otherwise(none).alias("indicators"),
        F.when(alive | back, ids(F.col("_p"))).otherwise(none).alias("places"),
        F.when(redirected, F.col("_passed")).otherwise(none).alias("passed"),
        told.alias("told"),
    )
