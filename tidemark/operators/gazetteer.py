"""Places that texts name, from a catalogue: names in any case and of any length, adjectives beside their head noun, names that
several places bear."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import values as V
from ..functions.folds import once
from ..functions.speech import first_spans, token_keys
from .places import gathered
from .verdicts import inflections

#: Tokens back from a head noun that an adjective may stand.
CHAIN = 6
REGIONS = ("oblast", "special_city")
PLACE = ("location_id", "ord", "type", "oblast_id", "geocoded")


def place_index(places: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Names and administrative adjectives of a catalogue (location_id, name, aliases, type, oblast_id, geocoded, ord), both by
    each form of their first word: (first, words, forms, the place) and (form, kind, the place). ord is the catalogue's
    order, another one for each place. An oblast is also named by its adjective, a raion is not."""
    admin, head = F.regexp_extract("name", V.ADMIN_NAME, 1), F.regexp_extract("name", V.ADMIN_NAME, 2)
    rows = places.withColumn("adjective", token_keys(admin))
    rows = rows.withColumn("kind", F.when(F.size("adjective") == 1, F.when(head == "область", "oblast").otherwise("raion")))
    adjective = F.get("adjective", F.lit(0))
    units = rows.where("kind IS NOT NULL").select(F.explode(inflections(adjective)).alias("form"), "kind", *PLACE)
    none = F.array().cast("array<string>")
    spelled = F.concat(F.array("name"), F.coalesce("aliases", none), F.when(F.col("kind") == "oblast", F.array(adjective)).otherwise(none))
    names = rows.select(*PLACE, "kind", adjective.alias("adjective"), F.explode(spelled).alias("spelling")).select(*PLACE, "kind", "adjective", token_keys(F.col("spelling")).alias("words"))
    bare = (F.size("words") == 1) & (F.get("words", F.lit(0)) == F.col("adjective")) & (F.col("kind") == "raion")
    names = names.where((F.size("words") > 0) & ~F.coalesce(bare, F.lit(False))).withColumn("forms", F.transform("words", inflections))
    return names.select(F.explode(F.get("forms", F.lit(0))).alias("first"), "words", "forms", *PLACE).distinct(), units


def _candidates(messages: DataFrame, names: DataFrame, units: DataFrame, longest: int | None, tasks: int | None) -> DataFrame:
    """(id, n, words, start, end, places) of all that a token may begin, dealt by message."""
    known = names.withColumn("kind", F.lit(None).cast("string")).unionByName(units.withColumnRenamed("form", "first"), allowMissingColumns=True)
    known, rows = gathered(known.groupBy("first", "kind", "words", "forms").agg(F.collect_set(F.struct(*PLACE)).alias("places")))
    if longest is None:
        longest = names.agg(F.coalesce(F.max(F.size("words")), F.lit(1))).first()[0] if rows is None else max((len(r["words"]) for r in rows if r["kind"] is None), default=1)
    by = (tasks, "id") if tasks else ("id",)
    most, adjectives = max(longest, CHAIN + 1), rows is None or any(r["kind"] for r in rows)
    if rows is None:
        tokens = first_spans(messages, most)
    else:
        firsts: dict[str, tuple[int, int, set[str] | None]] = {}
        for r in rows:
            few, many, after = (1, CHAIN + 1, None) if r["kind"] else (len(r["words"]), len(r["words"]), {form for forms in r["forms"][1:2] for form in forms})
            least, reach, seconds = firsts.get(r["first"], (few, many, set()))
            firsts[r["first"]] = (min(least, few), max(reach, many), None if after is None or seconds is None else seconds | after)
        inner = {form for r in rows if not r["kind"] for forms in r["forms"][1:] for form in forms}
        if adjectives:
            inner |= {r["first"] for r in rows if r["kind"]}.union(V.REGION_HEADS, V.DISTRICT_HEADS, V.CONNECTORS)
        # one shuffle, by message, for all that follows here and in linked_places
        tokens = first_spans(messages, most, firsts, inner).repartition(*by)
    at = lambda o: F.get("keys", o)
    declined = F.col("first") != F.get("words", F.lit(0))
    blocked = (F.size("words") == 1) & declined & (F.col("first").rlike(V.COMPASS) | F.col("first").isin(*V.NEVER_A_PLACE))
    fits = (F.size("words") <= F.size("keys")) & ~blocked
    for o in range(1, most):
        fits &= (F.size("words") <= o) | F.array_contains(F.get("forms", F.lit(o)), at(F.lit(o)))
    is_name = F.col("kind").isNull()
    met = tokens.withColumn("first", at(F.lit(0))).join(known, "first").where(F.when(is_name, F.coalesce(fits, F.lit(False))).otherwise(F.lit(True)))
    count = F.when(is_name, F.size("words")).otherwise(F.lit(1))
    met = met.select("id", "n", "kind", count.alias("words"), "start", F.get("ends", count - 1).alias("end"), F.when(~is_name, F.col("keys")).alias("keys"), "places")
    if rows is None:
        met = met.repartition(*by)
    out = ("id", "n", "words", "start", "end", "places")
    if not adjectives:
        return met.select(*out)

    # adjectives, licensed by a head noun after them: between the two are adjectives of the same kind and connectors alone
    # names have no neighbours to gather: each is a partition of its own
    near = Window.partitionBy("id", "kind", F.when(is_name, F.col("n"))).orderBy("n").rangeBetween(0, CHAIN)
    met = met.withColumn("near", F.collect_set(F.when(~is_name, F.col("n"))).over(near))
    is_head = lambda key: F.when(F.col("kind") == "oblast", key.isin(*V.REGION_HEADS)).otherwise(key.isin(*V.DISTRICT_HEADS))
    linked = lambda o: at(o).isin(*V.CONNECTORS) | F.array_contains("near", F.col("n") + o)
    first_gap = lambda d: F.forall(F.slice(F.array(*(F.lit(i) for i in range(1, CHAIN + 1))), F.lit(1), d - 1), linked)
    licensed = F.exists(F.array(*(F.lit(d) for d in range(1, CHAIN + 1))), lambda d: (d < F.size("keys")) & F.coalesce(is_head(at(d)), F.lit(False)) & first_gap(d))
    return met.where(F.when(is_name, F.lit(True)).otherwise(licensed)).select(*out)


def _bearers(places: Column) -> Column:
    return F.size(F.array_distinct(F.transform(places, lambda p: p["location_id"])))


def _finalist(places: Column, *marks: Callable[[Column], Column]) -> Column:
    """An array of the one place that is left of a span's places, where those with a mark, if there are any, leave the others
    behind, mark by mark; empty if more than one is left. Each step is computed once."""
    if not marks:
        return F.when(_bearers(places) == 1, F.slice(places, 1, 1)).otherwise(F.slice(places, 1, 0))
    kept = F.filter(places, lambda p: F.coalesce(marks[0](p), F.lit(False)))
    return once(kept, lambda some: once(F.when(F.size(some) > 0, some).otherwise(places), lambda left: _finalist(left, *marks[1:])))


def linked_places(messages: DataFrame, places: DataFrame, longest: int | None = None, tasks: int | None = None) -> DataFrame:
    """(id, location_id, start, end) of the places that each text names, where it names them first, in characters of the text
    in lower case. messages: (id, text); places: see place_index. A name matches word by word, in any of a word's forms.

    A span that several places bear goes to the oblast or special city among them, else to those within an oblast that the
    text names beyond doubt (or one of whose places it does), else to those with coordinates; if more than one is left, to
    none. Places with more words, then longer ones, then earlier ones of the catalogue take what they cover: another place
    counts where it stands outside. longest: words of the longest name; counted where not given. tasks: of the shuffle by message, if not
    the session's.

    Words meet names by equality, so that a large catalogue needs no broadcast; of a small one the words alone leave their
    texts, and one that nothing can cover once for each spelling. All that follows has a row for each span, whose places are an
    array; spans are shuffled by message once. Null and empty texts name nothing; equal ids count as one message."""
    names, units = place_index(places)
    found = _candidates(messages, names, units, longest, tasks)
    span, message = Window.partitionBy("id", "start", "end"), Window.partitionBy("id")
    found = found.withColumn("_s", F.collect_list("places").over(span))
    found = found.withColumn("places", F.when(F.size("_s") == 1, F.get("_s", F.lit(0))).otherwise(F.array_distinct(F.flatten("_s")))).drop("_s")
    found = found.withColumn("sure", F.when(F.when(F.size("places") == 1, F.lit(1)).otherwise(_bearers(F.col("places"))) == 1, F.get("places", F.lit(0))))
    place, within = F.col("sure.location_id"), F.col("sure.oblast_id")
    oblasts = F.collect_set(within).over(message)
    regions = F.collect_set(F.when(F.col("sure.type").isin(*REGIONS) & ~F.coalesce(place == within, F.lit(False)), place)).over(message)
    found = found.withColumns({"oblasts": oblasts, "regions": regions})
    near = lambda p: F.array_contains("oblasts", p["oblast_id"]) | F.array_contains("regions", p["oblast_id"])
    several = _finalist(F.col("places"), lambda p: p["type"].isin(*REGIONS), near, lambda p: p["geocoded"])
    # outer, as a condition on what is computed would have it computed twice
    clear = found.select("id", "n", "words", "start", "end", F.explode_outer(F.when(F.size("places") == 1, F.col("places")).otherwise(several)).alias("_p")).where(F.col("_p").isNotNull())
    clear = clear.select("id", "n", "words", "start", "end", "_p.location_id", "_p.ord")
    # what a place is ranked by: its longest span
    longest_span = F.max(F.struct((F.col("end") - F.col("start")).alias("length"), (-F.col("start")).alias("at"), F.col("words").alias("words"))).over(Window.partitionBy("id", "location_id"))
    clear = clear.withColumn("_l", longest_span).withColumn("rank", F.struct((-F.col("_l.words")).alias("words"), (-F.col("_l.length")).alias("length"), "ord"))
    clear = clear.select("id", "n", "words", "start", "end", "location_id", "rank")
    # a span meets those that cover its first word, so there is no pair of all spans of a text
    words = clear.select("*", F.posexplode(F.sequence(F.col("n"), F.col("n") + F.col("words") - 1)).alias("_o", "_word"))
    over = words.withColumn("_over", F.collect_set(F.struct("start", "end", "rank")).over(Window.partitionBy("id", "_word")))
    covers = lambda o: (o["start"] <= F.col("start")) & (o["end"] >= F.col("end")) & (o["rank"] < F.col("rank"))
    free = over.where((F.col("_o") == 0) & ~F.exists("_over", covers))
    first = F.min(F.struct((F.col("start") - F.col("end")).alias("length"), "start", "end"))
    return free.groupBy("id", "location_id").agg(first.alias("f")).select("id", "location_id", F.col("f.start").alias("start"), F.col("f.end").alias("end"))
