"""Places that messages name, the state of territories, and outlines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, Window, functions as F

from ..functions.folds import once
from ..functions.speech import with_spans, with_tokens

#: Ranks by which the strongest of several statements is taken.
RELATIONS = ("mentioned", "aftermath", "reported_direction", "explicit_threat")
EVIDENCE = ("unverified", "monitoring", "confirmed", "official")
COVERAGES = ("partial", "unmapped", "direct")
MOST_EVENTS = 8
#: Rows of names that are broadcast, some 10 MB.
MOST_BROADCAST = 20_000


def beside_texts(names: DataFrame) -> DataFrame:
    """names, to be joined with the words of texts: broadcast if they are few, which is counted, else merged. Left to itself,
    Spark takes words for fewer than names, as it doesn't know how many a text has, and broadcasts them."""
    return names.hint("broadcast" if names.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST else "merge")


def gathered(names: DataFrame, places: str = "places") -> tuple[DataFrame, list[Row] | None]:
    """names, each with an array of its places, to be joined with the words of texts as beside_texts has it, and their rows, if
    they are few and have few places; these are computed once."""
    n, borne = names.agg(F.count("*"), F.coalesce(F.sum(F.size(places)), F.lit(0))).first()
    if n > MOST_BROADCAST or borne > 10 * MOST_BROADCAST:
        return names.hint("merge"), None
    rows = names.collect()
    return names.sparkSession.createDataFrame(rows, names.schema).hint("broadcast"), rows


def place_mentions(messages: DataFrame, forms: DataFrame, most_words: int = 3) -> DataFrame:
    """(id, start, end, location_id) of the places that texts name. messages: (id, text); forms: (form, location_id, type)
    of all spellings, in lower case. The longest of overlapping names counts; where several places bear it, the only oblast
    among them does, or the only place, else none: location_id is null. Spellings that texts can't have don't matter; words
    meet the first words of spellings, so that no phrase is made that begins with no name. Forms are broadcast while they are
    few, texts never."""
    one = F.when(F.count_if(F.col("type") == "oblast") == 1, F.min(F.when(F.col("type") == "oblast", F.col("location_id")))).when(F.count_distinct("location_id") == 1, F.min("location_id"))
    known = forms.groupBy("form").agg(one.alias("location_id")).select(F.split("form", " ").alias("words"), "location_id")
    known = known.select(F.get("words", F.lit(0)).alias("first"), "words", "location_id").where(F.size("words") <= most_words)
    spans = with_spans(with_tokens(messages.select("id", "text")).drop("text"), most_words).withColumn("first", F.get("span", F.lit(0))["key"])
    met = spans.join(beside_texts(known), "first").where(F.transform(F.slice("span", F.lit(1), F.size("words")), lambda t: t["key"]) == F.col("words"))
    found = met.select("id", F.get("span", F.lit(0))["start"].alias("start"), F.get("span", F.size("words") - 1)["end"].alias("end"), "location_id")
    # the names of one message are few; each is kept unless a longer one lies over it
    per = found.groupBy("id").agg(F.collect_list(F.struct("start", "end", "location_id")).alias("s"))
    longer = lambda a, b: (b["end"] - b["start"] > a["end"] - a["start"]) & (b["start"] < a["end"]) & (a["start"] < b["end"])
    kept = F.filter("s", lambda a: ~F.exists("s", lambda b: longer(a, b)))
    return per.select("id", F.explode(kept).alias("s")).select("id", "s.*")


def rank(column: Column, order: tuple[str, ...]) -> Column:
    """Place in the order, from 1; 0 for what isn't in it."""
    return F.coalesce(F.array_position(F.array(*(F.lit(x) for x in order)), column), F.lit(0)).cast("int")


def territory_state(threats: DataFrame, tree: DataFrame, most: int = MOST_EVENTS) -> DataFrame:
    """What live events say of each place and class: the strongest relation, evidence and coverage, the newest direction,
    how many events, and the ids of the newest ones. threats: (event_id, location_id, threat_type, relation, evidence,
    direction, observed_at); a place named in two ways counts once, with the stronger relation. Places above the named one
    are covered in part."""
    named = threats.withColumn("r", rank(F.col("relation"), RELATIONS)).groupBy("event_id", "location_id", "threat_type", "evidence", "direction", "observed_at").agg(F.max("r").alias("r"))
    up = tree.select(F.col("descendant_id").alias("location_id"), F.col("ancestor_id").alias("territory_id"), F.when(F.col("depth") == 0, F.lit("direct")).otherwise(F.lit("partial")).alias("coverage"))
    reached = named.join(up, "location_id").withColumns({"e": rank(F.col("evidence"), EVIDENCE), "c": rank(F.col("coverage"), COVERAGES)})
    key = ["territory_id", "threat_type"]
    each = reached.groupBy(*key, "event_id").agg(F.max("r").alias("r"), F.max("e").alias("e"), F.max("c").alias("c"), F.max("observed_at").alias("observed_at"), F.max_by("direction", F.struct("observed_at", "direction")).alias("direction"))
    whole = each.groupBy(*key).agg(F.max("r").alias("r"), F.max("e").alias("e"), F.max("c").alias("c"), F.count("*").alias("events"), F.max("observed_at").alias("last_at"), F.max_by("direction", F.struct("observed_at", "event_id")).alias("direction"))
    newest = each.withColumn("n", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("observed_at"), "event_id"))).where(F.col("n") <= most)
    ids = newest.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "event_id"))), lambda x: x["event_id"]).alias("event_ids"))
    word = lambda c, order: F.get(F.array(*(F.lit(x) for x in order)), F.col(c) - 1)
    out = whole.join(ids, key)
    return out.select(*key, word("r", RELATIONS).alias("relation"), word("e", EVIDENCE).alias("evidence"), word("c", COVERAGES).alias("coverage"), "events", "last_at", "direction", "event_ids", (F.col("r") > 1).alias("asserted"))


def subscribers_by_region(subscriptions: DataFrame, regions: DataFrame) -> DataFrame:
    """(region_id, chats): chats with a subscription in the region; one with several places of a region counts once."""
    return subscriptions.join(regions, "location_id").groupBy("region_id").agg(F.count_distinct("chat_id").alias("chats"))


def _crosses(ring: Column) -> Column:
    """Of a ring of points (x, y): struct(cross, a, b) of each side, the one back to the first point included."""

    def side(a: Column, b: Column) -> Column:
        return F.struct((a["x"] * b["y"] - b["x"] * a["y"]).alias("cross"), (a["x"] + b["x"]).alias("x"), (a["y"] + b["y"]).alias("y"))

    before = lambda points: F.concat(F.slice(points, -1, 1), F.slice(points, F.lit(1), F.size(points) - 1))
    return once(ring, lambda points: F.zip_with(before(points), points, side))


def _total(values: Column, value) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + value(v))


def ring_area(ring: Column) -> Column:
    """Signed shoelace area of a ring of points (x, y); 0 for none."""
    return once(ring, lambda r: F.when(F.size(r) > 0, _total(_crosses(r), lambda v: v["cross"]) / 2).otherwise(F.lit(0.0)))


def centroid(ring: Column) -> Column:
    """struct<x, y>: the centroid of a ring, its first point where it has no area, null where it has no points."""

    def of(r: Column, crosses: Column, area: Column) -> Column:
        mean = lambda axis: _total(crosses, lambda v: v[axis] * v["cross"]) / (6 * area)
        whole = F.struct(mean("x").alias("x"), mean("y").alias("y"))
        first = F.struct(F.get(r, F.lit(0))["x"].alias("x"), F.get(r, F.lit(0))["y"].alias("y"))
        return F.when(area != 0, whole).otherwise(first)

    each = lambda r: once(_crosses(r), lambda c: once(_total(c, lambda v: v["cross"]) / 2, lambda area: of(r, c, area)))
    return once(ring, lambda r: F.when(F.size(r) > 0, each(r)))


def sane_ring(ring: Column) -> Column:
    """The ring's points within the degrees of the globe, each of a run of equal ones once, closed; null under 4 points."""
    inside = F.filter(ring, lambda p: p["x"].between(-180, 180) & p["y"].between(-90, 90))
    runs = lambda points: F.filter(points, lambda p, i: (i == 0) | (p != F.get(points, i - 1)))
    closed = lambda r: F.when(F.get(r, F.lit(0)) == F.element_at(r, -1), r).otherwise(F.concat(r, F.slice(r, 1, 1)))
    whole = lambda r: once(closed(r), lambda c: F.when(F.size(c) >= 4, c))
    return once(once(inside, runs), lambda r: F.when(F.size(r) > 0, whole(r)))


def bounds(ring: Column) -> Column:
    axis = lambda r, a: F.transform(r, lambda p: p[a])
    return once(ring, lambda r: F.struct(*(f(axis(r, a)).alias(f"{n}_{a}") for a in ("x", "y") for n, f in (("least", F.array_min), ("most", F.array_max)))))


def bounds_overlap(a: Column, b: Column) -> Column:
    meet = lambda a, b: (a["least_x"] <= b["most_x"]) & (b["least_x"] <= a["most_x"]) & (a["least_y"] <= b["most_y"]) & (b["least_y"] <= a["most_y"])
    return once(a, lambda one: once(b, lambda other: meet(one, other)))
