"""The place tree as a closure table (ancestor, descendant, depth), and what is asked of it.

The closure climbs the places with children up to eight levels, all in one lazy plan whose joins share one exchange of these
places' parents; it is a few rows a place. Joins with it are left to Spark, which broadcasts a side that its statistics prove
small."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

MOST_DEPTH = 8
TERMINAL = ("oblast", "special_city", "country")


def closure(locations: DataFrame, most_depth: int = MOST_DEPTH) -> DataFrame:
    """(descendant_id, ancestor_id, depth); depth 0 is the place itself. A path that comes back to a place ends there.

    Only places with children are climbed, in one chain of joins with their parents; the many leaves then take their parent's
    rows in one join. Nothing runs before the result is asked for."""
    parents = locations.where(F.col("parent_id").isNotNull()).select(F.col("id").alias("child"), "parent_id")
    inner = parents.select(F.col("parent_id").alias("inner_id")).distinct()
    steps = parents.join(inner, F.col("child") == F.col("inner_id"), "left_semi").select(F.col("child").alias("below"), F.col("parent_id").alias("next"))
    paths = inner.select("inner_id", F.col("inner_id").alias("top"), F.array("inner_id").alias("path"))
    for _ in range(1, most_depth):
        met = paths.join(steps, (F.col("top") == F.col("below")) & ~F.array_contains("path", F.col("next")), "left")
        paths = met.select("inner_id", F.col("next").alias("top"), F.when(F.col("next").isNotNull(), F.concat("path", F.array("next"))).otherwise(F.col("path")).alias("path"))
    climbed = paths.select("inner_id", F.posexplode_outer("path").alias("up", "top_id"))
    above = parents.join(climbed, F.col("parent_id") == F.col("inner_id")).where(F.col("child") != F.col("top_id"))
    own = locations.select(F.col("id").alias("descendant_id"), F.col("id").alias("ancestor_id"), F.lit(0).alias("depth"))
    return own.unionByName(above.select(F.col("child").alias("descendant_id"), F.col("top_id").alias("ancestor_id"), (F.col("up") + 1).alias("depth")))


def rollup(locations: DataFrame, tree: DataFrame, terminal: tuple[str, ...] = TERMINAL) -> DataFrame:
    """(location_id, region_id): the nearest ancestor, itself included, of a terminal type."""
    ends = locations.where(F.col("type").isin(*terminal)).select(F.col("id").alias("ancestor_id"))
    return tree.join(ends, "ancestor_id").groupBy(F.col("descendant_id").alias("location_id")).agg(F.min_by("ancestor_id", "depth").alias("region_id"))


def related(tree: DataFrame, anchors: DataFrame) -> DataFrame:
    """(root_id, location_id): ancestors and descendants of each anchor, itself included."""
    a = anchors.select(F.col("id").alias("root_id")).distinct()
    up = a.join(tree, F.col("root_id") == F.col("descendant_id")).select("root_id", F.col("ancestor_id").alias("location_id"))
    down = a.join(tree, F.col("root_id") == F.col("ancestor_id")).select("root_id", F.col("descendant_id").alias("location_id"))
    return up.union(down).distinct()


def ancestors_of_type(locations: DataFrame, tree: DataFrame, kind: str) -> DataFrame:
    """(location_id, ancestor_id): proper ancestors of one type."""
    ends = locations.where(F.col("type") == kind).select(F.col("id").alias("ancestor_id"))
    return tree.where(F.col("depth") > 0).join(ends, "ancestor_id").select(F.col("descendant_id").alias("location_id"), "ancestor_id").distinct()


def narrow(candidates: DataFrame, tree: DataFrame) -> DataFrame:
    """Of (mention_id, candidate_id, parent_id): the one candidate under the named parent, null unless exactly one is."""
    under = candidates.join(tree, (F.col("candidate_id") == F.col("descendant_id")) & (F.col("parent_id") == F.col("ancestor_id")), "left_semi")
    found = under.groupBy("mention_id").agg(F.count_distinct("candidate_id").alias("n"), F.min("candidate_id").alias("one"))
    return candidates.select("mention_id").distinct().join(found, "mention_id", "left").select("mention_id", F.when(F.col("n") == 1, F.col("one")).alias("location_id"))


def homonym_labels(places: DataFrame) -> DataFrame:
    """(id, label): the name, with the region where others bear it, with the district where others of the region do."""
    named, regional = Window.partitionBy("name"), Window.partitionBy("name", "region_name")
    label: Column = (
        F.when(F.count("*").over(named) == 1, F.col("name"))
        .when(F.count("*").over(regional) == 1, F.concat("name", F.lit(" ("), F.coalesce("region_name", F.lit("?")), F.lit(")")))
        .otherwise(F.concat("name", F.lit(" ("), F.coalesce("region_name", F.lit("?")), F.lit(", "), F.coalesce("district_name", F.lit("?")), F.lit(")")))
    )
    return places.select("id", label.alias("label"))


def scope_to_subscription(event_places: DataFrame, subscribed: DataFrame, tree: DataFrame) -> DataFrame:
    """Of (chat_id, event_id, location_id): the places related to one that the chat subscribes to, or all where none is."""
    near = related(tree, subscribed.select(F.col("location_id").alias("id"))).withColumnRenamed("location_id", "near_id")
    wanted = subscribed.join(near, F.col("location_id") == F.col("root_id")).select("chat_id", F.col("near_id").alias("location_id")).distinct().withColumn("hit", F.lit(True))
    marked = event_places.join(wanted, ["chat_id", "location_id"], "left")
    any_hit = F.max("hit").over(Window.partitionBy("chat_id", "event_id"))
    return marked.withColumn("any_hit", any_hit).where(F.col("hit") | F.col("any_hit").isNull()).select("chat_id", "event_id", "location_id")
