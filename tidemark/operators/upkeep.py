"""Tables that are kept up as rows come in: months that are counted anew only where they changed, texts within a budget, and
what a replay of the rules changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .waves import monthly_rollup

AXES = ("threat_type", "locations", "significance")


def month_of(at: str) -> Column:
    """The local month that monthly_rollup counts an instant in."""
    return F.date_format(F.date_trunc("month", F.from_utc_timestamp(at, "Europe/Kyiv")), "yyyy-MM")


def _digests(rows: DataFrame) -> DataFrame:
    """(month, digest): a sum of hashes that doesn't depend on the order of rows."""
    own = [c for c in sorted(rows.columns) if c != "month"]
    return rows.groupBy("month").agg(F.sum(F.xxhash64("month", *own).cast("decimal(38,0)")).cast("string").alias("digest"))


def refresh_months(periods: DataFrame, changed: DataFrame, path: str) -> DataFrame:
    """Bring the stored monthly rollup at `path` up to date; gives (month, outcome): written, confirmed or removed.

    periods: all intervals (location_id, started_at, ended_at), changed: those that came, went or changed since, as they were
    and as they are. Only their months are read and counted; a month whose rows are what is stored is confirmed and not
    written; others are overwritten as partitions, and those without rows any more are emptied. The first call counts every
    month that `changed` names. A call that failed is repeated as it was: partitions are replaced, never added to."""
    spark = periods.sparkSession
    months = changed.select(month_of("started_at").alias("month")).where("month IS NOT NULL").distinct()
    wanted = [r.month for r in months.collect()]  # a row for each month
    if not wanted:
        return spark.createDataFrame([], "month string, outcome string")
    fresh = monthly_rollup(periods.where(month_of("started_at").isin(wanted))).withColumn("month", F.substring("month", 1, 7)).persist()
    try:
        new = {r.month: r.digest for r in _digests(fresh).collect()}
        stored = stored_months(spark, path, fresh)
        old = {r.month: r.digest for r in _digests(stored.where(F.col("month").isin(wanted))).collect()} if stored is not None else {}
        write = sorted(m for m in new if old.get(m) != new[m])
        if write:
            fresh.where(F.col("month").isin(write)).repartition("month").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(path)
        gone = sorted(m for m in old if m not in new)
        for month in gone:
            folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/month={month}")
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
        outcome = [(m, "written" if m in write else "confirmed") for m in sorted(new)] + [(m, "removed") for m in gone]
        return spark.createDataFrame(outcome, "month string, outcome string")
    finally:
        fresh.unpersist()


def stored_months(spark: SparkSession, path: str, like: DataFrame) -> DataFrame | None:
    """The stored rollup, in the columns of `like`; None before anything is stored."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return None
    return spark.read.schema(like.schema).parquet(path).select(*like.columns)


def budgeted_texts(lines: DataFrame, budget: int, slot_seconds: int = 86_400) -> DataFrame:
    """(location_id, content, tokens, entries, compact_entries, compact_tokens): of each place the newest lines within a
    budget of tokens, oldest first, and how many older ones are left to be compacted. lines: (location_id, id, at, tokens,
    text); ties of time by id. A line over the budget by itself is left, with all before it. Null texts and places take no
    part.

    Running sums go within slots of time and over the slots' sums, so that no place's lines need to be in one task; what is
    gathered for a place is bounded by the budget, of which each line takes one token at least."""
    rows = lines.where(F.col("text").isNotNull() & F.col("location_id").isNotNull()).withColumn("tokens", F.greatest("tokens", F.lit(1)).cast("long")).withColumn("slot", F.floor(F.unix_micros("at") / (slot_seconds * 1_000_000)))
    key = ["location_id", "slot"]
    later = Window.partitionBy("location_id").orderBy(F.desc("slot")).rowsBetween(Window.unboundedPreceding, -1)
    slots = rows.groupBy(*key).agg(F.sum("tokens").alias("own")).select(*key, F.coalesce(F.sum("own").over(later), F.lit(0)).alias("later"))
    newest = Window.partitionBy(*key).orderBy(F.desc("at"), F.desc("id")).rowsBetween(Window.unboundedPreceding, 0)
    reach = rows.withColumn("within", F.sum("tokens").over(newest)).join(slots, key).withColumn("kept", F.col("within") + F.col("later") <= budget)
    kept, left = F.col("kept"), ~F.col("kept")
    content = F.transform(F.array_sort(F.collect_list(F.when(kept, F.struct("at", "id", "text")))), lambda x: x["text"])
    total = lambda mark, value: F.coalesce(F.sum(F.when(mark, value)), F.lit(0)).cast("long")
    return reach.groupBy("location_id").agg(F.array_join(content, "\n").alias("content"), total(kept, F.col("tokens")).alias("tokens"), total(kept, F.lit(1)).alias("entries"), total(left, F.lit(1)).alias("compact_entries"), total(left, F.col("tokens")).alias("compact_tokens"))


def verdict_diffs(old: DataFrame, new: DataFrame) -> DataFrame:
    """Of verdicts (message_id, threat_type, places, significant, rejection) those that a replay changes: the axes on which they
    differ, what was and what became, and the places that left and came. A class of null and unknown are the same; places are
    sets; messages of one side alone take no part."""
    side = lambda df, p: df.select("message_id", F.coalesce("threat_type", F.lit("unknown")).alias(f"{p}_type"), F.array_sort(F.array_distinct(F.coalesce("places", F.array().cast("array<string>")))).alias(f"{p}_places"), F.coalesce("significant", F.lit(False)).alias(f"{p}_significant"), F.col("rejection").alias(f"{p}_rejection"))
    both = side(old, "old").join(side(new, "new"), "message_id")
    pairs = (("old_type", "new_type"), ("old_places", "new_places"), ("old_significant", "new_significant"))
    axes = F.array_compact(F.array(*(F.when(F.col(a) != F.col(b), F.lit(axis)) for axis, (a, b) in zip(AXES, pairs))))
    rows = both.withColumn("axes", axes).where(F.size("axes") > 0)
    return rows.withColumns({"left_places": F.array_except("old_places", "new_places"), "came_places": F.array_except("new_places", "old_places")})


def replay_report(diffs: DataFrame, examples: int = 20) -> DataFrame:
    """(part, key, messages, examples) of verdict_diffs: by axis, with the ids of the first `examples` messages; moves of
    classes; what became significant or is ignored now, by reason. Examples are limited before they are shuffled."""
    axis = diffs.select(F.explode("axes").alias("key"), "message_id")
    order = Window.partitionBy("key").orderBy("message_id")
    shown = axis.withColumn("n", F.row_number().over(order)).where(F.col("n") <= examples).groupBy("key").agg(F.array_sort(F.collect_list("message_id")).alias("examples"))
    by_axis = axis.groupBy("key").agg(F.count("*").alias("messages")).join(shown, "key").select(F.lit("axis").alias("part"), "key", "messages", "examples")
    none = F.array().cast(by_axis.schema["examples"].dataType)
    counted = lambda part, rows: rows.groupBy("key").agg(F.count("*").alias("messages")).select(F.lit(part).alias("part"), "key", "messages", none.alias("examples"))
    moves = counted("move", diffs.where("old_type <> new_type").select(F.concat_ws(" -> ", "old_type", "new_type").alias("key")))
    turned = F.when(F.col("new_significant"), F.lit("significant")).otherwise(F.concat(F.lit("ignored: "), F.coalesce("new_rejection", F.lit("unknown"))))
    return by_axis.unionByName(moves).unionByName(counted("significance", diffs.where("old_significant <> new_significant").select(turned.alias("key"))))
