"""When something is expected, how fresh it is, and small columns about a message."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: How near an expectation is, nearest first, and for how many minutes it holds at least.
TIMINGS = ("now", "within_hour", "evening", "within_day", "within_two_days")
VALID_MINUTES = {"now": 30, "within_hour": 90, "evening": 360, "within_day": 1440, "within_two_days": 2880}
EVENING_HOUR = 18
FRESH_MINUTES = (10, 30, 120)


def timing_rank(timing: Column) -> Column:
    """0 for the nearest; null for what is no timing."""
    place = F.array_position(F.array(*(F.lit(t) for t in TIMINGS)), timing)
    return F.when(place > 0, place - 1)


def nearer_timing(a: Column, b: Column) -> Column:
    return F.when(timing_rank(a) <= timing_rank(b), a).otherwise(b)


def expected_window(timing: Column, at: Column, zone: str = "Europe/Kyiv") -> Column:
    """struct<since, until> of an expectation published at an instant. An evening is from 18:00 to 23:59 of the local day, or
    from then on if it has begun."""
    valid = F.element_at(F.create_map(*(F.lit(x) for kv in VALID_MINUTES.items() for x in kv)), timing)
    plus = lambda t, minutes: F.timestamp_micros(F.unix_micros(t) + minutes.cast("long") * 60_000_000)
    day = F.date_trunc("day", F.from_utc_timestamp(at, zone))
    local = lambda minutes: F.to_utc_timestamp(F.timestamp_micros(F.unix_micros(day) + F.lit(minutes * 60_000_000)), zone)
    since = F.greatest(at, local(EVENING_HOUR * 60))
    until = F.when(local(24 * 60 - 1) > since, local(24 * 60 - 1)).otherwise(plus(since, valid))
    return F.when(timing == "evening", F.struct(since.alias("since"), until.alias("until"))).otherwise(F.struct(at.alias("since"), plus(at, valid).alias("until")))


def freshness_bucket(confirmed_at: Column, now: Column) -> Column:
    """3 under 10 minutes, 2 under 30, 1 under 120, else 0, also for null; an instant to come counts as now."""
    age = F.greatest(F.unix_micros(now) - F.unix_micros(confirmed_at), F.lit(0)) / 60e6
    first, second, third = FRESH_MINUTES
    return F.when(confirmed_at.isNull(), 0).when(age < first, 3).when(age < second, 2).when(age < third, 1).otherwise(0)


def estimated_tokens(text: Column) -> Column:
    """About how many tokens a model counts: 2.8 Cyrillic, 4 Latin and 1.5 other characters to a token, rounded up."""
    cyrillic, latin = (F.length(F.regexp_replace(text, p, "")) for p in (r"[^\x{400}-\x{52F}]", "[^0-9A-Za-z]"))
    return F.coalesce(F.ceil(cyrillic / 2.8 + latin / 4 + (F.length(text) - cyrillic - latin) / 1.5), F.lit(0)).cast("int")


def numeric_id(external_id: Column) -> Column:
    """The number of an id that is all digits, else null."""
    return F.when(external_id.rlike("^[0-9]+$"), external_id.try_cast("long"))


def message_link(username: Column, external_id: Column, public_url: Column) -> Column:
    """The address of a post, of its channel, or of the source; null for a source without one."""
    name, post, url = F.regexp_replace(F.trim(F.coalesce(username, F.lit(""))), "^@", ""), F.trim(F.coalesce(external_id, F.lit(""))), F.trim(F.coalesce(public_url, F.lit("")))
    return F.when((name != "") & post.rlike("^[0-9]+$"), F.concat(F.lit("https://t.me/"), name, F.lit("/"), post)).when(name != "", F.concat(F.lit("https://t.me/"), name)).when(F.lower(url).rlike("^https?://"), url)
