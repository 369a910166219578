"""Text columns: class tags, outcome markers, reported counts, normalised names, guards on generated text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Patterns of the classes, in the order in which tags are given.
CLASS_PATTERNS: list[tuple[str, str]] = [
    ("ballistic_missile", r"баліст[а-яіїєґ]*|іскандер[-– ]?м|kn[-– ]?(23|24)"),
    ("cruise_missile", r"крилат[а-яіїєґ]* ракет[а-яіїєґ]*|іскандер[-– ]?к|калібр[а-яіїєґ]*|он[іи]кс|п[-– ]?800|(?<!\p{L})бандерол[а-яіїєґ]*|швидкісн[а-яіїєґ]*\s+ціл[а-яіїєґ]*"),
    ("guided_air_bomb", r"(?<!\p{L})каб(?:а|у|ом|і|и|ів|ам|ами|ах)?(?!\p{L})|керован[а-яіїєґ]*\s+(?:авіаційн[а-яіїєґ]*\s+бомб|авіабомб)[а-яіїєґ]*"),
    ("uav", r"бпла|ударн[а-яіїєґ]*\s+(?:дрон[а-яіїєґ]*|бп(?!\p{L}))|безпілотник[а-яіїєґ]*|шахед[а-яіїєґ]*|геран[ья][а-яіїєґ]*|мопед[а-яіїєґ]*|(?<!\p{L})реакт(?:ив[а-яіїєґ]*|и|ів|ах|ами)?(?!\p{L})(?!\s+(?:артилері|систем))|(?<!\p{L})zala(?!\p{L})|(?<!\p{L})молн[иі][яюієї](?!\p{L})"),
    ("aviation", r"стратегічн[а-яіїєґ]* авіаці[а-яіїєґ]*|тактичн[а-яіїєґ]* авіаці[а-яіїєґ]*|активність авіаці[а-яіїєґ]*"),
    ("mlrs", r"рсзв|реактивн[а-яіїєґ]* артилері[а-яіїєґ]*"),
    ("artillery", r"артилерійськ[а-яіїєґ]* обстріл[а-яіїєґ]*|ствольн[а-яіїєґ]* артилері[а-яіїєґ]*"),
    ("mortar", r"мінометн[а-яіїєґ]* обстріл[а-яіїєґ]*"),
]
# What a text says of the outcome.
OUTCOME_PATTERNS: list[tuple[str, str]] = [
    ("explosion", r"вибух|детонац|приліт|прильот|влучан"),
    ("air_defence", r"(?:робот|працю|відпрац)[\p{L}]*[^.!?\n]{0,30}(?:ппо|пво)|(?:ппо|пво)[^.!?\n]{0,30}(?:працю|робот)"),
    ("downed", r"збит|знищен|подавлен|ліквідован"),
    ("debris", r"уламк"),
]
# Counted nouns, the first that matches gives the class.
COUNTED_PATTERNS: list[tuple[str, str]] = [
    ("uav", r"^(?:шахед|герань|geran|бпла|дрон|безпілотник)"),
    ("ballistic_missile", r"^(?:балісти|іскандер|кинджал|kn-23)"),
    ("cruise_missile", r"^(?:калібр|крилат|х-101|х-555|х-59|х-31)"),
    ("guided_air_bomb", r"^(?:каб|фаб)[иіыa-я]?$"),
    ("cruise_missile", r"^ракет"),
    ("unknown", r"^(?:ціл[ьіеяю]|об'єкт|обʼєкт)"),
]
NUMBER_BEFORE = r"(\d{1,3})\s*(?:[×xх]\s*)?([\p{L}''-]+)"
NUMBER_AFTER = r"([\p{L}''-]+)\s*(?:[—:-]\s*)(\d{1,3})(?![\p{L}\d_])"
MOST_COUNT = 300
APOSTROPHES = "'’ʼ`"


#: Letters that differ in case alone from another, and that other; one character each, as regular expressions fold them.
_CASES = {c: c.upper().lower() if len(c.upper()) == 1 else c.lower() for c in map(chr, (*range(0xD800), *range(0xE000, 0x10000)))}
_CASES = {c: to for c, to in _CASES.items() if to != c and len(to) == 1}


def folded(text: Column) -> Column:
    """A text without differences of case, as long as before: a pattern in lower case finds in it what it finds in the text
    with (?iu), several times as fast."""
    return F.translate(text, "".join(_CASES), "".join(_CASES.values()))


def tags(text: Column, patterns: list[tuple[str, str]]) -> Column:
    """The names of the patterns that a text matches anywhere, in the patterns' order."""
    return F.array_compact(F.array(*(F.when(text.rlike(f"(?iu){p}"), F.lit(name)) for name, p in patterns)))


def threat_classes(text: Column) -> Column:
    return tags(text, CLASS_PATTERNS)


def raid_outcomes(text: Column) -> Column:
    return tags(text, OUTCOME_PATTERNS)


def reported_counts(text: Column) -> Column:
    """array<struct<threat_type, count>>: for each class the largest quantity that the text names; never a sum."""

    def found(pattern: str, word: int, number: int) -> Column:
        words = F.regexp_extract_all(text, F.lit(f"(?iu){pattern}"), F.lit(word))
        numbers = F.regexp_extract_all(text, F.lit(f"(?iu){pattern}"), F.lit(number))
        return F.zip_with(words, numbers, lambda w, n: F.struct(w.alias("word"), n.cast("int").alias("count")))

    def kind(word: Column) -> Column:
        out = F
        for name, p in COUNTED_PATTERNS:
            out = out.when(word.rlike(f"(?iu){p}"), F.lit(name))
        return out.otherwise(F.lit(None).cast("string"))

    every = F.concat(found(NUMBER_BEFORE, 2, 1), found(NUMBER_AFTER, 1, 2))
    named = F.filter(F.transform(every, lambda x: F.struct(kind(x["word"]).alias("threat_type"), x["count"].alias("count"))), lambda x: x["threat_type"].isNotNull() & (x["count"] > 0) & (x["count"] <= MOST_COUNT))
    kinds = F.array_sort(F.array_distinct(F.transform(named, lambda x: x["threat_type"])))
    return F.transform(kinds, lambda k: F.struct(k.alias("threat_type"), F.array_max(F.transform(F.filter(named, lambda x: x["threat_type"] == k), lambda x: x["count"])).alias("count")))


def normalised_name(name: Column) -> Column:
    """Lower case without apostrophes and with single spaces."""
    return F.btrim(F.regexp_replace(F.translate(F.lower(name), APOSTROPHES, ""), r"\s+", " "))


def match_rank(query: Column, name: Column, aliases: Column) -> Column:
    """0 for the name itself, 1 for an alias, 2 for a prefix, else null; all normalised before."""
    return F.when(name == query, F.lit(0)).when(F.array_contains(aliases, query), F.lit(1)).when(name.startswith(query), F.lit(2))


def ungrounded_numbers(text: Column, facts: Column) -> Column:
    """The numbers of a text that no fact (array of strings) states."""
    return F.array_except(F.regexp_extract_all(text, F.lit(r"\d+(?:[.,]\d+)?"), F.lit(0)), facts)


def rejection(retrospective: Column, asserts: Column, classes: Column, places: Column) -> Column:
    """Why a message raises nothing, the first reason of a fixed order; null if it does."""
    return F.when(retrospective, F.lit("retrospective")).when(~asserts, F.lit("not_an_assertion")).when(F.size(classes) == 0, F.lit("no_threat")).when(F.size(places) == 0, F.lit("no_location"))


def json_block(text: Column) -> Column:
    """The JSON object in a reply: the fenced block, or from the first brace to the last; null without one."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    loose = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    return F.when(fenced != "", fenced).when(loose != "", loose)
