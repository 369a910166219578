"""What a message says and denies: clauses, withdrawals, courses, origins, forecasts. All are columns over the text."""

from __future__ import annotations

from collections.abc import Collection, Iterable, Iterator, Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from . import values as V
from .folds import with_running_sums
from .texts import CLASS_PATTERNS, folded

# Denials, withdrawals, absence, anticipation, contrast.
NEGATION = r"(?<!\p{L})(?:не\s+(?:лет|фікс|зафіксов|спостеріга|відміча|відмічен|виявля|виявлен|помічен|зареєстров|становить|загрожу)|нічого\s+не|немає|нема(?!\p{L})|без\s+загроз|відсутн|неактивн|чисте небо)"
DE_ESCALATION = r"(?<!\p{L})відбій\s+загроз|загроз[аи]?\s+мину|небезпек[аи]?\s+мину|загроза\s+відсутн|ціл[ья][а-яіїєґ]*\s+(?:знищен|збит|ліквідован)|(?<!\p{L})збито\s+(?:ціл|усі|всі)|повітряний\s+простір\s+вільн"
#: The letters that denials and withdrawals begin with.
FIRST_OF_DENIALS = "нбвчзцп"
ABSENCE = r"(?<!\p{L})нічого\s+не\s+лет|(?<!\p{L})не\s+лет(?:ить|ять)|(?<!\p{L})неактивн[а-яіїєґ]*|(?<!\p{L})не\s+(?:відміча|фіксу|спостеріга|виявля|поміча)[а-яіїєґ]*|повітряний\s+простір\s+чист|чисте\s+небо|(?<!\p{L})без\s+загроз"
ANTICIPATION = r"(?<!\p{L})очікує|(?<!\p{L})чекає|сподіва|незабаром|(?<!\p{L})скоро(?!\p{L})|згодом|пильност|пильність|не\s+втрача|залишайт|(?<!\p{L})ще\s+не(?!\p{L})"
CONTRAST = r"(?<!\p{L})(?:але|проте|однак|втім|зате|натомість)(?!\p{L})"
CLAUSE_END = r"[.!?;\n]"
# How a course is written, and how a place that is passed is tied to the next.
HEADING = r"[ув]\s+напрямку|курс(?:ом)?\s+на|руха(?:ється|ються)\s+(?:до|на)|пряму(?:є|ють)\s+(?:до|на)|[ув]\s+бік|рух(?:у)?\s+на"
ARROW = r"→|➡|⮕|➤|-->|->"
TRANSIT = r"на|у\s+напрямку|в\s+напрямку|до"
# Seas that launches come from.
ORIGIN_ZONES: list[tuple[str, str]] = [
    ("black_sea", r"(?:з|із|зі)\s+акваторі[іїя]\s+чорного\s+мор|в\s+акваторі[іїя]\s+чорного\s+мор|(?:з|із|зі)\s+чорного\s+мор|чорноморськ[A-Za-z0-9_]*\s+акваторі"),
    ("azov_sea", r"(?:з|із|зі)\s+акваторі[іїя]\s+азовського\s+мор|в\s+акваторі[іїя]\s+азовського\s+мор|(?:з|із|зі)\s+азовського\s+мор"),
]
# Stems, in a row, by which a text forecasts.
FORECASTS = ["прогноз", "спрогноз", "передбачаєм", "передбачаю", "очікуєть", "очікуват", "очікуєм", "очікуй", "завдад", "атакуват", "буде атак", "будуть атак", "буде удар", "будуть удар", "планує", "планують", "готує удар", "готують удар", "намір", "наступн ціл", "цілі на", "ризик влучан", "під загроз буд", "ймовірн ціл", "ймовірн удар", "ймовірн атак", "ймовірн приліт", "ймовірн прильот", "ймовірн напрям", "найімовірніш", "найближч годин", "найближч доб", "найближч ноч"]
#: How far a denial reaches back to the class that it follows, in characters.
REACH = 30
#: Bytes of texts that are cut into words at once.
CHUNK_BYTES = 4 << 20


def _any(pattern: str) -> str:
    return f"(?iu){pattern}"


def with_stances(messages: DataFrame, text_col: str = "text", to: str = "stances", patterns: list[tuple[str, str]] = CLASS_PATTERNS) -> DataFrame:
    """messages with struct<asserted, withdrawn>: the classes that a text names, by whether their clause denies them; a
    class named twice may be in both. A denial or withdrawal reaches forward to the end of its clause and back over REACH
    characters, and never across a contrast. Null texts name nothing. Clauses are read for the classes alone that a text
    holds at all. Patterns are in lower case and find any."""
    denial = f"(?=[{FIRST_OF_DENIALS}])(?:{NEGATION}|{DE_ESCALATION})"
    text = F.col("_low")
    held = [text.rlike(p) for _, p in patterns]
    # columns of their own, so that they are computed once; no denial stands before what a clause's head names
    rows = messages.withColumn("_low", folded(F.coalesce(F.col(text_col), F.lit("")))).withColumn("_held", F.array(*held))
    # split compiles its pattern for each text unless that is one plain character; every end of a clause becomes a newline, which is one
    clauses = F.split(F.regexp_replace(text, f"{CLAUSE_END}|{CONTRAST}", "\n"), "\n", -1)
    rows = rows.withColumn("_parts", F.when(F.array_contains("_held", True), clauses))
    # up to the first denial, or all
    rows = rows.withColumn("_heads", F.transform("_parts", lambda part: F.regexp_extract(part, rf"\A([\s\S]*?)(?:{denial}|\z)", 1)))

    def stances(name: str, pattern: str) -> Column:
        last = pattern.count("(") - pattern.count("(?") + 1  # the group after the pattern's own ones

        def counts(part: Column, head: Column) -> Column:
            after = F.regexp_extract_all(part, F.lit(f"(?>{pattern})(?=([\\s\\S]{{0,{REACH}}}))"), F.lit(last))
            some = F.struct(F.regexp_count(head, F.lit(pattern)).alias("free"), after.alias("after"))
            # without a denial all are free, and one stands for them
            return F.when(part.rlike(pattern), F.when(head == part, F.struct(F.lit(1).alias("free"), F.array(F.lit("")).alias("after"))).otherwise(some))

        # a step for each value that is used more than once, as a lambda computes it anew for each mention
        met = F.array_compact(F.zip_with("_parts", "_heads", counts))
        met = F.transform(met, lambda c: F.struct(c["free"].alias("free"), F.size(c["after"]).alias("all"), F.size(F.filter(F.slice(c["after"], F.lit(1), c["free"]), lambda x: x.rlike(denial))).alias("denied")))
        return F.transform(met, lambda c: F.struct(F.lit(name).alias("name"), (c["free"] > c["denied"]).alias("asserted"), (c["all"] > c["free"] - c["denied"]).alias("withdrawn")))

    every = F.flatten(F.array_compact(F.array(*(F.when(F.get("_held", F.lit(i)), stances(n, p)) for i, (n, p) in enumerate(patterns)))))
    rows = rows.withColumn("_every", every)
    pick = lambda field: F.array_sort(F.array_distinct(F.transform(F.filter("_every", lambda x: x[field]), lambda x: x["name"])))
    return rows.withColumn(to, F.struct(pick("asserted").alias("asserted"), pick("withdrawn").alias("withdrawn"))).drop("_low", "_held", "_parts", "_heads", "_every")


def intent(text: Column, stances: Column) -> Column:
    """assertion, de_escalation or none. One class that isn't denied makes an assertion; only a text that anticipates
    nothing takes back."""
    low = folded(text)
    takes_back = (F.size(stances["withdrawn"]) > 0) | low.rlike(DE_ESCALATION) | low.rlike(ABSENCE)
    return F.when(F.size(stances["asserted"]) > 0, F.lit("assertion")).when(takes_back & ~low.rlike(ANTICIPATION), F.lit("de_escalation")).otherwise(F.lit("none"))


def redirect(text: Column) -> Column:
    """struct<passed, towards>: the parts of a text that name what was passed and what comes next; null without both."""
    pattern = _any(rf"(?<!\p{{L}})повз\s+([^.!?\n]{{2,60}}?)\s+(?:{TRANSIT})\s+([^.!?\n]{{2,80}})")
    passed = F.regexp_extract(text, pattern, 1)
    return F.when(passed != "", F.struct(passed.alias("passed"), F.regexp_extract(text, pattern, 2).alias("towards")))


def relation(text: Column, alias: Column) -> Column:
    """How a text relates to the place that it calls alias: reported_direction, explicit_threat, aftermath or mentioned."""
    name = F.concat(F.lit(r"\Q"), alias, F.lit(r"\E"))
    near = lambda before: F.regexp(text, F.concat(F.lit(_any(before)), name))
    course = near(rf"(?:{HEADING})\s+(?:.{{0,24}})") | near(rf"(?:{ARROW})\s*[^.!?\n]{{0,40}}?") | near(rf"повз\s+[^.!\n]{{0,40}}?(?:{TRANSIT})\s+(?:.{{0,10}})")
    return F.when(course, F.lit("reported_direction")).when(near(r"(?:загроза|небезпека|увага для)(?:.{0,45})"), F.lit("explicit_threat")).when(text.rlike(_any("наслідк|влучан|пошкоджен|вибух")), F.lit("aftermath")).otherwise(F.lit("mentioned"))


def origin_zone(text: Column) -> Column:
    """The first zone that a text names as an origin, or null."""
    return F.coalesce(*(F.when(text.rlike(_any(p)), F.lit(zone)) for zone, p in ORIGIN_ZONES))


def forecast_lexeme(text: Column, lexemes: list[str] = FORECASTS) -> Column:
    """The first of the lexemes whose stems begin words in a row of the text, or null."""
    word = r"[\p{L}\p{N}]"
    found = (F.when(text.rlike(_any(f"(?<!{word})" + f"{word}*[^\\p{{L}}\\p{{N}}]+".join(x.split()))), F.lit(x)) for x in lexemes)
    return F.coalesce(*found)


def commentary_fault(text: Column, facts: Column, classes: Column, known_classes: Column, places: Column, known_places: Column) -> Column:
    """The first fault of a generated comment: a number that no fact states, a forecast, a class or a place that isn't
    known; null for a sound one."""
    from .texts import ungrounded_numbers

    first = lambda values: F.get(F.array_sort(values), F.lit(0))
    number, lexeme = first(ungrounded_numbers(text, facts)), forecast_lexeme(text)
    odd_class, odd_place = first(F.array_except(classes, known_classes)), first(F.array_except(places, known_places))
    return F.coalesce(*(F.when(x.isNotNull(), F.concat(F.lit(f"{kind}: "), x)) for kind, x in (("number", number), ("forecast", lexeme), ("class", odd_class), ("place", odd_place))))


def token_keys(text: Column) -> Column:
    """The words of a text in lower case, without apostrophes; hyphens within words belong to them."""
    return F.transform(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(V.WORD), F.lit(0)), lambda w: F.translate(w, V.APOSTROPHES, ""))


def with_tokens(messages: DataFrame, text_col: str = "text", to: str = "tokens") -> DataFrame:
    """messages with array<struct<key, start, end>>: the words of a text, as token_keys gives them, and their places in
    characters of the lower-case text. Null and empty texts have none; a long text takes time in proportion to it."""
    low = F.lower(F.coalesce(F.col(text_col), F.lit("")))
    rows = messages.withColumn("_words", F.regexp_extract_all(low, F.lit(V.WORD), F.lit(0))).withColumn("_gaps", F.split(low, V.WORD, -1))
    rows = rows.withColumn("_steps", F.zip_with(F.slice("_gaps", 1, F.size("_words")), "_words", lambda g, w: F.length(g) + F.length(w)))
    rows = with_running_sums(rows, "_steps", "_at")

    def token(word: Column, i: Column) -> Column:
        end = F.get(F.col("_at"), i + 1)
        return F.struct(F.translate(word, V.APOSTROPHES, "").alias("key"), (end - F.length(word)).alias("start"), end.alias("end"))

    return rows.withColumn(to, F.transform("_words", token)).drop("_words", "_gaps", "_steps", "_at")


def with_spans(rows: DataFrame, most: int, tokens: str = "tokens", to: str = "span") -> DataFrame:
    """A row for each token, its number n and the array of it and those after it, `most` in all at the most; a text without
    tokens has a row of nulls."""
    # spans are cut below the generator, which would else copy all tokens for each; outer, as an inner one has the optimiser ask
    # below all projections whether there are any, and so compute the nested arrays anew
    cut = rows.withColumn("_spans", F.transform(tokens, lambda t, i: F.slice(F.col(tokens), i + 1, most))).drop(tokens)
    return cut.select(*[c for c in cut.columns if c != "_spans"], F.posexplode_outer("_spans").alias("n", to))


def _words(low: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All words of texts in lower case: as they are spelled, the text, the number in it, start and end in its characters. No
    text holds the character 1."""
    parts = pc.split_pattern(pc.replace_substring_regex(low, pattern=V.WORD, replacement="\x01\\0\x01"), "\x01")
    flat, offsets = parts.flatten(), parts.offsets.to_numpy().astype(np.int64)
    words = np.diff(offsets) // 2  # between the words, before and after them are gaps
    text = np.repeat(np.arange(len(words)), words)
    n = np.arange(len(text)) - (np.cumsum(words) - words)[text]
    at = offsets[text] + 2 * n + 1
    before = np.concatenate([[0], np.cumsum(pc.utf8_length(flat).to_numpy(), dtype=np.int64)])
    base = before[offsets[text]]
    return flat.take(pa.array(at)).dictionary_encode(), text, n, before[at] - base, before[at + 1] - base


def first_spans(messages: DataFrame, most: int, firsts: Mapping[str, tuple[int, int, Collection[str] | None]] | None = None, inner: Collection[str] = ()) -> DataFrame:
    """(id, n, start, keys, ends) of messages (id, text), a row for each token: its number, where it starts, and the keys and ends of
    it and those after it, `most` in all at the most; keys and places are those of with_tokens.

    firsts: the keys alone that are asked for, each with how few and how many tokens are of use, and the keys that may come second,
    where not all of inner may; of those after the first, only keys in inner are of use, and a span ends before another one. Of
    tokens that are alone in their spans and in no span of one before there is one row for each spelling in a text, the first."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if firsts is not None:
            sought, others = pa.array(list(firsts), pa.string()), pa.array(list(inner), pa.string())
            # the last for keys that aren't asked for, whose place is -1
            least, reach = (np.array([*(x[k] for x in firsts.values()), 0], np.int64) for k in (0, 1))
            places = {key: i for i, key in enumerate(inner)}
            pairs = np.array([i * len(places) + places[key] for i, x in enumerate(firsts.values()) for key in x[2] or ()], np.int64)
            checked = np.array([*(x[2] is not None for x in firsts.values()), False])
        for batch in batches:
            size = np.cumsum(pc.binary_length(batch.column(1)).to_numpy(), dtype=np.int64)
            cuts = np.flatnonzero(np.diff(size // CHUNK_BYTES)) + 1
            for start, stop in zip([0, *cuts], [*cuts, batch.num_rows]):
                part = batch.slice(start, stop - start)
                spelled, text, n, begin, end = _words(part.column(1).cast(pa.string()))
                codes, i = spelled.indices.to_numpy(), np.arange(len(n))
                keys = pc.replace_substring_regex(spelled.dictionary, pattern=f"[{V.APOSTROPHES}]", replacement="")
                ends_span = n == 0
                if firsts is None:
                    few, many = np.ones(len(n), np.int64), np.full(len(n), most)
                else:
                    place = pc.fill_null(pc.index_in(keys, value_set=sought), -1).to_numpy()
                    few, many = least[place][codes], np.minimum(reach[place], most)[codes]
                    other = pc.fill_null(pc.index_in(keys, value_set=others), -1).to_numpy().astype(np.int64)[codes]
                    ends_span |= other < 0
                # up to the next token that ends a span
                until = np.minimum.accumulate(np.append(np.where(ends_span, i, len(n)), len(n))[::-1])[::-1][1:]
                many = np.minimum(many, until - i)
                if firsts is not None:
                    more = np.flatnonzero((many > 1) & checked[place][codes])
                    met = np.isin(place.astype(np.int64)[codes[more]] * len(others) + other[more + 1], pairs)
                    many[more[~met]] = 1
                kept = np.flatnonzero((many > 0) & (many >= few))
                if firsts is not None:
                    over = np.maximum.accumulate(kept + many[kept])
                    alone = (many[kept] == 1) & (np.append(0, over[:-1])[: len(kept)] <= kept)
                    _, one = np.unique(text[kept[alone]] * len(keys) + codes[kept[alone]], return_index=True)
                    kept = np.sort(np.concatenate([kept[~alone], kept[alone][one]]))
                offsets = np.append(0, np.cumsum(many[kept]))
                at = np.repeat(kept - offsets[:-1], many[kept]) + np.arange(offsets[-1])
                lists = lambda values: pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)
                columns = [part.column(0).take(pa.array(text[kept])), pa.array(n[kept], pa.int32()), pa.array(begin[kept], pa.int32()), lists(keys.take(pa.array(codes[at]))), lists(pa.array(end[at], pa.int32()))]
                yield pa.RecordBatch.from_arrays(columns, ["id", "n", "start", "keys", "ends"])

    # lower makes odd bytes valid
    low = F.replace(F.lower(F.coalesce("text", F.lit(""))), F.lit("\x01"), F.lit(" "))
    return messages.select("id", low.alias("text")).mapInArrow(run, f"id {messages.schema['id'].dataType.simpleString()}, n int, start int, keys array<string>, ends array<int>")
