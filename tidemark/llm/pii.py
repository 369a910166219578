"""Personal data: patterns, and terms that disclose what the patterns found.

Base spans are e-mail addresses, IPv4 addresses, payment-card and telephone numbers. Each distinct value is a protected
entity. For entity e and any term t (a run of letters) of a document that holds e, corpus counts of documents give
PMI(e, t) = log(p(e | t) / p(e)) with p(e | t) = (n_et + PRIOR p(e)) / (n_t + PRIOR), and IC(e) = -log p(e): PRIOR
documents of the corpus at large are added to those that hold t, so that few documents tell less than many. Where
PMI / IC reaches the disclosure threshold, t tells that share of what e itself would tell, and all its occurrences in
documents that hold e become ``term`` spans. Sanitising replaces base spans by their kind (generalisation) and removes
disclosing terms.

Everything is DataFrame functions. Scale: patterns run where the text is; of documents with base spans the text is kept.
A term of such a document meets its count first, and pairs are made with those entities alone that it could tell at the
most, n_et = min(n_e, n_t); for an entity of one document n_et is 1 and no pair is made. Counts combine before shuffles;
joins read tables of their own, which AQE can split where an entity or a term is in a third of all documents.

Edge cases: null text counts as empty; repeated rows count as documents of their own and get the same spans; a null id
is an id like others; an entity in every document discloses nothing (IC = 0); terms inside e-mail addresses are no spans
of their own; long texts need no recursion, as the patterns are possessive, and time in
proportion to their words; only doc_id and text are read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .common import materialise

PRIOR, DISCLOSURE = 1.0, 0.7
KINDS = ("email", "ip", "card", "phone")
TERM = len(KINDS)
#: The base patterns. What the look-behinds rule out are starts inside a run whose first start has failed; \G lets a
#: match begin right where the one before has ended. Possessive quantifiers never change what is found here, as the next
#: character asked for is in none of the repeated classes.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
IP_VALUE = r"^0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})(?:\.0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})){3}$"
BLOCK = 128
#: Characters of a block of text.
TEXT_BLOCK = 4096


def _with_running(rows: DataFrame, numbers: str, to: str, step=lambda a, x: a + x) -> DataFrame:
    """rows with the array column `to`: for each of the numbers, and at the end, what step makes of those before it, from 0.

    In proportion to the numbers: blocks of BLOCK run on their own, then the blocks' ends in blocks, then the ends of these.
    Each array is a column of its own, so that no lambda computes it anew."""
    run = lambda values: F.aggregate(values, F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(step(F.element_at(a, -1), x))))
    blocks = lambda values: F.when(F.size(values) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / BLOCK).cast("int")), lambda b: run(F.slice(values, b * BLOCK + 1, BLOCK))))
    ends = lambda runs: F.transform(runs, lambda r: F.element_at(r, -1))
    one, two, three, last = (f"{to}_{i}" for i in ("one", "two", "three", "last"))
    rows = rows.withColumn(one, blocks(F.col(numbers))).withColumn(last, ends(F.col(one))).withColumn(two, blocks(F.col(last)))
    rows = rows.withColumn(three, run(ends(F.col(two))))
    before = lambda i: step(F.get(F.col(three), F.floor(i / BLOCK).cast("int")), F.get(F.get(F.col(two), F.floor(i / BLOCK).cast("int")), i % BLOCK))
    all_but_ends = F.flatten(F.transform(one, lambda r, i: F.transform(F.slice(r, 1, F.size(r) - 1), lambda x: step(before(i), x))))
    total = F.element_at(F.col(three), -1)
    rows = rows.withColumn(to, F.when(F.size(numbers) > 0, F.concat(all_but_ends, F.array(total))).when(F.size(numbers) == 0, F.array(F.lit(0))))
    return rows.drop(one, two, three, last)


def _among(word: Column, sorted_words: Column, powers: Column) -> Column:
    """Whether the sorted words hold word; powers: of two, downwards, up to their number."""
    at = F.aggregate(powers, F.lit(0), lambda a, p: F.when((a + p <= F.size(sorted_words)) & (F.get(sorted_words, a + p - 1) <= word), a + p).otherwise(a))
    return F.when(F.size(sorted_words) <= 16, F.array_contains(sorted_words, word)).otherwise(F.get(sorted_words, at - 1) == word)


def _luhn(digits: Column) -> Column:
    def value(i: Column) -> Column:
        d = F.substring(digits, -i, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d))

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda a, i: a + value(i)) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(IP_VALUE)
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "card":
        return F.length(digits).between(13, 19) & _luhn(digits)
    return F.length(digits).between(9, 15) if kind == "phone" else F.lit(True)


def _possible(kind: str, text: Column) -> Column:
    return F.contains(text, F.lit({"email": "@", "ip": ".", "phone": "+"}[kind])) if kind != "card" else text.rlike("[0-9]{2}|[0-9][ -][0-9]")


WORD = r"\p{L}++"


def _terms(text: Column) -> Column:
    """The different runs of letters, in lower case."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.lower))


def _with_occurrences(rows: DataFrame) -> DataFrame:
    """rows, which have masked and told, with the array column found_terms: (kind, start, end) of the runs of letters of
    masked that are among told. Each array is a column of its own, so that no lambda computes it anew."""
    words, gaps, numbers = F.col("words"), F.col("gaps"), F.col("numbers")
    some = F.col("told").isNotNull()
    rows = rows.withColumn("words", F.when(some, F.regexp_extract_all("masked", F.lit(WORD), F.lit(0)))).withColumn("gaps", F.when(some, F.split("masked", WORD, -1)))
    rows = rows.withColumn("advance", F.zip_with(F.slice(gaps, 1, F.size(words)), words, lambda g, w: F.length(g) + F.length(w)))
    rows = rows.withColumn("sorted_told", F.array_sort("told")).withColumn("powers", F.filter(F.array(*(F.lit(1 << i) for i in range(30, -1, -1))), lambda p: p <= F.size("told")))
    rows = rows.withColumn("numbers", F.when(F.size(words) > 0, F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda k: _among(F.lower(F.get(words, k)), F.col("sorted_told"), F.col("powers")))))
    rows = _with_running(rows, "advance", "word_at")

    def span(k: Column) -> Column:
        start = F.get(F.col("word_at"), k) + F.length(F.get(gaps, k))
        return F.struct(F.lit(TERM).alias("kind"), start.alias("start"), (start + F.length(F.get(words, k))).alias("end"))

    return rows.withColumn("found_terms", F.transform(numbers, span)).drop("words", "gaps", "advance", "sorted_told", "powers", "numbers", "word_at")


def _with_spans(rows: DataFrame, number: int, kind: str) -> DataFrame:
    """rows with the array column `kind` of the valid spans among the strings in {kind}_found."""
    found, gaps = F.col(f"{kind}_found"), F.col(f"{kind}_gaps")
    some = F.size(found) > 0
    advance = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, m: F.length(g) + F.length(m))
    rows = rows.withColumn(f"{kind}_gaps", F.when(some, F.split("text", PATTERNS[kind], -1)))
    rows = rows.withColumn(f"{kind}_advance", F.when(some, advance))
    rows = _with_running(rows, f"{kind}_advance", f"{kind}_at")

    def span(k: Column) -> Column:
        value = F.get(found, k)
        start = F.get(F.col(f"{kind}_at"), k) + F.length(F.get(gaps, k))
        return F.struct(
            F.lit(number).alias("kind"),
            start.alias("start"),
            (start + F.length(value)).alias("end"),
            F.md5(F.concat(F.lit(kind + ":"), F.lower(value)).cast("binary")).alias("entity"),
        )

    numbers = F.filter(F.sequence(F.lit(0), F.size(found) - 1), lambda k: _valid(kind, F.get(found, k)))
    rows = rows.withColumn(kind, F.when(some, F.transform(numbers, span)))
    if kind == "email":
        masked = F.zip_with(gaps, found, lambda g, m: F.concat(g, F.coalesce(F.repeat(F.lit("@"), F.length(m)), F.lit(""))))
        rows = rows.withColumn("masked", F.when(some, F.array_join(masked, "")).otherwise(F.col("text")))
    return rows.drop(f"{kind}_found", f"{kind}_gaps", f"{kind}_advance", f"{kind}_at")


def base_spans(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, same, base, masked, terms) of every row; base has (kind, start, end, entity), by kind and start. Rows with
    base spans have masked, the text with @ for each character of an e-mail address, and terms, those of the text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    out = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("same"), text.alias("text"))
    for kind, pattern in PATTERNS.items():
        out = out.withColumn(f"{kind}_found", F.when(_possible(kind, F.col("text")), F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>")))
    for number, kind in enumerate(KINDS):
        out = _with_spans(out, number, kind)
    empty = F.array().cast("array<struct<kind:int,start:int,end:int,entity:string>>")
    out = out.withColumn("base", F.concat(*(F.coalesce(F.col(k), empty) for k in KINDS)))
    some = F.size("base") > 0
    return out.select("doc_id", "same", "base", F.when(some, F.col("masked")).alias("masked"), F.when(some, _terms(F.col("text"))).alias("terms"))


def _disclosure(n: int, n_e: Column, n_t: Column, n_et: Column) -> Column:
    """PMI / IC; 0 where IC is 0 or there are no documents."""
    p_e = F.try_divide(n_e.cast("double"), F.lit(float(n)))
    pmi = F.log(F.try_divide(n_et + PRIOR * p_e, (n_t + PRIOR) * p_e))
    return F.coalesce(F.try_divide(pmi, -F.log(p_e)), F.lit(0.0))


def disclosing(documents: DataFrame, spans: DataFrame, threshold: float = DISCLOSURE, text_col: str = "text") -> DataFrame:
    """(row, terms) of the rows that hold terms which tell one of their entities. spans is a table of its own, with a
    number for each row."""
    n, n_e, n_t = spans.count(), F.col("n_e"), F.col("n_t")
    some = spans.where(F.size("base") > 0)
    held = materialise(some.select("row", F.explode(F.array_distinct(F.transform("base", lambda b: b["entity"]))).alias("entity")), "held")
    entities = materialise(held.groupBy("entity").agg(F.count("*").alias("n_e")).where(n_e < n), "entities")
    words = documents.select(F.explode(_terms(F.coalesce(F.col(text_col), F.lit("")))).alias("term"))
    terms = materialise(words.groupBy("term").agg(F.count("*").alias("n_t")), "terms")
    beside = F.collect_list(F.when(n_e > 1, F.struct("entity", "n_e")))
    rows = held.join(entities, "entity").groupBy("row").agg(beside.alias("beside"), F.max(n_e == 1).alias("single"))
    met = some.select("row", F.explode("terms").alias("term")).join(terms, "term").join(rows, "row")
    could = F.filter("beside", lambda e: _disclosure(n, e["n_e"], n_t, F.least(e["n_e"], n_t)) >= threshold)
    alone = F.col("single") & (_disclosure(n, F.lit(1), n_t, F.lit(1)) >= threshold)
    met = met.select("row", "term", "n_t", alone.alias("alone"), could.alias("could")).where(F.col("alone") | (F.size("could") > 0))
    met = materialise(met, "met")
    pairs = met.where(~F.col("alone")).select("row", "term", F.explode("could").alias("e")).select("row", "term", "e.entity")
    every = met.select("term", "n_t", F.explode("could").alias("e")).select("term", "n_t", "e.*")
    n_et = every.groupBy("entity", "term").agg(F.count("*").alias("n_et"), F.first("n_e").alias("n_e"), F.first("n_t").alias("n_t"))
    told = materialise(n_et.where(_disclosure(n, n_e, n_t, F.col("n_et")) >= threshold).select("entity", "term"), "told")
    found = met.where("alone").select("row", "term").unionByName(pairs.join(told, ["entity", "term"], "left_semi").select("row", "term"))
    return found.groupBy("row").agg(F.collect_set("term").alias("told"))


def find_personal_data(documents: DataFrame, threshold: float = DISCLOSURE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, same, spans) of every row: (kind, start, end), by kind (terms last) and start; same is the text's hash."""
    spans = materialise(base_spans(documents, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "base-spans")
    told = disclosing(documents, spans, threshold, text_col)
    base = F.transform("base", lambda b: F.struct(b["kind"].alias("kind"), b["start"].alias("start"), b["end"].alias("end")))
    none = F.array().cast("array<struct<kind:int,start:int,end:int>>")
    some, clean = spans.where(F.size("base") > 0), spans.where(F.size("base") == 0)
    joined = _with_occurrences(some.join(told, "row", "left")).select("doc_id", "same", F.concat(base, F.coalesce("found_terms", none)).alias("spans"))
    return joined.unionByName(clean.select("doc_id", "same", none.alias("spans")))


def sanitise(documents: DataFrame, threshold: float = DISCLOSURE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) of every row: base spans generalised to their kind in brackets, disclosing terms removed. Of spans
    that overlap, the first one's mark stands for all."""
    found = find_personal_data(documents, threshold, id_col, text_col).dropDuplicates(["doc_id", "same"]).select(F.col("doc_id").alias("f_doc"), F.col("same").alias("f_same"), F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))).alias("spans"))
    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    joined = rows.join(found, F.col("doc_id").eqNullSafe(F.col("f_doc")) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("f_same")))
    mark = lambda kind: reduce(lambda c, x: c.when(kind == x[0], F.lit(f"[{x[1].upper()}]")), enumerate(KINDS), F).otherwise(F.lit(""))
    # the text in blocks, so that no part of it is sought from its beginning
    joined = joined.withColumn("ends", F.transform("spans", lambda s: s["end"])).withColumn("blocks", F.regexp_extract_all("text", F.lit(f"(?s).{{1,{TEXT_BLOCK}}}"), F.lit(0)))
    joined = _with_running(joined, "ends", "reached", F.greatest)
    blocks = F.col("blocks")

    def cut(start: Column, end: Column) -> Column:
        first, last = F.floor(start / TEXT_BLOCK).cast("int"), F.floor((end - 1) / TEXT_BLOCK).cast("int")
        head, tail = F.substring(F.get(blocks, first), start % TEXT_BLOCK + 1, F.least(end - start, F.lit(TEXT_BLOCK))), F.substring(F.get(blocks, last), F.lit(1), end - last * TEXT_BLOCK)
        more = F.when(last > first, F.concat(F.array_join(F.slice(blocks, first + 2, F.greatest(last - first - 1, F.lit(0))), ""), tail)).otherwise(F.lit(""))
        return F.when(end > start, F.concat(head, more)).otherwise(F.lit(""))

    def piece(s: Column, i: Column) -> Column:
        before = F.get(F.col("reached"), i)
        return F.concat(cut(before, s["start"]), F.when(s["start"] >= before, mark(s["kind"])).otherwise(F.lit("")))

    rest = cut(F.element_at(F.col("reached"), -1), F.length("text"))
    done = F.concat(F.array_join(F.transform("spans", piece), ""), rest)
    return joined.select("doc_id", F.when(F.col("text").isNotNull(), done).alias("text"))


def personal_data(documents: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_term."""
    found = find_personal_data(documents)
    names = F.array(*(F.lit(k) for k in (*KINDS, "term")))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda i: F.size(F.filter("spans", lambda s: s["kind"] == i)).cast("long")
    return found.select("doc_id", *(count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)), F.sha2(joined(F.filter("spans", lambda s: s["kind"] < TERM)), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), count(TERM).alias("n_term"))
