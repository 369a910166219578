"""A corpus through five stages: language, repeated lines, near duplicates, benchmark passages, tokens.

Each stage takes (spark, docs, sf_dir) and gives what the next one gets, as Parquet in between; all but the last give
the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm import bpe, decontaminate, language_id, line_dedup, simhash
from tidemark.llm.common import materialise, table

#: A document stays if the best language's margin is at least so far above the mean of the others; the scale is from -1 to
#: 1 for each language, so the number of languages doesn't matter.
LEAST_LEAD = 0.05

#: No SQL: the stages learn a classifier, hash with XXH64 and run a tokenizer; tests compare them with brute force.
ORACLE_SQL = None


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: documents without a recognisable language (no letters, null, or a lead under LEAST_LEAD) go."""
    found, names = language_id.predict(docs, language_id.trained(docs))
    return found.where((F.col(names["lang_pred"]) != language_id.UNKNOWN) & (F.col(names["lead"]) >= LEAST_LEAD)).select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: frequent lines stay in the document with the largest id alone; n_chars follows the text."""
    out, names = line_dedup.kept_lines(docs)
    text = F.when(F.col("text").isNotNull(), F.col(names["kept_text"]))
    new = {"text": text, "n_chars": F.when(F.col(names["n_dropped"]) > 0, F.length(F.col(names["kept_text"])).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))} if "n_chars" in docs.columns else {"text": text}
    return out.select(*(new[c].alias(c) if c in new else F.col(c) for c in docs.columns))


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: of each component the document with the smallest id stays; of its repeated rows, one. Documents
    without an id have no component name and stay."""
    groups = simhash.near_duplicates(docs).select("doc_id", "component_id").where(F.col("doc_id") == F.col("component_id"))
    kept = materialise(groups.groupBy(F.col("doc_id").alias("kept_id")).count(), "kept")
    # one plan at every size: the kept ids grow with the documents, so they are never a broadcast side
    rows = lambda ids: docs.join(ids.hint("shuffle_hash"), F.col("doc_id") == F.col("kept_id"), "left_semi")
    out = rows(kept.where("count = 1")).unionByName(docs.where(F.col("doc_id").isNull()))
    repeated = kept.where("count > 1")
    return out if repeated.isEmpty() else out.unionByName(rows(repeated).dropDuplicates(["doc_id"]))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: documents that hold a window of a benchmark item go. Null and empty texts have no words and stay, and so
    do all documents beside an empty benchmark."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), "document")


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: doc_id, n_tokens, ids_sha256, decoded_sha256 and the token ids. Null and empty texts have no ids and the
    digest of the empty text; repeated rows each get their row; other columns are not read."""
    return bpe.round_trip(docs)


STAGES = [("language_id", identify), ("line_dedup", dedup_lines), ("near_dedup", dedup_near), ("decontaminate", drop_contaminated), ("bpe", tokenise)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
