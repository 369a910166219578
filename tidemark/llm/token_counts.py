"""Token counts behind a digest cache.

A document's content is known by its SHA-256, a tokenizer by the SHA-256 of its file. Counts that the cache holds for
both digests are joined; only the distinct contents that it lacks are encoded, and their counts are appended to it.

Scale: one narrow shuffle finds the missing digests. Where they are few (MAX_BROADCAST, by a count), they are broadcast and
texts are encoded where they are read: no text moves, and of a warm cache nothing is encoded. Where they are many, one
shuffle by (digest, id) brings the text of one representative of each to the encoder. One join of digests brings counts
back. A content that a third of all rows share is encoded once; its rows stay spread by the scan, and the last join reads
both sides from plain exchanges, which AQE splits when they are skewed.

Edge cases: null text counts as empty; an empty table adds nothing; repeated rows and ids each get their row; a null id
is an id like others; a digest that the cache holds several times counts once, with its smallest count. One job at a time
appends to a cache.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from .bpe import codec, tokenizer_path
from .common import materialise, scratch, sliced

TOKEN_LIMIT = 512
#: Missing digests (of 40 bytes with the id) up to which they are broadcast.
MAX_BROADCAST = 500_000
CACHE = "content binary, tokenizer string, n_tokens long"


def tokenizer_digest(path: str) -> str:
    """The version of a tokenizer: SHA-256 of its file."""
    return hashlib.sha256(Path(path).read_bytes()).hexdigest()


@lru_cache(maxsize=4)
def counter(path: str):
    """A function from a column of texts to their token counts, for a tokenizers (.json) or sentencepiece (.model) file."""
    if path.endswith(".model"):
        import sentencepiece

        pieces = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda column: np.array([len(pieces.encode(x.decode(), num_threads=1)) for x in column.cast(pa.binary()).fill_null(b"").to_pylist()], np.int64)
    from tokenizers import Tokenizer, pre_tokenizers

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    plain = Tokenizer.from_file(path)
    if isinstance(plain.pre_tokenizer, pre_tokenizers.ByteLevel) and plain.normalizer is None:
        return lambda column: np.diff(codec(path).encode(column)[1])
    plain.no_truncation()
    plain.no_padding()
    return lambda column: np.array([len(x.ids) for x in plain.encode_batch([x.decode() for x in column.cast(pa.binary()).fill_null(b"").to_pylist()], add_special_tokens=False)], np.int64)


def read_cache(spark: SparkSession, path: str, tokenizer: str) -> DataFrame:
    """The cached (content, n_tokens) of one tokenizer; empty where there is no cache yet."""
    try:
        cached = spark.read.schema(CACHE).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        cached = spark.createDataFrame([], CACHE)
    return cached.where(F.col("tokenizer") == tokenizer).groupBy("content").agg(F.min("n_tokens").alias("n_tokens"))


def token_counts(documents: DataFrame, cache_path: str, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """(id, n_bytes, n_tokens) of every row; fills the cache on the way."""
    spark, path = documents.sparkSession, path or tokenizer_path()
    tokenizer = tokenizer_digest(path)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = documents.select(F.col(id_col).alias("id"), text.alias("text"), F.unhex(F.sha2(text, 256)).alias("content"))
    wanted = rows.groupBy("content").agg(F.min("id").alias("id")).join(read_cache(spark, cache_path, tokenizer), "content", "left_anti")
    wanted = materialise(wanted, "missing-digests")
    n_wanted = wanted.count()
    wanted = F.broadcast(wanted) if n_wanted <= max_broadcast else wanted.hint("shuffle_hash")
    r, w = rows.alias("r"), wanted.alias("w")
    missing = r.join(w, (F.col("r.content") == F.col("w.content")) & F.col("r.id").eqNullSafe(F.col("w.id")), "left_semi").select("r.content", F.col("r.text").cast("binary").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = counter(path)
        for batch in sliced(batches, 1):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tokens(batch.column(1)), pa.int64())], ["content", "n_tokens"])

    if n_wanted:
        counted = missing.mapInArrow(count, "content binary, n_tokens long").dropDuplicates(["content"])
        counted.select("content", F.lit(tokenizer).alias("tokenizer"), "n_tokens").write.mode("append").parquet(cache_path)
    # a table of its own, so that the last join reads plain exchanges, which can be split where a content is hot
    known = materialise(rows.select("content").distinct().join(read_cache(spark, cache_path, tokenizer), "content"), "counts-of-contents")
    return rows.select("id", "content", F.octet_length("text").cast("long").alias("n_bytes")).join(known, "content").select(F.col("id").alias(id_col), "n_bytes", "n_tokens")


def document_token_counts(documents: DataFrame, cache_path: str | None = None) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit. Without a cache_path the cache begins empty, in the shared folder."""
    counts = token_counts(documents, cache_path or scratch(documents.sparkSession, "token-count-cache"))
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))
