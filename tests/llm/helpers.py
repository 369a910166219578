"""Rows that every text operator must take, and readers of the test tables."""

from __future__ import annotations

import hashlib
import re

import duckdb

LONG = "lorem ipsum dolor sit amet consectetur " * 20_000
#: doc_id, text, lang: nulls, empty and blank texts, repeated rows, equal texts under other ids, a very long text.
ODD = [
    (1, None, None),
    (2, "", "en"),
    (3, " \n\t\n", "en"),
    (4, "The quick brown fox jumps over the lazy dog near the old river bank today", "en"),
    (4, "The quick brown fox jumps over the lazy dog near the old river bank today", "en"),
    (5, "The quick brown fox jumps over the lazy dog near the old river bank today", None),
    (None, "a row without an id, with words enough for a window of ten words in it", "en"),
    (None, None, None),
    (6, LONG, "la"),
    (7, "one", "en"),
    (8, "naïve café — 東京 😀   don't   \r\nCAFÉ\x0b<|endoftext|>tail", "fr"),
    (9, "x" * 70_000, None),
]
SCHEMA = "doc_id long, text string, lang string"
CLASHING = ("n_words", "n_hit", "items", "clean_text", "n_lines", "n_dropped", "kept_text", "same", "kept", "lang_pred", "score", "token_ids", "Score_")


def documents(spark, rows=ODD, clashing=()):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, SCHEMA)
    return df.withColumns({c: F.lit("own") for c in clashing}) if clashing else df


def read(sf_dir: str, table: str, columns: str = "*") -> list[tuple]:
    path = f"{sf_dir}/{table}.parquet"
    import os

    return duckdb.sql(f"SELECT {columns} FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'").fetchall()


def sha(text: str | bytes) -> str:
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def lower_ascii(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def rows(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=repr)


def by_id(pairs) -> list[tuple]:
    return sorted(pairs, key=repr)
