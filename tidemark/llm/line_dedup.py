"""Line deduplication over levelled sorted runs of line hashes.

A line's key is the line without white space at both ends, A-Z lower-cased; keys shorter than a limit are left alone.
Documents come in batches. The distinct keys of a batch, (h1, h2, n_docs, last_doc), are merge-anti-joined with the runs:
keys that no run holds become a new sorted run of level 0, so every key is in one run only; the others, which earlier
batches have brought, are kept as repetitions. As soon as a level holds ``fanout`` runs, they are merged into one run of
the next level. In the end repetitions add their counts to the runs' keys, and a key that enough documents hold keeps its
lines only in the document with the largest id.

Everything is DataFrame functions. Scale: keys are 128-bit hashes; counts combine before they are shuffled. Runs are tables
bucketed and sorted by key, in the shared folder, so that the anti-joins and merges are sort-merge joins which shuffle no
run. The lines meet the frequent keys in an anti-join of two plain exchanges, which AQE can split where one line is in a
third of all documents; texts are shuffled once, to be put together from their kept lines.

Edge cases: a null or empty text is one empty line; a null doc_id counts as no document and never keeps a frequent line;
repeated rows (same id, same text) count as one document and each get the same result; a tie is impossible as ids order; a
long text takes time in proportion to its length;
only doc_id and text are read, so other columns cannot clash.
"""

from __future__ import annotations

import string
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import fresh, materialise, remove_path, scratch

MIN_KEY_CHARS, MIN_DOCS = 20, 3
#: Batches that one pass over a table is added in, and runs that a level holds before they are merged.
BATCHES, FANOUT = 4, 2
BLANK = " \t\n\x0b\x0c\r"
KEY = ["h1", "h2"]
RUN = "h1 long, h2 long, n_docs long, last_doc long"


def line_key(line: Column) -> Column:
    """lower() folds ASCII fast but other letters too, so it serves lines that are all ASCII; translate serves the others."""
    bare = F.btrim(line, F.lit(BLANK))
    ascii_only = F.octet_length(bare) == F.length(bare)
    return F.when(ascii_only, F.lower(bare)).otherwise(F.translate(bare, string.ascii_uppercase, string.ascii_lowercase))


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


class LineRuns:
    """The runs, as bucketed tables with files under `path`, known to one writer; close() drops tables and files.

    buckets: into how many parts, and so tasks, the keys are cut; shuffle partitions of the session where not given."""

    def __init__(self, spark: SparkSession, path: str, fanout: int = FANOUT, buckets: int | None = None):
        self.spark, self.path, self.fanout = spark, path, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []
        self.repeated: list[str] = []

    def _write(self, keys: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        keys.write.bucketBy(self.buckets, *KEY).sortBy(*KEY).option("path", f"{self.path}/{name}").saveAsTable(name)
        return name

    def _drop(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            remove_path(self.spark, f"{self.path}/{name}")

    def runs(self) -> list[str]:
        return [r for level in self.levels for r in level]

    def unseen(self, keys: DataFrame) -> DataFrame:
        """The rows whose keys no run holds."""
        for run in self.runs():
            keys = keys.join(self.spark.table(run).select(*KEY).hint("merge"), KEY, "left_anti")
        return keys

    def add(self, lines: DataFrame) -> None:
        """Add a batch of (doc_id, h1, h2); a document belongs to one batch."""
        held = lines.groupBy(*KEY, "doc_id").agg(F.lit(1).alias("one"))
        counts = held.groupBy(*KEY).agg(F.count("doc_id").alias("n_docs"), F.max("doc_id").alias("last_doc"))
        batch = self._write(counts.repartition(self.buckets, *KEY))
        if self.runs():
            keys = self.spark.table(batch)
            new = self._write(self.unseen(keys))
            repeated = f"{self.path}/repeated-{uuid.uuid4().hex}"
            keys.join(self.spark.table(new).select(*KEY).hint("merge"), KEY, "left_anti").write.parquet(repeated)
            self.repeated.append(repeated)
            self._drop([batch])
        else:
            new = batch
        self._place(new, 0)

    def _place(self, run: str, level: int) -> None:
        if len(self.levels) == level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            old, self.levels[level] = self.levels[level], []
            merged = self.spark.table(old[0])
            for other in old[1:]:  # a key is in one run only, so a merge has nothing to add up
                a, b = merged.alias("a"), self.spark.table(other).hint("merge").alias("b")
                merged = a.join(b, [F.col(f"a.{k}") == F.col(f"b.{k}") for k in KEY], "full_outer").select(*(F.coalesce(F.col(f"a.{c}"), F.col(f"b.{c}")).alias(c) for c in a.columns))
            new = self._write(merged)
            self._drop(old)
            self._place(new, level + 1)

    def frequent(self, min_docs: int) -> DataFrame:
        """(h1, h2, last_doc) of the keys that at least min_docs documents hold, over all runs; a table of its own."""
        out = self.spark.createDataFrame([], "h1 long, h2 long, last_doc long")
        more = None
        if self.repeated:
            rows = self.spark.read.schema(RUN).parquet(*self.repeated)
            more = self._write(rows.groupBy(*KEY).agg(F.sum("n_docs").alias("more_docs"), F.max("last_doc").alias("more_last")).repartition(self.buckets, *KEY))
        for run in self.runs():
            found, n, last = self.spark.table(run), F.col("n_docs"), F.col("last_doc")
            if more:
                found = found.join(self.spark.table(more).hint("merge"), KEY, "left")
                n, last = n + F.coalesce("more_docs", F.lit(0)), F.greatest("last_doc", "more_last")
            out = out.unionByName(found.where(n >= min_docs).select(*KEY, last.alias("last_doc")))
        out = materialise(out, "frequent-lines")
        self._drop([more] if more else [])
        return out

    def close(self) -> None:
        self._drop(self.runs())
        remove_path(self.spark, self.path)
        self.levels, self.repeated = [], []


def kept_lines(documents: DataFrame, min_chars: int = MIN_KEY_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES, fanout: int = FANOUT, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, dict[str, str]]:
    """documents with n_lines, n_dropped and kept_text, and the names that these columns got."""
    names: dict[str, str] = {}
    for name in ("n_lines", "n_dropped", "kept_text", "same", "kept", "lines"):
        names[name] = fresh(name, [*documents.columns, *names.values()])
    text = F.coalesce(F.col(text_col), F.lit(""))
    same = F.xxhash64(text)
    # hashed and split below the generator, so once for each text and not for each line
    split = documents.select(F.col(id_col).cast("long").alias("doc_id"), same.alias("same"), split_lines(F.col(text_col)).alias("lines"))
    exploded = split.select("doc_id", "same", F.posexplode("lines").alias("at", "line"))
    keyed = exploded.select("doc_id", "same", "at", line_key(F.col("line")).alias("key"))
    long = F.length("key") >= min_chars
    hashed = keyed.select("doc_id", "same", "at", F.when(long, F.xxhash64("key")).alias("h1"), F.when(long, F.xxhash64(F.lit(1), F.col("key"))).alias("h2"), F.pmod(F.xxhash64("doc_id"), F.lit(batches)).alias("batch"))
    lines = materialise(hashed, "line-hashes", "batch")

    runs = LineRuns(documents.sparkSession, scratch(documents.sparkSession, "line-runs"), fanout)
    for batch in range(batches):
        runs.add(lines.where((F.col("batch") == batch) & F.col("h1").isNotNull()).select("doc_id", "h1", "h2"))
    f, n = runs.frequent(min_docs).alias("f"), lines.alias("n")
    runs.close()
    gone = (F.col("n.h1") == F.col("f.h1")) & (F.col("n.h2") == F.col("f.h2")) & ~F.col("n.doc_id").eqNullSafe(F.col("f.last_doc"))
    kept = n.join(f, gone, "left_anti").groupBy("doc_id", "same").agg(F.array_sort(F.collect_set("at")).alias("kept"))

    d, k = documents.withColumn(names["same"], same), kept.select(F.col("doc_id").alias(f"k_{names['same']}"), F.col("same").alias(f"s_{names['same']}"), F.col("kept").alias(names["kept"])).hint("shuffle_hash")
    joined = d.join(k, F.col(id_col).cast("long").eqNullSafe(k[f"k_{names['same']}"]) & (F.col(names["same"]) == k[f"s_{names['same']}"]), "left")
    # the lines are a column of their own, so that they are split once and not for each number
    joined = joined.withColumn(names["lines"], split_lines(F.col(text_col)))
    all_lines, numbers = F.col(names["lines"]), F.coalesce(F.col(names["kept"]), F.array().cast("array<int>"))
    whole = F.size(numbers) == F.size(all_lines)
    rebuilt = F.when(whole, text).otherwise(F.array_join(F.transform(numbers, lambda i: F.get(all_lines, i)), "\n"))
    out = joined.select(*(F.col(c) for c in documents.columns), F.size(all_lines).cast("long").alias(names["n_lines"]), (F.size(all_lines) - F.size(numbers)).cast("long").alias(names["n_dropped"]), rebuilt.alias(names["kept_text"]))
    return out, names


def line_dedup(documents: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256."""
    out, names = kept_lines(documents.select("doc_id", "text"))
    return out.select("doc_id", F.col(names["n_lines"]).alias("n_lines"), F.col(names["n_dropped"]).alias("n_dropped"), F.sha2(F.col(names["kept_text"]), 256).alias("kept_sha256"))


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(l, 1) AS pos, unnest(l) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)
), keyed AS (
  SELECT doc_id, pos, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines
), frequent AS (
  SELECT k, max(doc_id) AS last_doc FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3
), judged AS (
  SELECT n.*, f.k IS NOT NULL AND n.doc_id <> f.last_doc AS gone FROM keyed n LEFT JOIN frequent f ON n.k = f.k
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
