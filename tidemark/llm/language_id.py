"""Language identification with a blended-spectrum string kernel.

A text is the set of byte n-grams (n = 1 .. 4, lower-cased A-Z) that occur in it. The kernel of two texts is, summed over
n, the number of n-grams that both have, over the geometric mean of their own numbers. The n-grams are hashed into 2^b
places (BITS), so that different ones sometimes count as one: the kernel is an approximation of the one over exact sets.
Landmark texts span a Nyström feature space; a one-versus-rest kernel ridge regression is fitted in it on a bounded sample
of labelled rows. As the classifier is linear in the kernel values, landmarks and coefficients are multiplied once, and a
batch of texts is scored by one product of its presence matrix with that.

Scale: the model is fitted once, on whole texts of ROWS_PER_LANGUAGE rows of each language, fewer where there are so many
languages that these would be over SAMPLE_ROWS, but one at least. One pass counts the labels, a second one takes the rows
with the smallest hashes into a table; tasks add up its normal equations. No language is left out, and landmarks follow the
languages. The model is a few MB for a few languages and grows with their number alone (about 85 kB each); the corpus is then
scored, whole texts, in one pass without a shuffle.

Edge cases: a null text, or one without a letter, gets ``und`` and score 0; without any labelled row every text does;
null labels are not learned from; ties go to the language that sorts first; repeated rows each get their row; only the
id, the text and, for fitting, the label are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from .common import fresh, materialise, sliced

#: Bounds of the sample of labelled rows that the classifier is fitted on.
ROWS_PER_LANGUAGE, SAMPLE_ROWS = 400, 40_000
#: Landmarks in all, and of each language at least.
LANDMARKS, LEAST_LANDMARKS, RIDGE = 192, 2, 1e-2
#: Labels whose limits are broadcast to the tasks that sample.
MAX_BROADCAST = 100_000
#: n-grams of 1, 2, 3, 4 bytes are hashed into 2^b places.
BITS = (9, 12, 13, 13)
#: A text is cut into pieces of so many bytes whose scores are averaged: presence says less the longer a text is.
PIECE_BYTES = 1024
#: Bytes of the blocks in which sums meet.
SUM_BYTES = 1 << 20
#: Pieces whose presence matrix (84 kB each) is held at once.
BATCH = 64
UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def presence(pieces: list[bytes], bits: tuple[int, ...] = BITS) -> np.ndarray:
    """A row for each piece: its n-grams, hashed into 2^bits[n - 1] places for each n, weighted so that the dot product
    of two rows is their kernel."""
    data = LOWER[np.frombuffer(b"".join(pieces), np.uint8)].astype(np.uint32)
    owner = np.repeat(np.arange(len(pieces)), [len(p) for p in pieces])
    parts, code = [], np.zeros(len(data), np.uint32)
    for n, b in enumerate(bits, 1):
        m = max(len(data) - n + 1, 0)
        code = code[:m] * np.uint32(257) + data[n - 1 :] + np.uint32(1)
        own = owner[:m]
        whole = own == owner[n - 1 :]
        part = np.zeros((len(pieces), 1 << b), np.float32)
        part[own[whole], (code * np.uint32(2654435761) >> np.uint32(32 - b))[whole]] = 1
        part /= np.sqrt(np.maximum(part.sum(axis=1, keepdims=True), 1) * len(bits))
        parts.append(part)
    return np.concatenate(parts, axis=1)


def cut_pieces(text: bytes, size: int = PIECE_BYTES) -> list[bytes]:
    """Pieces of nearly equal length, none over `size` bytes."""
    n = max(1, -(-len(text) // size))
    return [text[len(text) * i // n : len(text) * (i + 1) // n] for i in range(n)]


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # n-grams x languages: landmarks (n-grams x landmarks) times their coefficients
    bias: np.ndarray

    def margins(self, texts: list[bytes]) -> np.ndarray:
        """texts x languages: how far each language's regression speaks for it, about 1 where it does and -1 where not."""
        margin = np.zeros((len(texts), len(self.languages)))
        weight = np.zeros(len(texts))
        owners, pieces = [], []

        def add() -> None:
            if pieces:
                size = np.array([len(p) for p in pieces], float)
                np.add.at(margin, owners, (presence(pieces) @ self.weights + self.bias) * size[:, None])
                np.add.at(weight, owners, size)
                owners.clear()
                pieces.clear()

        for i, text in enumerate(texts):
            for piece in cut_pieces(text):
                owners.append(i)
                pieces.append(piece)
                if len(pieces) == BATCH:
                    add()
        add()
        return margin / np.maximum(weight, 1)[:, None]


def shares(margin: np.ndarray) -> np.ndarray:
    """Margins as scores that add up to 1 in each row."""
    e = np.exp(4 * (margin - margin.max(axis=1, keepdims=True)))
    return e / e.sum(axis=1, keepdims=True)


def leads(margin: np.ndarray) -> np.ndarray:
    """How far the best margin of each row is above the mean of the others, infinite where there are none: a text that
    speaks for no language has all margins about equal, whatever their number."""
    n = margin.shape[1]
    best = margin.max(axis=1)
    return best - (margin.sum(axis=1) - best) / (n - 1) if n > 1 else np.full(len(margin), np.inf)


def sample(labelled: DataFrame, id_col: str, text_col: str, label_col: str, rows: int = ROWS_PER_LANGUAGE, most: int = SAMPLE_ROWS) -> DataFrame:
    """(kind, text) of the rows with the smallest hashes of id and text, whole: at most `rows` of each label and about `most`
    in all, but one of each label at least, however many there are. A table of its own."""
    usable = labelled.where(F.col(label_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(label_col).alias("kind"), F.xxhash64(F.col(id_col).cast("string"), F.col(text_col)).alias("o"), F.col(text_col).alias("text"))
    spark = labelled.sparkSession
    counts = {r[0]: r[1] for r in usable.groupBy("kind").count().collect()}  # a row for each label
    if not counts:
        return spark.createDataFrame([], "kind string, text string")
    each = max(1, min(rows, most // len(counts)))

    def smallest(wanted: dict[str, int]) -> DataFrame:
        """The rows with the smallest hashes among those with hashes up to a limit for each label."""
        limits = spark.createDataFrame(list(wanted.items()), "kind string, most long")
        low = usable.join(F.broadcast(limits) if len(wanted) <= MAX_BROADCAST else limits, "kind").where(F.col("o") <= F.col("most"))
        rank = F.row_number().over(Window.partitionBy("kind").orderBy("o", "text"))
        return materialise(low.withColumn("rank", rank).where(F.col("rank") <= each).select("kind", "text"), "language-sample")

    # about 4 times as many hashes as are wanted lie below these limits, so that tasks sort and send few rows
    limit = lambda n: 2**63 - 1 if n <= 4 * each else int(-(2**63) + 2**64 * (4 * each / n))
    picked = smallest({k: limit(n) for k, n in counts.items()})
    got = {r[0]: r[1] for r in picked.groupBy("kind").count().collect()}
    short = {k: 2**63 - 1 for k, n in counts.items() if got.get(k, 0) < min(each, n)}  # many equal rows, whose hashes are equal
    if short:
        again = smallest(short)
        picked = picked.join(again.select("kind").distinct(), "kind", "left_anti").unionByName(again)
    return picked


def landmark_pieces(rows: DataFrame, each: int) -> list[tuple[str, bytes]]:
    """(label, piece): about `each` pieces of every label, from as many of its rows as there are, spread over each text."""
    by_kind = Window.partitionBy("kind")
    ranked = rows.withColumn("n", F.row_number().over(by_kind.orderBy(F.xxhash64("text"), "text"))).where(F.col("n") <= each)
    wanted = ranked.select("kind", "text", F.ceil(F.lit(each) / F.count("*").over(by_kind)).cast("long").alias("wanted"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for kind, text, n in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                own = cut_pieces(text.encode())
                own = [own[len(own) * i // n] for i in range(n)] if n < len(own) else own
                yield pa.RecordBatch.from_arrays([pa.array([kind] * len(own)), pa.array(own, pa.binary())], ["kind", "piece"])

    found: dict[str, list[bytes]] = {}
    for r in wanted.mapInArrow(run, "kind string, piece binary").collect():
        found.setdefault(r.kind, []).append(bytes(r.piece))
    return [(k, p) for k in sorted(found) for p in sorted(found[k])[:each]]


def fit(rows: DataFrame, landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model | None:
    """A model of the labelled rows (kind, text), all pieces of which count.

    The ridge regression's normal equations are sums over pieces: tasks add up landmarks x landmarks and languages x
    landmarks of theirs, blocks of these meet and are added up, and the driver gets one of each; targets are never spelled
    out."""
    spoken = rows.where(F.col("text").rlike(r"\p{L}"))
    pieces = F.greatest(F.ceil(F.octet_length("text") / F.lit(PIECE_BYTES)), F.lit(1))
    counts = {r[0]: int(r[1]) for r in spoken.groupBy("kind").agg(F.sum(pieces)).collect()}
    if not counts:
        return None
    languages, total = sorted(counts), sum(counts.values())
    marks = presence([p for _, p in landmark_pieces(spoken, max(landmarks // len(languages), LEAST_LANDMARKS))])
    values, vectors = np.linalg.eigh((marks @ marks.T).astype(float))
    keep = values > 1e-6 * values[-1]
    whiten = vectors[:, keep] / np.sqrt(values[keep])
    shared = rows.sparkSession.sparkContext.broadcast((marks, whiten, {k: (i, total / (counts[k] * len(languages))) for i, k in enumerate(languages)}))

    width = whiten.shape[1]
    lines = max(1, SUM_BYTES // (8 * width))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of one task: landmarks x landmarks above languages x landmarks, in blocks of lines."""
        own_marks, own_whiten, known = shared.value
        stacked = np.zeros((width + len(known), width))
        held: list[bytes] = []
        which: list[int] = []
        weight: list[float] = []

        def add() -> None:
            z = (presence(held) @ own_marks.T).astype(float) @ own_whiten
            weighted = z * np.array(weight)[:, None]
            stacked[:width] += z.T @ weighted
            np.add.at(stacked, which, weighted)
            held.clear()
            which.clear()
            weight.clear()

        for batch in batches:
            for kind, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for piece in cut_pieces(text.as_py().encode()):
                    held.append(piece)
                    which.append(width + known[kind][0])
                    weight.append(known[kind][1])
                    if len(held) == BATCH:
                        add()
        if held:
            add()
        for block, start in enumerate(range(0, len(stacked), lines)):
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([stacked[start : start + lines].tobytes()], pa.binary())], ["block", "sums"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The blocks of all tasks, added up as they come in order of their numbers."""
        current, total_of = None, None
        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = np.frombuffer(data.as_py())
                if block != current and current is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([current], pa.int32()), pa.array([total_of.tobytes()], pa.binary())], ["block", "sums"])
                total_of = own + total_of if block == current else own
                current = block
        if current is not None:
            yield pa.RecordBatch.from_arrays([pa.array([current], pa.int32()), pa.array([total_of.tobytes()], pa.binary())], ["block", "sums"])

    parts = spoken.select("kind", "text").mapInArrow(sums, "block int, sums binary").repartition("block").sortWithinPartitions("block")
    # one of each block: as much as the model's own fit needs
    blocks = sorted((r.block, bytes(r.sums)) for r in parts.mapInArrow(added, "block int, sums binary").collect())
    stacked = np.frombuffer(b"".join(d for _, d in blocks)).reshape(-1, width)
    square, by_language = stacked[:width], stacked[width:]
    every = by_language.sum(axis=0)
    mean_z, mean_t = every / total, 2 / len(languages) - 1
    centred = square - total * np.outer(mean_z, mean_z)
    towards = 2 * by_language.T - every[:, None] - total * mean_z[:, None] * mean_t
    beta = np.linalg.solve(centred + ridge * total * np.eye(len(mean_z)) / len(mean_z), towards)
    return Model(languages, marks.T @ (whiten @ beta).astype(np.float32), mean_t - mean_z @ beta)


def predict(documents: DataFrame, model: Model | None, text_col: str = "text") -> tuple[DataFrame, dict[str, str]]:
    """documents with lang_pred, score and lead (of the best margin over the mean of the others, null for ``und``), and the
    names that these columns got."""
    names = {n: fresh(n, documents.columns) for n in ("lang_pred", "score", "lead")}
    shared = documents.sparkSession.sparkContext.broadcast(model)
    at = documents.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in sliced(batches, at, 1 << 20):
            texts = batch.column(at).cast(pa.string()).to_pylist()
            spoken = [i for i, t in enumerate(texts) if t and LETTER.search(t)] if own else []
            language, score, lead = [UNKNOWN] * len(texts), np.zeros(len(texts)), [None] * len(texts)
            if spoken:
                margin = own.margins([texts[i].encode() for i in spoken])
                p, ahead = shares(margin), leads(margin)
                for i, row, best, over in zip(spoken, p, margin.argmax(axis=1), ahead, strict=True):
                    language[i], score[i], lead[i] = own.languages[best], row[best], over
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(language, pa.string()), pa.array(score), pa.array(lead, pa.float64())], [*batch.schema.names, *names.values()])

    schema = T.StructType([*documents.schema.fields, T.StructField(names["lang_pred"], T.StringType()), T.StructField(names["score"], T.DoubleType()), T.StructField(names["lead"], T.DoubleType())])
    return documents.mapInArrow(run, schema), names


def held_out(id_col: Column) -> Column:
    return F.crc32(id_col.cast("string").cast("binary")) % 4 == 2


def trained(documents: DataFrame, rows: int = ROWS_PER_LANGUAGE, most: int = SAMPLE_ROWS) -> Model | None:
    """A model learned from text and lang of the documents that aren't held out."""
    seen = documents.where(~F.coalesce(held_out(F.col("doc_id")), F.lit(True)))
    return fit(sample(seen, "doc_id", "text", "lang", rows, most))


def language_id(documents: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    out, names = predict(documents.select("doc_id", "text"), trained(documents))
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(True)).alias("held_out"), F.col(names["lang_pred"]).alias("lang_pred"), F.col(names["score"]).alias("score"))
