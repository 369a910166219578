"""Document scores by masked pseudo-likelihood.

A small network in numpy sees the SIDE words before and after a position and predicts the word between them. A document's
score is the sum over its words of log p(word | both sides).

Words are runs of digits, ASCII letters (lower-cased) and other characters. The most frequent words of the corpus have
units of their own, the others share hashed units; there are about 4 units for each root of the number of different
words, UNITS at least. The output is a two-level softmax: a unit's class, then the unit within its class, so
probabilities are normalised at the cost of two short rows. In a shared unit a word has its share of the unit's count:
(n(word) + PRIOR) / (n(unit) + PRIOR (words + unseen words)), and as many unseen words are supposed as there are seen ones.

Training begins with the words' shares in the corpus, which the network then bends to the context. It is a Spark job: in
each of ROUNDS rounds a copy of the parameters is trained on about COPY_WORDS words, and the copies are averaged, weighted
by their words, FAN_IN at a time until one is left. The rounds split the corpus, so one pass over all words is made in
total. The hash of id and text deals a document to its round and copy, and orders it there: the model depends on the
documents alone, not on their partitions, and copies of a text are spread. Word counts are a written table, and the words
of shared units, counted for each document first, meet it in a join on their hash. No such word is hot: each of the more
frequent ones has a unit of its own. The model grows with the root of the vocabulary (150 kB at least), and only it, the
frequent words and the counts of the shared units pass through the driver.

Edge cases: null and empty texts have no words, log_prob 0 and a null mean; an empty table gives no rows; ties in the
word counts go to the smaller hash; repeated rows each train and get the same score, up to
float32 rounding; only id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import SpanHasher, materialise, sliced
from .decontaminate import words

SIDE, WIDTH, CLASSES, IN_CLASS = 2, 16, 32, 32
UNITS = CLASSES * IN_CLASS
FREQUENT = UNITS * 7 // 8
ROUNDS, FAN_IN, BATCH, STEP, RATE = 2, 16, 8192, 2048, 0.2
#: Words that one copy learns from in a round, about.
COPY_WORDS = 250_000
BASE = 0x100000001B3
#: What a word counts beside its occurrences, and the steps of 1 in which logarithms are added up exactly.
PRIOR, STEPS = 0.5, 1 << 24

Parameters = dict[str, np.ndarray]


def class_size(vocabulary: int) -> int:
    """Units of a class: the power of two at or below an eighth of the root of the vocabulary, IN_CLASS at least."""
    return max(IN_CLASS, 1 << max(int(np.sqrt(vocabulary) / 8), 1).bit_length() - 1)


def shapes(in_class: int = IN_CLASS) -> dict[str, tuple[int, ...]]:
    return {"embedding": (CLASSES * in_class + 1, WIDTH), "hidden": (2 * SIDE * WIDTH, WIDTH), "bias": (WIDTH,), "classes": (WIDTH, CLASSES), "class_bias": (CLASSES,), "inner": (CLASSES, WIDTH, in_class), "inner_bias": (CLASSES, in_class)}


SHAPES = shapes()


def initial(seed: int = 3, in_class: int = IN_CLASS, counts: np.ndarray | None = None) -> Parameters:
    """Random parameters; with the counts of all units, those under which every context gives the units' shares."""
    rng, sizes = np.random.default_rng(seed), shapes(in_class)
    out = {k: (rng.standard_normal(v) * (0.3 if k == "embedding" else 1 / np.sqrt(v[-2]) if len(v) > 1 else 0)).astype(np.float32) for k, v in sizes.items()}
    out["inner_bias"] = np.zeros(sizes["inner_bias"], np.float32)
    if counts is not None:
        each = counts.reshape(CLASSES, in_class) + PRIOR
        out["class_bias"] = np.log(each.sum(axis=1) / each.sum()).astype(np.float32)
        out["inner_bias"] = np.log(each / each.sum(axis=1, keepdims=True)).astype(np.float32)
        out["classes"] *= 0
        out["inner"] *= 0
    return out


class Units:
    """Numbers of the words: frequent ones their own, in an order that spreads them over the classes, others hashed."""

    def __init__(self, frequent: list[int], in_class: int = IN_CLASS):
        self.in_class, self.units, self.shared = in_class, CLASSES * in_class, CLASSES * in_class // 8
        order = np.arange(len(frequent))
        own = (order % CLASSES) * in_class + order // CLASSES
        hashes = np.array(frequent, np.int64).view(np.uint64)
        sort = np.argsort(hashes)
        self.hashes, self.own = hashes[sort], own[sort].astype(np.int64)

    def of(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Units of the words with these hashes, and which of them are shared."""
        place = h % np.uint64(self.shared)
        unit = ((place % CLASSES) * self.in_class + (self.units - self.shared) // CLASSES + place // CLASSES).astype(np.int64)
        if not len(self.hashes):
            return unit, np.ones(len(h), bool)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        own = self.hashes[at] == h
        return np.where(own, self.own[at], unit), ~own

    def __call__(self, column: pa.Array, hasher: SpanHasher) -> tuple[np.ndarray, np.ndarray]:
        """Units of all words, and the first word of each text (n + 1)."""
        data, starts, ends, first = words(column)
        return self.of(hasher(data, starts, ends))[0], first


def contexts(unit: np.ndarray, first: np.ndarray, outside: int = UNITS) -> np.ndarray:
    """words x 2 SIDE: units on both sides, the number of units beyond a text's ends."""
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    columns = []
    for shift in (*range(-SIDE, 0), *range(1, SIDE + 1)):
        at = np.arange(len(unit)) + shift
        inside = (at >= first[doc]) & (at < first[doc + 1])
        columns.append(np.where(inside, unit[np.clip(at, 0, max(len(unit) - 1, 0))], outside))
    return np.stack(columns, axis=1) if len(unit) else np.zeros((0, 2 * SIDE), np.int64)


def exponentials(x: np.ndarray, most: float) -> np.ndarray:
    """exp(x) in place, each row times a number of its own where `most`, a bound of abs(x), is near float32's range."""
    if not most < 60:
        x -= x.max(axis=1, keepdims=True)
    return np.exp(x, out=x)


def tanh(x: np.ndarray) -> np.ndarray:
    """tanh(x) in place, by the exponential, which is the quicker one in numpy; within 1e-6 of it."""
    np.minimum(x, 40, out=x)
    x *= 2
    np.exp(x, out=x)
    x += 1
    np.divide(np.float32(2), x, out=x)
    return np.subtract(np.float32(1), x, out=x)


def sums(x: np.ndarray) -> np.ndarray:
    """The sum of each row."""
    return x @ np.ones(x.shape[1], x.dtype)


def bound(weights: np.ndarray, bias: np.ndarray) -> float:
    """What h @ weights + bias can be at most, in absolute value, for h between -1 and 1."""
    return float((np.abs(weights).sum(axis=-2) + np.abs(bias)).max())


def of_classes(p: Parameters, h: np.ndarray) -> np.ndarray:
    x = h @ p["classes"]
    x += p["class_bias"]
    return exponentials(x, bound(p["classes"], p["class_bias"]))


def forward(p: Parameters, context: np.ndarray) -> np.ndarray:
    return hidden(p, np.take(p["embedding"], context, axis=0).reshape(len(context), -1))


def hidden(p: Parameters, x: np.ndarray) -> np.ndarray:
    h = x @ p["hidden"]
    h += p["bias"]
    return tanh(h)


def by_class(unit: np.ndarray, in_class: int) -> tuple[np.ndarray, list[tuple[int, slice]]]:
    """An order of the positions that puts those of a class side by side, and the classes that occur with their slices."""
    c = (unit // in_class).astype(np.uint8 if CLASSES <= 256 else np.int64)
    order = np.argsort(c, kind="stable")
    bounds = np.searchsorted(c[order], np.arange(CLASSES + 1))
    return order, [(k, slice(bounds[k], bounds[k + 1])) for k in range(CLASSES) if bounds[k] < bounds[k + 1]]


def within(p: Parameters, h: np.ndarray, slices: list[tuple[int, slice]]) -> np.ndarray:
    """Of positions in the order by class: what the units of their class have, up to a factor for each row."""
    x = np.empty((len(h), p["inner"].shape[2]), h.dtype)
    for k, own in slices:
        np.matmul(h[own], p["inner"][k], out=x[own])
        x[own] += p["inner_bias"][k]
    return exponentials(x, bound(p["inner"], p["inner_bias"]))


def log_probabilities(p: Parameters, context: np.ndarray, unit: np.ndarray) -> np.ndarray:
    """log p(unit | context) of each position."""
    out, in_class = np.zeros(len(unit), np.float32), p["inner"].shape[2]
    for start in range(0, len(unit), BATCH):
        u = unit[start : start + BATCH]
        order, slices = by_class(u, in_class)
        u, h, row = u[order], forward(p, np.take(context[start : start + BATCH], order, axis=0)), np.arange(len(u))
        for e, at in ((of_classes(p, h), u // in_class), (within(p, h, slices), u % in_class)):
            out[start + order] += np.log(np.maximum(e[row, at] / sums(e), np.finfo(np.float32).tiny))
    return out


class Trainer:
    """Adagrad on the mean negative log-probability of batches of positions."""

    def __init__(self, p: Parameters):
        self.p = {k: v.copy() for k, v in p.items()}
        self.seen = {k: np.full(v.shape, 1e-4, np.float32) for k, v in p.items()}
        self.words = 0

    def _step(self, name: str, gradient: np.ndarray, at=...) -> None:
        self.seen[name][at] += gradient * gradient
        self.p[name][at] -= RATE * gradient / np.sqrt(self.seen[name][at])

    def batch(self, context: np.ndarray, u: np.ndarray) -> None:
        p, n, in_class = self.p, len(u), self.p["inner"].shape[2]
        order, slices = by_class(u, in_class)
        u, context, row = u[order], np.take(context, order, axis=0), np.arange(n)
        x = np.take(p["embedding"], context, axis=0).reshape(n, -1)
        h = hidden(p, x)
        off = of_classes(p, h)
        off *= (1 / (n * sums(off)))[:, None]
        off[row, u // in_class] -= 1 / n
        e = within(p, h, slices)
        e *= (1 / (n * sums(e)))[:, None]
        e[row, u % in_class] -= 1 / n
        # a last column of ones, so that one product gives the gradients of weights and biases
        with_one = np.ones((n, WIDTH + 1), h.dtype)
        with_one[:, :WIDTH] = h
        back, inner = np.empty_like(h), np.zeros((CLASSES, WIDTH + 1, in_class), h.dtype)
        for k, own in slices:
            np.matmul(e[own], p["inner"][k].T, out=back[own])
            np.matmul(with_one[own].T, e[own], out=inner[k])
        back += off @ p["classes"].T
        back *= 1 - h * h
        to_x = (back @ p["hidden"].T).reshape(-1, WIDTH)
        flat = context.reshape(-1).astype(np.uint16 if CLASSES * in_class < 1 << 16 else np.int64)
        sort = np.argsort(flat, kind="stable")
        flat = flat[sort]
        begin = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
        self._step("embedding", np.add.reduceat(np.take(to_x, sort, axis=0), begin, axis=0), flat[begin])
        classes = with_one.T @ off
        # of a class without words here the gradient is zero, which changes nothing
        for name, gradient in (("hidden", x.T @ back), ("bias", back.sum(axis=0)), ("classes", classes[:-1]), ("class_bias", classes[-1]), ("inner", inner[:, :-1]), ("inner_bias", inner[:, -1])):
            self._step(name, gradient)
        self.words += n

    def text(self, context: np.ndarray, unit: np.ndarray, step: int = STEP) -> None:
        for start in range(0, len(unit), step):
            self.batch(context[start : start + step], unit[start : start + step])


def packed(p: Parameters) -> bytes:
    return np.concatenate([p[k].reshape(-1) for k in SHAPES]).astype(np.float32).tobytes()


def unpacked(raw: bytes) -> Parameters:
    flat, out, at, in_class = np.frombuffer(raw, np.float32), {}, 0, IN_CLASS
    while sum(int(np.prod(x)) for x in shapes(in_class).values()) < len(flat):
        in_class *= 2
    for k, shape in shapes(in_class).items():
        size = int(np.prod(shape))
        out[k] = flat[at : at + size].reshape(shape)
        at += size
    return out


def word_counts(documents: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, n): how often the words with each 64-bit hash occur in all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = SpanHasher(BASE)
        for batch in sliced(batches, 0, 1 << 20):
            data, starts, ends, _ = words(batch.column(0))
            h, n = np.unique(hasher(data, starts, ends), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], ["word", "n"])

    return documents.select(F.col(text_col).cast("binary").alias("text")).mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def averaged(copies: DataFrame) -> bytes | None:
    """The mean of (copy, words, parameters), weighted by words; FAN_IN copies meet in a group, in their order."""

    def mean(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("copy")
        weight = rows["words"].to_numpy(float)
        total = sum(w * np.frombuffer(raw, np.float32).astype(np.float64) for w, raw in zip(weight, rows["parameters"], strict=True))
        return pd.DataFrame({"copy": [int(rows["copy"].min()) // FAN_IN], "words": [int(weight.sum())], "parameters": [(total / weight.sum()).astype(np.float32).tobytes()]})

    copies = materialise(copies.where("words > 0"), "copies")
    most = copies.agg(F.max("copy")).first()[0]
    if most is None:
        return None
    while True:
        copies = copies.groupBy(F.floor(F.col("copy") / FAN_IN).alias("group")).applyInPandas(mean, "copy long, words long, parameters binary")
        most //= FAN_IN
        if most == 0:
            return bytes(copies.first().parameters)


def train(documents: DataFrame, text_col: str = "text", rounds: int = ROUNDS, counts: DataFrame | None = None, id_col: str = "doc_id") -> tuple[Units, bytes]:
    """The units and the packed parameters, learned from all documents; counts are their word_counts, if written already."""
    counts = materialise(word_counts(documents, text_col), "word-counts") if counts is None else counts
    size = counts.agg(F.count("*").alias("words"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    in_class = class_size(size.words)
    frequent = counts.orderBy(F.desc("n"), "word").limit(CLASSES * in_class * 7 // 8).collect()
    units = Units([r.word for r in frequent], in_class)
    total = unit_totals(counts, units)[0]
    total[units.of(np.array([r.word for r in frequent], np.int64).view(np.uint64))[0]] = [r.n for r in frequent]
    model = packed(initial(in_class=in_class, counts=total))
    context = documents.sparkSession.sparkContext
    copies = max(1, -(-size.n // (COPY_WORDS * rounds)))
    # who learns from a text, and when, is up to its hash and id alone, so that the model is the same on every cluster
    deal = F.xxhash64(F.col(id_col).cast("string"), F.col(text_col))
    rows = documents.where(F.length(text_col) > 0).select(F.col(text_col).cast("binary").alias("text"), deal.alias("deal"), F.pmod(deal, F.lit(copies)).cast("int").alias("copy"), F.pmod(F.shiftrightunsigned(deal, 40), F.lit(rounds)).alias("round"))
    for number in range(rounds):
        shared = context.broadcast((units, model))

        def learn(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own, raw = shared.value
            hasher, current, trainer = SpanHasher(BASE), None, None

            def done() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array([current], pa.int64()), pa.array([trainer.words], pa.int64()), pa.array([packed(trainer.p)], pa.binary())], ["copy", "words", "parameters"])

            for whole in batches:
                copy = whole.column(0).to_numpy()
                cuts = np.flatnonzero(np.diff(copy)) + 1
                for a, b in zip([0, *cuts], [*cuts, len(copy)], strict=True):
                    if a < b and copy[a] != current:
                        if trainer:
                            yield done()
                        current, trainer = int(copy[a]), Trainer(unpacked(raw))
                    for batch in sliced([whole.slice(a, b - a)], 1, 1 << 20):
                        unit, first = own(batch.column(1), hasher)
                        trainer.text(contexts(unit, first, own.units), unit)
            if trainer:
                yield done()

        mine = rows.where(F.col("round") == number).repartition(copies, "copy").sortWithinPartitions("copy", "deal", "text").select("copy", "text")
        model = averaged(mine.mapInArrow(learn, "copy long, words long, parameters binary")) or model
    return units, model


def unit_totals(counts: DataFrame, units: Units) -> tuple[np.ndarray, np.ndarray]:
    """For each shared unit how often its words occur, and how many different ones do; 0 for the other units."""
    shared = counts.sparkSession.sparkContext.broadcast(units)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit, rare = shared.value.of(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
            n = batch.column(1).to_numpy(zero_copy_only=False)[rare]
            u, first, size = np.unique(unit[rare], return_inverse=True, return_counts=True)
            total = np.zeros(len(u), np.int64)
            np.add.at(total, first, n)
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(total), pa.array(size)], ["unit", "n", "words"])

    total, different = np.zeros(units.units), np.zeros(units.units)
    for r in counts.select("word", "n").mapInArrow(place, "unit long, n long, words long").groupBy("unit").agg(F.sum("n").alias("n"), F.sum("words").alias("words")).collect():
        total[r.unit], different[r.unit] = r.n, r.words
    return total, different


def share_weights(counts: DataFrame, units: Units) -> np.ndarray:
    """For each unit the logarithm of what its words' n + PRIOR are divided by; 0 for words with a unit of their own."""
    total, different = unit_totals(counts, units)
    shared = np.arange(units.units) % units.in_class >= (units.units - units.shared) // CLASSES
    # where nothing was seen, one unseen word is supposed
    return np.where(shared, np.log(np.where(different > 0, total + PRIOR * 2 * different, PRIOR)), 0).astype(np.float32)


def score(documents: DataFrame, units: Units, model: bytes, id_col: str = "doc_id", text_col: str = "text", counts: DataFrame | None = None) -> DataFrame:
    """(doc_id, n_words, log_prob, mean_log_prob) of every row; of words with the table counts of the training documents'
    word_counts, of units without it."""
    weights = np.zeros(units.units, np.float32) if counts is None else share_weights(counts, units)
    shared = documents.sparkSession.sparkContext.broadcast((units, model, weights))
    whole = counts is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, raw, weight = shared.value
        p, hasher = unpacked(raw), SpanHasher(BASE)
        for batch in sliced(batches, 1, 1 << 20):
            data, starts, ends, first = words(batch.column(1))
            h = hasher(data, starts, ends)
            unit, rare = own.of(h)
            each = log_probabilities(p, contexts(unit, first, own.units), unit) - weight[unit]
            total = np.concatenate([[0.0], np.cumsum(each, dtype=float)])[first]
            columns = [batch.column(0), pa.array(np.diff(first)), pa.array(np.diff(total))]
            if whole:
                doc = np.repeat(np.arange(len(first) - 1), np.diff(first))[rare]
                sort = np.lexsort((h[rare], doc))
                doc, word = doc[sort], h[rare][sort]
                begin = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (word[1:] != word[:-1])])) if len(doc) else np.zeros(0, np.int64)
                offsets = pa.array(np.searchsorted(doc[begin], np.arange(len(first))), pa.int32())
                times = np.diff(np.append(begin, len(doc)))
                columns += [pa.ListArray.from_arrays(offsets, pa.array(word[begin].view(np.int64))), pa.ListArray.from_arrays(offsets, pa.array(times, pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "log_prob", "word", "times"][: len(columns)])

    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    scored = rows.mapInArrow(run, "doc_id long, n_words long, log_prob double" + ", word array<long>, times array<long>" * whole)
    if whole:
        scored = materialise(scored.withColumn("row", F.monotonically_increasing_id()), "scored")
        pairs = scored.select("row", F.explode(F.arrays_zip("word", "times")).alias("w")).select("row", "w.*")
        steps = F.round(F.log(F.coalesce("n", F.lit(0)) + F.lit(PRIOR)) * STEPS).cast("long")
        # whole numbers add up to the same sum in any order, so that equal texts get equal scores
        shares = pairs.join(counts.select("word", "n"), "word", "left").groupBy("row").agg(F.sum(F.col("times") * steps).alias("share"))
        scored = scored.select("row", "doc_id", "n_words", "log_prob").join(shares, "row", "left").select("doc_id", "n_words", (F.col("log_prob") + F.coalesce(F.col("share"), F.lit(0)) / STEPS).alias("log_prob"))
    return scored.withColumn("mean_log_prob", F.when(F.col("n_words") > 0, F.col("log_prob") / F.col("n_words")))


def pseudo_likelihood(documents: DataFrame) -> DataFrame:
    """doc_id, n_words, log_prob, mean_log_prob, by a model trained on the same documents."""
    counts = materialise(word_counts(documents), "word-counts")
    return score(documents, *train(documents, counts=counts), counts=counts)
