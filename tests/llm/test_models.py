import zlib

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import language_id as li, pseudo_likelihood as pl
from tidemark.llm.common import SpanHasher

from .helpers import CLASHING, ODD, documents, read


def test_held_out_accuracy(spark, medium):
    got = li.language_id(spark.read.parquet(f"{medium}/documents.parquet")).collect()
    truth = {i: (lang, text) for i, lang, text in read(medium, "documents", "doc_id, lang, text")}
    assert len(got) == len(truth)
    right = []
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
        lang, text = truth[r.doc_id]
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in text or ""))
        if r.held_out and lang is not None and r.lang_pred != "und" and len(text) >= 40:
            right.append(r.lang_pred == lang)
    assert len(right) > 100 and np.mean(right) >= 0.9


def test_language_of_odd_rows(spark):
    docs = documents(spark, [*ODD, (50, "1234 !?", "en"), (51, "Это русский текст", "ru")], CLASHING)
    got = {r.doc_id: r for r in li.language_id(docs).collect()}
    assert got[1].lang_pred == got[2].lang_pred == got[3].lang_pred == got[50].lang_pred == "und" and got[1].score == 0
    assert {r.lang_pred for r in li.language_id(documents(spark, [(i, t, None) for i, t, _ in ODD])).collect()} == {"und"}
    assert li.language_id(documents(spark, [])).collect() == []


def test_numerals_and_marks_are_no_letters(spark):
    rows = [*ODD, (60, "½ ²", None), (61, "١٢٣ Ⅳ", None), (62, "ªº", None)]
    got = {r.doc_id: r.lang_pred for r in li.language_id(documents(spark, rows)).collect()}
    assert got[60] == got[61] == "und" and (got[62] == "und") == (not "ªº".isalpha())


def sampled(spark, rows, *bounds):
    return [(r.text, r.kind) for r in li.sample(documents(spark, rows), "doc_id", "text", "lang", *bounds).collect()]


def test_sample_is_bounded_and_whole_below_the_bound(spark):
    rows = [(i, f"text number {i}", "a" if i % 10 else "b") for i in range(3000)]
    got = sampled(spark, rows, 50)
    assert [x[1] for x in got].count("a") == 50 and len(got) == 100
    assert len({p for p, _ in sampled(spark, rows[:40], 50)}) == 40
    equal = [(1, "the same row", "a")] * 500 + [(2, "another", "b")]
    assert sorted(x[1] for x in sampled(spark, equal, 5)) == ["a"] * 5 + ["b"]


def test_every_label_is_learned(spark):
    """Any number of labels, over the sample's bound too; what the driver holds is the model and sums of its size."""
    syllable = lambda i: "".join("bcdfghjklm"[int(c)] + "aeiou"[int(c) % 5] for c in f"{i:03}")
    rows = [(i * 4 + j, " ".join(f"{syllable(i)}{syllable(i * 7 % 500)}{x}" for x in range(j, j + 12)), f"l{i}") for i in range(500) for j in range(4)]
    assert {x[1] for x in sampled(spark, rows, 400, 499)} == {f"l{i}" for i in range(500)} and len(sampled(spark, rows, 400, 499)) == 500
    model = li.fit(li.sample(documents(spark, rows), "doc_id", "text", "lang"))
    assert len(model.languages) == 500 and model.weights.nbytes < 60e6
    best = model.margins([t.encode() for _, t, _ in rows[::17]]).argmax(axis=1)
    assert np.mean([model.languages[b] == r[2] for b, r in zip(best, rows[::17])]) > 0.9


def test_sampled_texts_are_whole(spark):
    text = "".join(chr(0x4E00 + i) for i in range(20_000))
    assert sampled(spark, [(1, text, "zh")]) == [(text, "zh")]
    pieces = li.landmark_pieces(li.sample(documents(spark, [(1, text, "zh")]), "doc_id", "text", "lang"), 5)
    assert len(pieces) == 5 and text.encode().find(pieces[0][1]) >= 0


def test_sums_of_tasks_are_the_regression_over_all_pieces(spark, small):
    """Against one dense solution over all pieces, with targets spelled out."""
    rows = [(i, t, lang) for i, t, lang in read(small, "documents", "doc_id, text, lang") if t and lang and any(c.isalpha() for c in t)]
    picked = li.sample(documents(spark, rows), "doc_id", "text", "lang").repartition(7)
    model = li.fit(picked, 40)
    pieces = [(p, r.kind) for r in picked.collect() for p in li.cut_pieces(r.text.encode())]
    marks = li.presence([p for _, p in li.landmark_pieces(picked, 40 // len(model.languages))])
    values, vectors = np.linalg.eigh((marks @ marks.T).astype(float))
    keep = values > 1e-6 * values[-1]
    z = (li.presence([p for p, _ in pieces]) @ marks.T).astype(float) @ (vectors[:, keep] / np.sqrt(values[keep]))
    t = np.array([[1.0 if k == name else -1.0 for name in model.languages] for _, k in pieces])
    n = {name: sum(k == name for _, k in pieces) for name in model.languages}
    w = np.array([len(pieces) / (n[k] * len(n)) for _, k in pieces])
    zm, tm = np.average(z, axis=0, weights=w), np.average(t, axis=0, weights=w)
    beta = np.linalg.solve(((z - zm) * w[:, None]).T @ (z - zm) + li.RIDGE * len(pieces) * np.eye(z.shape[1]) / z.shape[1], ((z - zm) * w[:, None]).T @ (t - tm))
    got = li.presence([p for p, _ in pieces]) @ model.weights + model.bias
    assert np.abs(got - ((z - zm) @ beta + tm)).max() < 1e-3


def test_predictions_against_a_plain_product(spark, small):
    """Every document of the query by dictionaries of n-grams and the model's weights, one at a time."""
    df = spark.read.parquet(f"{small}/documents.parquet")
    model = li.trained(df)
    got = {r.doc_id: (r.lang_pred, r.score) for r in li.language_id(df).collect()}
    starts = np.cumsum([0, *(1 << b for b in li.BITS)])

    def margins(text):
        out, size = np.zeros(len(model.languages)), 0
        for piece in li.cut_pieces(text.encode()):
            low = bytes(c + 32 if 65 <= c <= 90 else c for c in piece)
            row = model.bias.copy()
            for n, b in enumerate(li.BITS, 1):
                places = set()
                for i in range(len(low) - n + 1):
                    code = 0
                    for c in low[i : i + n]:
                        code = (code * 257 + c + 1) % 2**32
                    places.add((code * 2654435761 % 2**32) >> (32 - b))
                row += sum(model.weights[starts[n - 1] + p].astype(float) for p in sorted(places)) / np.sqrt(max(len(places), 1) * len(li.BITS)) if places else 0
            out += row * len(piece)
            size += len(piece)
        return out / max(size, 1)

    for doc_id, text in read(small, "documents", "doc_id, text"):
        if not text or not li.LETTER.search(text):
            assert got[doc_id] == ("und", 0)
            continue
        m = margins(text)
        e = np.exp(4 * (m - m.max()))
        top = np.sort(e / e.sum())[::-1]
        if len(top) < 2 or top[0] - top[1] > 1e-4:
            assert got[doc_id][0] == model.languages[m.argmax()]
        assert got[doc_id][1] == pytest.approx(top[0], abs=1e-4)


def test_leads_do_not_depend_on_the_number_of_languages():
    flat = lambda n: np.full((1, n), 2 / n - 1)
    clear = lambda n: np.array([[0.2] + [-0.8] * (n - 1)])
    for n in (2, 4, 100):
        assert li.leads(flat(n))[0] == pytest.approx(0) and li.leads(clear(n))[0] == pytest.approx(1)
    assert li.leads(np.array([[0.5]]))[0] == np.inf
    assert li.shares(np.array([[3.0, 1.0], [-900.0, -900.0]])).sum(axis=1) == pytest.approx([1, 1])


def naive_kernel(a, b):
    grams = lambda t, n: {t[i : i + n] for i in range(len(t) - n + 1)}
    total = 0.0
    for n in range(1, 5):
        x, y = grams(a.lower(), n), grams(b.lower(), n)
        total += len(x & y) / np.sqrt(max(len(x), 1) * max(len(y), 1)) / 4
    return total


def test_kernel_against_a_naive_one(small):
    """Hashing into places makes the kernel only a little larger or smaller."""
    texts = [t.encode()[:1000] for i, t in read(small, "documents", "doc_id, text") if t and len(t) > 60][:40]
    x = li.presence(texts)
    got, want = x @ x.T, np.array([[naive_kernel(a, b) for b in texts] for a in texts])
    assert np.abs(got - want).max() < 0.06 and np.abs(got - want).mean() < 0.03
    x = li.presence([b"abcdabcd", b"ABCD", b"wxyz"])
    assert x[0] @ x[1] > x[0] @ x[2] and x[1] @ x[1] == pytest.approx(1, abs=1e-5)


def test_probabilities_add_up():
    p = pl.initial()
    context = np.random.default_rng(0).integers(0, pl.UNITS + 1, (3, 2 * pl.SIDE))
    for row in context:
        every = pl.log_probabilities(p, np.repeat(row[None], pl.UNITS, axis=0), np.arange(pl.UNITS))
        assert np.exp(every.astype(float)).sum() == pytest.approx(1, abs=1e-4)


def test_gradient():
    """One step lowers the loss by about what central differences say."""
    rng = np.random.default_rng(3)
    p = {k: v.astype(np.float64) for k, v in pl.initial().items()}
    context, unit = rng.integers(0, pl.UNITS + 1, (40, 2 * pl.SIDE)), rng.integers(0, pl.UNITS, 40)

    class Grabber(pl.Trainer):
        def _step(self, name, gradient, at=...):
            self.grads = getattr(self, "grads", {}) | {name: (gradient, at)}

    trainer = Grabber(p)
    trainer.batch(context, unit)
    loss = lambda q: -pl.log_probabilities(q, context, unit).astype(float).mean()
    for name in ("hidden", "bias", "classes", "class_bias"):
        gradient = trainer.grads[name][0]
        at = np.unravel_index(np.argmax(np.abs(gradient)), gradient.shape)
        moved = []
        for e in (0.05, -0.05):
            q = {k: v.copy() for k, v in p.items()}
            q[name][at] += e
            moved.append(loss(q))
        assert (moved[0] - moved[1]) / 0.1 == pytest.approx(gradient[at], rel=0.05)


def test_a_batch_updates_each_table_once():
    """However many classes there are, and as a tanh of the library's own would have it."""

    class Counter(pl.Trainer):
        names: list[str] = []

        def _step(self, name, gradient, at=...):
            self.names.append(name)
            super()._step(name, gradient, at)

    rng = np.random.default_rng(2)
    unit = rng.integers(0, pl.UNITS, 3000)
    trainer = Counter(pl.initial())
    trainer.batch(pl.contexts(unit, np.array([0, 3000])), unit)
    assert sorted(trainer.names) == sorted(pl.SHAPES)
    x = np.concatenate([rng.standard_normal(1000) * 9, [0, 100, -100, 1e30, -1e30]]).astype(np.float32)
    assert np.abs(pl.tanh(x.copy()) - np.tanh(x)).max() < 1e-6


def test_training_helps_and_scores_sum(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    units, model = pl.train(docs)
    got = {r.doc_id: r for r in pl.score(docs, units, model).collect()}
    assert len(got) == docs.count()
    before = {r.doc_id: r for r in pl.score(docs, units, pl.packed(pl.initial())).collect()}
    total = lambda x: sum(r.log_prob for r in x.values())
    assert total(got) > 0.9 * total(before)
    p, hasher = pl.unpacked(model), SpanHasher(pl.BASE)
    for doc_id, text in read(small, "documents", "doc_id, text")[:20]:
        unit, first = units(pa.array([(text or "").encode()], pa.binary()), hasher)
        want = pl.log_probabilities(p, pl.contexts(unit, first), unit).astype(float).sum()
        assert got[doc_id].n_words == len(unit) and got[doc_id].log_prob == pytest.approx(want, rel=1e-3, abs=1e-3)


def test_beats_a_unigram_on_held_out_text(spark, medium):
    docs = spark.read.parquet(f"{medium}/documents.parquet").where("text IS NOT NULL")
    kept, unseen = docs.where("crc32(cast(doc_id AS string)) % 4 <> 2").dropDuplicates(["text"]), docs.where("crc32(cast(doc_id AS string)) % 4 = 2").join(docs.where("crc32(cast(doc_id AS string)) % 4 <> 2").select("text"), "text", "left_anti")
    units, model = pl.train(kept)
    hasher, times = SpanHasher(pl.BASE), np.full(units.units, pl.PRIOR)
    for r in kept.select("text").collect():
        np.add.at(times, units(pa.array([r.text.encode()], pa.binary()), hasher)[0], 1)
    share = np.log(times / times.sum())
    own = sum(share[units(pa.array([r.text.encode()], pa.binary()), hasher)[0]].sum() for r in unseen.select("text").collect())
    got = pl.score(unseen, units, model).agg({"log_prob": "sum", "n_words": "sum"}).first()
    assert got["sum(n_words)"] > 10_000 and got["sum(log_prob)"] / got["sum(n_words)"] > own / got["sum(n_words)"] + 0.1


def test_the_model_depends_on_the_documents_alone(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    first, second = (pl.train(docs.repartition(n).sortWithinPartitions(order)) for n, order in ((3, "doc_id"), (11, "text")))
    assert np.array_equal(first[0].hashes, second[0].hashes) and first[1] == second[1]


def test_scores_of_odd_rows(spark):
    got = pl.pseudo_likelihood(documents(spark, ODD, CLASHING)).collect()
    assert len(got) == len(ODD)
    empty = [r for r in got if r.n_words == 0]
    assert len(empty) == 4 and all(r.log_prob == 0 and r.mean_log_prob is None for r in empty)
    same = [r.log_prob for r in got if r.doc_id in (4, 5)]
    assert len(same) == 3 and same == pytest.approx([same[0]] * 3, rel=1e-6)
    assert pl.pseudo_likelihood(documents(spark, [])).collect() == []


def test_rare_words_have_their_own_share(spark):
    """Words of one shared unit differ by their counts, and a word that was never seen is below all of them."""
    common = [(i, " ".join(f"w{k}x" for k in range(i, pl.FREQUENT, 4)), "en") for i in range(4)] * 9
    common = [(i, t.replace("0", "q").translate(str.maketrans("123456789", "abcdefghi")), lang) for i, t, lang in common]
    names = ["r" + "".join(chr(97 + k // 26**j % 26) for j in range(3)) for k in range(600)]
    rare = [(100 + i, f"{n} " * (1 + i % 5), "en") for i, n in enumerate(names)]
    docs = documents(spark, common + rare)
    counts = pl.materialise(pl.word_counts(docs), "counts")
    units, model = pl.train(docs, counts=counts)
    hasher = SpanHasher(pl.BASE)
    unit = lambda w: int(units(pa.array([w.encode()], pa.binary()), hasher)[0][0])
    seen = [(n, 1 + i % 5) for i, n in enumerate(names)]
    home = unit(names[0])
    mates = [(n, c) for n, c in seen if unit(n) == home]
    unseen = next(w for w in (f"z{'y' * k}" for k in range(2000)) if unit(w) == home)
    got = {r.doc_id: r.log_prob for r in pl.score(documents(spark, [(i, w, "en") for i, (w, _) in enumerate([*mates, (unseen, 0)])]), units, model, counts=counts).collect()}
    assert len(mates) > 1
    for i, (_, c) in enumerate(mates):
        assert got[i] - got[len(mates)] == pytest.approx(np.log((c + 0.5) / 0.5), abs=1e-3)
    shares = [np.exp(got[i] - float(pl.log_probabilities(pl.unpacked(model), np.full((1, 2 * pl.SIDE), units.units), np.array([home]))[0])) for i in range(len(got))]
    assert sum(shares[:-1]) + len(mates) * shares[-1] == pytest.approx(1, abs=1e-3)


def test_units_grow_with_the_vocabulary():
    assert pl.class_size(0) == pl.class_size(5000) == pl.IN_CLASS < pl.class_size(1_200_000) < pl.class_size(30_000_000)
    p = pl.initial(in_class=128)
    q = pl.unpacked(pl.packed(p))
    assert all(np.array_equal(p[k], q[k]) for k in p)


def test_scores_of_all_documents_by_a_plain_loop(spark, small):
    """The whole query against words by a pattern, counts by a dictionary and a softmax in double precision, one position at
    a time, with the model that the query learns."""
    import re
    from collections import Counter

    df = spark.read.parquet(f"{small}/documents.parquet")
    units, model = pl.train(df)
    p, hasher = {k: v.astype(float) for k, v in pl.unpacked(model).items()}, SpanHasher(pl.BASE)
    docs = read(small, "documents", "doc_id, text")
    said = {i: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for i, t in docs}
    n = Counter(w for words in said.values() for w in words)
    names = sorted(n)
    number = dict(zip(names, units(pa.array([w.encode() for w in names], pa.binary()), hasher)[0].tolist()))
    frequent = {w for w, _ in sorted(n.items(), key=lambda x: -x[1])[: len(units.hashes)]}
    own = Counter(number[w] for w in names)
    least = min(n[w] for w in frequent)
    # words of shared units: those that have no unit of their own; a unit of its own has one word
    alone = {w for w in names if own[number[w]] == 1 and n[w] >= least and number[w] % units.in_class < (units.units - units.shared) // pl.CLASSES}
    shared = {u: (sum(n[w] for w in names if number[w] == u and w not in alone), sum(number[w] == u and w not in alone for w in names)) for u in {number[w] for w in names if w not in alone}}
    got = {r.doc_id: r for r in pl.pseudo_likelihood(df).collect()}
    assert len(alone) == len(units.hashes) and len(got) == len(docs)

    def log_softmax(x):
        return x - x.max() - np.log(np.exp(x - x.max()).sum())

    checked = 0
    for doc_id, words in said.items():
        assert got[doc_id].n_words == len(words)
        if len(words) > 400:
            continue
        total, unit = 0.0, [number[w] for w in words]
        for i, w in enumerate(words):
            around = [unit[j] if 0 <= j < len(unit) else units.units for j in (i - 2, i - 1, i + 1, i + 2)]
            h = np.tanh(np.concatenate([p["embedding"][u] for u in around]) @ p["hidden"] + p["bias"])
            c, k = divmod(unit[i], units.in_class)
            total += log_softmax(h @ p["classes"] + p["class_bias"])[c] + log_softmax(h @ p["inner"][c] + p["inner_bias"][c])[k]
            if w not in alone:
                held, different = shared[unit[i]]
                total += np.log((n[w] + pl.PRIOR) / (held + pl.PRIOR * 2 * different))
        assert got[doc_id].log_prob == pytest.approx(total, rel=1e-3, abs=1e-3)
        checked += 1
    assert checked > 50
