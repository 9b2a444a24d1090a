"""Language-model scoring, language identification and their networks."""

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillspark.llm import langid, lm
from quillspark.llm.gru import HIDDEN, Gru, Lanes, Shape, flat, initial, unflat

DOCS = "doc_id long, text string, lang string"


def documents(n=160):
    """Two invented languages with different words, and the odd cases."""
    rng = np.random.default_rng(1)
    words = {"aa": [f"ka{c}o" for c in "bdfglmnprst"] + ["the", "of"], "bb": [f"{c}üsche" for c in "bdfglmnprst"] + ["der", "und"]}
    rows = []
    for k in range(n):
        lang = ("aa", "bb")[k % 2]
        rows.append((k, " ".join(rng.choice(words[lang], rng.integers(5, 60))) + ".\nÉnd", lang if k % 5 else None))
    return rows + [(1000, None, "aa"), (1001, "", "bb"), (1002, "12 34 !", "aa"), (1003, "UNSEEN\x0b\x0cWörds\xa0x \x1f", None), (3, "again", "aa"), (None, "kabo of", "bb"), (1004, "kabo the " * 30000, "aa")]


def test_gradients_are_those_of_the_loss():
    shape = Shape(6, 2, 3)
    rng = np.random.default_rng(0)
    params = {k: v.astype(np.float64) for k, v in initial(shape, rng.random(9) * 5, hidden=4).items()}
    lanes = Lanes(rng.integers(0, 9, 23), np.array([9, 1, 13]), shape, 2)
    model = Gru(shape, params)
    size = len(lanes.want)
    _, want, past = next(lanes.windows(size))
    states, kept = model._run(past, np.zeros((want.shape[1], 4)), lanes.start_id, True)
    grads = model._gradients(states.astype(np.float64), kept, want, past)

    def loss(p):
        return -Gru(shape, p).score(lanes, size).sum() / 23

    for name, value in params.items():
        for at in list(np.ndindex(value.shape))[:: max(1, value.size // 7)]:
            moved = {k: v.copy() for k, v in params.items()}
            moved[name][at] += 1e-3
            up = loss(moved)
            moved[name][at] -= 2e-3
            assert (up - loss(moved)) / 2e-3 == pytest.approx(grads[name][at], abs=3e-3)


def test_a_text_scores_the_same_in_any_window_and_lane():
    shape, rng = Shape(6, 2, 3), np.random.default_rng(2)
    model = Gru(shape, initial(shape, rng.random(9)))
    sizes = np.array([5, 1, 40, 17])
    ids = rng.integers(0, 9, sizes.sum())
    one = model.score(Lanes(ids, sizes, shape, 1), 1000)
    np.testing.assert_allclose(model.score(Lanes(ids, sizes, shape, 3), 4), one, rtol=1e-4)
    vector = flat(model.p)
    assert all((v == model.p[k]).all() for k, v in unflat(vector, model.p).items())


def test_probabilities_of_words_sum_to_one():
    shape = Shape(6, 2, 3)
    model = Gru(shape, initial(shape, np.arange(9.0)))
    all_next = [model.score(Lanes(np.array([1, k]), np.array([2]), shape, 1)) for k in range(9)]
    first = model.score(Lanes(np.array([1]), np.array([1]), shape, 1))
    assert np.exp(np.array(all_next).ravel() - first).sum() == pytest.approx(1, abs=1e-4)


def test_lm_scores_against_brute_force(spark):
    rows = documents()
    df = spark.createDataFrame(rows, DOCS).withColumn("model", F.lit(1)).withColumn("row", F.lit("x"))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))
    got = lm.lm_scores(df, ~held_out).collect()
    tokens = lambda t: [w for w in (t or "").encode().lower().split()] + [b""]
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    counts = Counter(w for i, t, _ in rows if not out(i) for w in tokens(t))
    total = sum(counts.values())
    want = sorted((repr(i), len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)), round(sum(math.log10((counts[w] + 1) / (total + len(counts) + 1)) for w in tokens(t)), 6)) for i, t, _ in rows)
    assert sorted((repr(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == want
    assert {r.train_tokens for r in got} == {total}
    unseen = [r for r in got if out(r.doc_id) and r.n_tokens > 10 and r.n_tokens < 1000]
    assert sum(r.score for r in unseen) > sum(r.base_score for r in unseen)
    assert all(r.score < 0 for r in got)


def test_training_learns_from_every_window(spark):
    """Word k stands in window k of a long text only, so its vector moves only if that window learns."""
    words = [b""] + [f"w{k}".encode() for k in range(8)]
    head = lm.Head(words, [1] + [16] * 8, Shape(9, 3, 2))
    params = initial(head.shape, np.ones(11))
    text = " ".join(w.decode() for w in words[1:] for _ in range(16))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = lm.trained(df, head, params, {k: np.full_like(v, 1e-5) for k, v in params.items()})
    assert [bool((got["x"][k] != params["x"][k]).any()) for k in range(1, 9)] == [True] * 8


def test_lm_on_empty_tables(spark):
    empty = spark.createDataFrame([], DOCS)
    assert lm.lm_scores(empty, F.lit(True)).count() == 0
    one = spark.createDataFrame([(1, "a b", "x")], DOCS)
    assert [(r.n_tokens, r.n_known, r.train_tokens) for r in lm.lm_scores(one, F.lit(False)).collect()] == [(3, 0, 0)]


def test_slices_of_a_batch_keep_all_words():
    texts = [f"Word{k} and É{k} " * (k % 7) for k in range(50)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(50)), pa.array(texts)], names=["doc_id", "text"])
    got = []
    for part in lm.slices(batch, most=300):
        distinct, which, sizes = lm.coded_words(part.column(1))
        names = distinct.to_pylist()
        at = 0
        for n in sizes:
            got.append([names[k] for k in which[at : at + n]])
            at += n
    assert got == [[w.decode() for w in t.encode().lower().split()] + [""] for t in texts]


def test_language_identification(spark):
    rows = documents()
    df = spark.createDataFrame(rows, DOCS).withColumn("lang_pred", F.lit("taken"))
    held_out = F.coalesce(langid.remainder(F.col("doc_id"), 3) == 1, F.lit(False))
    got = {(r.doc_id, r.text): r for r in langid.identified(df, langid.train(df.where(~held_out))).collect()}
    assert len(got) == len(rows)
    right = [got[i, t].lang_pred == ("aa", "bb")[i % 2] for i, t, _ in rows[:160] if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum(right) >= 0.95 * len(right)
    for i, t in ((1000, None), (1001, ""), (1002, "12 34 !")):
        assert (got[i, t].lang_pred, got[i, t].lang_score) == ("und", 0.0)
    assert all(0 <= r.lang_score <= 1 for r in got.values())


def test_predictions_against_a_plain_network(spark):
    """Whole texts by a convolution written out, window after window, weighted by bytes."""
    rows = documents(40) + [(2000 + k, "ü" * n, "bb") for k, n in enumerate((1, 127, 128, 129, 300))]
    df = spark.createDataFrame(rows, DOCS)
    model = langid.train(df)
    p = {k: v.astype(np.float64) for k, v in model.params.items()}

    def plain(text):
        data = text.encode()
        total = np.zeros(len(model.labels))
        for at in range(0, len(data), langid.WINDOW):
            part = data[at : at + langid.WINDOW]
            e = p["embed"][list(part.ljust(langid.WINDOW, b"\0"))]
            pooled = [max(e[k : k + w].ravel() @ p[f"conv{w}"][:, f] for k in range(langid.WINDOW - w + 1)) + p[f"conv{w}_b"][f] for w in langid.WIDTHS for f in range(langid.FILTERS)]
            total += langid.softmax((np.maximum(pooled, 0) @ p["out"] + p["out_b"])[None])[0] * len(part)
        return total / len(data)

    for r in langid.identified(df, model).collect():
        if r.text and any(c.isalpha() for c in r.text) and len(r.text) < 5000:
            want = plain(r.text)
            assert r.lang_score == pytest.approx(want.max(), abs=1e-4)
            assert want[model.labels.index(r.lang_pred)] == pytest.approx(want.max(), abs=1e-4)
    empty = langid.identified(df.limit(0), model)
    assert empty.count() == 0 and empty.columns == [*df.columns, "lang_pred", "lang_score"]


def test_the_sample_has_a_bound_and_every_language(spark, monkeypatch):
    monkeypatch.setattr(langid, "MOST_DOCS", 60)
    df = spark.createDataFrame([(k, f"some text {k}", f"l{k % 100}") for k in range(2000)], DOCS)
    assert len({r["lang"] for r in langid.training_windows(df.where("doc_id < 100"))}) == 100
    assert len(langid.training_windows(df)) <= 120
    # Rows without an id, and copies of one text, are not chosen all together beyond the bound.
    lost = spark.createDataFrame([(None, f"some text {k}" if k % 2 else "copy", "l0") for k in range(2000)], DOCS)
    assert 0 < len(langid.training_windows(lost)) <= 120


def test_words_tied_at_the_heads_last_count(spark):
    counts = spark.createDataFrame([(f"w{k}".encode(), 0, 5) for k in range(3000)] + [(b"", 0, 9), (b"the", 0, 7)], "word binary, rest int, c long")
    words, c = lm.read_head(counts, 1000)
    assert words[:2] == [b"", b"the"] and c[:2] == [9, 7] and 900 < len(words) <= 1000 and words == lm.read_head(counts.repartition(7), 1000)[0]
    assert len(lm.read_head(counts, 5000)[0]) == 3002


def test_language_identification_without_labels(spark):
    df = spark.createDataFrame([(1, "abc", None)], DOCS)
    assert langid.train(df) is None
    assert langid.identified(df, None).first().lang_pred == "und"
    assert langid.train(spark.createDataFrame([], DOCS)) is None


def test_tables_give_the_networks_answers():
    model = langid.ByteCnn(["a", "b"], seed=1)
    x = np.random.default_rng(0).integers(0, 256, (5, langid.WINDOW)).astype(np.uint8)
    p = model.params
    e = p["embed"][x]
    pooled = []
    for w in langid.WIDTHS:
        z = np.stack([e[:, k : k + w].reshape(5, -1) @ p[f"conv{w}"] for k in range(langid.WINDOW - w + 1)], 1) + p[f"conv{w}_b"]
        pooled.append(z.max(1))
    want = langid.softmax(np.maximum(np.concatenate(pooled, 1), 0) @ p["out"] + p["out_b"])
    np.testing.assert_allclose(model.probabilities(x, model.tables()), want, rtol=1e-4, atol=1e-6)


def test_a_window_updates_only_the_rows_that_it_uses():
    shape, rng = Shape(6, 2, 3), np.random.default_rng(1)
    model = Gru(shape, initial(shape, rng.random(9), hidden=4))
    lanes = Lanes(np.array([1, 4, 1, 4]), np.array([4]), shape, 1)
    _, want, past = next(lanes.windows(4))
    states, kept = model._run(past, np.zeros((1, 4), np.float32), lanes.start_id, True)
    rows, own = model._touched(states, kept, want, past)["x"]
    assert rows.tolist() == [1, 4, lanes.start_id] and len(own) == 3
    before = {k: v.copy() for k, v in model.p.items()}
    model.train(lanes, 0.1)
    assert [k for k in range(shape.tokens) if (model.p["x"][k] != before["x"][k]).any()] == rows.tolist()


def test_word_classes_of_arrays():
    words = pa.array([b"", b"a", b"ab", b"xyz", b"\xff\xfe", "é".encode(), b"\xff"] * 3, pa.large_binary())
    for part in (words, words.slice(3, 9), words.slice(0, 0), pa.array([b""], pa.large_binary())):
        assert lm.rest_classes(part).tolist() == [lm.rest_class(x) for x in part.to_pylist()]
    head = lm.Head([b"the", b"of", b"rare"], [5, 3, 1], Shape(2, 2, lm.REST))
    asked = pa.array(["of", "rare", "new", "the"], pa.large_string())
    assert head.model_ids(asked).tolist() == head.ids(asked)[0].tolist() == [1, 2 + lm.rest_class(b"rare"), 2 + lm.rest_class(b"new"), 0]


@pytest.mark.parametrize("by", [1, 40, 4000])
def test_network_against_plain_formulas(by):
    """Gates and probabilities by exponentials, for weights within the safe bound and far beyond it."""
    rng, shape = np.random.default_rng(5), Shape(20, 4, 3)
    params = {k: (v * by).astype(np.float32) for k, v in initial(shape, np.arange(1.0, 24.0)).items()}
    ids = rng.integers(0, 23, 30)
    p, h, past, want = {k: v.astype(np.float64) for k, v in params.items()}, np.zeros(HIDDEN), shape.tokens - 1, 0.0
    log_softmax = lambda x: x - x.max() - np.log(np.exp(x - x.max()).sum())
    n = HIDDEN
    for y in ids.tolist():
        e, a = p["x"][past], h @ p["u"]
        z, r = (0.5 + 0.5 * np.tanh((e[k * n : k * n + n] + a[k * n : k * n + n]) / 2) for k in range(2))
        c = np.tanh(e[2 * n :] + r * a[2 * n :])
        h, past = c + z * (h - c), y
        k = int(shape.class_of(np.array([y]))[0])
        want += log_softmax(h @ p["c"] + p["c_b"])[k] + (log_softmax(h @ p["w"][k] + p["w_b"][k])[y - 5 * k] if y < 20 else 0)
    got = Gru(shape, params).score(Lanes(ids, np.array([30]), shape, 4))
    assert np.isfinite(got).all() and abs(got[0] - want) <= 2e-3 * max(1, abs(want))
