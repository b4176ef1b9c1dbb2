"""Recurrent networks: exact gradients, held-out accuracy, windows, and odd rows."""

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from headwater.llm import language, neural, toxicity
from headwater.llm import words as W

SF = "/root/testdata/sf0.1"  # 4,000 labels; sf0.01 has but 30 toxic documents to learn twenty word stems from


def test_backpropagation_equals_differences(monkeypatch):
    monkeypatch.setattr(neural, "F32", np.float64)
    rng = np.random.default_rng(1)
    gx, U = rng.normal(size=(5, 2, 3, 12)), rng.normal(size=(2, 4, 12))
    mask = (rng.random((5, 1, 3, 1)) < 0.7).astype(float)
    target = rng.normal(size=(5, 2, 3, 4))
    loss = lambda gx, U: float((neural.forward(gx, U, mask)[0] * target).sum())
    hs, cache = neural.forward(gx, U, mask)
    dgx, dU = neural.backward(target, cache, U, mask)
    for a, d in ((gx, dgx), (U, dU)):
        for _ in range(25):
            i = tuple(rng.integers(n) for n in a.shape)
            keep, e = a[i], 1e-5
            a[i] = keep + e
            up = loss(gx, U)
            a[i] = keep - e
            down = loss(gx, U)
            a[i] = keep
            assert abs((up - down) / (2 * e) - d[i]) < 1e-3 * max(1, abs(d[i]))


def test_inference_equals_training_pass():
    rng = np.random.default_rng(2)
    gx, U = rng.normal(size=(7, 2, 5, 24)).astype("f4"), rng.normal(size=(2, 8, 24)).astype("f4")
    hs, _ = neural.forward(gx, U)
    got = neural.run(lambda t: gx[t].transpose(0, 2, 1).copy(), U, 5, 7)
    assert np.allclose(got.transpose(0, 1, 3, 2), hs, atol=1e-5)


def test_windows_cover_every_byte_and_unit():
    data = np.arange(250, dtype=np.uint8)
    at = np.array([0, 0, 1, 200, 250])
    symbols, text = language.windows(data, at)
    assert sorted(symbols[symbols != language.PAD].tolist()) == list(range(250)) and text.tolist() == [1, 2, 2, 2, 3]
    for n in (0, 1, 24, 25, 36, 37, 100):
        start, text = toxicity.cut(np.array([0, n]))
        covered = {k for s in start.tolist() for k in range(s, min(n, s + toxicity.WINDOW))}
        assert covered == set(range(n)) and (np.diff(start) <= toxicity.STRIDE).all()
    letters, number, offsets = toxicity.units(pa.array(["Ab " + "x" * 40, None or "", "ab"]))
    assert offsets.tolist() == [0, 4, 4, 5] and number[0] == number[4] and (letters != 0).sum() == 2 + 16 + 8


def test_vocabulary_against_brute_force():
    texts = ["bad day", "bad bad luck", "bad day", "good day", "good luck", "good day", ""]
    letters, number, offsets = toxicity.units(pa.array(texts))
    vocab = toxicity.vocabulary(letters, number, offsets)
    names = [bytes(x[x > 0]).decode() for x in letters]
    of = {int(k): n for k, n in zip(toxicity.keys(letters), names)}
    docs = {n: sum(n in t.split() for t in texts) for n in names}
    assert sorted(of[int(k)] for k in vocab) == sorted(n for n in names if docs[n] >= toxicity.LEAST_DOCS) and (np.diff(vocab.astype(object)) > 0).all()


def test_learnable_windows_are_bounded_and_spread():
    long = " ".join(f"w{i}" for i in range(5000))
    (whole, n), (some, m), (none, k) = toxicity.learnable(pa.array(["a b c " * 30, long, "..."]))
    assert len(whole) == 90 * toxicity.LETTERS and n == len(toxicity.cut(np.array([0, 90]))[0]) and (none, k) == (b"", 0)
    assert len(some) == toxicity.WINDOWS_A_ROW * toxicity.WINDOW * toxicity.LETTERS and m == len(toxicity.cut(np.array([0, 5000]))[0])
    words = [bytes(x[x > 0]).decode() for x in np.frombuffer(some, np.uint8).reshape(-1, toxicity.LETTERS)]
    assert words[: toxicity.WINDOW] == [f"w{i}" for i in range(toxicity.WINDOW)] and int(words[-1][1:]) > 4800


def slow_gru(xs, U):
    """States of one direction, element by element."""
    H = U.shape[0]
    h, out = [0.0] * H, []
    squash = lambda v: v / (1 + abs(v))
    for x in xs:
        g = [sum(h[i] * U[i][j] for i in range(H)) for j in range(3 * H)]
        z = [0.5 * squash(x[j] + g[j]) + 0.5 for j in range(H)]
        r = [0.5 * squash(x[H + j] + g[H + j]) + 0.5 for j in range(H)]
        n = [squash(x[2 * H + j] + r[j] * g[2 * H + j]) for j in range(H)]
        h = [(1 - z[j]) * n[j] + z[j] * h[j] for j in range(H)]
        out.append(h)
    return out


def test_toxicity_score_equals_a_plain_forward_pass():
    """Characters, word embeddings, both directions, attention, highest window and calibration in plain Python."""
    model = toxicity.train([(f"fine words here {i} and some more", 0) for i in range(40)] + [(f"you awful fool {i} go", 1) for i in range(40)], 0.5)
    p = {k: v.astype(float) for k, v in model.params.items()}
    text = "you are an awful extraordinarilylongword fine " * 6

    def features(word):
        raw = np.zeros((1, toxicity.LETTERS), np.uint8)
        raw[0, : len(word)] = list(word)
        mean = np.mean([p["words"][i] for i in model.rank(raw)[0]], 0)
        sides = [slow_gru([p["letters"][k][c] for c in (word if k == 0 else word[::-1])], p["Uc"][k])[-1] for k in (0, 1)]
        return np.concatenate([mean, *sides])

    units = [w[i : i + toxicity.LETTERS] for w in (x.encode() for x in text.split()) for i in range(0, len(w), toxicity.LETTERS)]
    start, _ = toxicity.cut(np.array([0, len(units)]))
    logits = []
    for s in start.tolist():
        f = [features(u) for u in units[s : s + toxicity.WINDOW]]
        states = [slow_gru([x @ p["W"][k] + p["b"][k] for x in (f if k == 0 else f[::-1])], p["U"][k]) for k in (0, 1)]
        h = [np.concatenate([a, b]) for a, b in zip(states[0], states[1][::-1])]
        w = [float(np.exp((lambda v: v / (1 + np.abs(v)))(x @ p["A"]) @ p["a"])) for x in h]
        logits.append(sum(a * float(x @ p["v"]) for a, x in zip(w, h)) / sum(w) + float(p["c"][0]))
    want = 1 / (1 + np.exp(-(model.scale[0] * max(logits) + model.scale[1] * np.log(len(start)) + model.scale[2])))
    assert len(start) > 1 and abs(want - model.score(pa.array([text]))[0]) < 1e-4


def test_language_pooling_equals_a_plain_forward_pass():
    rng = np.random.default_rng(5)
    model = language.Model(["de", "en", "fr"])
    p = {k: v.astype(float) for k, v in model.params.items()}
    data = rng.integers(32, 120, 230).astype(np.uint8)
    total = np.zeros(3)
    for at in range(0, 230, language.WINDOW):
        own = [int(c) for c in data[at : at + language.WINDOW]]
        pad = [language.PAD] * (language.WINDOW - len(own))
        there, back = slow_gru([p["table"][0][c] for c in own + pad], p["U"][0]), slow_gru([p["table"][1][c] for c in (own + pad)[::-1]], p["U"][1])[::-1]
        for t in range(len(own)):
            e = np.exp(np.concatenate([there[t], back[t]]) @ p["V"] + p["b"])
            total += e / e.sum()
    assert np.allclose(model.pool(data, np.array([0, 230]))[0], total / 230, atol=1e-5)


def test_scores_do_not_depend_on_the_batch(spark):
    model = toxicity.train([(f"fine words here {i}", 0) for i in range(80)] + [(f"you awful fool {i}", 1) for i in range(80)], 0.5)
    texts = ["fine words here", "you awful fool", "", "x " * 200]
    together = model.score(pa.array(texts))
    assert np.allclose(together, [model.score(pa.array([t]))[0] for t in texts], atol=1e-6)
    assert together[1] > 0.5 > together[0] and 0 <= together.min() <= together.max() <= 1


def test_held_out_language(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    lang = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    rows = language.identify(docs).collect()
    assert len(rows) == len(lang) and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert np.mean([lang[r["doc_id"]] == r["lang_pred"] for r in held]) > 0.95 and all(0 <= r["score"] <= 1 for r in rows)


def test_held_out_toxicity(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "labels"))
    toxic = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    rows = toxicity.score_toxicity(docs, labels).collect()
    assert len(rows) == docs.count() and all(r["predicted"] == (r["score"] >= 0.3) for r in rows)
    one, zero = ([r["score"] for r in rows if r["held_out"] and toxic.get(r["doc_id"]) == k] for k in (1, 0))
    assert np.mean([a > b for a in one for b in zero]) > 0.97  # README states the figure


def test_odd_rows(spark):
    rows = [(1, None, "en"), (2, "", "en"), (3, "123 !!", "en"), (None, "hello there", "en"), (5, "hello " * 9000, "en"), (5, "hello " * 9000, "en"), (6, "guten tag", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("held_out", F.lit("x"))
    got = language.identify(docs).collect()
    assert len(got) == 7 and {r["doc_id"] for r in got if r["lang_pred"] == "und"} == {1, 2, 3}
    assert {r["doc_id"] for r in language.keep_identified(docs).collect()} == {None, 5, 6}
    nobody = language.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r["lang_pred"] for r in nobody} == {"und"}
    labels = spark.createDataFrame([(5, 1), (5, 0), (None, 1)], "doc_id long, toxic int").withColumn("y", F.lit(3)).withColumn("text", F.lit("z"))
    docs = docs.withColumn("y", F.lit("clash")).withColumn("h", F.lit(1)).withColumn("k", F.lit(1)).withColumn("i", F.lit(1)).withColumn("id", F.lit("x"))
    assert {r["score"] for r in toxicity.score_toxicity(docs, labels).collect()} == {0.0}
    assert language.identify(docs.limit(0)).count() == 0 and toxicity.score_toxicity(docs.limit(0), labels).count() == 0
    piece = pa.array(["a", None, "bé"])
    assert W.buffers(W.as_strings(piece))[1].tolist() == [0, 1, 1, 4]
