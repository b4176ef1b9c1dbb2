"""Toxicity by a bidirectional gated recurrent network with attention pooling.

Inputs of a step: the mean of the embeddings of a word and of its beginnings that several documents of the sample share
(one embedding for all others) and the final states of a character network (itself bidirectional and gated) over the word's bytes;
words of over ``LETTERS`` bytes are several steps. All parameters start at random: what is known of toxicity is learned by the
network. All windows of ``WINDOW`` steps, every ``STRIDE`` steps, are scored; attention pools a window's states. The document's
logit is that of its highest window, calibrated together with the number of windows. Trained in numpy: as labels are those of
documents, the first ``WARM`` rounds train on windows drawn at random from documents of both labels, and each later round on the
window of each document that the network scores highest so far. The sample is bounded: ``PER_CLASS`` rows of each label, of
each ``WINDOWS_A_ROW`` windows, which are cut on the executors; only they come to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headwater.llm import neural as N
from headwater.llm import words as W
from headwater.llm.shared import held_out, tidy

WINDOW, STRIDE, LETTERS = 24, 12, 16
VOCABULARY, EMBED, CHARS, HIDDEN, ATTEND = 8192, 8, 6, 8, 8
#: Words of the vocabulary are in so many documents of the sample.
LEAST_DOCS = 3
#: Bytes of a unit's beginnings that have an embedding too, so that inflected and compound forms share what their stem says.
STEMS = (4, 6, 8)
#: Bounds of the training sample: rows of each label, and windows a row is cut into at most (spread over the text).
PER_CLASS, WINDOWS_A_ROW = 1500, 48
ROUNDS, WARM, STEPS, BATCH = 8, 3, 60, 96
RATE, DECAY = 0.016, 0.8
#: Share of words whose characters a training step hides, and of shared words taken as unknown, so that neither input is relied on alone.
HIDE_CHARS, HIDE_WORDS = 0.3, 0.2
CUT = 0.3


def units(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(unique units as padded bytes, number of each unit in the texts, offsets by text)."""
    w = W.words(texts)
    size = w.end - w.start
    n = -(-size // LETTERS)
    word = np.repeat(np.arange(len(size)), n)
    start = w.start[word] + (np.arange(len(word)) - np.repeat(np.cumsum(n) - n, n)) * LETTERS
    stop = np.minimum(start + LETTERS, w.end[word])
    offsets = np.concatenate([[0], np.cumsum(n)])[w.offsets]
    if not len(word):
        return np.zeros((0, LETTERS), np.uint8), np.zeros(0, np.int64), offsets
    place = start[:, None] + np.arange(LETTERS)
    letters = np.where(place < stop[:, None], w.data[np.minimum(place, len(w.data) - 1)], 0).astype(np.uint8)
    key = W.mix(letters[:, :8].copy().view(np.uint64)[:, 0]) ^ letters[:, 8:].copy().view(np.uint64)[:, 0] * np.uint64(0x9E3779B97F4A7C15)
    _, first, number = np.unique(key, return_index=True, return_inverse=True)
    return letters[first], number, offsets


def keys(letters: np.ndarray) -> np.ndarray:
    half = letters.reshape(-1, 2, 8).copy().view(np.uint64)[..., 0]
    return W.mix(W.mix(half[:, 0]) + half[:, 1])


def vocabulary(letters: np.ndarray, number: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sorted keys of the units that ``LEAST_DOCS`` texts have, of the ``VOCABULARY`` most frequent."""
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    pair = np.unique(text * max(len(letters), 1) + number)
    total, key = np.bincount(pair % len(letters), minlength=len(letters)) if len(letters) else np.zeros(0, np.int64), keys(letters)
    used = np.lexsort((key, -total))[:VOCABULARY]
    return np.sort(key[used[total[used] >= LEAST_DOCS]])


def stems(letters: np.ndarray, size: int) -> np.ndarray:
    """The first ``size`` bytes of each unit."""
    return letters * (np.arange(LETTERS) < size)


def vocabularies(letters: np.ndarray, number: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """``vocabulary`` of the whole units, then of the stems of each length."""
    out = [vocabulary(letters, number, offsets)]
    for size in STEMS:
        own = stems(letters, size)
        _, first, inverse = np.unique(keys(own), return_index=True, return_inverse=True)
        out.append(vocabulary(own[first], inverse[number], offsets))
    return out


def cut(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first unit, text) of every window; a text with units has one at least, and the last reaches its end."""
    n = np.diff(offsets)
    count = np.where(n > 0, 1 + np.maximum(0, -(-(n - WINDOW) // STRIDE)), 0)
    text = np.repeat(np.arange(len(n)), count)
    i = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    return offsets[:-1][text] + np.minimum(i * STRIDE, np.maximum(0, n[text] - WINDOW)), text


class Model:
    def __init__(self, vocabs: list[np.ndarray], seed: int = 5):
        """``vocabs``: sorted keys of the whole units and of the stems of each length."""
        rng = np.random.default_rng(seed)
        self.vocabs = vocabs
        self.offsets = np.cumsum([0, *(len(v) + 1 for v in self.vocabs)])
        D = EMBED + 2 * CHARS
        self.params = {
            "letters": N.init(rng, 2, 256, 3 * CHARS), "Uc": N.init(rng, 2, CHARS, 3 * CHARS), "words": N.init(rng, self.offsets[-1], EMBED, scale=0.1),
            "W": N.init(rng, 2, D, 3 * HIDDEN, scale=0.3), "b": np.zeros((2, 3 * HIDDEN), N.F32), "U": N.init(rng, 2, HIDDEN, 3 * HIDDEN),
            "A": N.init(rng, 2 * HIDDEN, ATTEND), "a": N.init(rng, ATTEND), "v": N.init(rng, 2 * HIDDEN), "c": np.zeros(1, N.F32),
        }
        self.scale = np.array([1.0, 0.0, 0.0])  # of the highest logit, of the log of the windows' number, constant

    def rank(self, letters: np.ndarray) -> np.ndarray:
        """(units, 1 + stems): rows of the embeddings whose mean a unit has; each level's last is that of all it doesn't know."""
        out = np.empty((len(letters), len(self.vocabs)), np.int64)
        for level, (vocab, own) in enumerate(zip(self.vocabs, (letters, *(stems(letters, k) for k in STEMS)), strict=True)):
            key, n = keys(own), len(vocab)
            place = np.minimum(np.searchsorted(vocab, key), max(n - 1, 0))
            out[:, level] = self.offsets[level] + (np.where(vocab[place] == key, place, n) if n else 0)
        return out

    # Characters.

    @staticmethod
    def _sides(letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes in both directions, left-aligned: (LETTERS, 2, n); and each unit's length."""
        size = (letters != 0).sum(1)
        place = size[:, None] - 1 - np.arange(LETTERS)
        back = np.where(place >= 0, np.take_along_axis(letters, np.maximum(place, 0), 1), 0)
        return np.stack([letters.T, back.T], 1), size

    def inputs(self, letters: np.ndarray) -> np.ndarray:
        """(2, 3H, units): projections of each unique unit, for inference; the padding comes last."""
        p = self.params
        out = np.empty((2, 3 * HIDDEN, len(letters) + 1), N.F32)
        out[:, :, -1] = p["b"]
        table, Ut = p["letters"].transpose(0, 2, 1).copy(), p["Uc"].transpose(0, 2, 1).copy()
        for low in range(0, len(letters), 8192):
            own = letters[low : low + 8192]
            sides, size = self._sides(own)
            order = np.argsort(-size, kind="stable")
            sides, size = sides[:, :, order].astype(np.intp), size[order]
            final = np.zeros((2, CHARS, len(own)), N.F32)
            for t in range(int(size[0]) if len(size) else 0):  # only the units that are long enough
                n = int(np.searchsorted(-size, -t))
                x = np.stack([table[k].take(sides[t, k, :n], 1) for k in (0, 1)])
                final[:, :, :n] = N.step(final[:, :, :n].copy(), x, Ut)
            features = np.empty((EMBED + 2 * CHARS, len(own)), N.F32)
            features[:EMBED] = p["words"][self.rank(own)].mean(1).T
            features[EMBED:, order] = final.reshape(2 * CHARS, -1)
            for k in (0, 1):
                out[k, :, low : low + len(own)] = p["W"][k].T @ features + p["b"][k][:, None]
        return out

    def logits(self, letters: np.ndarray, number: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Of every window from its first unit to ``end`` (of the text), by attention over its states."""
        p, out = self.params, np.empty(len(start), N.F32)
        gx = self.inputs(letters)
        A, v = p["A"].T.copy(), p["v"]
        for low in range(0, len(start), 4096):
            s, e = start[low : low + 4096], end[low : low + 4096]
            place = s + np.arange(WINDOW)[:, None]
            there = place < e
            unit = np.where(there, number[np.minimum(place, len(number) - 1)], len(letters))

            def inputs(t: int, unit=unit) -> np.ndarray:
                x = np.empty((2, 3 * HIDDEN, unit.shape[1]), N.F32)
                gx[0].take(unit[t], 1, x[0], "clip")
                gx[1].take(unit[WINDOW - 1 - t], 1, x[1], "clip")
                return x

            hs = N.run(inputs, p["U"], len(s), WINDOW)
            top, total = np.zeros(len(s), N.F32), np.zeros(len(s), N.F32)
            for t in range(WINDOW):
                f, b = hs[t, 0], hs[WINDOW - 1 - t, 1]
                weight = np.exp(p["a"] @ N.squash(A[:, :HIDDEN] @ f + A[:, HIDDEN:] @ b)) * there[t]
                top += (v[:HIDDEN] @ f + v[HIDDEN:] @ b) * weight
                total += weight
            out[low : low + len(s)] = top / total + p["c"][0]
        return out

    # Training.

    def step(self, adam: N.Adam, rng: np.random.Generator, letters: np.ndarray, unit: np.ndarray, there: np.ndarray, y: np.ndarray) -> None:
        """One gradient step on windows: units (WINDOW, B) into ``letters``, whose last row is the padding."""
        p = self.params
        used, inverse = np.unique(unit, return_inverse=True)
        own = letters[used]
        sides, size = self._sides(own)
        mask = (np.arange(LETTERS)[:, None] < size)[:, None, :, None].astype(N.F32)
        gc = np.stack([p["letters"][k][sides[:, k]] for k in (0, 1)], 1)
        cs, ccache = N.forward(gc, p["Uc"], mask)
        row = np.where(rng.random((len(own), 1 + len(STEMS))) < HIDE_WORDS, self.offsets[1:] - 1, self.rank(own))
        shown = (rng.random((len(own), 1)) >= HIDE_CHARS) / N.F32(1 - HIDE_CHARS)
        real = (size > 0)[:, None]
        features = np.concatenate([p["words"][row].mean(1), cs[-1, 0] * shown, cs[-1, 1] * shown], 1) * real
        inverse = inverse.reshape(unit.shape)
        x = features[inverse]
        both = np.stack([x, x[::-1]], 1)
        hs, cache = N.forward(np.matmul(both, p["W"][None]) + p["b"][:, None], p["U"])
        h = np.concatenate([hs[:, 0], hs[::-1, 1]], -1)
        u = N.squash(h @ p["A"])
        w = np.where(there, np.exp(u @ p["a"]), 0)
        w /= w.sum(0)
        value = h @ p["v"]
        logit = (value * w).sum(0) + p["c"][0]
        d = (N.sigmoid(logit) - y).astype(N.F32) / len(y)
        ds = w * (value - (logit - p["c"][0])) * d
        du = ds[..., None] * p["a"] * N.squash_slope(u)
        dh = (w * d)[..., None] * p["v"] + du @ p["A"].T
        dgx, dU = N.backward(np.stack([dh[..., :HIDDEN], dh[::-1, :, HIDDEN:]], 1), cache, p["U"])
        dW = np.stack([both[:, k].reshape(-1, both.shape[-1]).T @ dgx[:, k].reshape(-1, 3 * HIDDEN) for k in (0, 1)])
        dx = dgx[:, 0] @ p["W"][0].T + (dgx[:, 1] @ p["W"][1].T)[::-1]
        df = N.scatter(inverse, dx, len(used)) * real
        dcs = np.zeros_like(cs)
        dcs[-1, 0], dcs[-1, 1] = df[:, EMBED : EMBED + CHARS] * shown, df[:, EMBED + CHARS :] * shown
        dgc, dUc = N.backward(dcs, ccache, p["Uc"], mask)
        dgc *= mask
        adam.step({
            "letters": np.stack([N.scatter(sides[:, k].astype(np.int64), dgc[:, k], 256) for k in (0, 1)]), "Uc": dUc,
            "words": N.scatter(row, np.repeat(df[:, :EMBED] / row.shape[1], row.shape[1], 0), self.offsets[-1]), "W": dW, "b": dgx.sum((0, 2)), "U": dU,
            "A": np.einsum("tbh,tba->ha", h, du), "a": (ds[..., None] * u).sum((0, 1)), "v": ((w * d)[..., None] * h).sum((0, 1)), "c": d.sum(keepdims=True),
        })

    def score(self, texts: pa.Array) -> np.ndarray:
        letters, number, offsets = units(texts)
        start, text = cut(offsets)
        high = np.full(len(texts), self.empty, np.float64)
        count = np.bincount(text, minlength=len(texts)) if len(text) else np.zeros(len(texts), np.int64)
        if len(start):
            logit = self.logits(letters, number, start, offsets[1:][text])
            first = np.flatnonzero(np.concatenate([[True], np.diff(text) != 0]))
            high[text[first]] = np.maximum.reduceat(logit, first)
        s = self.scale
        return 1 / (1 + np.exp(-np.clip(s[0] * high + s[1] * np.log(np.maximum(count, 1)) + s[2], -30, 30)))

    empty = -3.0


def learnable(texts: pa.Array) -> Iterator[tuple[bytes, int]]:
    """Of each text the units to learn from, ``LETTERS`` bytes each, and the number of all its windows.

    A text of at most ``WINDOWS_A_ROW`` windows is taken whole; of a longer one so many windows are taken, spread over
    it and put one after another, each of ``WINDOW`` units.
    """
    letters, number, offsets = units(texts)
    start, text = cut(offsets)
    first = np.searchsorted(text, np.arange(len(offsets)))
    for d in range(len(offsets) - 1):
        own = start[first[d] : first[d + 1]]
        if len(own) <= WINDOWS_A_ROW:
            taken = number[offsets[d] : offsets[d + 1]]
        else:
            some = own[np.arange(WINDOWS_A_ROW) * len(own) // WINDOWS_A_ROW]
            taken = number[some[:, None] + np.arange(WINDOW)].ravel()
        yield letters[taken].tobytes(), len(own)


def train(rows: list[tuple[str, int]], share: float) -> Model | None:
    """From (text, label) rows; ``share`` is that of label 1 among all labelled rows, for the calibration."""
    got = list(learnable(pa.array([t or "" for t, _ in rows], pa.string()))) if rows else []
    return fit([(u, n, y) for (u, n), (_, y) in zip(got, rows, strict=True)], share)


def fit(rows: list[tuple[bytes, int, int]], share: float) -> Model | None:
    """From (units, number of windows, label) rows, see ``learnable``."""
    y = np.array([k for *_, k in rows], np.float64)
    if not len(y) or y.min() == y.max():
        return None
    rng = np.random.default_rng(13)
    every = np.frombuffer(b"".join(u for u, *_ in rows), np.uint8).reshape(-1, LETTERS)
    _, one, number = np.unique(keys(every), return_index=True, return_inverse=True)
    letters, offsets = every[one], np.concatenate([[0], np.cumsum([len(u) // LETTERS for u, *_ in rows])])
    model = Model(vocabularies(letters, number, offsets))
    total = np.array([n for _, n, _ in rows])
    # A window of a text taken whole starts every STRIDE units, else every WINDOW units, where windows were put together.
    starts = [np.arange(WINDOWS_A_ROW) * WINDOW if n > WINDOWS_A_ROW else cut(np.array([0, size]))[0] for n, size in zip(total.tolist(), np.diff(offsets).tolist(), strict=True)]
    text = np.repeat(np.arange(len(rows)), [len(x) for x in starts])
    start = np.concatenate(starts).astype(np.int64) + offsets[:-1][text]
    end = offsets[1:][text]
    if not len(start):
        return model
    padded = np.concatenate([letters, np.zeros((1, LETTERS), np.uint8)])
    adam = N.Adam(model.params, RATE)
    first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=len(rows)))])
    docs = [np.flatnonzero((np.diff(first) > 0) & (y == k)) for k in (0, 1)]

    def any_window(label: int, n: int) -> np.ndarray:
        d = rng.choice(docs[label], n) if len(docs[label]) else docs[label]
        return first[d] + (rng.random(len(d)) * (first[d + 1] - first[d])).astype(np.int64)

    for r in range(ROUNDS):
        adam.rate = RATE * DECAY**r
        if r >= WARM:
            logit = model.logits(letters, number, start, end)
            order = np.lexsort((-logit, text))
            top = order[np.concatenate([[True], np.diff(text[order]) != 0])]
            high, low = top[y[text[top]] == 1], top[y[text[top]] == 0]
        for _ in range(STEPS):  # both labels alike, and as many steps whatever the sample's size
            if r < WARM:
                b = np.concatenate([any_window(1, BATCH // 2), any_window(0, BATCH // 2)])
            else:
                b = np.concatenate([*(rng.choice(x, BATCH // k) for x, k in ((high, 2), (low, 3)) if len(x)), any_window(0, BATCH // 6)])
            place = start[b] + np.arange(WINDOW)[:, None]
            there = place < end[b]
            unit = np.where(there, number[np.minimum(place, len(number) - 1)], len(letters))
            model.step(adam, rng, padded, unit, there, y[text[b]])
    # Calibration on the documents of the sample, weighted to the true share.
    logit = model.logits(letters, number, start, end)
    high = np.full(len(rows), model.empty)
    begin = np.flatnonzero(np.concatenate([[True], np.diff(text) != 0]))
    high[text[begin]] = np.maximum.reduceat(logit, begin)
    x = np.stack([high, np.log(np.maximum(total, 1)), np.ones(len(y))], 1)
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    s = np.array([0.5, 0.0, 0.0])
    for _ in range(60):  # damped Newton steps of a ridge regression; the classes may be separable
        q = 1 / (1 + np.exp(-np.clip(x @ s, -30, 30)))
        grad = x.T @ (weight * (q - y)) + s
        hess = (x * (weight * q * (1 - q))[:, None]).T @ x + np.eye(3)
        move = np.linalg.solve(hess, grad)
        s = s - move * min(1.0, 0.5 / (np.abs(move).max() + 1e-12))
    model.scale = s
    return model


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in W.pieces(batch, "text"):
            got = list(learnable(W.as_strings(piece.column("text"))))
            yield pa.RecordBatch.from_arrays([piece.column("h"), pa.array([u for u, _ in got], pa.binary()), pa.array([n for _, n in got], pa.int64()), piece.column("y")], ["h", "units", "n", "y"])


def sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> tuple[list[tuple[bytes, int, int]], float]:
    """Bounded sample of both labels, as ``learnable`` cuts it, and the share of label 1 among all labelled rows that may be learned from.

    At most 3 * PER_CLASS rows (ids may repeat) of at most WINDOWS_A_ROW * WINDOW * LETTERS bytes come to the driver, never a whole long text.
    """
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y"))
    rows = known.where(F.col("y").isin(0, 1) & F.col("id").isNotNull() & ~held_out(F.col("id"))).groupBy("id").agg(F.max("y").alias("y"))
    counts = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(counts) < 2:
        return [], 0.5
    drawn = None
    for y in (0, 1):
        part = rows.where(F.col("y") == y).orderBy(F.xxhash64(F.lit("toxic"), "id"), "id").limit(PER_CLASS)
        drawn = part if drawn is None else drawn.unionByName(part)
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    found = source.join(F.broadcast(drawn), "id").select(F.xxhash64(F.lit("order"), "id", "text").alias("h"), "text", "y")
    got = found.mapInArrow(tidy(_windows), "h long, units binary, n long, y int").orderBy("h", "n", "y").limit(3 * PER_CLASS).collect()
    return [(bytes(r["units"]), r["n"], r["y"]) for r in got], counts[1] / (counts[0] + counts[1])


def _score(model):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Model | None = model.value
        for batch in batches:
            for piece in W.pieces(batch, "text"):
                texts = W.as_strings(piece.column("text"))
                s = own.score(texts) if own else np.zeros(len(texts))
                yield pa.RecordBatch.from_arrays(
                    [piece.column("id"), piece.column("held_out"), pa.array(s), pa.array((s >= CUT).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"]
                )

    return score


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """(doc_id, held_out, score, predicted): one row per document, scored by its text alone.

    Null, empty and word-less texts get the score of a text without any window. Without rows of both labels every score is 0. If an id
    has several labels the highest counts. Null ids are never held out; repeated rows keep their rows; equal texts have
    equal scores. A very long text is scored window by window. Ids are cast to long. An empty table gives none. Other
    columns of either table, whatever their names, are not read.
    """
    source = docs.select(F.col(id_col).cast("long").alias("id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    model = fit(*sample(docs, labels, id_col, text_col, label_col))
    return source.mapInArrow(tidy(_score(docs.sparkSession.sparkContext.broadcast(model))), "doc_id long, held_out boolean, score double, predicted int")
