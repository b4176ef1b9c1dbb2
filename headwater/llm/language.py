"""Language identification by a bidirectional gated recurrent network over bytes.

Texts are cut into windows of ``WINDOW`` bytes; all of them are run. The network labels every byte; a document's
probabilities are the mean over all its bytes. Trained in numpy by backpropagation through time on a bounded sample of
labelled rows (``PER_LANGUAGE`` of each language, chosen by a hash of the id, fewer where there are very many languages); its windows
are cut on the executors, and only they come to the driver. Every language of the rows that may be learned from is learned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headwater.llm import neural as N
from headwater.llm import words as W
from headwater.llm.shared import bounded, held_out, tidy

WINDOW, HIDDEN, PAD = 96, 8, 256
#: Bounds of the training sample: rows of each language, windows a row gives at most, and windows in all (10 MB), whatever the number of languages.
PER_LANGUAGE, WINDOWS_A_ROW, WINDOWS = 250, 8, 100_000
STEPS, BATCH = 180, 160
UNKNOWN = "und"
#: Share of the probability that one language has to have for a document to stay in the pipeline: at a half, 12 of the 10,000 documents of sf0.1 would go,
#: all of them short or in two languages; at a third none does.
LEAST_SCORE = 1 / 3


def windows(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(WINDOW, windows) of byte values, padded, and the text of each window."""
    sizes = np.diff(at)
    n = -(-sizes // WINDOW)
    text = np.repeat(np.arange(len(sizes)), n)
    start = (np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)) * WINDOW + at[:-1][text]
    place = start + np.arange(WINDOW)[:, None]
    if not len(data):
        return np.zeros((WINDOW, 0), np.int16), text
    return np.where(place < at[1:][text], data[np.minimum(place, len(data) - 1)].astype(np.int16), np.int16(PAD)), text


class Model:
    """Table: byte -> input projections of both directions; U: recurrences; V, b: position labels."""

    def __init__(self, languages: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.params = {
            "table": N.init(rng, 2, PAD + 1, 3 * HIDDEN),
            "U": N.init(rng, 2, HIDDEN, 3 * HIDDEN),
            "V": N.init(rng, 2 * HIDDEN, len(languages)),
            "b": np.zeros(len(languages), N.F32),
        }

    def fit(self, symbols: np.ndarray, label: np.ndarray, seed: int = 11) -> None:
        """Windows (WINDOW, n) with a label each, drawn evenly over the languages."""
        rng, p = np.random.default_rng(seed), self.params
        by = [np.flatnonzero(label == k) for k in range(len(self.languages))]
        by = [x for x in by if len(x)]
        adam = N.Adam(p, 0.02)
        for _ in range(STEPS):
            rows = np.concatenate([rng.choice(x, max(1, BATCH // len(by))) for x in by])
            x, y = symbols[:, rows], label[rows]
            both = np.stack([x, x[::-1]], 1)
            gx = np.stack([p["table"][0][both[:, 0]], p["table"][1][both[:, 1]]], 1)
            hs, cache = N.forward(gx, p["U"])
            h = np.concatenate([hs[:, 0], hs[::-1, 1]], -1)
            logit = h @ p["V"] + p["b"]
            e = np.exp(logit - logit.max(-1, keepdims=True))
            d = e / e.sum(-1, keepdims=True)
            d[:, np.arange(len(rows)), y] -= 1
            d *= (x != PAD)[..., None] / max(1, int((x != PAD).sum()))
            dh = d @ p["V"].T
            dgx, dU = N.backward(np.stack([dh[..., :HIDDEN], dh[::-1, :, HIDDEN:]], 1), cache, p["U"])
            adam.step({
                "table": np.stack([N.scatter(both[:, k], dgx[:, k], PAD + 1) for k in (0, 1)]),
                "U": dU, "V": np.einsum("tbh,tbl->hl", h, d), "b": d.sum((0, 1)),
            })

    def pool(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """(texts, languages): mean of the position probabilities; zeros for an empty text."""
        p, L = self.params, len(self.languages)
        symbols, text = windows(data, at)
        total = np.zeros((len(at) - 1, L))
        table, V, b = p["table"].transpose(0, 2, 1).copy(), p["V"].T.copy(), p["b"][:, None]
        for low in range(0, symbols.shape[1], 4096):
            x = symbols[:, low : low + 4096].astype(np.intp)
            n = x.shape[1]

            def inputs(t: int, x=x, n=n) -> np.ndarray:
                out = np.empty((2, 3 * HIDDEN, n), N.F32)
                table[0].take(x[t], 1, out[0], "clip")
                table[1].take(x[WINDOW - 1 - t], 1, out[1], "clip")
                return out

            hs = N.run(inputs, p["U"], n, WINDOW)
            own = np.zeros((L, n), N.F32)
            for t in range(WINDOW):
                e = np.exp(V[:, :HIDDEN] @ hs[t, 0] + V[:, HIDDEN:] @ hs[WINDOW - 1 - t, 1] + b)
                e *= ((x[t] != PAD) / e.sum(0)).astype(N.F32)
                own += e
            for k in range(L):
                total[:, k] += np.bincount(text[low : low + n], own[k], len(at) - 1)
        return total / np.maximum(np.diff(at), 1)[:, None]


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """At most ``WINDOWS_A_ROW`` windows of each text, spread over it."""
    for batch in batches:
        for piece in W.pieces(batch, "text"):
            symbols, text = windows(*W.buffers(W.as_strings(piece.column("text"))))
            total = np.bincount(text, minlength=piece.num_rows)
            rank = np.arange(len(text)) - np.repeat(np.cumsum(total) - total, total)
            keep = np.flatnonzero(rank * WINDOWS_A_ROW // np.maximum(total[text], WINDOWS_A_ROW) != (rank - 1) * WINDOWS_A_ROW // np.maximum(total[text], WINDOWS_A_ROW))
            cut = [symbols[:, i].astype("<i2").tobytes() for i in keep.tolist()]
            of = pa.array(text[keep])
            yield pa.RecordBatch.from_arrays([piece.column("h").take(of), pa.array(rank[keep]), piece.column("k").take(of), pa.array(cut, pa.binary())], ["h", "place", "k", "symbols"])


def sample(docs: DataFrame, id_col: str, text_col: str, label_col: str) -> list[tuple[bytes, str]]:
    """(window, label) of at most ``PER_LANGUAGE`` rows or so of each label that may be learned from.

    Counts per label are exact and cover all rows; then each label keeps the share of rows whose hash is small enough, at
    least one row or so.
    """
    label = F.col(label_col).cast("string")
    known = docs.select(F.col(id_col).alias("i"), label.alias("k"), F.col(text_col).cast("string").alias("text"))
    rows = known.where(~held_out(F.col("i")) & F.col("k").isNotNull() & F.col("text").isNotNull())
    counts = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    languages = counts.count()
    if not languages:
        return []
    each = max(1, min(PER_LANGUAGE, WINDOWS // (WINDOWS_A_ROW * languages)))
    shares = counts.select("k", F.least(F.lit(1.0), F.lit(float(each)) / F.col("n")).alias("share"))
    drawn = rows.join(bounded(shares), "k").where(F.pmod(F.xxhash64(F.lit("sample"), "i"), F.lit(1_000_003)) < F.col("share") * 1_000_003)
    got = drawn.select(F.xxhash64(F.lit("order"), "i", "text").alias("h"), "k", "text").mapInArrow(tidy(_windows), "h long, place long, k string, symbols binary")
    got = got.orderBy("h", "place", "k").limit(2 * each * WINDOWS_A_ROW * languages).collect()
    return [(bytes(r["symbols"]), r["k"]) for r in got]


def train(rows: list[tuple[bytes, str]]) -> Model | None:
    if not rows:
        return None
    model = Model(sorted({k for _, k in rows}))
    number = {k: i for i, k in enumerate(model.languages)}
    symbols = np.frombuffer(b"".join(x for x, _ in rows), "<i2").reshape(-1, WINDOW).T
    model.fit(symbols, np.array([number[k] for _, k in rows]))
    return model


def _predict(model):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Model | None = model.value
        names = np.array([*(own.languages if own else []), UNKNOWN], object)
        for batch in batches:
            for piece in W.pieces(batch, "text"):
                texts = W.as_strings(piece.column("text"))
                data, at = W.buffers(texts)
                letter = np.concatenate([[0], np.cumsum(((data | 32) >= 0x61) & ((data | 32) <= 0x7A) & (data < 0x80))])
                has = letter[at[1:]] > letter[at[:-1]]
                for i in np.flatnonzero(~has & (np.diff(at) > 0)).tolist():
                    has[i] = any(map(str.isalpha, texts[i].as_py()))
                if own:
                    p = own.pool(data, at)
                    best, score = p.argmax(1), p.max(1)
                else:
                    best, score = np.zeros(len(texts), np.int64), np.zeros(len(texts))
                best = np.where(has, best, len(names) - 1)
                yield pa.RecordBatch.from_arrays(
                    [piece.column("id"), piece.column("held_out"), pa.array(names[best], pa.string()), pa.array(np.where(has, np.clip(score, 0, 1), 0.0))],
                    ["doc_id", "held_out", "lang_pred", "score"],
                )

    return predict


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score): one row per document, labelled by its text alone.

    Null, empty and letter-less texts are ``und`` with score 0, and so is every text if there is no labelled row to
    learn from. Null ids are never held out; repeated rows keep their rows; equal texts have equal results; of equally likely
    languages the first by name. A very long text is pooled window by window. Ids are cast to long. An empty table gives
    none. Other columns, whatever their names, are not read.
    """
    source = docs.select(F.col(id_col).cast("long").alias("id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    model = train(sample(docs, id_col, text_col, label_col))
    return source.mapInArrow(tidy(_predict(docs.sparkSession.sparkContext.broadcast(model))), "doc_id long, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", least: float = LEAST_SCORE) -> DataFrame:
    """Documents whose language is identified, with ``label_col`` filled where it is null; all columns, whatever their names, in one pass without a shuffle.

    Null, empty and letter-less texts go, and so do texts of which no language has ``least`` of the probability (mixtures and noise). A
    label that is there stays, even where the network would give another. Without a labelled row to learn from nothing is known of any text: all rows stay
    as they are. Repeated rows stay; a label column that is not text is not filled.
    """
    trained = train(sample(docs, id_col, text_col, label_col))
    if trained is None:
        return docs
    model = docs.sparkSession.sparkContext.broadcast(trained)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = pa.RecordBatch.from_arrays([pa.nulls(batch.num_rows, pa.int64()), pa.nulls(batch.num_rows, pa.bool_()), batch.column(text_col)], ["id", "held_out", "text"])
            found = pa.Table.from_batches(list(_predict(model)(iter([own]))), pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])).combine_chunks()
            told, place = found["lang_pred"], batch.schema.get_field_index(label_col)
            if pa.types.is_string(batch.schema.field(place).type) and batch.num_rows:
                batch = batch.set_column(place, batch.schema.field(place), pc.coalesce(batch.column(place), told.combine_chunks()))
            yield batch.filter(pc.and_(pc.not_equal(told, UNKNOWN), pc.greater_equal(found["score"], least)).combine_chunks())

    return docs.mapInArrow(tidy(keep), docs.schema)
