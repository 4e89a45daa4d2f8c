"""Operator 8: language identification by a bidirectional gated recurrent network over bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sketchlark.llm.kernel import Chunk, chunks, mix64
from sketchlark.plans.names import neutral, with_fields
from sketchlark.llm.recurrent import Adam, gru_backward, gru_forward, gru_project, gru_weights

#: The sample to learn from: labelled rows per language, and windows of WINDOW bytes from anywhere in them (both expected
#: numbers, chosen by hash); training takes STEPS batches of BATCH windows.
DOCS_PER_LANGUAGE, WINDOWS, WINDOW, STEPS, BATCH, HIDDEN, SEED = 600, 6000, 48, 140, 256, 12, 11
#: Texts are labelled in pieces of about PIECE bytes; either network starts CONTEXT bytes outside of its piece.
PIECE, CONTEXT = 192, 24
#: A worker labels so many pieces at once.
TOGETHER = 1024
#: The symbol for what lies outside of a text: the networks start anew after it.
OUTSIDE = 256


def pieces(c: Chunk, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text of the pieces of about ``size`` bytes of each text, cut between characters; they cover every byte."""
    n = -(-(c.ends - 1 - c.starts) // size)
    text = np.repeat(np.arange(c.n), n)
    start = c.starts[text] + (np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)) * size
    for _ in range(3):
        start = start - (((c.data[start] & 0xC0) == 0x80) & (start > c.starts[text]))
    last = np.append(text[1:] != text[:-1], True)[: len(text)]
    return start, np.where(last, c.ends[text] - 1, np.append(start[1:], 0)[: len(text)]), text


def symbols(c: Chunk, text: np.ndarray, start: np.ndarray, n: int) -> np.ndarray:
    """(n, pieces): the bytes from each start on, OUTSIDE before and after the text."""
    at = start[None, :] + np.arange(n)[:, None]
    inside = (at >= c.starts[text]) & (at < c.ends[text] - 1)
    return np.where(inside, c.data[np.clip(at, 0, len(c.data) - 1)].astype(np.int64), OUTSIDE)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


class Labeller:
    """Probabilities of languages at every byte, from a forward and a backward network."""

    def __init__(self, languages: list[str], weights: dict[str, np.ndarray]):
        self.languages, self.weights = languages, weights

    @classmethod
    def train(cls, windows: list[bytes], label: np.ndarray, languages: list[str], hidden: int = HIDDEN, steps: int = STEPS, seed: int = SEED) -> Labeller:
        """Cross-entropy at every byte of the windows, by backpropagation through time; languages are drawn equally often."""
        rng = np.random.default_rng(seed)
        w = gru_weights(rng, OUTSIDE, hidden, "f") | gru_weights(rng, OUTSIDE, hidden, "b")
        w |= {"v": (rng.standard_normal((2 * hidden, len(languages))) * 0.1).astype(np.float32), "c": np.zeros(len(languages), np.float32)}
        adam = Adam(w)
        longest = max(map(len, windows), default=0)
        table = np.full((len(windows), longest), OUTSIDE, np.int64)
        for i, x in enumerate(windows):
            table[i, : len(x)] = np.frombuffer(x, np.uint8)
        weight = 1.0 / np.bincount(label, minlength=len(languages)).clip(1)[label] if len(windows) else np.zeros(0)
        chance = np.cumsum(weight) / max(weight.sum(), 1e-9)
        for step in range(steps if len(languages) > 1 else 0):
            some = np.minimum(np.searchsorted(chance, rng.random(BATCH), side="right"), len(windows) - 1)
            x = table[some]
            # A quarter of them is shortened, as texts may be.
            short = rng.integers(4, max(5, longest + 1), BATCH)
            short[BATCH // 4 :] = longest
            x[np.arange(longest)[None, :] >= short[:, None]] = OUTSIDE
            x = np.ascontiguousarray(x.T)
            live = (x != OUTSIDE)[:, :, None]
            hf, sf = gru_forward(w, "f", x, True)
            hb, sb = gru_forward(w, "b", x[::-1], True)
            both = np.concatenate([hf, hb[::-1]], 2)
            d = softmax(both @ w["v"] + w["c"])
            d[:, np.arange(BATCH), label[some]] -= 1
            d *= live / np.float32(live.sum())
            back = d @ w["v"].T
            flat = d.reshape(-1, len(languages))
            grads = {"v": both.reshape(-1, 2 * hidden).T @ flat, "c": flat.sum(0)}
            grads |= gru_backward(w, "f", x, sf, back[:, :, :hidden])
            grads |= gru_backward(w, "b", x[::-1], sb, np.ascontiguousarray(back[::-1, :, hidden:]))
            adam.rate = 0.03 * (1 - step / steps) + 0.001
            adam.step(grads)
        return cls(languages, w)

    def pooled(self, c: Chunk) -> np.ndarray:
        """Mean probabilities of the languages over all bytes of each text (zeros for an empty one)."""
        w, n = self.weights, len(self.languages)
        hidden = len(w["v"]) // 2
        start, end, text = pieces(c, PIECE)
        total = np.zeros((c.n, n))
        for at in range(0, len(start), TOGETHER):
            part = slice(at, at + TOGETHER)
            a, of, length = start[part], text[part], end[part] - start[part]
            longest = int(length.max())
            score = gru_project(w, "f", symbols(c, of, a - CONTEXT, CONTEXT + longest), w["v"][:hidden], CONTEXT)
            score += gru_project(w, "b", symbols(c, of, a, longest + CONTEXT)[::-1], w["v"][hidden:], CONTEXT)[::-1]
            score += w["c"][:, None]
            score -= score.max(1, keepdims=True)
            np.exp(score, out=score)
            score *= ((np.arange(longest)[:, None] < length) / score.sum(1))[:, None, :]
            for k, sums in enumerate(score.sum(0, dtype=np.float64)):
                total[:, k] += np.bincount(of, weights=sums, minlength=c.n)
        return total / np.maximum(1, c.ends - 1 - c.starts)[:, None]


def sample_windows(rows: DataFrame, docs: int = DOCS_PER_LANGUAGE, windows: int = WINDOWS, size: int = WINDOW) -> list[tuple[str, bytes]]:
    """(language, window) pairs from ``rows`` (key, text, lang): about ``docs`` rows of each language, and of all windows of
    ``size`` bytes of their whole texts about ``windows``, both chosen by hash, so that long texts give as many as they have.

    The driver holds a count per language, as the network does an output.
    """
    size_of = F.coalesce(F.octet_length("text"), F.lit(0)).cast("double")
    counts = rows.groupBy("lang").agg(F.count("*").alias("n"), F.sum(size_of).alias("bytes")).collect()
    if not counts:
        return []
    # Literal maps, so that texts aren't dealt by their language.
    of = lambda values: F.element_at(F.create_map(*(F.lit(x) for r, v in zip(counts, values) for x in (r["lang"], float(v)))), F.col("lang"))
    row_share = [min(1.0, docs / r["n"]) for r in counts]
    window_share = [min(1.0, windows * size / max(1.0, s * r["bytes"])) for r, s in zip(counts, row_share)]
    chosen = (F.pmod(F.xxhash64("key", "text"), F.lit(1 << 30)) + 0.5) / (1 << 30) < of(row_share)
    some = rows.where(chosen).select("text", "lang", of(window_share).alias("share"))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, found = [], []
            names, share = batch.column(1).to_pylist(), batch.column(2).to_numpy()
            for at, c in chunks(batch.column(0)):
                own = c.hashes(c.starts, c.ends)
                start, end, text = pieces(c, size)
                h = mix64(own[text] + (start - c.starts[text]).astype(np.uint64))
                for i in np.flatnonzero((h >> np.uint64(11)).astype(np.float64) / (1 << 53) < share[at + text]):
                    lang.append(names[at + text[i]])
                    found.append(c.data[start[i] : end[i]].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(found, pa.binary())], ["lang", "window"])

    found = some.mapInArrow(pick, "lang string, window binary").collect()
    return sorted((r["lang"], bytes(r["window"])) for r in found)


def has_letter(text: str):
    return F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))


def fit(docs: DataFrame, learn, key: str = "doc_id", text: str = "text", lang: str = "lang", **more) -> Labeller:
    """A labeller from the rows of ``docs`` where the condition ``learn`` holds, language is known and text has a letter.

    With rows of one language only, or none, it always says that one, or none.
    """
    rows = docs.where(learn & F.col(lang).isNotNull() & has_letter(text)).select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    sample = sample_windows(rows)
    languages = sorted({x for x, _ in sample})
    at = {x: i for i, x in enumerate(languages)}
    return Labeller.train([w for _, w in sample], np.array([at[x] for x, _ in sample], np.int64), languages, **more)


def predict(docs: DataFrame, model: Labeller, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score: the language of highest mean probability over all bytes, and that mean.

    Every byte of every whole text is labelled, with at least CONTEXT bytes read on either side where the text has them.
    A null text or one without a letter has ``und`` and score 0, as has every text if the model knows no language. Of
    languages with equal means the first by name is taken. Repeated rows are labelled like others, an empty table gives
    an empty result, and columns of these names are replaced.
    """
    rows, (body,), back = neutral(docs, text, without=["lang_pred", "score"])
    where = rows.columns.index(body)
    rows = rows.withColumn("letter", has_letter(body))

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pred, score = [], []
            for _, c in chunks(batch.column(where)):
                p = model.pooled(c) if model.languages else np.zeros((c.n, 1))
                best = p.argmax(1)
                score += p[np.arange(c.n), best].tolist()
                pred += [model.languages[b] if model.languages else None for b in best]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pred, pa.string()), pa.array(score, pa.float64())], [*batch.schema.names, "lang", "p"])

    out = rows.mapInArrow(label, with_fields(rows, "lang string, p double"))
    sure = F.col("letter") & F.col("lang").isNotNull() & (F.col("p") > 0)
    return back(out, F.when(sure, F.col("lang")).otherwise("und").alias("lang_pred"), F.when(sure, F.least(F.lit(1.0), F.round("p", 6))).otherwise(0.0).alias("score"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    model = fit(docs, ~held & F.col("doc_id").isNotNull())
    return predict(docs.select("doc_id", held.alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score")
