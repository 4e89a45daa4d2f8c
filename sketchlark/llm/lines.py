"""Operator 6: removal of repeated runs of lines, found by winnowing over line hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sketchlark.llm.kernel import Chunk, chunks, mix64, range_sums
from sketchlark.plans.hubs import lookup
from sketchlark.plans.names import neutral, with_fields
from sketchlark.plans.scratch import settle

MIN_WORDS = 25
_INDEX = 28
#: A worker lists the runs of so many places at once.
TOGETHER = 10_000
#: A worker cuts so many texts at once.
ROWS = 256


def line_table(c: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, words and text of each line with a word; white space around a line doesn't count."""
    c.words()
    ends = np.union1d(np.flatnonzero(c.data == 10), c.ends - 1)
    starts = np.concatenate([[0], ends[:-1] + 1])
    a, b = np.searchsorted(c.word_start, starts), np.searchsorted(c.word_start, ends)
    some = b > a
    a, b = a[some], b[some]
    doc = c.word_doc[a] if len(a) else np.zeros(0, np.int64)
    return c.hashes(c.word_start[a], c.word_end[b - 1]) if len(a) else np.zeros(0, np.uint64), b - a, doc


def winnow(line: np.ndarray, words: np.ndarray, doc: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """(line index, hash) of the selected grams.

    The gram at a line is the fewest lines from it on, within its text, that hold ``min_words`` words. The window at a
    line is the grams that start on those same lines; each window selects its gram of least hash, the first of equals.
    A run of lines with 2 * min_words - 1 words or more holds the gram that the window at its first line selects, whatever
    surrounds the run.
    """
    n = len(line)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    total = np.concatenate([[0], np.cumsum(words)])
    end = np.searchsorted(total, total[:-1] + min_words)  # the gram is lines [i, end)
    last = np.searchsorted(doc, doc, side="right")
    exists = end <= last
    at = np.flatnonzero(exists)
    gram = np.full(n + 1, np.iinfo(np.uint64).max, np.uint64)
    gram[at] = mix64(mix64(range_sums(n, lambda a, b: line[a:b], at, end[at])) + (end[at] - at).astype(np.uint64))
    index = np.arange(n + 1, dtype=np.uint64)
    packed = np.where(gram == np.iinfo(np.uint64).max, gram, (gram >> np.uint64(_INDEX) << np.uint64(_INDEX)) | index)
    if not len(at):
        return at, gram[at]
    least = np.minimum.reduceat(packed, np.stack([at, end[at]], 1).ravel())[::2]
    chosen = np.unique((least & np.uint64((1 << _INDEX) - 1)).astype(np.int64))
    return chosen, gram[chosen]


def _lines(docs: DataFrame, min_words: int, key: str, text: str) -> DataFrame:
    """k, text_hash, lines, words, at, grams for each row."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists: tuple[list, ...] = ([], [], [], [])
            for _, c in chunks(batch.column(2)):
                line, words, doc = line_table(c)
                at, gram = winnow(line, words, doc, min_words)
                first = np.searchsorted(doc, np.arange(c.n + 1))
                cut = np.searchsorted(at, first)
                for d in range(c.n):
                    own, sel = slice(first[d], first[d + 1]), slice(cut[d], cut[d + 1])
                    for out, v in zip(lists, (line[own].view(np.int64), words[own].astype(np.int32), (at[sel] - first[d]).astype(np.int32), gram[sel].view(np.int64))):
                        out.append(v)
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(x, pa.list_(t)) for x, t in zip(lists, kinds))], ["k", "text_hash", "lines", "words", "at", "grams"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("k"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("t"))
    return rows.mapInArrow(make, f"k {kind}, text_hash long, lines array<long>, words array<int>, at array<int>, grams array<long>")


def contexts(line: np.ndarray, words: np.ndarray, start: np.ndarray, stop: np.ndarray, at: np.ndarray, min_words: int) -> tuple[np.ndarray, ...]:
    """(place, low, high, name) of the runs [low, high) to compare for places ``at`` of grams in texts of lines [start, stop).

    They are the gram alone, the gram with the lines before it, one by one up to min_words - 1 words, and with those after
    it, up to 2 * min_words - 2 words. Equal names of the same gram mean equal lines at the same distance.
    """
    total = np.concatenate([[0], np.cumsum(words)])
    end = np.searchsorted(total, total[at] + min_words)

    def chain(name: np.ndarray, pos: np.ndarray, step: int, ok) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        live = np.arange(len(pos))
        while True:
            more = ok(live, pos)
            live, pos, name = live[more], pos[more], name[more]
            if not len(live):
                return
            name = mix64(name + line[pos])
            yield live, pos, name
            pos = pos + step

    own = np.full(len(at), 0x2545F4914F6CDD1D, np.uint64)
    for live, _, name in chain(own.copy(), at, 1, lambda i, p: p < end[i]):
        own[live] = name
    out = [(np.arange(len(at)), at, end, own)]
    for live, pos, name in chain(own ^ np.uint64(0x9E3779B97F4A7C15), at - 1, -1, lambda i, p: (p >= start[i]) & (total[at[i]] - total[p] < min_words)):
        out.append((live, pos, end[live], name))
    for live, pos, name in chain(own, end, 1, lambda i, p: (p < stop[i]) & (total[np.minimum(p + 1, len(line))] - total[end[i]] <= 2 * (min_words - 1))):
        out.append((live, at[live], pos + 1, name))
    return tuple(np.concatenate(x) for x in zip(*out))


def _compared(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(k, text_hash, lines, words, places, grams) -> a row for each run of ``contexts``."""
        for batch in batches:
            lines, words, places, grams = (batch.column(i) for i in range(2, 6))
            line, count = lines.flatten().to_numpy().view(np.uint64), words.flatten().to_numpy()
            first = np.concatenate([[0], np.cumsum(lines.value_lengths().to_numpy())])
            row = np.repeat(np.arange(batch.num_rows), places.value_lengths().to_numpy())
            at, gram = places.flatten().to_numpy() + first[row], grams.flatten().to_numpy()
            for i in range(0, len(at), TOGETHER):
                own = row[i : i + TOGETHER]
                a, b = first[own[0]], first[own[-1] + 1]  # the lines of these texts
                place, low, high, name = contexts(line[a:b], count[a:b], first[own] - a, first[own + 1] - a, at[i : i + TOGETHER] - a, min_words)
                take, shift = pa.array(own[place]), first[own[place]] - a
                where = (at[i : i + TOGETHER] - first[own])[place]
                numbers = (pa.array(x.astype(np.int32)) for x in (where, low - shift, high - shift))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), *numbers, pa.array(gram[i : i + TOGETHER][place]), pa.array(name.view(np.int64))], ["k", "text_hash", "at", "low", "high", "gram", "name"])

    return run


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """k, text_hash, runs: for each text with lines to delete, arrays of [low, high) over its lines with words."""
    table = settle(_lines(docs, min_words, key, text).dropDuplicates(["k", "text_hash"]), "lines")
    prints = table.select("k", "text_hash", F.explode(F.arrays_zip("at", "grams")).alias("z")).select("k", "text_hash", F.col("z.at").alias("at"), F.col("z.grams").alias("gram"))
    several = prints.groupBy(F.col("gram").alias("g")).agg(F.count("*").alias("n")).where("n > 1").select("g")
    places = prints.join(several, F.col("gram") == F.col("g"), "left_semi").groupBy("k", "text_hash").agg(F.collect_list(F.struct("at", "gram")).alias("z"))
    own = table.select(F.col("k").alias("ko"), F.col("text_hash").alias("ho"), "lines", "words")
    places = places.join(own, F.col("k").eqNullSafe(F.col("ko")) & (F.col("text_hash") == F.col("ho"))).select("k", "text_hash", "lines", "words", "z.at", "z.gram")
    kind = table.schema["k"].dataType.simpleString()
    runs = places.mapInArrow(_compared(min_words), f"k {kind}, text_hash long, at int, low int, high int, gram long, name long")
    first = runs.groupBy("gram", "name").agg(F.min(F.struct("k", "text_hash", "at")).alias("o"), F.count("*").alias("n")).where("n > 1")
    first = settle(first, "first-places")
    later = lookup(runs, first, ["gram", "name"], "o", "n", [F.col("k"), F.col("text_hash"), F.col("at")]).where(F.struct("k", "text_hash", "at") > F.col("o"))
    widest = later.groupBy("k", "text_hash", "at").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    return widest.groupBy("k", "text_hash").agg(F.collect_set(F.struct("low", "high")).alias("runs"))


def without_runs(text: str | None, runs: list[tuple[int, int]]) -> tuple[str | None, int, int]:
    """The text less those of its lines with words that are in a run; its lines with words; those deleted."""
    if text is None:
        return None, 0, 0
    gone = {i for a, b in runs for i in range(a, b)}
    kept, n, cut = [], 0, 0
    for line in text.split("\n"):
        if line.strip(" \t\n\x0b\x0c\r"):
            n += 1
            if n - 1 in gone:
                cut += 1
                continue
        kept.append(line)
    return ("\n".join(kept), n, cut) if cut else (text, n, 0)


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the later copies of repeated runs of lines deleted from the text, and n_lines and n_deleted.

    Lines are split at \\n; those without a word are left alone and don't part a run. White space around a line doesn't
    count. Places of a gram selected by winnowing (see ``winnow``) are in the order of key, text hash and line. Every run
    around a place (see ``contexts``) has a name, whose first place is the original; at every later place the run is
    deleted. A place is thus compared with all earlier ones, at a number of names bounded by min_words, and no pairs arise.

    Any run of at least 2 * min_words - 1 words that occurs earlier is found whole, whatever surrounds it and wherever
    its parts occur besides; runs of fewer than min_words words never are. For, the windows within such a run select the
    same grams in both copies: the first starts less than min_words words into the run, the next ones leave gaps of less
    than that, and fewer than 2 * min_words - 1 words follow the last. Each deleted line has an equal line earlier, so of
    every line at least one copy stays.

    Null texts stay null and empty ones empty, with 0 lines. Rows that agree in key and text are one document stored
    several times: each loses the same lines. Null keys sort first. Columns that clash with the added ones are replaced.
    """
    rows, (k, body), back = neutral(docs, key, text, without=["n_lines", "n_deleted"])
    runs = repeated_runs(rows, min_words, k, body).withColumnsRenamed({"k": "run_key", "text_hash": "run_hash"})
    where, names = rows.columns.index(body), rows.columns
    fields = with_fields(rows, "n_lines long, n_deleted long")
    rows = rows.withColumn("hash", F.xxhash64(body)).join(runs, F.col(k).eqNullSafe(F.col("run_key")) & (F.col("hash") == F.col("run_hash")), "left").select(*names, "runs")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts = [], []
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                made = [without_runs(t, [(x["low"], x["high"]) for x in r or []]) for t, r in zip(part.column(where).to_pylist(), part.column(len(names)).to_pylist())]
                texts.append(pa.array([m[0] for m in made], batch.schema.field(where).type))
                counts += [m[1:] for m in made]
            cols = batch.columns[: len(names)]
            cols[where] = pa.concat_arrays(texts) if texts else cols[where]
            yield pa.RecordBatch.from_arrays([*cols, *(pa.array([c[i] for c in counts], pa.int64()) for i in (0, 1))], [*names, "n_lines", "n_deleted"])

    return back(rows.mapInArrow(cut, fields), "n_lines", "n_deleted")


def op6_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs)
