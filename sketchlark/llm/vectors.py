"""Operator 3: near-duplicate embeddings by counting collisions in sorted one-dimensional projections."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sketchlark.llm.graph import components, forest
from sketchlark.plans.scratch import settle

THRESHOLD, PROJECTIONS, WIDTH, RECALL, SEED = 0.93, 32, 1.5, 0.9995, 5
#: Distinct vectors that a task compares with so many others; rows whose collisions, and pairs whose cosines, it has at once.
CHUNK, ROWS, PAIRS = 2048, 512, 50_000


def needed_collisions(projections: int = PROJECTIONS, width: float = WIDTH, recall: float = RECALL) -> int:
    """The largest count that a pair at the threshold reaches with probability ``recall`` or more.

    A pair's difference has a Gaussian projection whose deviation is the pair's distance, so with a half-window of
    ``width`` times the distance at the threshold, each projection collides with probability P(|N| <= width).
    """
    p, tail = math.erf(width / math.sqrt(2)), 0.0
    for n in range(projections, 0, -1):
        tail += math.comb(projections, n) * p**n * (1 - p) ** (projections - n)
        if tail >= recall:
            return n
    return 1


def collided(px: np.ndarray, py: np.ndarray, reach: float, needed: int) -> np.ndarray:
    """(rows of px, words) bits: whether row j of py lies in the window of ``reach`` around row i of px in ``needed`` projections.

    Each projection of y is sorted, and for each place in that order the set of rows before it is kept as bits; a window
    is then two places, and its rows the exclusive-or of their sets. Windows of the projections are added up in counters
    whose bits lie in one array each, so a word adds 64 pairs at a time.
    """
    n = len(py)
    words = -(-n // 64)
    rows = np.arange(n)
    total = [np.zeros((len(px), words), np.uint64) for _ in range(int(px.shape[1]).bit_length())]
    for k in range(px.shape[1]):
        order = np.argsort(py[:, k], kind="stable")
        before = np.zeros((n + 1, words), np.uint64)
        before[rows + 1, order // 64] = np.uint64(1) << (order % 64).astype(np.uint64)
        np.bitwise_xor.accumulate(before, axis=0, out=before)
        line = py[order, k]
        carry = before[np.searchsorted(line, px[:, k] + reach, side="right")]
        carry ^= before[np.searchsorted(line, px[:, k] - reach)]
        for digit in total[: int(k + 1).bit_length()]:
            up = digit & carry
            digit ^= carry
            carry = up
    # count >= needed, from the highest digit down.
    more, same = np.zeros_like(total[0]), np.full_like(total[0], np.iinfo(np.uint64).max)
    for i in range(len(total) - 1, -1, -1):
        if needed >> i & 1:
            same &= total[i]
        else:
            more |= same & total[i]
            same &= ~total[i]
    return more | same


def linked(x: np.ndarray, y: np.ndarray, px: np.ndarray, py: np.ndarray, reach: float, needed: int, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (rows of x, rows of y) that collide often enough and have a cosine of ``threshold`` or more, in blocks of rows of x; x and y are unit vectors, px and py their projections."""
    for at in range(0, len(x), ROWS):
        bits = collided(px[at : at + ROWS], py, reach, needed)
        i, j = np.nonzero(np.unpackbits(bits.view(np.uint8), axis=1, count=len(y), bitorder="little"))
        for s in range(0, len(i), PAIRS):
            a, b = i[s : s + PAIRS] + at, j[s : s + PAIRS]
            near = np.einsum("ij,ij->i", x[a], y[b]) >= threshold
            yield a[near], b[near]


def _tiles(threshold: float, projections: int, width: float, recall: float, seed: int):
    reach, needed = width * math.sqrt(2 - 2 * threshold), needed_collisions(projections, width, recall)

    def compare(side0: list, side1: list | None) -> pa.RecordBatch:
        def unpack(rows):
            vid, many = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
            x = np.stack([r[2] for r in rows])
            return vid, many, x / np.linalg.norm(x / np.abs(x).max(axis=1, keepdims=True), axis=1, keepdims=True) / np.abs(x).max(axis=1, keepdims=True)

        vx, mx, x = unpack(side0)
        directions = np.random.Generator(np.random.PCG64(seed)).standard_normal((x.shape[1], projections))
        vy, my, y = (vx, mx, x) if side1 is None else unpack(side1)
        px, py = x @ directions, y @ directions
        nx, ny = np.zeros(len(vx), np.int64), np.zeros(len(vy), np.int64)
        name = np.concatenate([vx, vy])
        parent = np.arange(len(vx) + (0 if side1 is None else len(vy)))
        shift = 0 if side1 is None else len(vx)
        for i, j in linked(x, y, px, py, reach, needed, threshold):
            if side1 is None:
                i, j = i[i != j], j[i != j]
            nx += np.bincount(i, weights=my[j], minlength=len(vx)).astype(np.int64)
            if side1 is not None:
                ny += np.bincount(j, weights=mx[i], minlength=len(vy)).astype(np.int64)
            if len(i):
                v, root = forest(np.concatenate([i, np.arange(len(parent))]), np.concatenate([shift + j, parent]))
                parent[v] = root
        n = nx if side1 is None else np.concatenate([nx, ny])
        some = np.flatnonzero(n)
        return pa.RecordBatch.from_arrays([pa.array(name[some]), pa.array(n[some]), pa.array(name[parent[some]])], ["vid", "n", "parent"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, sides = None, ([], [])
        for batch in batches:
            cols = [batch.column(i).to_pylist() for i in range(7)]
            vectors = batch.column(7)
            flat, ends = vectors.flatten().to_numpy(), np.cumsum([len(v) for v in vectors])
            for i, (label, size, lo, hi, side, vid, many) in enumerate(zip(*cols)):
                if (label, size, lo, hi) != tile:
                    if sides[0] and (sides[1] or tile[2] == tile[3]):
                        yield compare(sides[0], sides[1] or None)
                    tile, sides = (label, size, lo, hi), ([], [])
                sides[side].append((vid, many, flat[ends[i] - size : ends[i]]))
        if sides[0] and (sides[1] or tile[2] == tile[3]):
            yield compare(sides[0], sides[1] or None)

    return run


def near_vectors(df: DataFrame, threshold: float = THRESHOLD, projections: int = PROJECTIONS, width: float = WIDTH, recall: float = RECALL, seed: int = SEED, key: str = "vec_id", vector: str = "embedding", label: str = "label", chunk: int = CHUNK) -> DataFrame:
    """key, n_links, component_id, kept for each row; rows link when labels are equal and cosine >= threshold.

    Equal vectors of a label form one class with a count first, so copies cost no pairs. The classes of a label are dealt
    into chunks of about ``chunk``; each two chunks meet in one task, which sorts both by ``projections`` random directions,
    counts for each vector the windows around its projections that hold another, and verifies the pairs with enough
    collisions by cosine in double precision. ``recall`` is the least chance to find a pair at the threshold; nearer pairs
    have a higher one. Only link counts and a spanning forest leave a task, never pairs.

    n_links counts the other rows linked directly, copies included. A vector that is null or zero, that has null or
    non-finite components, or whose label is null links with nothing; nor do vectors of different lengths. Null keys are
    passed over for component_id where others exist. kept is key = component_id (true for two nulls). Rows that share a key
    are vectors like others. An empty table gives an empty result; other columns are ignored, whatever their names.
    """
    numbers = F.transform(F.col(vector), lambda x: x.cast("double") + F.lit(0.0))
    rows = df.select(F.col(key).alias("k"), F.col(label).alias("l"), numbers.alias("x"))
    fine = F.col("l").isNotNull() & F.col("x").isNotNull() & (F.size("x") > 0)
    fine = fine & F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("x", lambda v: v != 0)
    rows = rows.withColumn("x", F.when(fine, F.col("x"))).withColumns({"h": F.when(F.col("x").isNotNull(), F.xxhash64("x")), "g": F.when(F.col("x").isNotNull(), F.xxhash64(F.lit(1), "x"))})
    by = ["l", "h", "g"]
    classes = rows.where("h is not null").groupBy(*by).agg(F.min("k").alias("low"), F.count("*").alias("many"), F.first("x").alias("x"))
    classes = settle(classes.withColumns({"vid": F.monotonically_increasing_id(), "size": F.size("x")}), "classes")
    cuts = classes.groupBy(F.col("l").alias("cl"), F.col("size").alias("cs")).agg(F.ceil(F.count("*") / chunk).cast("int").alias("cuts"))
    tiles = classes.join(cuts, (F.col("l") == F.col("cl")) & (F.col("size") == F.col("cs"))).withColumn("c", F.pmod(F.xxhash64("vid"), F.col("cuts")).cast("int"))
    tiles = tiles.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    tiles = tiles.select("l", "size", F.least("c", "other").alias("lo"), F.greatest("c", "other").alias("hi"), F.when(F.col("c") <= F.col("other"), 0).otherwise(1).alias("side"), "vid", "many", "x")
    tiles = tiles.repartition("l", "size", "lo", "hi").sortWithinPartitions("l", "size", "lo", "hi")
    found = settle(tiles.mapInArrow(_tiles(threshold, projections, width, recall, seed), "vid long, n long, parent long"), "links")
    comps = components(found.select("vid", "parent"))
    counts = found.groupBy(F.col("vid").alias("fv")).agg(F.sum("n").alias("n"))
    of = classes.join(counts, F.col("vid") == F.col("fv"), "left").join(comps, F.col("vid") == F.col("v"), "left")
    of = of.select(*by, "low", (F.coalesce("n", F.lit(0)) + F.col("many") - 1).alias("n_links"), F.coalesce("root", "vid").alias("root"))
    lows = of.groupBy(F.col("root").alias("r")).agg(F.min("low").alias("component"))
    of = of.join(lows, F.col("root") == F.col("r")).select(*(F.col(b).alias(f"_{b}") for b in by), "n_links", "component")
    same = (F.col("l") == F.col("_l")) & (F.col("h") == F.col("_h")) & (F.col("g") == F.col("_g"))
    component = F.when(F.col("n_links") > 0, F.col("component")).otherwise(F.col("k"))
    out = rows.drop("x").join(of, same, "left").select(F.col("k").alias(key), F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"))
    return out.withColumn("kept", F.col(key).eqNullSafe(F.col("component_id")))


def op3_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
