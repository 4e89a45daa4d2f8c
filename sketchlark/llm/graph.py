"""Connected components of links between 64-bit vertices, without hot groups or driver-side links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sketchlark.plans.hubs import lookup
from sketchlark.plans.scratch import remove, settle

#: Links that a task joins up at once.
TOGETHER = 1_000_000


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(vertices, the smallest vertex each is connected with) for links a-b."""
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    label = np.arange(len(names))
    while True:
        x, y = label[a], label[b]
        low, high = np.minimum(x, y), np.maximum(x, y)
        if (low == high).all():
            return names, names[label]
        np.minimum.at(label, high, low)
        while (label[label] != label).any():
            label = label[label]


def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of one task -> one link (v, root) for each vertex that isn't its task's smallest of a component.

    Links are joined up as they come, so a task holds its vertices and not its links.
    """
    v, root = np.zeros(0, np.int64), np.zeros(0, np.int64)
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    held = 0
    for batch in batches:
        parts.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        held += batch.num_rows
        if held > max(TOGETHER, len(v)):
            v, root = forest(*(np.concatenate(x) for x in zip((v, root), *parts)))
            parts, held = [], 0
    if parts:
        v, root = forest(*(np.concatenate(x) for x in zip((v, root), *parts)))
    more = v != root
    if more.any():
        yield pa.RecordBatch.from_arrays([pa.array(v[more]), pa.array(root[more])], ["v", "p"])


def components(links: DataFrame, joined: bool = False) -> DataFrame:
    """(v, root) for every vertex of ``links`` (two long columns), root being the component's smallest vertex.

    Links are joined up within each task first (``joined``: they have been, which spares a Python worker), so a vertex has one link a task at most when they are dealt by their
    larger end. Each round then lets every vertex jump to its parent's parent, looked up so that no parent's vertices
    meet in one task (see ``plans.hubs``). Ends when each vertex has one parent and no parent has one. The tables of a
    round are removed when the next one is written.
    """
    a, b = (F.col(f"`{c}`") for c in links.columns[:2])
    e = links.select(F.greatest(a, b).alias("v"), F.least(a, b).alias("p")).where("v <> p")
    e = settle((e if joined else e.mapInArrow(contract, "v long, p long")).repartition("v").mapInArrow(contract, "v long, p long"), "links")
    while True:
        low = e.groupBy("v").agg(F.min("p").alias("q"), F.count("*").alias("n"))
        times = e.groupBy("p").agg(F.count("*").alias("times"))
        parents = settle(times.join(low.withColumnRenamed("v", "w"), F.col("p") == F.col("w"), "left").select("p", "times", "q"), "parents")
        state = parents.agg(F.sum("times").alias("all"), F.count("q").alias("deep")).first()
        if not state["deep"] and not low.where("n > 1").limit(1).count():
            remove(parents)
            break
        jumped = lookup(e, parents, ["p"], "q", "times", [F.col("v")], state["all"]).select("v", F.coalesce("q", "p").alias("p"))
        # A vertex with several parents keeps them linked: its task joins them up.
        after = settle(jumped.repartition("v").mapInArrow(contract, "v long, p long"), "links")
        remove(e)
        remove(parents)
        e = after
    return e.select("v", F.col("p").alias("root")).union(e.select("p", "p").distinct())
