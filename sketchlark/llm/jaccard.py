"""Operator 2: word n-gram Jaccard join with prefix trees."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sketchlark.llm.graph import components, contract, forest
from sketchlark.llm.kernel import LOWER, Chunk, chunks, grams, mix64
from sketchlark.plans.hubs import lookup
from sketchlark.plans.names import neutral
from sketchlark.plans.scratch import settle

WORDS, PERCENT = 3, 90
#: Sets that one trie holds; larger candidate blocks are cut into such chunks and joined chunk by chunk.
TRIE = 512
#: Texts looked at, and grams noted, to learn which grams are common; this decides speed, not links.
SAMPLE, COMMON = 2000, 50_000


def sets_of(c: Chunk, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed n-grams of a chunk's texts in the global order (by hash) within each text, and the first of each text."""
    c.words()
    g, doc = grams(c.hashes(c.word_start, c.word_end), c.doc_word, n, True)
    order = np.lexsort((g, doc))
    g, doc = g[order], doc[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (doc[1:] != doc[:-1])
    g, doc = g[new], doc[new]
    return g, np.searchsorted(doc, np.arange(c.n + 1))


@functools.lru_cache(maxsize=None)
def lost(percent: int, n: int) -> tuple[int, int]:
    """One more than the most members that a set of n members lacks in a set linked with it, and a bound for broken chains."""
    pairs = []
    for m in {-(-percent * n // 100), n, n * 100 // percent, min(n * 100 // percent, n + 1), max(-(-percent * n // 100), n - 1)}:
        shared = -(-percent * (n + m) // (100 + percent))
        if shared <= min(n, m):
            pairs.append((n - shared, m - shared))
    # one more for rounding between the sizes looked at
    return max(a for a, _ in pairs) + 1, max(2 * a + b for a, b in pairs) + 3


@functools.lru_cache(maxsize=None)
def needs(percent: int, size: int) -> tuple[int, int]:
    """How many single members, and how many chains, a set of ``size`` members has to emit; 0: that kind isn't needed.

    A chain is two members next to each other in the global order. A linked set lacks at most a = |A - B| of A's members
    and brings b = |B - A| others; each of the former breaks two chains at most and each of the latter one, so of n - 1
    chains at least n - 1 - 2 a - b are in common, and one of them is among the first 2 a + b + 1 by hash of either set.
    Sets so small that no chain need be in common emit members instead, the first a + 1; sets that can link with both
    such sets and larger ones emit both kinds. For a low ``percent`` no size needs chains.
    """

    def chained_enough(n: int) -> bool:
        return n - 1 - lost(percent, n)[1] >= 1

    if size < -(-percent // (100 - percent)):
        return 0, 0
    least = next((n for n in range(1, 400) if all(map(chained_enough, range(n, 2 * n + 50)))), None)
    a, broken = lost(percent, size)
    singles = min(size, a + 1) if least is None or percent * size < 100 * least else 0
    return singles, min(size - 1, broken + 1) if least is not None and size >= least else 0


def summed(x: np.ndarray) -> np.ndarray:
    """Running sums before each value, and the whole; sums wrap around."""
    out = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(x, out=out[1:])
    return out


def common_members(docs: DataFrame, n: int, text: str) -> np.ndarray:
    """Hashed grams that several of about SAMPLE distinct texts have, sorted; the COMMON most frequent at most.

    They only come last in the order in which signatures are chosen. Any order gives the same links; this one keeps
    passages that many texts share from making candidates.
    """
    total = max(1, docs.count())
    some = docs.where(F.col(text).isNotNull() & ((F.pmod(F.xxhash64(text), F.lit(1 << 30)) + 0.5) / (1 << 30) * total < SAMPLE)).select(F.col(text).alias("t")).distinct()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, c in chunks(batch.column(0), LOWER):
                yield pa.RecordBatch.from_arrays([pa.array(sets_of(c, n)[0].view(np.int64))], ["h"])

    found = some.mapInArrow(read, "h long").groupBy("h").agg(F.count("*").alias("n")).where("n > 2").orderBy(F.desc("n"), "h").limit(COMMON)
    return np.sort(np.array([r["h"] for r in found.collect()], np.int64).view(np.uint64))


def signatures(g: np.ndarray, first: np.ndarray, percent: int, common: np.ndarray | None = None) -> list[np.ndarray]:
    """Per text, hashes of members and chains (see ``needs``) of which any two linked texts have one in common.

    They are those that come first in one order for all texts: by hash, those of ``common`` members after the others.
    """
    rare = np.ones(len(g), bool)
    if common is not None and len(common):
        rare = common[np.minimum(np.searchsorted(common, g), len(common) - 1)] != g
    single = mix64(g ^ np.uint64(0x5851F42D4C957F2D))
    chain = mix64(mix64(g[:-1] + np.uint64(0xD6E8FEB86659FD93)) + g[1:]) if len(g) else g
    top = np.uint64(1 << 63)
    late1, late2 = np.where(rare, np.uint64(0), top), np.where(rare[:-1] & rare[1:], np.uint64(0), top)
    single, chain = single >> np.uint64(1) | late1, chain >> np.uint64(1) | late2
    out = []
    for a, b in zip(first[:-1], first[1:]):
        n1, n2 = needs(percent, int(b - a))
        own = []
        if n1:
            own.append(np.sort(single[a:b])[:n1])
        if n2:
            c = chain[a : b - 1]
            own.append(np.partition(c, n2 - 1)[:n2] if n2 < len(c) else c)
        out.append(np.concatenate(own).view(np.int64) if own else np.zeros(0, np.int64))
    return out


def hashed_sets(docs: DataFrame, n: int, percent: int, key: str, text: str, common: np.ndarray | None = None) -> DataFrame:
    """k, text_hash, n_shingles, set_a, set_b (a 128-bit name of the set) and sigs for each row.

    A set that a task meets again has no sigs there, so that copies don't pile up on theirs.
    """

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            size, names, sigs = [], [], []
            for _, c in chunks(batch.column(2), LOWER):
                g, first = sets_of(c, n)
                size.append(np.diff(first))
                for salt in (1, 2):
                    s = summed(mix64(g + np.uint64(salt)))
                    names.append((s[first[1:]] - s[first[:-1]]).view(np.int64))
                new = np.array([not (x in seen or seen.add(x)) for x in names[-2].tolist()], bool)
                keep = np.repeat(new, np.diff(first))
                ends = np.concatenate([[0], np.cumsum(np.where(new, np.diff(first), 0))])
                sigs += signatures(g[keep], ends, percent, common)
            if size:
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.concatenate(size)), pa.array(np.concatenate(names[0::2])), pa.array(np.concatenate(names[1::2])), pa.array(sigs, pa.list_(pa.int64()))], ["k", "text_hash", "n_shingles", "set_a", "set_b", "sigs"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("k"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("t"))
    return rows.mapInArrow(make, f"k {kind}, text_hash long, n_shingles long, set_a long, set_b long, sigs array<long>")


def _neighbours(percent: int, sig: np.ndarray, size: np.ndarray, vid: np.ndarray) -> np.ndarray:
    """Which rows, in the order of (sig, size, vid), are linked with the row before: same sig, other set, sizes that allow it.

    All sizes between two that allow a link do so too, so linked sets stay connected.
    """
    return (sig[1:] == sig[:-1]) & (vid[1:] != vid[:-1]) & (100 * size[:-1] >= percent * size[1:])


def _chained(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Ordered (sig, size, vid) rows of a range -> links (v, p) of neighbours, joined up per task, with null sig; and
        the range's first and last row."""
        ends: list[tuple] = []

        def links() -> Iterator[pa.RecordBatch]:
            last = None
            for batch in batches:
                cols = [batch.column(i).to_numpy() for i in range(3)]
                if not len(cols[0]):
                    continue
                ends[1:] = [tuple(int(c[-1]) for c in cols)]
                if last is None:
                    ends.insert(0, tuple(int(c[0]) for c in cols))
                else:
                    cols = [np.concatenate([a, b]) for a, b in zip(last, cols)]
                last = [c[-1:] for c in cols]
                same = _neighbours(percent, *cols)
                pair = np.unique(np.stack([cols[2][1:][same], cols[2][:-1][same]], 1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], ["v", "p"])

        for out in contract(links()):
            none = pa.nulls(out.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays([*out.columns, none, none], ["v", "p", "sig", "size"])
        if ends:
            sig, size, vid = zip(*ends)
            yield pa.RecordBatch.from_arrays([pa.array(vid), pa.nulls(len(ends), pa.int64()), pa.array(sig), pa.array(size)], ["v", "p", "sig", "size"])

    return run


def candidate_links(sig: DataFrame, percent: int) -> DataFrame:
    """(v, p): links that connect all sets with a signature in common whose sizes allow a link; ``sig`` is (sig, size, vid).

    Rows are dealt by ranges of (sig, size, vid), so that a signature of any number of sets spans as many tasks as it
    needs. Two rows a range, its ends, come to the driver to join up neighbours in different ranges.
    """
    ranged = sig.repartitionByRange("sig", "size", "vid").sortWithinPartitions("sig", "size", "vid")
    found = settle(ranged.mapInArrow(_chained(percent), "v long, p long, sig long, size long"), "chains")
    ends = sorted((r["sig"], r["size"], r["v"]) for r in found.where("sig is not null").collect())
    across = []
    if ends:
        cols = [np.array(c, np.int64) for c in zip(*ends)]
        same = _neighbours(percent, *cols)
        across = list(zip(cols[2][1:][same].tolist(), cols[2][:-1][same].tolist()))
    return found.where("sig is null").select("v", "p").union(sig.sparkSession.createDataFrame(across, "v long, p long"))


class _Node:
    __slots__ = ("ends", "high", "kids", "longest", "low", "segment", "shortest", "top")


def build(seqs: list[np.ndarray]) -> _Node:
    """A compressed prefix tree over increasing sequences, which must be sorted; node.low..high are the sequences below it."""
    size = [len(s) for s in seqs]

    def common(a: np.ndarray, b: np.ndarray) -> int:
        n = min(len(a), len(b))
        differ = np.flatnonzero(a[:n] != b[:n])
        return int(differ[0]) if len(differ) else n

    shared = [common(a, b) for a, b in zip(seqs, seqs[1:])]
    root, todo = None, [(0, len(seqs), 0, None)]
    while todo:
        low, high, depth, parent = todo.pop()
        node = _Node()
        top = min(shared[low : high - 1], default=size[low])
        top = 0 if parent is None else top
        node.low, node.high, node.top, node.segment, node.kids = low, high, top, seqs[low][depth:top], []
        node.shortest, node.longest = min(size[low:high]), max(size[low:high])
        node.ends = next((i for i in range(low, high) if size[i] > top), high)
        if parent is None:
            root = node
        else:
            parent.kids.append(node)
        at = node.ends
        while at < high:
            end = at + 1
            while end < high and shared[end - 1] > top:
                end += 1
            todo.append((at, end, top, node))
            at = end
    return root


def trie_links(stored: list[tuple[int, np.ndarray]], asked: list[tuple[int, np.ndarray]] | None, percent: int) -> list[tuple[int, int]]:
    """Links (vid, vid) that connect whatever sets with 100 * intersection >= percent * union connect, and no others.

    ``asked`` None: among the stored ones. A subtree is left when the overlap so far, plus what the query and the
    subtree's sets can still share by their remaining lengths, is too small; or when all its sets are connected with
    the query already.
    """
    every = np.unique(np.concatenate([s for _, s in stored + (asked or [])]))
    local = lambda s: np.searchsorted(every, s)
    stored = sorted(((v, local(s)) for v, s in stored), key=lambda x: x[1].astype(">u4").tobytes())
    root = build([s for _, s in stored])
    vids = [v for v, _ in stored]
    queries = [(v, s, i) for i, (v, s) in enumerate(stored)] if asked is None else [(v, local(s), None) for v, s in asked]
    group = np.arange(len(stored) + (len(queries) if asked is not None else 0))
    out, mask = [], np.zeros(len(every) + 1, bool)
    for k, (vid, q, own) in enumerate(queries):
        mine = own if own is not None else len(stored) + k
        mask[:] = False
        mask[q] = True
        so_far = np.concatenate([[0], np.cumsum(mask)])
        n, todo = len(q), [(root, 0)]
        while todo:
            node, overlap = todo.pop()
            below = group[node.low : node.high]
            if (below == group[mine]).all():
                continue
            if len(node.segment):
                overlap += int(np.count_nonzero(mask[node.segment]))
                left = n - int(so_far[node.segment[-1] + 1])
            else:
                left = n
            most = min(max(node.top + left, node.shortest), node.longest)
            if (100 + percent) * (overlap + min(left, most - node.top)) < percent * (n + most):
                continue
            for i in range(node.low, node.ends):
                if group[i] != group[mine] and (100 + percent) * overlap >= percent * (n + node.top):
                    out.append((vid, vids[i]))
                    a, b = sorted((group[i], group[mine]))
                    group[group == b] = a
            todo += [(kid, overlap) for kid in node.kids]
    return out


def parted(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """A label for each of ``sets``; linked sets have the same one.

    Of each set the members that come first when those of the fewest sets here do, one more than a linked set may lack,
    are kept: two linked sets have one of them in common. What many of the sets share comes last, so that sets which met
    by a common passage part again, by one sort of all members instead of a comparison of each two.
    """
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    of = np.repeat(np.arange(len(sets)), size)
    _, at, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    order = np.lexsort((at, times[at], of))
    first = np.fromiter((lost(percent, n)[0] + 1 for n in size.tolist()), np.int64, len(sets))
    early = np.arange(len(order)) - np.repeat(np.cumsum(size) - size, size) < first[of]
    at, of = at[order][early], of[early]
    order = np.lexsort((of, size[of], at))
    at, of = at[order], of[order]
    near = _neighbours(percent, at, size[of], of)
    label = np.arange(len(sets))
    if near.any():
        some, low = forest(of[1:][near], of[:-1][near])
        label[some] = low
    return label


def tile_links(stored: list[tuple[int, np.ndarray]], asked: list[tuple[int, np.ndarray]] | None, percent: int) -> list[tuple[int, int]]:
    """``trie_links`` of a tile, with a tree for each part of it that may hold links (see ``parted``)."""
    if len(stored) + len(asked or []) <= 2:
        return trie_links(stored, asked, percent)
    sides: dict[int, tuple[list, list]] = {}
    for i, label in enumerate(parted([s for _, s in stored + (asked or [])], percent).tolist()):
        late = i >= len(stored)
        sides.setdefault(label, ([], []))[late].append(asked[i - len(stored)] if late else stored[i])
    out = []
    for mine, others in sides.values():
        if len(mine) > 1 if asked is None else mine and others:
            out += trie_links(mine, None if asked is None else others, percent)
    return out


def _joined(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (the five parts of a tile, side, vid, set) sorted by tile -> links, joined up per task."""
        yield from contract(links(batches))

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, sides, found = None, {}, []

        def finish() -> None:
            if tile is not None:
                stored, asked = list(sides.get(0, {}).items()), list(sides.get(1, {}).items())
                alone = tile[1:3] == tile[3:5]
                if stored and (asked or alone):
                    found.extend(tile_links(stored, None if alone else asked, percent))

        def taken() -> Iterator[pa.RecordBatch]:
            if found:
                a, b = map(np.array, zip(*found))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["v", "p"])
                found.clear()

        for batch in batches:
            cols = [batch.column(i).to_pylist() for i in range(7)]
            for *at, side, vid, raw in zip(*cols, batch.column(7)):
                if at != tile:
                    finish()
                    tile, sides = at, {}
                sides.setdefault(side, {})[vid] = np.frombuffer(raw.as_buffer(), np.uint64)
            yield from taken()
        finish()
        yield from taken()

    return run


def tiled(members: DataFrame, percent: int, trie: int = TRIE) -> DataFrame:
    """(vid, root, cell, c, tiles) of members (vid, root, size, many): the tiles (x, lo, y, hi, side) in which a set meets others.

    A block of at most ``trie`` sets is one tile. A larger one (many) is parted into cells by the logarithm of the sets'
    sizes, of which linked sets share one or have neighbouring ones, and each cell into chunks of about ``trie`` sets;
    each two chunks of a cell meet in a tile, and each chunk meets those of the next cell.
    """
    step = np.log(100 / percent) * (1 + 1e-9) if percent < 100 else None
    cell = F.floor(F.log(F.col("size")) / step) if step else F.col("size")
    members = members.withColumn("cell", F.when(F.col("many") > trie, cell).otherwise(0).cast("long"))
    cells = members.groupBy("root", "cell").agg(F.count("*").alias("n")).withColumn("cuts", F.ceil(F.col("n") / trie).cast("int"))
    order = Window.partitionBy("root").orderBy("cell")
    near = lambda f, d: F.when(f("cell").over(order) == F.col("cell") + d, f("cuts").over(order)).otherwise(0)
    cells = settle(cells.select("root", "cell", "n", F.struct("cuts", near(F.lag, -1).alias("below"), near(F.lead, 1).alias("above")).alias("near")), "cells")
    rows = lookup(members, cells, ["root", "cell"], "near", "n", [F.col("vid")]).select("vid", "root", F.col("cell").cast("int").alias("cell"), "near.*").withColumn("c", F.pmod(F.xxhash64("vid"), F.col("cuts")).cast("int"))
    to = lambda n: F.when(F.col(n) > 0, F.sequence(F.lit(0), F.col(n) - 1)).otherwise(F.array().cast("array<int>"))
    tile = lambda x, lo, y, hi, side: F.struct(x.alias("x"), lo.alias("lo"), y.alias("y"), hi.alias("hi"), side.alias("side"))
    x, c, one, two = F.col("cell"), F.col("c"), F.lit(0), F.lit(1)
    own = F.transform(to("cuts"), lambda o: tile(x, F.least(c, o), x, F.greatest(c, o), F.when(c <= o, one).otherwise(two)))
    up = F.transform(to("above"), lambda o: tile(x, c, x + 1, o, one))
    down = F.transform(to("below"), lambda o: tile(x - 1, o, x, c, two))
    return rows.select("vid", "root", F.concat(own, up, down).alias("tiles"))


def near_groups(docs: DataFrame, n: int = WORDS, percent: int = PERCENT, key: str = "doc_id", text: str = "text", trie: int = TRIE) -> DataFrame:
    """key, text_hash, n_shingles, component_id, component_set for each row: groups by Jaccard links of word n-gram sets.

    Words are runs of bytes other than space and x09-x0D, A-Z lower-cased; a text of fewer than n words has its whole
    sequence as one gram. Rows link when 100 * intersection >= percent * union; component_id is the smallest key
    reachable by links. Null or blank texts have no set and no link: their own key is their component_id. A null key is
    passed over for component_id unless a component has no other. Rows of the same set form one class before anything
    is compared, so copies cost no pairs, and repeated rows share their class. Components may share a component_id, where
    keys are null or repeated; component_set names the component by one of its sets, and is null for rows without a set.

    Classes with a common signature (see ``signatures``: every link has one) form candidate blocks; only blocks of two
    or more fetch their sets. Classes are named by 64-bit hashes, whose chance to clash among 10^9 is about 1 in 40. A
    block of more than ``trie`` classes is cut into chunks by size (see ``tiled``). A task parts two chunks by their rarest
    members (see ``parted``); of each part it stores one chunk's sets in a prefix tree in the global order and looks the
    other's up in it. An empty table gives an empty result.
    """
    base = settle(hashed_sets(docs, n, percent, key, text, common_members(docs, n, text)), "sets")
    sig = base.where("size(sigs) > 0").select(F.explode("sigs").alias("sig"), F.col("n_shingles").alias("size"), F.col("set_a").alias("vid"))
    blocks = settle(components(candidate_links(sig, percent), joined=True), "blocks")

    sets = base.where("n_shingles > 0").groupBy(F.col("set_a").alias("vid"), "set_b").agg(F.min("k").alias("low"), F.min(F.struct("k", "text_hash")).alias("rep"), F.first("n_shingles").alias("size"), F.count("*").alias("rows"))
    classes = settle(sets, "classes")
    counts = settle(blocks.groupBy("root").agg(F.count("*").alias("many")), "counts")
    members = lookup(blocks, counts, ["root"], "many", "many", [F.col("v")]).join(classes, F.col("v") == F.col("vid")).select("vid", "root", "size", "many")
    wanted = tiled(members, percent, trie).join(classes.select(F.col("vid").alias("w"), "rep"), F.col("vid") == F.col("w")).select("vid", "root", "tiles", F.col("rep.k").alias("_k"), F.col("rep.text_hash").alias("_h"))
    texts = docs.select(F.col(key).alias("_key"), F.xxhash64(text).alias("_hash"), F.col(text).alias("t"))
    found = texts.join(wanted, F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_hash") == F.col("_h")))
    found = found.groupBy("vid").agg(F.first("root").alias("root"), F.first("tiles").alias("tiles"), F.first("t").alias("t"))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = []
            for _, c in chunks(batch.column(3), LOWER):
                g, first = sets_of(c, n)
                raw += [g[a:b].tobytes() for a, b in zip(first[:-1], first[1:])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(raw, pa.binary())], ["vid", "root", "tiles", "raw"])

    kind = "array<struct<x:int,lo:int,y:int,hi:int,side:int>>"
    found = found.select("vid", "root", F.col("tiles").cast(kind).alias("tiles"), "t").mapInArrow(fetch, f"vid long, root long, tiles {kind}, raw binary")
    tiles = found.select("root", F.explode("tiles").alias("z"), "vid", "raw").select("root", "z.x", "z.lo", "z.y", "z.hi", "z.side", "vid", "raw")
    tiles = tiles.repartition("root", "x", "lo", "y", "hi").sortWithinPartitions("root", "x", "lo", "y", "hi")
    comps = settle(components(tiles.mapInArrow(_joined(percent), "v long, p long"), joined=True), "groups")

    # Rows of one set, and classes of one component, may be a large share of all: neither meets in one task.
    of = classes.join(comps, F.col("vid") == F.col("v"), "left").select("vid", "set_b", "low", "rows", F.coalesce("root", "vid").alias("root"))
    of = settle(of, "classes-in-groups")
    lows = settle(of.groupBy("root").agg(F.min("low").alias("component"), F.count("*").alias("n")), "lows")
    of = lookup(of, lows, ["root"], "component", "n", [F.col("vid")])
    of = settle(of.select(F.col("vid").alias("set_a"), "set_b", "rows", F.struct("component", F.col("root").alias("component_set")).alias("group")), "groups-of-sets")
    full = lookup(base.where("n_shingles > 0").drop("sigs"), of, ["set_a", "set_b"], "group", "rows", [F.col("k"), F.col("text_hash")])
    full = full.select(F.col("k").alias(key), "text_hash", "n_shingles", F.col("group.component").alias("component_id"), F.col("group.component_set").alias("component_set"))
    blank = base.where("n_shingles = 0").select(F.col("k").alias(key), "text_hash", "n_shingles", F.col("k").alias("component_id"), F.lit(None).cast("long").alias("component_set"))
    return full.union(blank)


def one_of_each(docs: DataFrame, n: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each group of ``near_groups``: of the rows with the group's smallest key, the one first by
    the text's hash, and of repeated rows any one. A null key is passed over unless a group has no other; groups of the
    same smallest key each keep a row. Rows without a set are all kept.
    """
    rows, (k, body), back = neutral(docs, key, text)
    groups = near_groups(rows, n, percent, k, body).where("n_shingles > 0")
    first = groups.groupBy("component_set").agg(F.min(F.struct(F.col(k).isNull().alias("none"), F.col(k).alias("key"), "text_hash")).alias("f"))
    kept = first.select(F.col("f.key").alias("kept_key"), F.col("f.text_hash").alias("kept_hash"))
    blank = F.coalesce(~F.col(body).rlike(r"[^\x20\x09-\x0D]"), F.lit(True))
    rows = rows.withColumn("hash", F.xxhash64(body))
    full = rows.where(~blank).join(kept, F.col(k).eqNullSafe(F.col("kept_key")) & (F.col("hash") == F.col("kept_hash"))).select(rows.columns)
    return back(full.dropDuplicates([k, "hash"]).union(rows.where(blank)))


def op2_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("text_hash", "component_set")
