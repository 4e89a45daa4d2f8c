"""What the best windows would be where simulated reads come from."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sketchlark.functions.sequences import overlap_ratio, truth
from sketchlark.operators import mapping
from sketchlark.operators.sketch import kmers, sketch
from sketchlark.params import Params
from sketchlark.plans.scratch import settle

SIDES = {"left": -1, "own": 0, "next": 1}
_NOTHING = (None, None, 0, 0, -1.0)
#: Letters of reads that a task looks at together; letters of a segment's reads beyond which they are dealt to several tasks.
TOGETHER, MANY = 1 << 20, 1 << 28
#: More than any position; parts the numbers of segments or windows from positions in one key.
_FAR = 1 << 40


def hits_before(h: np.ndarray, occs: np.ndarray) -> np.ndarray:
    """For each hit the place of the hit of the same k-mer that comes occs earlier, or -1.

    A window that starts after that place counts the hit: it holds fewer than occs earlier ones of the k-mer.
    """
    order = np.lexsort((np.arange(len(h)), h))
    back = np.arange(len(h)) - occs[order]
    same = (back >= 0) & (h[order][np.maximum(back, 0)] == h[order])
    out = np.full(len(h), -1)
    out[order] = np.where(same, order[np.maximum(back, 0)], -1)
    return out


def window_sums(before: np.ndarray, last: np.ndarray, value: np.ndarray) -> np.ndarray:
    """For each hit i the sum of ``value`` over the counted hits of the window i .. last[i]; last must not decrease.

    Hit j is counted by the windows from i = max(before[j] + 1, the first i with last[i] >= j) to j, so it adds its value
    where these begin and takes it off where they end.
    """
    n = len(last)
    j = np.arange(n)
    low = np.maximum(before + 1, np.searchsorted(last, j))
    change = np.zeros(n + 1, np.int64)
    some = low <= j
    np.add.at(change, low[some], value[some])
    np.add.at(change, j[some] + 1, -value[some])
    return np.cumsum(change)[:n]


def best_window(hits: dict[str, np.ndarray], ends: list[np.ndarray], m: int, use_jaccard: bool) -> tuple:
    """(T_l, T_r, shared, strands, score) of the first best of the windows from each hit i to ends[k][i], for every k.

    A window's shared k-mers are its hits, of each k-mer at most the read's own number (the first ones); strands is the
    sum of those hits' codirections. The score is shared / m, or over the union with the window's span of sketch
    positions. An end before its start is no window. Ties go to the first start, then to the first k.
    """
    n = len(hits["h"])
    if not n:
        return _NOTHING
    before, place = hits_before(hits["h"], hits["occs"]), np.arange(n)
    scores, parts = [], []
    for last in ends:
        shared, strands = window_sums(before, last, np.ones(n, np.int64)), window_sums(before, last, hits["codir"])
        size = hits["tpos"][np.maximum(last, place)] - hits["tpos"] + 1
        scores.append(np.where(last >= place, shared / (m + size - shared if use_jaccard else m), -1.0))
        parts.append((last, shared, strands))
    table = np.stack(scores, 1)
    i, k = divmod(int(np.argmax(table)), len(ends))
    if table[i, k] < 0:
        return _NOTHING
    last, shared, strands = parts[k]
    return int(hits["r"][i]), int(hits["r"][last[i]]), int(shared[i]), int(strands[i]), float(table[i, k])


def best_by_letters(hits: dict[str, np.ndarray], letters: int, m: int, use_jaccard: bool = False) -> tuple:
    """The best of the windows from a hit to the last one whose r lies within ``letters`` of its own."""
    return best_window(hits, [np.searchsorted(hits["r"], hits["r"] + letters, side="right") - 1], m, use_jaccard)


def best_by_span(hits: dict[str, np.ndarray], least: int, most: int, m: int) -> tuple:
    """By Jaccard, the best of the windows from a hit to one whose tpos is more than ``least`` and at most ``most`` beyond its
    own, or to the last one that is at most ``least`` beyond it.
    """
    x = hits["tpos"]
    near, far = (np.searchsorted(x, x + d, side="right") - 1 for d in (least, most))
    many = int((far - near).max(initial=0)) + 1
    return best_window(hits, [np.minimum(near + k, far) for k in range(many)], m, True)


def columns_of(hits: pa.StructArray | None) -> dict[str, np.ndarray]:
    """A bucket's hits (tpos, r, h, occs, codir), sorted by tpos, as arrays."""
    names = ("tpos", "r", "h", "occs", "codir")
    if hits is None:
        return {n: np.zeros(0, np.int64) for n in names}
    return {n: hits.field(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in names}


def sketch_places(points: DataFrame, ref: DataFrame, segment: str = "segm_id") -> DataFrame:
    """``points`` (segment, pos, ...) with ``at``: the sampled k-mers of the segment that end before pos.

    One sort per segment of its k-mers and points together.
    """
    own = [c for c in points.columns if c not in (segment, "pos")]
    marks = ref.select(segment, F.col("r").cast("long").alias("pos"), F.lit(1).alias("_kind"), (F.col("tpos") + 1).alias("_t"), *(F.lit(None).cast(points.schema[c].dataType).alias(c) for c in own))
    asked = points.select(segment, F.col("pos").cast("long").alias("pos"), F.lit(0).alias("_kind"), F.lit(None).cast("int").alias("_t"), *own)
    order = Window.partitionBy(segment).orderBy("pos", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    found = marks.unionByName(asked).withColumn("at", F.coalesce(F.max("_t").over(order), F.lit(0)))
    return found.where("_kind = 0").drop("_kind", "_t")


def origin_windows(ordered: DataFrame, sizes: DataFrame, ref: DataFrame, names: DataFrame, key: str = "query_id", segment: str = "segm_id") -> DataFrame:
    """(key, segment, side, b, hits, and the best windows C_* by containment and J_* by Jaccard) of each read with a true origin.

    ``ordered`` are the reads' seeds, ``sizes`` (key, P_sz), ``names`` (segment, segm_name). ``side`` is the bucket of m
    sketch positions before the origin's start, the one it lies in, and the next; the one before bucket 0 is bucket 0. A
    read whose name holds no truth or an unknown segment, or without seeds, has no row; a bucket without hits has score -1
    and null positions. A bucket's hits are at most twice the read's sketch.
    """
    known = sizes.withColumn("_t", truth(key)).where("_t is not null").join(names.select(segment, F.col("segm_name").alias("_name")), F.col("_t.segment") == F.col("_name"))
    ends = F.explode(F.array(F.struct(F.lit(0).alias("end"), F.col("_t.start").alias("pos")), F.struct(F.lit(1).alias("end"), F.col("_t.end").alias("pos"))))
    points = known.select(segment, key, "P_sz", ends.alias("e")).select(segment, key, "P_sz", "e.end", "e.pos")
    placed = sketch_places(points, ref, segment).groupBy(key, segment, "P_sz").agg(F.max(F.when(F.col("end") == 0, F.col("at"))).alias("start"), F.max(F.when(F.col("end") == 1, F.col("at"))).alias("stop"))
    m = ordered.select(key, "m").distinct()
    sides = F.explode(F.array(*(F.struct(F.lit(k).alias("side"), F.lit(v).alias("step")) for k, v in SIDES.items())))
    buckets = placed.join(m, key).withColumn("x", sides)
    buckets = buckets.select(key, segment, "P_sz", "start", "stop", "m", "x.side", F.greatest(F.lit(0), F.floor(F.col("start") / F.col("m")) + F.col("x.step")).cast("int").alias("b"))
    slim = ordered.where("hits > 0").select(key, "h", F.col("strand").alias("q_strand"), "occs")
    near = slim.join(placed.select(key, segment), key).join(ref, ["h", segment])
    codir = F.when(F.col("q_strand") == F.col("strand"), 1).otherwise(-1)
    inside = near.join(buckets.select(key, segment, "side", "b", "m"), [key, segment]).where((F.col("tpos") >= F.col("b") * F.col("m")) & (F.col("tpos") < (F.col("b") + 2) * F.col("m")))
    lists = inside.groupBy(key, segment, "side").agg(F.sort_array(F.collect_list(F.struct("tpos", "r", "h", "occs", codir.alias("codir")))).alias("hits"))
    rows = buckets.join(lists, [key, segment, "side"], "left")
    plain = [key, segment, "side", "b", "P_sz", "start", "stop", "m"]
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    made = [f"{k}_{c}" for k in "CJ" for c in ("l", "r", "shared", "strands", "score")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for i, (letters, start, stop, m) in enumerate(zip(*(batch.column(i).to_pylist() for i in (4, 5, 6, 7)))):
                hits = columns_of(batch.column(8)[i].values)
                found.append((*best_by_letters(hits, letters, m), *best_by_span(hits, stop - start - 2, stop - start + 2, m)))
            cols = [pa.array([f[i] for f in found], pa.float64() if i % 5 == 4 else pa.int32()) for i in range(10)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], *cols], [*plain[:4], *made])

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in plain[:4]) + ", " + ", ".join(f"{c} {'double' if c.endswith('score') else 'int'}" for c in made)
    return rows.select(*plain, "hits").mapInArrow(run, schema)


def _sketches(seqs: list[bytes], k: int, ratio: float) -> tuple[np.ndarray, ...]:
    """(which of seqs, r, h) of all sampled k-mers of ``seqs``, in order."""
    size = np.array([len(x) + 1 for x in seqs], np.int64)
    start = np.cumsum(size) - size
    r, h, _ = kmers(b"N".join([*seqs, b""]), k, ratio)
    of = np.searchsorted(start, r, side="right") - 1
    return of, r - start[of], h


def _spread(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which range, index) of all indices of the ranges low .. high - 1."""
    size = np.maximum(high - low, 0)
    of = np.repeat(np.arange(len(size)), size)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size) + low[of]


def best_of_each(win: np.ndarray, r: np.ndarray, h: np.ndarray, occs: np.ndarray, letters: np.ndarray) -> tuple[np.ndarray, ...]:
    """(win, r of the first hit, shared) of the first best window by ``letters`` of each ``win``, of hits sorted by (win, r).

    The same as ``best_by_letters`` for each by itself; ``h`` are small numbers of k-mers.
    """
    n, place = len(win), np.arange(len(win))
    same_kmer = win * (int(h.max(initial=0)) + 1) + h
    order = np.argsort(same_kmer, kind="stable")
    back = place - occs[order]
    same = (back >= 0) & (same_kmer[order][np.maximum(back, 0)] == same_kmer[order])
    before = np.full(n, -1)
    before[order] = np.where(same, order[np.maximum(back, 0)], -1)
    last = np.searchsorted(win * _FAR + r, win * _FAR + np.minimum(r + letters, _FAR - 1), side="right") - 1
    low = np.maximum(before + 1, np.searchsorted(last, place))
    some = low <= place
    shared = np.cumsum(np.bincount(low[some], minlength=n + 1) - np.bincount(place[some] + 1, minlength=n + 1))[:n]
    names, first = np.unique(win, return_index=True)
    best = np.flatnonzero(shared == np.repeat(np.maximum.reduceat(shared, first), np.diff(np.append(first, n)))) if n else place
    best = best[np.searchsorted(win[best], names)]
    return names, r[best], shared[best]


def _held(segs: list[tuple], own: list[tuple], p: Params) -> list[tuple]:
    """Rows (key, segment, side, b, C_l, C_shared, C_score) of reads (group, key, start, letters) on segments (group, segment)."""
    s_of = {x: i for i, x in enumerate(dict.fromkeys((g, name) for g, name, _ in segs))}
    q_of = {x: i for i, x in enumerate(dict.fromkeys((g, key) for g, key, *_ in own))}
    of, r, h = _sketches([x[2] for x in segs], p.k, p.ratio)
    tpos = np.arange(len(of)) - np.searchsorted(of, of)
    s = np.array([s_of[x[:2]] for x in segs], np.int64)[of]
    if len(s_of) < len(segs):  # rows of one segment
        order = np.lexsort((h, r, tpos, s))
        s, tpos, r, h = s[order], tpos[order], r[order], h[order]
    of, _, own_h = _sketches([x[4] for x in own], p.k, p.ratio)
    q = np.array([q_of[x[:2]] for x in own], np.int64)[of]
    m = np.bincount(q, minlength=len(q_of))
    order = np.lexsort((own_h, q))
    q, own_h = q[order], own_h[order]
    new = np.flatnonzero(np.concatenate([[True], (q[1:] != q[:-1]) | (own_h[1:] != own_h[:-1])])) if len(q) else q
    occs, q, own_h = np.diff(np.append(new, len(q))), q[new], own_h[new]
    names = np.unique(own_h)
    wide = len(names) + 1
    seed = q * wide + np.searchsorted(names, own_h)
    kmer = np.searchsorted(names, h)
    kmer = np.where(names[np.minimum(kmer, len(names) - 1)] == h, kmer, wide - 1) if len(names) else np.zeros(len(h), np.int64)

    on = {}
    for (g, name), i in s_of.items():
        on.setdefault(g, []).append((i, name))
    asked = [(key, name, q_of[g, key], i, start, letters) for g, key, start, letters in dict.fromkeys(x[:4] for x in own) if m[q_of[g, key]] for i, name in on.get(g, [])]
    if not asked:
        return []
    w_q, w_s, start, letters = (np.repeat(np.array(x, np.int64), len(SIDES)) for x in list(zip(*asked))[2:])
    by_r, by_t = np.sort(s * _FAR + r), s * _FAR + tpos
    places = np.searchsorted(by_r, w_s * _FAR + np.clip(start, 0, _FAR - 1)) - np.searchsorted(by_r, w_s * _FAR)
    b = np.maximum(0, places // m[w_q] + np.tile(list(SIDES.values()), len(asked)))
    ends = [np.searchsorted(by_t, w_s * _FAR + np.minimum(x * m[w_q], _FAR - 1)) for x in (b, b + 2)]
    win, i = _spread(*ends)
    want = w_q[win] * wide + kmer[i]
    found = np.searchsorted(seed, want)
    hit = seed[np.minimum(found, len(seed) - 1)] == want
    win, i, found = win[hit], i[hit], found[hit]
    if len(s_of) < len(segs):
        order = np.lexsort((tpos[i], r[i], win))
        win, i, found = win[order], i[order], found[order]
    left, shared, score = np.full(len(b), -1), np.zeros(len(b), np.int64), np.full(len(b), -1.0)
    best, left_r, most = best_of_each(win, r[i], kmer[i], occs[found], letters[win])
    left[best], shared[best], score[best] = left_r, most, most / m[w_q[best]]
    each = [(key, name, side) for key, name, *_ in asked for side in SIDES]
    return [(*x, bb, None if c < 0 else ll, n, c) for x, bb, ll, n, c in zip(each, b.tolist(), left.tolist(), shared.tolist(), score.tolist())]


def containment_at_origin(reads: DataFrame, segments: DataFrame, params: Params, key: str = "query_id", segment: str = "segm_id") -> DataFrame:
    """(key, segment, side, b, C_l, C_shared, C_score) as in ``origin_windows``, of reads (key, seq) on segments (segment, segm_name, seq).

    A read's windows lie in its own segment, so letters meet there instead of hashes, in one shuffle of both sides, and
    each task sketches what it gets; it holds the k-mers of one segment. Reads of a segment that hold more than MANY
    letters, or a thousandth of all, are dealt to several tasks, each with the segment's letters. Rows of one key are one
    read, and rows of one segment are one, by the k-mers of all of them. With ``max_matches`` hashes have to be counted
    over all segments, so they are met as in ``origin_windows``.
    """
    columns = [key, segment, "side", "b", "C_l", "C_shared", "C_score"]
    if params.max_matches is not None:
        cut = lambda df, c: sketch(df, c, "seq", params.k, params.ratio)
        ordered, usable = mapping.seeded(cut(reads, key), cut(segments, segment), params, key)
        return origin_windows(ordered, reads.select(key, F.length("seq").alias("P_sz")), usable, segments.select(segment, "segm_name"), key, segment).select(columns)
    kinds = {key: reads.schema[key].dataType.simpleString(), segment: segments.schema[segment].dataType.simpleString()}
    own = reads.withColumn("_t", truth(key)).where("_t is not null").select(F.col("_t.segment").alias("name"), F.col(key).alias("key"), F.col("_t.start").alias("start"), F.col("seq"))
    # Reads may be costly to make, and are read twice.
    own = settle(own, "reads")
    size = own.groupBy("name").agg(F.sum(F.length("seq")).alias("n"))
    unit = max(MANY, (size.agg(F.sum("n")).first()[0] or 0) // 1000)
    heavy = F.broadcast(size.where(F.col("n") > unit).select("name", F.ceil(F.col("n") / unit).cast("int").alias("parts")))
    segs = segments.where("segm_name is not null").select(F.col("segm_name").alias("name"), F.col(segment).alias("segment"), "seq").join(heavy, "name", "left")
    segs = segs.select("name", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"), F.lit(0).alias("kind"), "segment", F.lit(None).cast(kinds[key]).alias("key"), F.lit(None).cast("long").alias("start"), "seq")
    own = own.join(heavy, "name", "left").select("name", F.pmod(F.xxhash64("key"), F.coalesce("parts", F.lit(1))).cast("int").alias("part"), F.lit(1).alias("kind"), F.lit(None).cast(kinds[segment]).alias("segment"), "key", "start", "seq")
    rows = segs.unionByName(own).repartition("name", "part").sortWithinPartitions("name", "part", "kind", "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, number, segs, own, letters, mine = None, 0, [], [], 0, 0

        def out() -> pa.RecordBatch:
            cols = list(zip(*_held(segs, own, params))) or [()] * len(columns)
            types = [key_type, segment_type, pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.float64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], columns)

        for batch in batches:
            key_type, segment_type = batch.column(4).type, batch.column(3).type
            cols = [batch.column(i).to_pylist() for i in range(6)]
            for name, part, kind, seg, key_, start, seq in zip(*cols, batch.column(6)):
                # What is held is looked at when a read begins; of segments only the present group's are kept.
                if own and letters >= max(TOGETHER, 4 * mine) and ((name, part) != group or key_ != own[-1][1]):
                    yield out()
                    segs, own, letters = [x for x in segs if x[0] == number], [], 0
                if (name, part) != group:
                    if not own:
                        segs = []
                    group, number, mine = (name, part), number + 1, 0
                seq = (seq.as_py() or "").encode("latin-1", "replace")
                letters += len(seq)
                if kind:
                    own.append((number, key_, start, len(seq), seq))
                else:
                    segs.append((number, seg, seq))
                    mine += len(seq)
        if own:
            yield out()

    return rows.mapInArrow(run, f"`{key}` {kinds[key]}, `{segment}` {kinds[segment]}, side string, b int, C_l int, C_shared int, C_score double")


def lost_reads(origins: DataFrame, buckets: DataFrame, key: str = "query_id", segment: str = "segm_id") -> DataFrame:
    """(key): reads none of whose candidate buckets is one at their origin."""
    return origins.select(key).distinct().join(origins.join(buckets.select(key, segment, "b"), [key, segment, "b"], "left_semi").select(key), key, "left_anti")


def origin_table(origins: DataFrame, ordered: DataFrame, reads: DataFrame, theta: float, reaching: DataFrame | None = None, key: str = "query_id", segment: str = "segm_id") -> DataFrame:
    """One row per read of ``origin_windows``: its sketch, the three buckets at its origin with their best scores, and its letters.

    reads are (key, seq). With ``reaching`` (see ``sweeps.reaching_theta``) the buckets that reach theta, their numbers
    and the highest scores follow. gt_C_l_lmax is gt_C_l, as windows by letters have no other limit, and gt_C_r_lmax -1.
    """
    names = {"left": "l", "own": "r", "next": "next"}
    of = lambda c, side: F.max(F.when(F.col("side") == side, F.col(c)))
    wide = origins.groupBy(key, segment).agg(*(of("b", s).alias(f"gt_{n}_bucket") for s, n in names.items()), *(of(f"{x}_score", s).alias(f"gt_{x}_{n}") for x in "JC" for s, n in names.items()))
    m = ordered.groupBy(key).agg(F.first("m").alias("m"))
    out = wide.join(m, key).join(reads.select(key, F.col("seq").alias("P")), key)
    columns = [key, "m", F.lit(theta).alias("theta"), F.col("m").alias("hl"), F.col(segment).alias("segm"), *(f"gt_{n}_bucket" for n in names.values()), *(f"gt_{x}_{n}" for x in "JC" for n in names.values()), F.col("gt_C_l").alias("gt_C_l_lmax"), F.lit(-1.0).alias("gt_C_r_lmax")]
    if reaching is not None:
        out = out.join(reaching, key, "left")
        listed = lambda x: F.concat(F.lit("{"), F.array_join(F.transform(f"{x}_buckets", lambda b: F.concat(F.lit("("), F.concat_ws(", ", *(b[c].cast("string") for c in ("segm_id", "b"))), F.lit(")"))), ","), F.lit("}"))
        columns += [*(F.coalesce(f"{x}_n", F.lit(0)).alias(f"{x}_reaching") for x in "JC"), *(F.coalesce(listed(x), F.lit("{}")).alias(f"{x}_list") for x in "JC"), *(F.coalesce(f"max_{x}", F.lit(0.0)).alias(f"max{x}") for x in "JC")]
    return out.select(*columns, "P")


def origin_tags(table: DataFrame, mapped: DataFrame, key: str = "query_id") -> DataFrame:
    """(key, tags): the tags that a mapping's PAF row gets where the read's origin is known, from ``origin_table`` and ``map_reads``."""
    t = truth(key)
    rows = table.join(mapped.select(key, "T_l", "T_r", F.col("segm_id").alias("_g")), key).withColumn("_t", t)
    number = lambda c: F.format_string("%.3f", F.coalesce(c, F.lit(-1.0)).cast("double"))
    near = overlap_ratio(F.col("_g").cast("string"), F.col("T_l"), F.col("T_r"), F.col("_t.segment"), F.col("_t.start"), F.col("_t.end"))
    whole = {"gt_start_nucl": F.col("_t.start"), "gt_end_nucl": F.col("_t.end"), "bucket_l": F.col("hl")}
    tags = [F.concat(F.lit("gt_segm:s:"), F.col("_t.segment")), *(F.concat(F.lit(f"{n}:i:"), v.cast("string")) for n, v in whole.items())]
    tags += [F.concat(F.lit(f"gt_b_{n}:s:"), F.concat_ws(",", F.col("segm").cast("string"), F.col(f"gt_{n}_bucket").cast("string"))) for n in ("l", "r", "next")]
    tags += [F.concat(F.lit(f"gt_{x}:f:"), number(F.col(f"gt_{x}"))) for x in ("J_l", "J_r", "J_next", "C_l", "C_r", "C_next", "C_l_lmax", "C_r_lmax")]
    tags += [F.concat(F.lit("gt_mapping_len:i:"), (F.col("_t.end") - F.col("_t.start")).cast("string")), F.concat(F.lit("reported_mapping_len:i:"), (F.col("T_r") - F.col("T_l")).cast("string")), F.concat(F.lit("gt_overlap:f:"), number(near))]
    return rows.select(key, F.concat_ws("\t", *tags).alias("tags"))
