import numpy as np
import pytest

from sketchlark.operators import mapping, origin
from sketchlark.operators.sketch import sketch
from sketchlark.params import Params


def _hits(rng, n):
    occs = {h: int(rng.integers(1, 3)) for h in range(5)}
    tpos = np.sort(rng.choice(40, n, replace=False))
    r = tpos * 3 + rng.integers(0, 3, n)
    return [{"tpos": int(t), "r": int(p), "h": int(h), "occs": occs[int(h)], "codir": int(c)} for t, p, h, c in zip(tpos, r, rng.integers(0, 5, n), rng.choice([-1, 1], n))]


def _arrays(hits):
    return {k: np.array([x[k] for x in hits], np.int64) for k in ("tpos", "r", "h", "occs", "codir")}


def _window(hits, low, last, m, jac):
    """(T_l, T_r, shared, strands, score): of each k-mer its first hits count, up to the read's own number."""
    left, shared, strands = {}, 0, 0
    for x in hits[low : last + 1]:
        if left.setdefault(x["h"], x["occs"]) > 0:
            left[x["h"]] -= 1
            shared, strands = shared + 1, strands + x["codir"]
    size = hits[last]["tpos"] - hits[low]["tpos"] + 1
    return hits[low]["r"], hits[last]["r"], shared, strands, shared / (m + size - shared if jac else m)


def test_windows_by_letters_against_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(200):
        hits, letters, m = _hits(rng, int(rng.integers(1, 15))), int(rng.integers(0, 60)), 20
        for jac in (False, True):
            every = [_window(hits, low, max(i for i, y in enumerate(hits) if y["r"] <= x["r"] + letters), m, jac) for low, x in enumerate(hits)]
            assert origin.best_by_letters(_arrays(hits), letters, m, jac) == pytest.approx(max(every, key=lambda w: w[4]))


def test_windows_by_span_against_brute_force():
    rng = np.random.default_rng(4)
    for _ in range(300):
        hits, most, m = _hits(rng, int(rng.integers(1, 15))), int(rng.integers(0, 20)), 20
        least = most - 4
        every = []
        for low, x in enumerate(hits):
            span = [y["tpos"] - x["tpos"] for y in hits]
            near = [i for i in range(low, len(hits)) if span[i] <= least][-1:]
            every += [_window(hits, low, last, m, True) for last in [*near, *(i for i in range(low, len(hits)) if least < span[i] <= most)]]
        assert origin.best_by_span(_arrays(hits), least, most, m) == pytest.approx(max(every, key=lambda w: w[4]))
    assert origin.best_by_span(_arrays([]), 0, 4, 3)[4] == -1.0


def test_origin_of_simulated_reads(spark):
    rng = np.random.default_rng(6)
    seq = "".join(rng.choice(list("ACGT"), 3000))
    p = Params(k=11, ratio=0.5, theta=0.5)
    segs = spark.createDataFrame([(0, "s", seq), (1, "t", seq[:200])], "segm_id int, segm_name string, seq string")
    reads = spark.createDataFrame([("a!s!500!900!+", seq[500:900]), ("b!s!0!300!+", seq[:300]), ("c!none!0!300!+", seq[:300]), ("d", seq[:300])], "query_id string, seq string")
    ref = sketch(segs, "segm_id", "seq", p.k, p.ratio)
    ordered = mapping.seed_order(mapping.seeds(sketch(reads, "query_id", "seq", p.k, p.ratio), mapping.hit_counts(ref)), p)
    sizes = reads.selectExpr("query_id", "length(seq) as P_sz")
    found = origin.origin_windows(ordered, sizes, ref, segs.select("segm_id", "segm_name"))
    rows = {(r.query_id[0], r.side): r for r in found.collect()}
    assert {k[0] for k in rows} == {"a", "b"} and len(rows) == 6
    assert rows["a", "own"].C_score == 1.0 and rows["a", "own"].J_score > 0.9 and rows["b", "left"].b == rows["b", "own"].b == 0
    starts = ref.where("segm_id = 0 and r < 500").count()
    assert rows["a", "own"].b == starts // ordered.where("query_id like 'a%'").first().m
    lost = origin.lost_reads(found, mapping.bucket_matches(ordered, ref, p))
    assert lost.count() == 0


def _both_ways(spark, segs, reads, p, **kinds):
    cut = lambda df, c: sketch(df, c, "seq", p.k, p.ratio)
    ordered, usable = mapping.seeded(cut(reads, "query_id"), cut(segs, "segm_id"), p)
    old = origin.origin_windows(ordered, reads.selectExpr("query_id", "length(seq) as P_sz"), usable, segs.select("segm_id", "segm_name"))
    new = origin.containment_at_origin(reads, segs, p)
    return sorted(map(tuple, old.select(new.columns).collect())), sorted(map(tuple, new.collect()))


def test_letters_met_in_their_segment_give_the_windows_of_hashes_met_by_shuffles(spark, monkeypatch):
    rng = np.random.default_rng(11)
    letters = lambda n: "".join(rng.choice(list("ACGTN"), n, p=[0.24, 0.24, 0.25, 0.26, 0.01]))
    unit = letters(30)
    texts = [letters(3000), unit * 40 + letters(500), letters(9), "", letters(200) + unit * 3 + letters(700), None]
    segs = spark.createDataFrame([(i, f"s{i}", t) for i, t in enumerate(texts)], "segm_id int, segm_name string, seq string")
    rows = [(f"r{i}.{j}!s{i}!{a}!{a + n}!+", t[a : a + n]) for i, t in enumerate(texts) if t for j in range(12) for a, n in [(int(rng.integers(0, len(t))), int(rng.integers(5, 400)))]]
    rows += [("x!none!0!50!+", texts[0][:50]), ("y", unit), ("z!s3!0!50!+", unit * 3), ("n!s5!-7!50!+", unit), ("e!s0!9!9!+", ""), (None, unit), ("v!s0!99999!100000!-", texts[0][:300])]
    reads = spark.createDataFrame(rows, "query_id string, seq string")
    for p in (Params(k=11, ratio=0.5), Params(k=7, ratio=1.0), Params(k=9, ratio=0.3, max_matches=2)):
        old, new = _both_ways(spark, segs, reads, p)
        assert new == old and len(new) > 50
    # A few letters at a time, and reads of one segment in several tasks.
    monkeypatch.setattr(origin, "TOGETHER", 300)
    monkeypatch.setattr(origin, "MANY", 900)
    p = Params(k=11, ratio=0.5)
    old, new = _both_ways(spark, segs, reads, p)
    assert new == old
    plan = origin.containment_at_origin(reads, segs, p)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_COL") == 1 and "SortMergeJoin" not in plan


def test_rows_of_one_segment_and_of_one_read_are_one(spark):
    rng = np.random.default_rng(12)
    a, b = ("".join(rng.choice(list("ACGT"), 600)) for _ in range(2))
    p = Params(k=15, ratio=1.0)
    segs = spark.createDataFrame([(0, "s", a), (0, "s", b), (1, "t", a)], "segm_id int, segm_name string, seq string")
    reads = spark.createDataFrame([("r!s!100!200!+", b[100:200]), ("q!t!100!200!+", a[100:200]), ("q!t!100!200!+", a[100:200])], "query_id string, seq string")
    got = {(r.query_id[0], r.side): r for r in origin.containment_at_origin(reads, segs, p).collect()}
    # 86 k-mers end before position 100 of each row, and a row of a read has 86.
    assert len(got) == 6 and got["r", "own"].b == 172 // 86 and got["q", "own"].b == 86 // 172
    assert got["q", "own"].C_shared == 86 and got["q", "own"].C_score == 0.5 and got["q", "own"].C_l == 114
