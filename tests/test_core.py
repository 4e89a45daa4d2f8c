import re
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from sketchlark.functions import sequences as S
from sketchlark.operators import align, intervals, mapping
from sketchlark.operators.align import edit_path, run_lengths
from sketchlark.operators.sketch import COMPLEMENT, SEEDS, kmers, sketch
from sketchlark.params import Metric, Params
from sketchlark.plans.meters import Counters, Timers, memory_mb, progress_bar


def test_hash_is_the_same_on_both_strands():
    r, h, strand = kmers(b"ACGGT", 4)
    r2, h2, strand2 = kmers(b"ACCGT", 4)
    assert h.tolist() == h2.tolist()[::-1] and strand.tolist() == (~strand2).tolist()[::-1] and r.tolist() == [3, 4]
    assert len(kmers(b"ACC", 4)[0]) == 0 and len(kmers(b"ACNGT", 2)[0]) == 2


def test_hash_against_definition():
    rot = lambda x, n: ((x << n % 64) | (x >> (64 - n % 64))) & (1 << 64) - 1 if n % 64 else x
    seq, k = "ACGTTGCAAGTCCATG" * 9, 21
    _, h, _ = kmers(seq.encode(), k)
    for i in (0, 5, 63, 64, 100):
        a = b = 0
        for j, c in enumerate(seq[i : i + k]):
            a ^= rot(SEEDS[c], k - 1 - j)
            b ^= rot(SEEDS[COMPLEMENT[c]], j)
        assert int(h[i]) == a ^ b


def test_index_counts(spark):
    segs = spark.createDataFrame([(0, "ACCAGTACCA"), (1, "GGACCA"), (2, None)], "segm_id int, seq string")
    ref = sketch(segs, "segm_id", "seq", 4, 1.0)
    counts = mapping.hit_counts(ref)
    rows = ref.join(counts, "h").where("segm_id = 0").orderBy("tpos").select("n").collect()
    assert [r.n for r in rows] == [3, 1, 1, 1, 1, 1, 3]
    stats = mapping.index_stats(ref).first()
    assert (stats.hits, stats.kmers) == (10, 8)


def test_window_sweep_against_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(200):
        m, n = int(rng.integers(1, 8)), int(rng.integers(1, 16))
        all_h = rng.integers(0, 5, n)
        occs = {h: int(rng.integers(0, 3)) for h in range(5)}
        x = np.array([i for i in range(n) if occs[all_h[i]]], np.int64)
        if not len(x):
            continue
        codir = rng.choice([-1, 1], len(x))
        for jac in (False, True):
            best = None
            for lo in range(n):
                e = min(lo + m, n)
                inside = [i for i, v in enumerate(x) if lo <= v < e]
                c = {}
                for i in inside:
                    c[all_h[x[i]]] = c.get(all_h[x[i]], 0) + 1
                shared = sum(min(v, occs[h]) for h, v in c.items())
                score = shared / (m + e - lo - shared) if jac else shared / m
                if best is None or score > best[3]:
                    best = (lo, shared, int(sum(codir[i] for i in inside)), score)
            got = mapping.window_sweep(x, all_h[x], np.array([occs[h] for h in all_h[x]]), codir, 0, n, m, jac)
            assert got[:3] == best[:3] and got[3] == pytest.approx(best[3])


def test_lcs_of_joined_positions():
    assert mapping.lcs_score([[5, 1], [3], [5, 1]]) == 3


def test_read_is_mapped_where_it_comes_from(spark):
    rng = np.random.default_rng(1)
    seq = "".join(rng.choice(list("ACGT"), 3000))
    segs = spark.createDataFrame([(0, "".join(rng.choice(list("ACGT"), 2000))), (1, seq)], "segm_id int, seq string")
    reads = spark.createDataFrame([("a", seq[500:900]), ("b", "ACGT"), ("c", None)], "query_id string, seq string")
    p = Params(k=11, ratio=0.5, theta=0.5)
    out = mapping.map_reads(sketch(reads, "query_id", "seq", p.k, p.ratio), sketch(segs, "segm_id", "seq", p.k, p.ratio), p).collect()
    assert [(r.query_id, r.segm_id, r.mapq, r.score) for r in out] == [("a", 1, 60, 1.0)] and 500 <= out[0].T_l and out[0].T_r < 900


def test_parameters_are_validated():
    for bad in ({"k": 0}, {"ratio": 0}, {"theta": 2}, {"metric": "x"}):
        with pytest.raises(ValueError):
            Params(**bad)


def test_expressions(spark):
    row = spark.range(1).select(
        S.reverse_complement(F.lit("ACNTx")).alias("rc"), S.truth(F.lit("r!s!1!9!+")).alias("t"), S.truth(F.lit("r!s!x!9!+")).alias("none"), S.suffixed_number(F.lit("1.5k")).alias("n")
    ).first()
    assert row.rc == "NANGT" and row.t.end == 9 and row.none is None and row.n == 1500


def test_intervals_against_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = [(int(c), int(s), int(s + w)) for c, s, w in zip(rng.integers(0, 2, 60), rng.integers(0, 300, 60), rng.integers(0, 50, 60))]
    df = spark.createDataFrame(rows, "chrom int, st int, en int")
    want = sum(1 for a in rows for b in rows if a[0] == b[0] and max(a[1], b[1]) < min(a[2], b[2]))
    assert intervals.overlap_join(df, df, 20).count() == want
    covered = {(c, p) for c, s, e in rows for p in range(s, e)}
    assert intervals.merge(df).agg(F.sum(F.col("en") - F.col("st"))).first()[0] == len(covered)
    assert intervals.covered_once(df).agg(F.sum("covered")).first()[0] == len(covered)


def test_intervals_that_span_bins_against_brute_force(spark):
    rng = np.random.default_rng(14)
    rows = [(int(c) or None, int(s) - 40, int(s + w) - 40) for c, s, w in zip(rng.integers(0, 3, 90), rng.integers(0, 400, 90), rng.choice([0, 1, 3, 9, 70], 90))]
    df = spark.createDataFrame(rows, "chrom int, st int, en int")
    want, steps = [], []
    for c in {r[0] for r in rows}:
        low = high = None
        for _, s, e in sorted(r for r in rows if r[0] == c):
            if high is None or s > high:
                want += [(c, low, high)] if high is not None else []
                low, high = s, e
            high = max(high, e)
        want.append((c, low, high))
        over = [sum(r[0] == c and r[1] <= x < r[2] for r in rows) for x in range(-40, 450)]
        steps += [(c, x - 40, d) for x, d in enumerate(over) if d]
    for size in (7, 50, 1 << 20):
        assert sorted(map(str, (tuple(r) for r in intervals.merge(df, bin_size=size).collect()))) == sorted(map(str, want))
        got = [(r.chrom, x, r.depth) for r in intervals.depth(df, bin_size=size).collect() for x in range(r.st, r.en)]
        assert sorted(map(str, got)) == sorted(map(str, steps))


def _distances(query, target, mode):
    rows = [[0 if mode == "HW" else j for j in range(len(target) + 1)]]
    for i, q in enumerate(query, 1):
        row = [i]
        for j, t in enumerate(target, 1):
            row.append(min(rows[-1][j - 1] + (q != t), rows[-1][j] + 1, row[-1] + 1))
        rows.append(row)
    return rows[-1]


@pytest.mark.parametrize("cells", [1 << 28, 6])
def test_alignment_against_the_whole_matrix(cells, monkeypatch):
    monkeypatch.setattr(align, "CELLS", cells)
    rng = np.random.default_rng(8)
    for _ in range(150):
        q, t = ("".join(rng.choice(list("ACG"), int(rng.integers(0, 14)))) for _ in range(2))
        for mode in align.MODES:
            last = _distances(q, t, mode)
            end = len(t) if mode == "NW" else last.index(min(last))
            distance, start, stop, cigar = align.edit_path(q, t, mode)
            assert (distance, stop) == (last[end], end - 1) == align.edit_distance(q, t, mode)
            i, j, cost = 0, start, 0
            for n, op in re.findall(r"(\d+)([=XID])", cigar):
                for _ in range(int(n)):
                    assert op not in "=X" or (q[i] == t[j]) == (op == "=")
                    i, j, cost = i + (op != "D"), j + (op != "I"), cost + (op != "=")
            assert (i, j, cost) == (len(q), end, distance)
            for k in range(4):
                assert align.edit_distance(q, t, mode, k) == ((distance, stop) if distance <= k else (-1, -1))


def test_alignment_of_long_texts_and_letters_that_match():
    rng = np.random.default_rng(9)
    q = "".join(rng.choice(list("ACGT"), 6000))
    assert align.edit_path(q, q[:2000] + "A" + q[2003:])[0] <= 3
    assert align.edit_distance("ANNT", "ACGT", equal=(("N", "C"), ("N", "G"))) == (0, 3)
    assert align.edit_path("ANNT", "ACGT", equal=(("N", "C"),))[3] == "2=1X1="


def test_long_sequences_are_sketched_in_blocks(spark):
    rng = np.random.default_rng(10)
    seqs = ["".join(rng.choice(list("ACGTN"), n, p=[0.24, 0.25, 0.25, 0.25, 0.01])) for n in (5000, 100, 7, 0)]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(seqs)], "id int, seq string")
    whole, parts = (sorted(map(tuple, sketch(df, "id", "seq", 9, 0.5, block=b).collect())) for b in (1 << 20, 64))
    assert whole == parts and [x[1] for x in whole if x[0] == 0] == list(range(sum(x[0] == 0 for x in whole)))


def test_metrics_against_buckets(spark):
    """All four metrics on one set of reads: candidates and bounds agree with the aggregates of bucket_matches."""
    rng = np.random.default_rng(11)
    seqs = ["".join(rng.choice(list("ACGT"), 1500)) for _ in range(3)]
    seqs.append(seqs[0][200:900] + seqs[1][:300])
    segs = spark.createDataFrame(list(enumerate(seqs)), "segm_id int, seq string")
    reads = spark.createDataFrame([(f"r{i}", seqs[i % 4][100 * i : 100 * i + 300]) for i in range(8)], "query_id string, seq string")
    for metric in Metric:
        p = Params(k=9, ratio=0.6, theta=0.4, min_diff=0.1, max_overlap=0.3, metric=metric)
        ref = sketch(segs, "segm_id", "seq", p.k, p.ratio)
        ordered, usable = mapping.seeded(sketch(reads, "query_id", "seq", p.k, p.ratio), ref, p)
        cols = ["query_id", "segm_id", "b", "matches", "codirection", "r_min", "r_max", "sh"]
        scored = mapping.scored_buckets(ordered, usable, p)
        assert sorted(map(tuple, scored.select(cols).collect())) == sorted(map(tuple, mapping.bucket_matches(ordered, usable, p).select(cols).collect()))
        out = mapping.map_seeds(ordered, usable, p).collect()
        assert len(out) >= 6 and all(r.score > p.theta and r.final_buckets >= 1 for r in out)


def test_frequent_kmers_are_left_out(spark):
    rng = np.random.default_rng(12)
    unit = "".join(rng.choice(list("ACGT"), 200))
    segs = spark.createDataFrame([(i, unit + "".join(rng.choice(list("ACGT"), 300))) for i in range(6)], "segm_id int, seq string")
    reads = spark.createDataFrame([("a", unit)], "query_id string, seq string")
    p = Params(k=9, ratio=1.0, theta=0.3, min_diff=0.1)
    sketched = [sketch(df, key, "seq", p.k, p.ratio) for df, key in ((reads, "query_id"), (segs, "segm_id"))]
    assert mapping.map_reads(*sketched, p).count() == 1
    assert mapping.map_reads(*sketched, replace(p, max_matches=5)).count() == 0


def test_counters_and_timers():
    c = Counters(c1=1, c2=2)
    assert (c.frac("c1", "c2"), c.perc("c1", "c2")) == (0.5, 50) and (c + Counters(c1=2, x=1)).count("c1") == 3
    c.inc("zero", 0)
    assert c.frac("c1", "zero") == float("inf")
    with pytest.raises(KeyError):
        c.count("unknown")
    t = Timers()
    t.add("a", 0.01)
    t.add("b", 0.02)
    t.add("b", 0.01)
    assert t.perc("a", "b") == pytest.approx(100 / 3) and t.range_ratio("b") == 2 and (t + t).secs("a") == 0.02
    t.start("c")
    with pytest.raises(ValueError):
        t.start("c")
    t.stop("c")
    with pytest.raises(ValueError):
        t.stop("c")
    assert [b[0] for b in t.breakdown("b")] == ["a", "b", "c"] and memory_mb()["VmRSS"] > 1
    assert mapping.time_warnings({"mapping": 10, "match_seeds": 9.5, "match_rest": 1, "match_rest_for_best2": 0.3}) == [("match_seeds", 95.0)]
    assert progress_bar(0.5, "x", 4) == "\rx [==  ] 50%"


def test_alignment():
    assert edit_path("kitten", "sitting")[0] == 3
    assert edit_path("abc", "xxabcxx", "HW") == (0, 2, 4, "3=")
    assert edit_path("abc", "abxc", "SHW")[0] == 1 and edit_path("", "abc")[3] == "3D"
    assert edit_path("abc", "xyz", most=2)[0] == -1 and run_lengths("==XI", False) == "3M1I"
