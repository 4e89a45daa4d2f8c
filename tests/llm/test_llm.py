import collections
import itertools
import re
import time
import zlib

import numpy as np
import pytest

from sketchlark.llm import graph, jaccard, kernel, language, lines, mixing, packing, quality, recurrent, sharding, tokens, vectors
from sketchlark.llm import html as pages

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


@pytest.fixture(scope="module")
def docs(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(60):
        t = [WORDS[j] for j in rng.integers(0, len(WORDS), int(rng.integers(1, 90)))]
        rows.append((i, "\n".join(" ".join(t[a : a + 9]) for a in range(0, len(t), 9)), "en", f"s{i % 4}"))
    for i in range(60, 80):
        t = rows[i % 10][1]
        rows.append((i, t if i % 2 else t + " more", "en", "s0"))
    long = " ".join(str(x) for x in rng.integers(0, 10**9, 60_000))
    rows += [(80, None, None, None), (81, "", "en", "s1"), (82, " \n\t", "en", None), (5, rows[5][1], "en", "s1"), (None, "no key here", "en", "s2"), (83, long, "en", "s2"), (84, long, "en", "s3"), (85, "été — naïve", "fr", "s3")]
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, lang string, source string, size int, v string")


def components_of(keys, links):
    parent = {k: k for k in keys}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {k: find(k) for k in keys}


def test_components(spark):
    rng = np.random.default_rng(0)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 200, (150, 2))] + [(i, i + 1) for i in range(1000, 1100)]
    got = {r.v: r.root for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = components_of({x for e in links for x in e}, links)
    assert all(got.get(k, k) == r for k, r in want.items())
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_shards(docs, spark):
    rows = sharding.shard(docs, 5).collect()
    given = [(r.doc_id, (r.text or "").encode()) for r in docs.collect()]
    assert collections.Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == collections.Counter((k, len(t) + 1, zlib.crc32(t)) for k, t in given)
    # In the order of keys the sizes before a row add up to its first_byte; its middle decides the shard.
    ordered = sorted(rows, key=lambda r: r.first_byte)
    assert [r.doc_id for r in ordered] == sorted((k for k, _ in given), key=lambda k: (k is not None, k or 0))
    total, at, slots = sum(r["size"] for r in rows), 0, collections.Counter()
    for r in ordered:
        assert r.first_byte == at and r.shard == min(4, (2 * at + r["size"]) * 5 // (2 * total)) and r.slot == slots[r.shard]
        at += r["size"]
        slots[r.shard] += 1
    assert sharding.shard(docs.limit(0)).count() == 0


def test_shards_with_ties_and_a_large_row(spark):
    rows = [(1, "same")] * 40 + [(2, None)] * 3 + [(3, "x" * 5000)] + [(i, "y" * 20) for i in range(4, 60)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()
    size = collections.Counter()
    for r in got:
        size[r.shard] += r["size"]
    assert len(got) == 100 and len({(r.shard, r.slot) for r in got}) == 100
    assert sorted({r.first_byte for r in got if r.doc_id == 1}) == [5 * i for i in range(40)]
    assert [r.doc_id for r in got if r["size"] > 5000] == [3] and sum(size.values()) == 40 * 5 + 3 + 5001 + 56 * 21


def test_jaccard_against_brute_force(docs):
    for n, percent in ((3, 90), (5, 80), (1, 50)):
        sets = []
        for r in docs.collect():
            w = re.findall(r"[^\x20\x09-\x0D]+", (r.text or "").lower())
            sets.append((r.doc_id, frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()))
        links = [(a[0], b[0]) for a, b in itertools.combinations(sets, 2) if a[0] is not None and b[0] is not None and a[1] and b[1] and 100 * len(a[1] & b[1]) >= percent * len(a[1] | b[1])]
        want = components_of([k for k, _ in sets if k is not None], links)
        got = jaccard.near_groups(docs, n, percent).collect()
        assert len(got) == len(sets)
        assert all(r.component_id == want[r.doc_id] for r in got if r.doc_id is not None), (n, percent)
        assert {r.doc_id: r.n_shingles for r in got} == {k: len(s) for k, s in sets}


def test_one_of_each_with_null_and_repeated_keys(spark):
    text = lambda name: " ".join(f"{name}{i}" for i in range(30))
    rows = [(None, text("a")), (None, text("b")), (None, text("c")), (None, text("c") + " more"), (None, text("d")), (3, text("d")), (5, text("e")), (5, text("f")), (5, text("f")), (7, text("f")), (7, text("g")), (8, text("g") + " more"), (None, None), (5, ""), (None, " ")]
    kept = [(r.doc_id, r.text) for r in jaccard.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    either = [x for x in kept if x in rows[2:4]]
    assert len(either) == 1
    kept.remove(either[0])
    want = [rows[i] for i in (0, 1, 5, 6, 7, 10, 12, 13, 14)]
    assert collections.Counter(kept) == collections.Counter(want)


def test_trie_and_signatures():
    rng = np.random.default_rng(1)
    for trial in range(60):
        percent = (90, 80, 60)[trial % 3]
        base = np.unique(rng.integers(0, 1 << 63, int(rng.integers(3, 80))).astype(np.uint64))
        own = []
        for v in range(30):
            s = np.unique(np.concatenate([base[rng.random(len(base)) > rng.choice([0, 0.02, 0.05, 0.1])], rng.integers(0, 1 << 63, int(rng.integers(0, 4))).astype(np.uint64)]))
            if len(s):
                own.append((v, s))
        sets = {v: set(s.tolist()) for v, s in own}
        links = [(a, b) for a, b in itertools.combinations(sets, 2) if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
        assert components_of(sets, links) == components_of(sets, jaccard.trie_links(own, None, percent))
        flat, first = np.concatenate([s for _, s in own]), np.cumsum([0] + [len(s) for _, s in own])
        sigs = dict(zip(sets, (set(x.tolist()) for x in jaccard.signatures(flat, first, percent, base[::3]))))
        assert all(sigs[a] & sigs[b] for a, b in links if sets[a] != sets[b])


def test_tiles_part_sets_that_share_a_passage_only(monkeypatch):
    """Sets of one passage and own members: each two are compared before, only copies of one text after; no link is lost."""
    rng = np.random.default_rng(7)
    draw = lambda n: rng.integers(0, 1 << 63, n).astype(np.uint64)
    for percent in (90, 80, 60):
        passage, sets = draw(20), []
        for v in range(300):
            own = np.concatenate([passage, draw(int(rng.integers(25, 60)))])
            sets += [np.unique(np.concatenate([own[rng.random(len(own)) > lack], draw(more)])) for lack, more in ((0, 0), (0.02, 1), (0.06, 2))[: 1 + v % 7 % 3]]
        sets = [(i, sets[i]) for i in rng.permutation(len(sets)).tolist()]
        compared = []
        real = jaccard.trie_links
        monkeypatch.setattr(jaccard, "trie_links", lambda a, b, p: (compared.append(len(a) + len(b or [])), real(a, b, p))[1])
        for stored, asked in ((sets, None), (sets[:200], sets[200:])):
            every = set(range(len(sets)))
            want = components_of(every, real(stored, asked, percent))
            compared.clear()
            assert components_of(every, jaccard.tile_links(stored, asked, percent)) == want
            assert len(compared) > 20 and max(compared) <= 3
        monkeypatch.undo()


def test_parts_of_a_tile_against_brute_force():
    rng = np.random.default_rng(8)
    for trial in range(60):
        percent, base = (90, 80, 60)[trial % 3], rng.integers(0, 1 << 63, int(rng.integers(1, 60))).astype(np.uint64)
        sets = [np.unique(np.concatenate([base[rng.random(len(base)) > rng.choice([0, 0.03, 0.1, 0.3])], rng.integers(0, 1 << 63, int(rng.integers(0, 4))).astype(np.uint64)])) for _ in range(40)]
        sets = [s for s in sets if len(s)]
        label = jaccard.parted(sets, percent)
        for a, b in itertools.combinations(range(len(sets)), 2):
            both = len(np.intersect1d(sets[a], sets[b]))
            assert label[a] == label[b] or 100 * both < percent * (len(sets[a]) + len(sets[b]) - both)


def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((10, 16))
    rows = [(i, (centres[i % 10] + rng.standard_normal(16) * 0.12).tolist(), i % 2) for i in range(300)]
    rows += [(300, rows[0][1], 0), (301, None, 0), (302, [0.0] * 16, 0), (303, rows[0][1], None), (304, [float("nan")] * 16, 0), (305, [1.0], 0), (306, [None] * 16, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r for r in vectors.near_vectors(df).collect()}
    x = np.array([r[1] for r in rows[:301]])
    x /= np.linalg.norm(x, axis=1)[:, None]
    hit = (x @ x.T >= 0.93) & (np.array([r[2] for r in rows[:301]])[:, None] == np.array([r[2] for r in rows[:301]]))
    np.fill_diagonal(hit, False)
    found = sum(got[i].n_links for i in range(301))
    assert 0.98 * hit.sum() <= found <= hit.sum() and all(got[i].n_links == 0 and got[i].kept for i in range(301, 307))
    assert len(got) == len(rows)


def test_quality_base_rules_against_brute_force(docs, spark):
    labels = spark.createDataFrame([(i, 1, 0) for i in range(30)], "doc_id long, quality int, toxic int")
    for r in quality.quality(docs, labels).collect():
        t = r.text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        at = collections.defaultdict(list)
        for i in range(len(w) - 4):
            at[tuple(w[i : i + 5])].append(i)
        cover = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 5)}
        full = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (r.n_words, r.word_chars, r.n_repeat_words, r.n_dup_lines) == (len(w), sum(map(len, w)), len(cover), len(full) - len(set(full)))
        assert r.n_symbols == sum(c in "#*$%&|<>" for c in t) and r.v == "x"
    assert quality.quality(docs.limit(0), labels).count() == 0


def test_sainte_lague_against_quotients():
    rng = np.random.default_rng(5)
    for _ in range(100):
        votes = rng.integers(0, 50, 6).astype(float).tolist()
        caps = rng.integers(0, 20, 6).tolist()
        seats = int(rng.integers(0, 40))
        quotients = sorted(((-v / (2 * k + 1), i) for i, v in enumerate(votes) if v for k in range(caps[i])))[:seats]
        want = collections.Counter(i for _, i in quotients)
        got = mixing.sainte_lague(votes, seats, caps)
        assert sorted((v / (2 * g - 1) if g else 0) for v, g in zip(votes, got)) == sorted((votes[i] / (2 * want[i] - 1) if want[i] else 0) for i in range(6))


def test_mix(docs):
    rows = mixing.mix(docs).collect()
    taken, target, size = collections.Counter(), {}, collections.Counter()
    for r in rows:
        assert 0 <= r.mix_taken <= 2 * r.mix_size
        taken[r.source] += r.mix_taken
        size[r.source] += r.mix_size
        target[r.source] = r.mix_target
    assert len(rows) == docs.count() and all(abs(taken[s] - target[s]) <= 64 for s in target)
    assert sum(target.values()) == pytest.approx(min(1.5 * sum(size.values()), 2 * sum(size.values())))
    texts = mixing.mixed_texts(docs).collect()
    assert sum(len(r.text.split()) for r in texts) == sum(taken.values())
    again = {(r.doc_id, r.text): r.mix_taken for r in mixing.mix(docs.repartition(3)).collect()}
    assert again == {(r.doc_id, r.text): r.mix_taken for r in rows}


def test_mix_passes_columns_of_any_name_through(docs):
    extra = ["_origin", "_o0", "_w_x", "_range", "_s", "_p", "_run_x", "_quota_source"]
    more = docs.selectExpr("*", *(f"concat('{c} ', doc_id) AS {c}" for c in extra))
    rows, texts = mixing.mix(more), mixing.mixed_texts(more)
    assert set(extra) <= set(rows.columns) and texts.columns == more.columns
    assert all(r[c] == f"{c} {r.doc_id}" for r in [*rows.collect(), *texts.collect()] if r.doc_id is not None for c in extra)
    plain = {(r.doc_id, r.text): r.mix_taken for r in mixing.mix(docs).collect()}
    assert plain == {(r.doc_id, r.text): r.mix_taken for r in rows.collect()}


def test_lines(docs, spark):
    passage = " ".join(f"word{i}" for i in range(60))
    two = "\n".join(" ".join(f"w{i}{j}" for j in range(12)) for i in range(6))
    rows = [(1, f"a b c\n{passage}\nend"), (2, f"other start\n{passage}"), (3, f"x\n\n{two}\ny"), (4, f"{two}\nz"), (5, "short line\nshort line"), (6, None), (7, "")]
    got = {r.doc_id: r.text for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: rows[0][1], 2: "other start", 3: rows[2][1], 4: "z", 5: rows[4][1], 6: None, 7: ""}
    assert lines.dedup_lines(docs).count() == docs.count()


def test_lines_of_a_passage_with_a_part_that_occurs_earlier(spark):
    line = lambda name, n: " ".join(f"{name}{i}" for i in range(n))
    rows = []
    for p in range(8):
        parts = [line(f"{c}{p}x", n) for c, n in (("a", 20), ("b", 25), ("c", 15))]
        rows += [(10 * p + 1, f"start {p}\n{parts[1]}\nend {p}"), (10 * p + 2, "\n".join(["two", *parts, "2"])), (10 * p + 3, "\n".join(["three", *parts, "3"]))]
    got = {r.doc_id: r.text for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[10 * p + 3] == "three\n3" for p in range(8))


def test_lines_against_brute_force(spark):
    rng = np.random.default_rng(11)
    vocabulary = [" ".join(f"v{i}w{j}" for j in range(int(n))) for i, n in enumerate(rng.choice([1, 2, 5, 9, 14, 24, 26, 40], 24))]
    texts = [[int(x) for x in rng.integers(0, 24, int(rng.integers(1, 9)))] for _ in range(25)]
    for _ in range(50):  # spliced from parts of others
        t = [x for _ in range(4) for s in [texts[int(rng.integers(len(texts)))]] for a in [int(rng.integers(len(s)))] for x in s[a : a + int(rng.integers(1, 9))]]
        texts.append(t)
    for min_words in (25, 10):
        rows = [(i, "\n".join(vocabulary[x] for x in t)) for i, t in enumerate(texts)]
        runs = {r.k: {i for x in r.runs for i in range(x.low, x.high)} for r in lines.repeated_runs(spark.createDataFrame(rows, "doc_id long, text string"), min_words).collect()}
        size = [len(v.split()) for v in vocabulary]
        for i, t in enumerate(texts):
            must, may = set(), set()
            for j in range(i + 1):
                for shift in range(-len(texts[j]) + 1, len(t)):  # t[x] against texts[j][x - shift]
                    if j == i and shift <= 0:
                        continue
                    same = [0 <= x - shift < len(texts[j]) and t[x] == texts[j][x - shift] for x in range(len(t))]
                    for equal, group in itertools.groupby(range(len(t)), key=same.__getitem__):
                        group = list(group)
                        n = sum(size[t[x]] for x in group)
                        may |= set(group) if equal and n >= min_words else set()
                        must |= set(group) if equal and n >= 2 * min_words - 1 else set()
            assert must <= runs.get(i, set()) <= may, (min_words, i)


def test_boundaries_against_all_choices():
    rng = np.random.default_rng(6)
    for _ in range(30):
        hist = {int(n): int(c) for n, c in zip(rng.choice(30, 7, replace=False) + 1, rng.integers(1, 9, 7))}
        pad = lambda ends: sum(c * (min(e for e in ends if e >= n) - n) for n, c in hist.items())
        best = min(pad((*some, max(hist))) for some in itertools.combinations(sorted(hist)[:-1], 2))
        assert pad(packing.boundaries(hist, 3)) == best
    assert packing.boundaries({}) == []


def test_pack(docs):
    rows = packing.pack(docs, max_len=50, n_buckets=4, budget=200).collect()
    words = sum(len((r.text or "").split()) for r in docs.collect())
    assert sum(r.n_tokens for r in rows) == words and all(0 <= r.padding for r in rows)
    slots = collections.defaultdict(list)
    for r in rows:
        slots[r.bucket, r.batch].append((r.slot, r.bucket_len))
    assert all(sorted(s for s, _ in v) == list(range(len(v))) and len(v) * v[0][1] <= max(200, v[0][1]) for v in slots.values())
    assert packing.pack(docs.limit(0)).count() == 0


def test_tokens_against_library(docs):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = str(public.path("word_bpe_49k.json"))
    library = Tokenizer.from_file(path)
    for t in ["", "Don't STOP 123 — été", "a<|endoftext|>b", "ΣΑΣ", "日本 ½²", "x" * 3000, "a\x1cb", *(r.text or "" for r in docs.collect())]:
        assert tokens.MergeCounter(path).count(t) == len(library.encode(t, add_special_tokens=False).ids)


def test_language(spark):
    rng = np.random.default_rng(7)
    kinds = {"aa": "aeiou", "bb": "bcdfg"}
    rows = [(i, " ".join("".join(rng.choice(list(kinds[k]), 5)) for _ in range(20)), k) for i in range(60) for k in kinds]
    df = spark.createDataFrame([*rows, (-1, None, None), (-2, "12 !", "aa")], "doc_id long, text string, lang string")
    model = language.fit(df, df.doc_id < 40, steps=120)
    out = language.predict(df, model).collect()
    assert all(r.lang_pred == r.lang for r in out if r.doc_id >= 0) and {r.lang_pred for r in out if r.doc_id < 0} == {"und"}


def test_language_of_rows_held_out(spark):
    rng = np.random.default_rng(9)
    kinds = {"aa": "aeiouy", "bb": "bcdfgh", "cc": "aceikm", "dd": "жзиклм"}
    rows = []
    for i in range(240):
        k = list(kinds)[i % 4]
        rows.append((i, " ".join("".join(rng.choice(list(kinds[k]), 5)) for _ in range(int(rng.choice([4, 20, 400])))), k))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = language.predict(df.where("doc_id >= 160"), language.fit(df, df.doc_id < 160)).collect()
    assert len(out) == 80 and sum(r.lang_pred == r.lang for r in out) >= 78 and all(0 < r.score <= 1 for r in out)


def test_language_edge_cases(spark):
    df = spark.createDataFrame([(1, "abc abd " * 4, "aa"), (2, "xyz xyw " * 4, "bb"), (2, "xyz xyw " * 4, "bb"), (None, None, "aa"), (3, "", None), (4, " 1 2\n", "aa"), (5, "ab", None), (6, "xyzw " * 40_000, None)], "doc_id long, text string, lang string")
    model = language.fit(df, df.doc_id < 3, steps=60)
    out = language.predict(df, model).collect()
    assert [(r.lang_pred, r.score) for r in out if r.doc_id in (None, 3, 4)] == [("und", 0.0)] * 3
    assert {r.doc_id: r.lang_pred for r in out if r.doc_id in (1, 2, 5, 6)} == {1: "aa", 2: "bb", 5: "aa", 6: "bb"}
    assert len(out) == 8 and language.predict(df.limit(0), model).count() == 0
    alone = language.predict(df, language.fit(df, df.lang == "aa")).collect()
    assert {r.lang_pred for r in alone if r.doc_id in (1, 2)} == {"aa"}
    nothing = language.predict(df, language.fit(df.limit(0), df.doc_id < 3)).collect()
    assert {(r.lang_pred, r.score) for r in nothing} == {("und", 0.0)}


def test_language_pieces_cover_every_byte():
    texts = [b"", "aé漢😀".encode() * 60, b"x", b"plain " * 50]
    c = kernel.Chunk(texts)
    start, end, text = language.pieces(c, 16)
    for i, t in enumerate(texts):
        own = [c.data[a:b].tobytes() for a, b, x in zip(start, end, text) if x == i]
        assert b"".join(own) == t and all(p.decode() and len(p) <= 19 for p in own)


def test_language_reads_across_pieces():
    """The same result whatever else a chunk holds, and as from the plain networks run over the bytes around a piece."""
    rng = np.random.default_rng(1)
    w = recurrent.gru_weights(rng, 256, 8, "f") | recurrent.gru_weights(rng, 256, 8, "b") | {"v": rng.standard_normal((16, 3)).astype(np.float32), "c": np.zeros(3, np.float32)}
    model = language.Labeller(["a", "b", "c"], w)
    text = bytes(rng.integers(97, 123, 500).astype(np.uint8))
    c = kernel.Chunk([b"other", text, b""])
    got = model.pooled(c)
    x = np.concatenate([np.full(600, 256), np.frombuffer(text, np.uint8), np.full(600, 256)]).astype(np.int64)
    want = np.zeros(3)
    start, end, of = language.pieces(c, language.PIECE)
    for a, b in [(a - 6, b - 6) for a, b, i in zip(start, end, of) if i == 1]:  # the first text and its space take 6 bytes
        f = recurrent.gru_forward(w, "f", x[600 + a - language.CONTEXT : 600 + b][:, None])[language.CONTEXT :]
        longest = language.PIECE if len(text) > language.PIECE else b - a
        after = x[600 + a : 600 + a + longest + language.CONTEXT][::-1]
        r = recurrent.gru_forward(w, "b", after[:, None])[language.CONTEXT :][::-1][: b - a]
        want += language.softmax(np.concatenate([f, r], 2) @ w["v"] + w["c"]).sum((0, 1))
    assert np.allclose(got[1], want / len(text), atol=1e-5) and not got[2].any()


def test_language_sample(spark):
    rng = np.random.default_rng(8)
    rows = [(i, " ".join(str(x) for x in rng.integers(0, 10**6, 3000)), "aa") for i in range(20)] + [(90, "ab cd", "bb"), (91, "", "bb")]
    df = spark.createDataFrame(rows, "key long, text string, lang string")
    sample = language.sample_windows(df, windows=500)
    own = [w for k, w in sample if k == "aa"]
    assert 400 < len(own) < 600 and len(set(own)) == len(own) and [w for k, w in sample if k == "bb"] == [b"ab cd"]
    # From all parts of all texts.
    places = [(i, t.index(w.decode()) * 4 // len(t)) for w in own for i, t, _ in rows[:20] if w.decode() in t]
    assert len(set(places)) == 80
    every = language.sample_windows(df.where("lang = 'aa'"), windows=10**6)
    assert sum(len(w) for _, w in every) == sum(len(t) for _, t, _ in rows[:20])
    assert language.sample_windows(df.limit(0)) == []


def test_html(spark):
    page = "<html><head><title>T</title><script>var a='<p>no</p>'</script></head><body><nav><ul><li><a href='/x'>Menu</a></ul></nav><article><h1>Big &amp; small</h1><p>One <b>two</b><br>three.<p>Four&nbsp;five.</article><div class='comments'><p>me too</p></div><footer>&copy; x</footer></body></html>"
    found = pages.blocks(page)
    assert [t for _, t, _ in found] == ["T", "Menu", "Big & small", "One two three.", "Four five.", "me too", "© x"]
    df = spark.createDataFrame([(i, page) for i in range(8)] + [(8, None), (9, "")], "page_id long, html string")
    out = {r.page_id: r.text for r in pages.extract(df, pages.fit(df, steps=60)).collect()}
    assert out[0] == "Big & small\n\nOne two three.\n\nFour five." and out[8] == out[9] == ""


def test_html_without_names(spark):
    body = lambda i, j: f"Sentence {i} of part {j} tells at some length what has been seen on that day, and who has been there to see it."
    page = lambda i: f"<body><div><a href='/a'>Home {i}</a></div><div><a href='/b'>About us</a></div><table><tr><td><p>{body(i, 1)}</p><p>{body(i, 2)}</p></td></tr></table><div>x {i}</div></body>"
    df = spark.createDataFrame([(i, page(i)) for i in range(12)], "page_id long, html string")
    out = {r.page_id: r.text for r in pages.extract(df, pages.fit(df, steps=60)).collect()}
    assert out == {i: f"{body(i, 1)}\n\n{body(i, 2)}" for i in range(12)}


def test_html_learns_from_names_to_do_without(spark):
    """Pages with names teach; pages stripped of them are read nearly as well, headings and short lines included."""
    rng = np.random.default_rng(12)
    words = [f"{a}{b}" for a in "ba ce di fo gu".split() for b in "la me ni ro tu".split()]
    line = lambda n: " ".join(rng.choice(words, n)).capitalize()

    def page(named: bool) -> tuple[str, str]:
        menu = "".join(f"<li><a href='/{i}'>{line(1)}</a></li>" for i in range(5))
        main = [("h1", line(3))] + [("p", line(int(rng.integers(4, 60))) + ".") for _ in range(6)] + [("h2", line(2)), ("p", line(20) + ".")]
        body = "".join(f"<{t}>{x}</{t}>" for t, x in main)
        said = "".join(f"<div class='comment'><p>{line(12)}.</p></div>" if named else f"<div><div><p>{line(12)}.</p></div></div>" for _ in range(2))
        parts = ("<nav><ul>", "</ul></nav><article>", "</article><section class='comments'>", "</section><footer>") if named else ("<div><ul>", "</ul></div><div>", "</div><div>", "</div><div>")
        end = parts[3].split("<")[-1][:-1]
        return f"<body>{parts[0]}{menu}{parts[1]}{body}{parts[2]}{said}{parts[3]}<p>{line(2)}</p></{end}></body>", "\n\n".join(x for _, x in main)

    teach = [page(True) for _ in range(150)]
    asked = [page(False) for _ in range(40)] + teach[:20]
    df = spark.createDataFrame([(i, h) for i, (h, _) in enumerate(teach)], "page_id long, html string")
    model = pages.fit(df)
    out = {r.page_id: r.text for r in pages.extract(spark.createDataFrame([(i, h) for i, (h, _) in enumerate(asked)], "page_id long, html string"), model).collect()}
    blocks = lambda t: collections.Counter(t.split("\n\n"))
    hit = sum((blocks(out[i]) & blocks(t)).total() for i, (_, t) in enumerate(asked))
    assert hit >= 0.97 * sum(blocks(t).total() for _, t in asked) and hit >= 0.97 * sum(blocks(t).total() for t in out.values())
    assert all(out[40 + i] == t for i, (_, t) in enumerate(teach[:20]))


def test_html_that_is_broken_or_long(spark):
    began = time.time()
    for page in ("<!" * 20_000, "<a '" * 20_000, "<p \"" * 20_000, "<" * 50_000, "<p>" * 5_000, "</p>" * 20_000, "<script>" * 5_000, "<?" * 20_000):
        pages.blocks(page)
    assert time.time() - began < 20
    assert [t for _, t, _ in pages.blocks("<p>a &lt; b<p>c <br/>d<!-- x --> e</p>f<!-- open")] == ["a < b", "c d e", "f"]
    assert [t for _, t, _ in pages.blocks("1 < 2 <b>bold</b>&nbsp;&amp; <style>p{}</style>after")] == ["1 < 2 bold &", "after"]
    long = "<article>" + "".join(f"<p>Sentence number {i} of a long page says something.</p>" for i in range(3000)) + "</article>"
    df = spark.createDataFrame([(1, long), (1, long), (None, None), (2, ""), (3, "no mark-up")], "page_id long, html string")
    out = pages.extract(df, pages.fit(df, steps=30)).collect()
    assert [r.text.count("Sentence") for r in out if r.page_id == 1] == [3000, 3000] and all(r.n_chars == len(r.text) for r in out)
    assert pages.extract(df.limit(0), pages.fit(df.limit(0))).count() == 0


def test_gradients_against_differences():
    """Both recurrent nets' backward passes against small changes of single weights, with symbols that stand for nothing."""
    rng = np.random.default_rng(13)
    symbols = rng.integers(0, 6, (7, 3))
    symbols[5:, 1] = symbols[:2, 2] = 5
    for kind in ("gru", "lstm"):
        w = {k: v.astype(np.float64) for k, v in (recurrent.gru_weights(rng, 5, 4, "f") if kind == "gru" else recurrent.lstm_weights(rng, 5, 4, "f")).items()}
        x, live = rng.standard_normal((7, 3, 5)).astype(np.float32), (symbols < 5).astype(np.float32)
        goal = rng.standard_normal((7, 3, 4)).astype(np.float32)
        run = lambda keep: recurrent.gru_forward(w, "f", symbols, keep) if kind == "gru" else recurrent.lstm_forward(w, "f", x, live, keep)
        loss = lambda: float((run(False).astype(np.float64) * goal).sum())
        saved = run(True)[1]
        grads = recurrent.gru_backward(w, "f", symbols, saved, goal) if kind == "gru" else recurrent.lstm_backward(w, "f", x, saved, goal)
        for name, g in grads.items():
            for _ in range(6):
                at = tuple(int(rng.integers(n)) for n in g.shape)
                was = w[name][at]
                w[name][at] = was + 1e-3
                up = loss()
                w[name][at] = was - 1e-3
                down = loss()
                w[name][at] = was
                assert abs((up - down) / 2e-3 - g[at]) < 2e-2 * max(1, abs(g[at])), (kind, name, at)
