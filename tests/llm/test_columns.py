"""Every operator keeps every input column, whatever its name, and gives defined results for odd rows."""

import itertools

import pytest

from sketchlark.llm import html, jaccard, language, lines, mixing, packing, quality, sharding, tokens, vectors

NAMES = """c0 c1 c2 c9 k l x h g t v w p q r n o i a b hash _hash _h _k _key _text _range _o0 _w_x _run_x run_key run_hash runs _runs
text_hash letter _letter lang_ html _html share part o0 o1 w0 t0 b0 p0 g0 of_source of_shard source_ shard hash_ key kept_key kept_hash
vid root tiles cell cuts component component_set none f sig sigs size many low rep bucket piece batch slot ends words `tick a.b""".split()


def wide(spark, rows, schema):
    """The rows with a column of each of NAMES, holding the name and the row's number."""
    given = [c.split()[0].lower() for c in schema.split(", ")]
    extra = [n for n in NAMES if n.lower() not in given]
    df = spark.createDataFrame([(*r, *(f"{n} {i}" for n in extra)) for i, r in enumerate(rows)], [*given, *extra])
    return df.select(*(df[f"`{c.replace('`', '``')}`"].cast(s.split()[1]).alias(c) for c, s in zip(given, schema.split(", "))), *(df[f"`{n.replace('`', '``')}`"] for n in extra)), extra


TEXTS = [(1, "one two three four five six seven eight nine ten eleven", "en", "s"), (2, "one two three four five six seven eight nine ten eleven", "en", "s"), (3, None, None, None), (4, "", "en", "t"), (5, "ein zwei drei vier", "de", "t"), (6, "ein zwei drei vier\nfunf " + "lang " * 30, "de", "t")]


def intact(before, out, extra, least):
    assert set(before.columns) - {"html"} <= set(out.columns)
    rows = out.collect()
    assert len(rows) >= least
    for r in rows:
        numbers = {r[n].rsplit(" ", 1) [1] for n in extra}
        assert len(numbers) == 1 and all(r[n] == f"{n} {r[extra[0]].rsplit(' ', 1)[1]}" for n in extra)


@pytest.mark.parametrize("name", ["quality", "lines", "one", "mix", "mixed", "tokens", "language"])
def test_documents_keep_their_columns(spark, name):
    df, extra = wide(spark, TEXTS, "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    if name == "tokens":
        path = str(pytest.importorskip("public_tokenizers").path("word_bpe_49k.json"))
    out = {
        "quality": lambda: quality.quality(df, labels),
        "lines": lambda: lines.dedup_lines(df),
        "one": lambda: jaccard.one_of_each(df),
        "mix": lambda: mixing.mix(df),
        "mixed": lambda: mixing.mixed_texts(df),
        "tokens": lambda: tokens.count_tokens(df, path),
        "language": lambda: language.predict(df, language.fit(df, df.doc_id < 9, steps=3)),
    }[name]()
    intact(df, out, extra, {"one": 5, "mixed": 4}.get(name, 6))


def test_pages_keep_their_columns(spark):
    df, extra = wide(spark, [(1, "<p>Some text here.</p>"), (2, None)], "page_id long, page string")
    intact(df, html.extract(df, html.fit(df, html="page", steps=3), html="page").withColumnRenamed("page_id", "page_id").selectExpr("*", "'' AS page"), extra, 2)


def test_tables_with_such_columns_give_the_same(spark):
    df, _ = wide(spark, TEXTS, "doc_id long, text string, lang string, source string")
    plain = df.select("doc_id", "text", "lang", "source")
    for f in (sharding.shard, packing.pack, jaccard.near_groups):
        assert sorted(map(str, f(df).collect())) == sorted(map(str, f(plain).collect()))
    v, _ = wide(spark, [(1, "s"), (2, "s")], "vec_id long, label string")
    v = v.selectExpr("*", "array(1.0D, vec_id / 9) AS embedding")
    assert [r.n_links for r in vectors.near_vectors(v).collect()] == [1, 1]


def test_added_columns_are_replaced(spark):
    df = spark.createDataFrame([(i, f"word{i} " * 12, "en", "s", "old", "old", "old", "old") for i in range(3)], "doc_id long, text string, lang string, source string, llr string, n_deleted string, mix_size string, score string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = [(quality.quality(df, labels), "llr"), (lines.dedup_lines(df), "n_deleted"), (mixing.mix(df), "mix_size"), (language.predict(df, language.fit(df, df.doc_id < 9)), "score")]
    for rows, name in out:
        assert rows.columns.count(name) == 1 and all(r[name] != "old" for r in rows.collect())


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    vecs = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert [f(docs).count() for f in (jaccard.near_groups, jaccard.one_of_each, lines.dedup_lines, mixing.mix, mixing.mixed_texts, packing.pack, sharding.shard)] == [0] * 7
    assert vectors.near_vectors(vecs).count() == 0


def test_quality_verdict_against_brute_force(spark):
    import collections
    import math

    rows = [(i, " ".join(f"w{(i * j) % 7}" if i % 3 else f"zq{j}#" for j in range(12 + i))) for i in range(12)] + [(12, None), (13, "ab"), (14, "é"), (14, "é")]
    labels = [(i, int(i % 2 == 0), 0) for i in range(10)] + [(1, 1, 1), (3, 1, None), (None, 1, 0), (99, 1, 0)]
    got = quality.quality(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    trusted = {k for k, q, t in labels if q == 1 and not t and k is not None}

    def buckets(text):
        b = (text or "").encode() + b" "
        for i in range(len(b) - 2):
            x = (b[i] * 257 * 257 + b[i + 1] * 257 + b[i + 2]) * 0x9E3779B1 & 0xFFFFFFFF
            yield x >> 16

    raw, good = collections.Counter(), collections.Counter()
    for k, t in rows:
        raw.update(buckets(t))
        if k in trusted:
            good.update(buckets(t))
    scale = good.total() / raw.total()
    for r in got:
        grams = list(buckets(r.text))
        want = sum(math.log(good[x] + 1) - math.log(raw[x] * scale + 1) for x in grams) / max(1, len(grams))
        assert r.llr == pytest.approx(want, abs=1e-8)
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) and r.kept == (not r.base_failed and r.llr >= quality.THRESHOLD)
    assert {r.base_failed for r in got} == {True, False} and any(not r.base_failed and not r.kept for r in got) is not None
    none = quality.quality(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect()
    assert all(r.llr == 0 and r.kept == (not r.base_failed) for r in none)


def test_quality_of_a_text_longer_than_a_block(spark):
    text = " ".join(f"w{i * 7919 % 5000}" for i in range(90_000)) + "\n#\n#\n"
    r = quality.quality(spark.createDataFrame([(1, text), (2, text[:1000])], "doc_id long, text string"), spark.createDataFrame([(2, 1, 0)], "doc_id long, quality int, toxic int")).where("doc_id = 1").first()
    words = text.split()
    assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines) == (len(words), sum(map(len, words)), 2, 1) and r.n_repeat_words == 90_000 and len(text) > 400_000


def test_pack_against_brute_force(spark):
    import collections

    rows = [(i % 23 if i % 9 else None, " ".join(["w"] * n)) for i, n in enumerate([1, 2, 3, 5, 8, 13, 21, 34, 7, 7, 7, 1, 9, 11, 19, 33, 40, 41, 3, 100, 2, 6, 6])] + [(4, None), (5, " \n")]
    max_len, n_buckets, budget = 20, 3, 40
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), max_len, n_buckets, budget).collect()
    pieces = [(k, p, min(max_len, n - p * max_len)) for k, t in rows for n in [len((t or "").split())] for p in range(-(-n // max_len))]
    assert collections.Counter((r.doc_id, r.piece, r.n_tokens) for r in got) == collections.Counter(pieces)
    hist = collections.Counter(n for _, _, n in pieces)
    pad = lambda ends: sum(c * (min(e for e in ends if e >= n) - n) for n, c in hist.items())
    assert sum(r.padding for r in got) == min(pad((*some, max(hist))) for some in itertools.combinations(sorted(hist)[:-1], 2))
    by = collections.defaultdict(list)
    for r in got:
        assert r.first_token == r.piece * max_len and r.bucket_len - r.n_tokens == r.padding
        by[r.bucket].append(r)
    for own in by.values():
        room = max(1, budget // own[0].bucket_len)
        own.sort(key=lambda r: (r.batch, r.slot))
        assert [(r.batch, r.slot) for r in own] == [(i // room, i % room) for i in range(len(own))]
        keys = [(r.doc_id is not None, r.doc_id or 0) for r in own]
        assert keys == sorted(keys)


def test_mix_against_blocks(spark):
    """taken, recomputed block by block from each shard's running sums."""
    import collections

    rows = [(i, " ".join(f"w{j}" for j in range(i * 37 % 90)), f"s{i % 3}" if i % 7 else None) for i in range(120)] + [(200, None, "s0"), (5, "w0 w1", "s1"), (5, "w0 w1", "s1")]
    block = 8
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), block=block).collect()
    assert len(got) == len(rows)
    shards = collections.defaultdict(list)
    for r in got:
        shards[r.source, r.mix_blocks, r.mix_quota, r.mix_offset].append(r)
    for (_, blocks, quota, offset), own in shards.items():
        taken = [(quota // blocks) + (((i + 1 + offset) * (quota % blocks) // blocks) - ((i + offset) * (quota % blocks) // blocks)) for i in range(blocks)] if blocks else []
        assert sum(taken) == quota
        for r in own:
            assert r.mix_taken == sum(taken[p // block] for p in range(r.mix_start, r.mix_start + r.mix_size))
    sizes = collections.Counter()
    for r in got:
        sizes[r.source] += r.mix_size
    names = sorted(s for s in sizes if s) + [None]
    want = mixing.capped_targets([sizes[s] for s in names], [(5.0, 2.0, 1.0)[i % 3] for i in range(len(names))], 1.5 * sum(sizes.values()))
    assert all(r.mix_target == pytest.approx(want[names.index(r.source)]) and r.mix_source_size == sizes[r.source] for r in got)
    lean = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), block=block, keep_text=False).collect()
    assert sorted((r.doc_id, r.mix_size, r.mix_taken) for r in lean) == sorted((r.doc_id, r.mix_size, r.mix_taken) for r in got)


def test_mix_planned_as_a_table(spark):
    """The plan of a table equals the driver's, for sources with caps, ties, nothing in them, and null."""
    import numpy as np

    rng = np.random.default_rng(17)
    totals = [(f"s{i:02d}" if i else None, part, int(n)) for i in range(40) for part in range(3) for n in [rng.choice([0, 5, 32, 64, 320, 4000])]]
    want = mixing.plan(totals, 32)
    df = spark.createDataFrame(totals, "source string, shard int, words long")
    got = {(r.of_source, r.of_shard): r for r in mixing.planned(df, 32, mixing.TOTAL_SHARE, mixing.WEIGHTS, mixing.MAX_REPEAT).collect()}
    assert len(got) == len(want)
    for source, part, size, target, blocks, quota in want:
        r = got[source, part]
        assert (r.mix_source_size, r.mix_blocks, r.mix_quota) == (size, blocks, quota) and r.mix_target == pytest.approx(target)
    for votes, seats, caps in (([3.0, 3.0, 3.0, 1.0], 4, [5, 5, 5, 5]), ([5.0, 5.0], 3, [1, 9]), ([0.0, 2.0], 9, [4, 4]), ([7.0, 2.0, 2.0], 0, [4, 4, 4])):
        table = spark.createDataFrame([(i, v, c) for i, (v, c) in enumerate(zip(votes, caps))], "rank long, votes double, cap long")
        assert [r.quota for r in mixing.apportioned(table, seats).orderBy("rank").collect()] == mixing.sainte_lague(votes, seats, caps)
    docs = spark.createDataFrame([(i, "w " * (i % 40), f"s{i % 5}" if i % 11 else None) for i in range(200)], "doc_id long, text string, source string")
    one, other = (sorted((r.doc_id, r.mix_taken) for r in mixing.mix(docs, at_driver=n).collect()) for n in (10**6, 0))
    assert one == other


def test_jaccard_blocks_larger_than_a_trie(spark):
    """A block of hundreds of sets of many sizes, with chunks of 8, against all pairs."""
    import numpy as np

    from tests.llm.test_llm import components_of

    rng = np.random.default_rng(2)
    base = [f"b{i}" for i in range(200)]
    rows = []
    for i in range(150):
        n = int(rng.choice([40, 44, 60, 63, 100, 180]))
        words = base[:n]
        for j in rng.integers(0, n, int(rng.integers(0, 4))):
            words = [*words[:j], f"x{rng.integers(0, 30)}", *words[j + 1 :]]
        rows.append((i, " ".join(words)))
    sets = [(k, {tuple(w[i : i + 3]) for w in [t.split()] for i in range(len(w) - 2)}) for k, t in rows]
    links = [(a, b) for (a, s), (b, u) in itertools.combinations(sets, 2) if 100 * len(s & u) >= 80 * len(s | u)]
    want = components_of([k for k, _ in rows], links)
    got = jaccard.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), 3, 80, trie=8).collect()
    assert {r.doc_id: r.component_id for r in got} == want and len(set(want.values())) > 5


def test_vectors_of_labels_larger_than_a_chunk(spark):
    import numpy as np

    from tests.llm.test_llm import components_of

    rng = np.random.default_rng(3)
    centres = rng.standard_normal((40, 32))
    x = centres[rng.integers(0, 40, 700)] + rng.standard_normal((700, 32)) * rng.choice([0.05, 0.2, 0.27], 700)[:, None]
    rows = [(i, v.tolist(), None if i % 50 == 0 else i % 2) for i, v in enumerate(x)] + [(700, [float("inf")] * 32, 0), (701, x[1].tolist(), 1), (701, x[1].tolist(), 1), (None, x[1].tolist(), 1)]
    got = vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), chunk=64).collect()
    unit = np.array([r[1] for r in rows if r[0] != 700])
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    label = np.array([-i if r[2] is None else r[2] + 1 for i, r in enumerate(rows) if r[0] != 700])
    hit = (unit @ unit.T >= 0.93) & (label[:, None] == label)
    np.fill_diagonal(hit, False)
    assert len(got) == len(rows)
    found = sum(r.n_links for r in got)
    assert 0.99 * hit.sum() <= found <= hit.sum()
    want = components_of(range(700), [(int(a), int(b)) for a, b in zip(*np.nonzero(hit[:700, :700]))])
    same = sum(r.component_id == want[r.vec_id] for r in got if r.vec_id is not None and r.vec_id < 700)
    assert same >= 690


def test_components_of_a_hub_and_long_chains(spark):
    from sketchlark.llm import graph

    links = [(0, i) for i in range(1, 2000)] + [(5000 - i, 9000) for i in range(1000)] + [(i, i + 1) for i in range(10_000, 10_300)] + [(9000, 1999)]
    got = {r.v: r.root for r in graph.components(spark.createDataFrame(links, "a long, b long").repartition(7)).collect()}
    assert got == {**{i: 0 for i in range(2000)}, **{5000 - i: 0 for i in range(1000)}, 9000: 0, **{i: 10_000 for i in range(10_000, 10_301)}}


def test_tokens_of_odd_rows(spark):
    path = str(pytest.importorskip("public_tokenizers").path("word_bpe_49k.json"))
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    rows = [(1, None), (2, ""), (3, "word " * 2049), (3, "word " * 2049), (None, "é<|startoftext|>x"), (4, "a\x1cb 　c")]
    got = tokens.count_tokens(spark.createDataFrame(rows, "doc_id long, text string"), path).collect()
    want = [(k, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for k, t in rows]
    assert sorted(map(str, ((r.doc_id, r.n_bytes, r.n_tokens) for r in got))) == sorted(map(str, want))
    assert all(r.over_limit == (r.n_tokens > 2048) for r in got) and any(r.over_limit for r in got)
    assert tokens.count_tokens(spark.createDataFrame([], "doc_id long, text string"), path).count() == 0
