"""The stages of the corpus pipeline, each on its own input, and all of them in a row."""

import collections
import itertools
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sketchlark.llm import mixing, packing, quality
from sketchlark.plans import batches

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


VOCABULARY = [f"{a}{b}{c}" for a in "ba ko mi su".split() for b in "la ren to vi".split() for c in ("", "n", "s", "ta")]


def sentence(rng, n, letters=""):
    if letters:
        return " ".join("".join(rng.choice(list(letters), int(rng.integers(2, 8)))) for _ in range(n))
    return " ".join(rng.choice(VOCABULARY, n))


def rows_of(spark, rows):
    return spark.createDataFrame([(k, t, "en", s, len(t) if t is not None else None) for k, t, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = np.random.default_rng(21)
    passage = "\n".join(sentence(rng, 15) for _ in range(5))
    rows = [(i, sentence(rng, 40) + "\n" + sentence(rng, 30), f"s{i % 3}") for i in range(30)]
    rows += [(30 + i, f"{sentence(rng, 20)}\n{passage}\n{sentence(rng, 20)}", "s0") for i in range(4)]
    rows += [(40 + i, rows[i][1] + (" end" if i % 2 else ""), "s1") for i in range(6)]
    rows += [(50, "too short", "s2"), (51, sentence(rng, 4) + " a b c d e" * 20, "s2"), (52, "#%&| " * 30 + sentence(rng, 20, "#%&|<>$"), "s1")]
    rows += [(53, None, "s0"), (54, "", None), (55, " \n", "s1"), (None, sentence(rng, 50), None), (3, rows[3][1], "s0"), (3, sentence(rng, 40), "s0")]
    folder = tmp_path_factory.mktemp("corpus")
    rows_of(spark, rows).write.parquet(str(folder / "documents.parquet"))
    labels = [(i, 1, 0) for i in range(0, 30, 2)] + [(52, 0, 0), (51, 1, 1), (None, 1, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(folder / "labels.parquet"))
    return rows, str(folder)


def read(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_quality_stage(spark, corpus):
    rows, folder = corpus
    kept = corpus_pipeline.quality_rules(spark, read(spark, folder), folder)
    assert kept.columns == corpus_pipeline.COLUMNS
    scored = quality.quality(read(spark, folder), spark.read.parquet(f"{folder}/labels.parquet")).collect()
    assert collections.Counter((r.doc_id, r.text) for r in kept.collect()) == collections.Counter((r.doc_id, r.text) for r in scored if r.kept)
    gone = {k for k, _, _ in rows} - {r.doc_id for r in kept.collect()}
    assert gone == {50, 51, 52, 53, 54, 55}


def test_line_stage(spark, corpus):
    rows, folder = corpus
    out = corpus_pipeline.line_dedup(spark, read(spark, folder), folder)
    assert out.columns == corpus_pipeline.COLUMNS and out.count() == len(rows)
    texts = {r.doc_id: r for r in out.collect() if r.doc_id != 3}
    passage = rows[30][1].split("\n")[1:6]
    assert texts[30].text == rows[30][1]
    for i in (31, 32, 33):
        own = rows[i][1].split("\n")
        assert texts[i].text == f"{own[0]}\n{own[6]}" and not set(passage) & set(texts[i].text.split("\n"))
    assert all(r.n_chars == (len(r.text) if r.text is not None else None) for r in texts.values())
    assert all(texts[i].text == "" for i in (40, 42, 44)) and texts[53].text is None


def test_near_duplicate_stage_against_all_pairs(spark, corpus):
    rows, folder = corpus
    out = corpus_pipeline.near_duplicates(spark, read(spark, folder), folder)
    assert out.columns == corpus_pipeline.COLUMNS
    given = [(k, t) for k, t, _ in rows]
    sets = []
    for _, t in given:
        w = [x.lower() for x in words(t)]
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    group = list(range(len(given)))
    for i, j in itertools.combinations(range(len(given)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
            a, b = sorted((group[i], group[j]))
            group = [a if g == b else g for g in group]
    groups = collections.defaultdict(list)
    for g, (k, t) in zip(group, given):
        groups[g].append((k, t))
    kept = collections.Counter((r.doc_id, r.text) for r in out.collect())
    assert kept.total() == len(groups)
    for own in groups.values():
        least = min((k for k, _ in own if k is not None), default=None)
        assert sum(kept[x] > 0 for x in set(own)) == 1 and any(kept[x] for x in own if x[0] == least)


def test_mixing_stage(spark, corpus):
    rows, folder = corpus
    out = corpus_pipeline.mixing(spark, read(spark, folder), folder)
    assert out.columns == corpus_pipeline.COLUMNS
    taken = collections.Counter()
    for r in mixing.mix(read(spark, folder)).collect():
        taken[r.doc_id, r.source] += r.mix_taken
    found = collections.Counter()
    for r in out.collect():
        found[r.doc_id, r.source] += len(words(r.text))
        assert r.n_chars == len(r.text) and r.text
    assert found == +taken
    by = collections.defaultdict(set)
    for k, t, _ in rows:
        by[k] |= set(words(t))
    assert all(set(words(r.text)) <= by[r.doc_id] for r in out.collect())


def test_packing_stage(spark, corpus):
    _, folder = corpus
    rows = sorted(map(str, corpus_pipeline.packing(spark, read(spark, folder), folder).collect()))
    assert rows == sorted(map(str, packing.pack(read(spark, folder)).collect())) and len(rows) > 40


def test_run_is_the_stages_in_a_row(spark, corpus, tmp_path):
    _, folder = corpus
    docs = read(spark, folder)
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
    cols = ["doc_id", "piece", "first_token", "n_tokens", "bucket_len", "padding"]
    count = lambda df: collections.Counter(map(tuple, df.select(cols).collect()))
    assert count(corpus_pipeline.run(spark, folder)) == count(docs)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "near duplicates", "mixing", "packing"]


def test_stages_on_nothing_and_on_blanks(spark, corpus):
    _, folder = corpus
    none = rows_of(spark, [])
    blank = rows_of(spark, [(1, None, None), (None, None, "s"), (2, "", "s"), (2, "", "s")])
    left = {"quality rules": 0, "line dedup": 4, "near duplicates": 4, "mixing": 0, "packing": 0}
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, folder).count() == 0
        assert stage(spark, blank, folder).count() == left[name], name


@pytest.mark.parametrize("stage", [s for name, s in corpus_pipeline.STAGES if name != "packing"])
def test_stages_bound_the_bytes_of_a_batch(spark, corpus, stage):
    _, folder = corpus
    before = spark.conf.get(batches.LIMIT, None)
    spark.conf.unset(batches.LIMIT)
    try:
        stage(spark, read(spark, folder), folder)
        long = spark.range(0, 3000, 1, 1).select(F.repeat(F.lit("abcd"), 2000).alias("t"))
        sizes = long.mapInArrow(lambda b: (pa.RecordBatch.from_arrays([pa.array([x.nbytes])], ["n"]) for x in b), "n long").collect()
        assert sum(r.n for r in sizes) > 3000 * 8000 and max(r.n for r in sizes) < 5_000_000
        spark.conf.set(batches.LIMIT, 1 << 20)
        stage(spark, read(spark, folder), folder)
        assert int(spark.conf.get(batches.LIMIT)) == 1 << 20
    finally:
        spark.conf.unset(batches.LIMIT)
        if before is not None:
            spark.conf.set(batches.LIMIT, before)
