"""Operator 5: mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks."""

from __future__ import annotations

import heapq
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sketchlark.plans.names import neutral
from sketchlark.plans.running import running_sums
from sketchlark.plans.scratch import settle

WEIGHTS, TOTAL_SHARE, MAX_REPEAT, BLOCK, N_SHARDS, SEED = (5.0, 2.0, 1.0), 1.5, 2, 32, 4, 17
#: Totals by source and shard that the driver plans with; more of them are planned with as a table. Parts of a source's rows then.
AT_DRIVER, SPREAD = 100_000, 32
PLAN = T.StructType([T.StructField(n, k()) for n, k in {"of_source": T.StringType, "of_shard": T.IntegerType, "mix_source_size": T.LongType, "mix_target": T.DoubleType, "mix_blocks": T.LongType, "mix_quota": T.LongType}.items()])
#: A worker cuts so many texts at once.
ROWS = 256
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
WORD = r"[^\x20\x09-\x0D]++"


def capped_targets(sizes: list[int], weights: list[float], total: float, repeat: int = MAX_REPEAT) -> list[float]:
    """Shares of ``total`` by weight; what exceeds ``repeat`` times a size is shared again by weight until nothing does."""
    out, left = [0.0] * len(sizes), min(float(total), float(repeat * sum(sizes)))
    open_ = [i for i, (n, w) in enumerate(zip(sizes, weights)) if n > 0 and w > 0]
    while open_:
        weight = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / weight > repeat * sizes[i]]
        if not over:
            for i in open_:
                out[i] = left * weights[i] / weight
            break
        for i in over:
            out[i] = float(repeat * sizes[i])
        left -= sum(out[i] for i in over)
        gone = set(over)
        open_ = [i for i in open_ if i not in gone]
    return out


def sainte_lague(votes: list[float], seats: int, caps: list[int]) -> list[int]:
    """Seats by the highest quotients votes / (2 k + 1), no more than caps[i] each; ties go to the lower index.

    Starts from the rounded shares, which differ from the answer by few seats, and moves single seats by quotient, so
    the work depends on the number of parties and not on the number of seats.
    """
    seats = min(seats, sum(c for c, v in zip(caps, votes) if v > 0))
    whole = sum(votes)
    if seats <= 0 or whole <= 0:
        return [0] * len(votes)
    got = [min(c, max(0, math.floor(v * seats / whole + 0.5))) if v > 0 else 0 for v, c in zip(votes, caps)]
    given = sum(got)
    up = [(-v / (2 * g + 1), i) for i, (v, g) in enumerate(zip(votes, got)) if v > 0 and g < caps[i]]
    down = [(v / (2 * g - 1), -i) for i, (v, g) in enumerate(zip(votes, got)) if g]
    heapq.heapify(up)
    heapq.heapify(down)

    def move(step: int) -> None:
        i = heapq.heappop(up)[1] if step > 0 else -heapq.heappop(down)[1]
        got[i] += step
        if got[i] < caps[i] and (step > 0):
            heapq.heappush(up, (-votes[i] / (2 * got[i] + 1), i))
        if got[i] and step < 0:
            heapq.heappush(down, (votes[i] / (2 * got[i] - 1), -i))

    for _ in range(abs(seats - given)):
        move(1 if seats > given else -1)
    # Rounding to the nearest is itself a divisor rule only up to the divisor: swap while a quotient outranks a held one.
    while True:
        best = max(((v / (2 * g + 1), -i) for i, (v, g) in enumerate(zip(votes, got)) if v > 0 and g < caps[i]), default=None)
        worst = min(((v / (2 * g - 1), -i) for i, (v, g) in enumerate(zip(votes, got)) if g), default=None)
        if not best or not worst or best <= worst:
            return got
        got[-best[1]] += 1
        got[-worst[1]] -= 1


def plan(totals: list[tuple[str | None, int, int]], block: int = BLOCK, share: float = TOTAL_SHARE, weights: tuple = WEIGHTS, repeat: int = MAX_REPEAT) -> list[tuple]:
    """Quotas from (source, shard, words) rows: (source, shard, source_size, target, blocks, quota)."""
    sizes: dict[str | None, int] = {}
    for source, _, words in totals:
        sizes[source] = sizes.get(source, 0) + words
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    size = [sizes[s] for s in names]
    target = capped_targets(size, [weights[i % len(weights)] for i in range(len(names))], share * sum(size), repeat)
    at = {s: [] for s in names}
    for source, part, words in sorted(totals, key=lambda x: x[1]):
        at[source].append((part, -(-words // block)))
    blocks = [sum(n for _, n in at[s]) for s in names]
    # A source's last block of a shard is short, so votes count blocks at the source's own mean words per block.
    votes = [t * b / n if n else 0.0 for t, b, n in zip(target, blocks, size)]
    quota = sainte_lague(votes, math.floor(sum(votes) + 0.5), [repeat * b for b in blocks])
    out = []
    for s, n, t, q in zip(names, size, target, quota):
        parts = sainte_lague([float(b) for _, b in at[s]], q, [repeat * b for _, b in at[s]])
        out += [(s, part, n, t, b, k) for (part, b), k in zip(at[s], parts)]
    return out


def apportioned(sources: DataFrame, seats: int) -> DataFrame:
    """``sources`` (votes, cap, rank, ...) with quota: ``sainte_lague`` over a table, ties to the lower rank.

    The quotients that win a seat are those from some value on. That value is found by halving an interval, each step one
    sum over the table; of quotients at the value itself the first by rank win what is left.
    """
    sources = sources.withColumn("cap", F.when(F.col("votes") > 0, F.col("cap")).otherwise(0))
    held = lambda q: F.least(F.col("cap"), F.floor((F.col("votes") / F.lit(q) + 1) / 2)).cast("long")
    facts = sources.agg(F.sum("cap").alias("room"), F.max("votes").alias("most"), F.min(F.when(F.col("cap") > 0, F.col("votes") / (2 * F.col("cap") + 1))).alias("least")).first()
    seats = max(0, min(seats, facts["room"] or 0))
    if not seats:
        return sources.withColumn("quota", F.lit(0).cast("long"))
    low, high = facts["least"], 2.0 * facts["most"]  # at low all room is taken, at high none
    given_low, given_high = facts["room"], 0
    while given_low != seats and (middle := (low + high) / 2) not in (low, high):
        given = sources.agg(F.sum(held(middle)).alias("n")).first()["n"]
        low, high, given_low, given_high = (middle, high, given, given_high) if given >= seats else (low, middle, given_low, given)
    if given_low == seats:
        return sources.withColumn("quota", held(low))
    tied = running_sums(sources.withColumns({"quota": held(high), "open": held(low) - held(high)}), [F.col("rank")], {"before": "open"})
    more = F.greatest(F.lit(0), F.least(F.col("open"), F.lit(seats - given_high) - F.col("before")))
    return tied.withColumn("quota", F.col("quota") + more).drop("open", "before")


def planned(totals: DataFrame, block: int, share: float, weights: tuple, repeat: int) -> DataFrame:
    """``plan`` over a table of any number of sources: no source comes to the driver, only sums over all of them do."""
    rows = totals.withColumn("blocks", F.ceil(F.col("words") / block))
    parts = F.sort_array(F.collect_list(F.struct("shard", "blocks")))
    sources = rows.groupBy("source").agg(F.sum("words").alias("size"), F.sum("blocks").alias("blocks"), parts.alias("parts"))
    sources = running_sums(sources.withColumn("one", F.lit(1).cast("long")), [F.col("source").isNull(), F.col("source")], {"rank": "one"})
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.col("rank") % len(weights) + 1).cast("int"))
    sources = settle(sources.withColumn("weight", weight), "sources")
    open_, most = (F.col("size") > 0) & (F.col("weight") > 0), F.col("size") * float(repeat)
    size = sources.agg(F.sum("size").alias("n")).first()["n"] or 0
    # A source is capped if its weight's share at the present level is above its cap; each round raises the level.
    level, capped = 0.0, -1
    while True:
        over = open_ & (most / F.col("weight") < level)
        facts = sources.agg(F.count(F.when(over, 1)).alias("n"), F.sum(F.when(over, most).otherwise(0.0)).alias("fixed"), F.sum(F.when(open_ & ~over, F.col("weight")).otherwise(0.0)).alias("weight")).first()
        if facts["n"] == capped or not facts["weight"]:
            break
        level, capped = (min(share * size, float(repeat * size)) - facts["fixed"]) / facts["weight"], facts["n"]
    target = F.when(~open_, 0.0).when(most / F.col("weight") < level, most).otherwise(F.col("weight") * level)
    sources = settle(sources.withColumn("target", target).withColumns({"votes": F.when(F.col("size") > 0, F.col("target") * F.col("blocks") / F.col("size")).otherwise(0.0), "cap": repeat * F.col("blocks")}), "targets")
    votes = sources.agg(F.sum("votes").alias("n")).first()["n"] or 0.0
    quotas = apportioned(sources, math.floor(votes + 0.5)).select("source", "size", "target", "parts", "quota")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                counts = [p["blocks"] for p in r["parts"]]
                got = sainte_lague([float(n) for n in counts], r["quota"], [repeat * n for n in counts])
                out += [(r["source"], p["shard"], r["size"], r["target"], p["blocks"], k) for p, k in zip(r["parts"], got)]
            cols = list(zip(*out)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(cols, (pa.string(), pa.int32(), pa.int64(), pa.float64(), pa.int64(), pa.int64()))], [f.name for f in PLAN.fields])

    return quotas.mapInArrow(deal, PLAN)


def with_plan(rows: DataFrame, of: str, block: int, share: float, weights: tuple, repeat: int, at_driver: int = AT_DRIVER) -> DataFrame:
    """``rows`` (source column ``of``, shard, mix_size, hash) with the plan's columns of their source and shard.

    Up to ``at_driver`` totals come to the driver and their plan is broadcast; beyond that the plan is a table, and each
    source's rows meet it in SPREAD parts, so that a large source isn't one task's.
    """
    totals = settle(rows.groupBy(F.col(of).alias("source"), "shard").agg(F.sum("mix_size").alias("words")), "totals")
    same = F.col(of).eqNullSafe(F.col("of_source")) & (F.col("shard") == F.col("of_shard"))
    if totals.count() <= at_driver:
        made = plan([tuple(r) for r in totals.select("source", "shard", "words").collect()], block, share, weights, repeat)
        return rows.join(F.broadcast(totals.sparkSession.createDataFrame(made, PLAN)), same)
    spread = settle(planned(totals, block, share, weights, repeat), "plan").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    return rows.join(spread, same & (F.pmod(F.col("hash"), F.lit(SPREAD)) == F.col("salt"))).drop("salt")


def mix(docs: DataFrame, block: int = BLOCK, n_shards: int = N_SHARDS, seed: int = SEED, share: float = TOTAL_SHARE, weights: tuple = WEIGHTS, repeat: int = MAX_REPEAT, key: str = "doc_id", text: str = "text", source: str = "source", keep_text: bool = True, at_driver: int = AT_DRIVER) -> DataFrame:
    """The rows and columns of ``docs`` with mix_size, mix_source_size, mix_target, mix_taken, and mix_start, mix_blocks, mix_quota, mix_offset.

    Each source's words, in a seeded order of its documents, are cut into blocks of ``block`` words within each of
    ``n_shards`` shards (a shard is a seeded hash of key and text). Sainte-Lague gives blocks to sources by their
    targets and then to each source's shards by their blocks. A shard with b blocks and quota q takes each block
    q div b times, and q mod b blocks, spread evenly from a seeded start, once more; a document's words taken are its
    words in each block times that block's count. So no document exceeds ``repeat`` times its size.

    Sources are ranked by code point, null last; null texts and texts without words have size 0 and none taken.
    Repeated rows are rows like others. An empty table gives an empty result. Other columns pass through; columns that
    clash with the added ones are replaced. Without ``keep_text`` the text is null in the result, and so isn't shuffled.
    Reruns agree: all order comes from seeded hashes of key and text.
    """
    added = [f"mix_{x}" for x in ("size", "source_size", "target", "taken", "start", "blocks", "quota", "offset")]
    rows, (k, body, of), back = neutral(docs, key, text, source, without=added)
    size = {"mix_size": F.coalesce(F.regexp_count(F.col(body), F.lit(WORD)), F.lit(0)).cast("long")}
    rows = rows.withColumn("hash", F.xxhash64(F.lit(seed), F.col(k), F.col(body)))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64(F.lit("shard"), "hash"), F.lit(n_shards)).cast("int"))
    if not keep_text:
        rows, size = settle(rows.withColumns(size).withColumn(body, F.lit(None).cast("string")), "words"), {}
    rows = running_sums(rows, [F.col("hash"), F.col(k)], {"mix_start": "mix_size"}, [of, "shard"], size)
    rows = with_plan(rows, of, block, share, weights, repeat, at_driver)
    b, wide = F.col("mix_blocks"), "decimal(38,0)"
    rows = rows.withColumn("mix_offset", F.when(b > 0, F.pmod(F.xxhash64(F.lit(seed), "of_source", "of_shard"), b)).otherwise(0))
    extra = F.when(b > 0, F.col("mix_quota") % b).otherwise(0)

    def extras_before(i):  # of blocks 0 .. i-1, those taken once more: block j is one if ((j + offset) * extra) mod b < extra, in steps
        return F.floor((i + F.col("mix_offset")) * extra.cast(wide) / b) - F.floor(F.col("mix_offset") * extra.cast(wide) / b)

    def words_before(p):  # extra words at positions below p
        i = F.floor(p / F.lit(block)).cast("long")
        return extras_before(i) * block + (p - i * block) * (extras_before(i + 1) - extras_before(i))

    end = F.col("mix_start") + F.col("mix_size")
    taken = F.when(b > 0, F.floor(F.col("mix_quota") / b) * F.col("mix_size") + words_before(end) - words_before(F.col("mix_start"))).otherwise(0)
    return back(rows.withColumn("mix_taken", taken.cast("long")), *added)


def taken_parts(start: int, size: int, block: int, blocks: int, quota: int, offset: int) -> list[tuple[int, int]]:
    """The word ranges of a document that lie in blocks taken once more."""
    extra = quota % blocks if blocks else 0
    out: list[tuple[int, int]] = []
    for i in range(start // block, (start + size - 1) // block + 1) if extra and size else ():
        if (i + 1 + offset) * extra // blocks > (i + offset) * extra // blocks:
            a, b = max(start, i * block) - start, min(start + size, (i + 1) * block) - start
            if out and out[-1][1] == a:
                out[-1] = (out[-1][0], b)
            else:
                out.append((a, b))
    return out


def mixed_texts(docs: DataFrame, block: int = BLOCK, key: str = "doc_id", text: str = "text", source: str = "source", **more) -> DataFrame:
    """The mix as rows with the columns of ``docs``: a row for each whole time that a document is taken, and one whose
    text is its words in blocks taken once more, parts joined by a newline. Documents of which nothing is taken go.
    """
    plain, (k, body, of), back = neutral(docs, key, text, source)
    names, where = plain.columns, plain.columns.index(body)
    rows = mix(plain, block=block, key=k, text=body, source=of, **more).where("mix_taken > 0")
    rows = rows.select(*names, "mix_size", "mix_start", "mix_blocks", "mix_quota", "mix_offset")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                row, texts = [], []
                plans = zip(*(part.column(len(names) + i).to_pylist() for i in range(5)))
                for r, (t, (size, start, blocks, quota, offset)) in enumerate(zip(part.column(where), plans)):
                    t = t.as_py()
                    whole = quota // blocks
                    row += [r] * whole
                    texts += [t] * whole
                    ranges = taken_parts(start, size, block, blocks, quota, offset)
                    if ranges:
                        spans = [m.span() for m in _WORD.finditer(t)]
                        row.append(r)
                        texts.append("\n".join(t[spans[a][0] : spans[b - 1][1]] for a, b in ranges))
                take = pa.array(row, pa.int64())
                cols = [c.take(take) for c in part.columns[: len(names)]]
                cols[where] = pa.array(texts, batch.schema.field(where).type)
                yield pa.RecordBatch.from_arrays(cols, names)

    return back(rows.mapInArrow(cut, plain.schema))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    out = mix(docs, keep_text=False)
    return out.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), F.col("mix_taken").alias("taken"))
