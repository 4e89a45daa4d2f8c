"""Operator 7: token counts by heap-and-linked-list byte-pair merging; no identifiers are made."""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sketchlark.plans.names import neutral, with_fields

LIMIT = 2048
#: Counts of white-space-free pieces are remembered for at most this many pieces of at most so many characters.
REMEMBERED, LONGEST = 400_000, 64


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(other)) for b in range(256)]


class _Words(dict):
    """word -> tokens, remembered like pieces."""

    def __init__(self, merged):
        super().__init__()
        self.merged = merged

    def __missing__(self, word: str) -> int:
        n = self.merged(word)
        if len(word) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = n
        return n


class MergeCounter(dict):
    """piece -> number of tokens, for pieces without white space, filled when asked for.

    Reads a tokenizer file whose model is byte-pair merging with a word-end suffix, whose normalizer is NFC, white space
    to one space, lower case, and whose pre-tokenizer keeps the matches of one pattern and maps bytes to symbols.
    """

    def __init__(self, path: str):
        super().__init__()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kinds = [x["type"] for x in spec["normalizer"]["normalizers"]], [x["type"] for x in spec["pre_tokenizer"]["pretokenizers"]]
        if spec["model"]["type"] != "BPE" or kinds != (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]) or spec["model"]["ignore_merges"]:
            raise ValueError("a lower-casing, NFC, byte-level BPE file is needed")
        self.ranks = {tuple(m if isinstance(m, list) else m.split(" ")): i for i, m in enumerate(spec["model"]["merges"])}
        self.suffix = spec["model"]["end_of_word_suffix"] or ""
        self.words = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.special = re.compile("|".join(re.escape(a["content"]) for a in spec["added_tokens"])) if spec["added_tokens"] else None
        self.symbols = byte_symbols()
        self.memo = _Words(self.merged)

    def merged(self, word: str) -> int:
        """Tokens of one pre-token: its symbols less the merges made, popping the lowest rank, leftmost pair from a heap."""
        symbol = list(word) if word.isascii() else [self.symbols[b] for b in word.encode()]
        if word[0] < "!" or "\x7f" in word or not word.isprintable():
            symbol = [self.symbols[b] for b in word.encode()]
        symbol[-1] += self.suffix
        n = count = len(symbol)
        after, before, ranks = list(range(1, n + 1)), list(range(-1, n - 1)), self.ranks
        heap = [(r, i, symbol[i], symbol[i + 1]) for i in range(n - 1) if (r := ranks.get((symbol[i], symbol[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if symbol[i] != a or j >= n or symbol[j] != b:
                continue  # one of the two has been merged meanwhile
            symbol[i], symbol[j] = a + b, ""
            count -= 1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := ranks.get((symbol[i], symbol[k]))) is not None:
                    heapq.heappush(heap, (r, i, symbol[i], symbol[k]))
            if (h := before[i]) >= 0 and (r := ranks.get((symbol[h], symbol[i]))) is not None:
                heapq.heappush(heap, (r, h, symbol[h], symbol[i]))
        return count

    def __missing__(self, piece: str) -> int:
        plain = unicodedata.normalize("NFC", piece)
        plain = plain.replace("Σ", "σ").lower()  # character by character: no final sigma
        n = sum(map(self.memo.__getitem__, [plain] if plain.isascii() and plain.isalpha() else self.words.findall(plain)))
        if len(piece) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
            self[piece] = n
        return n

    def count(self, text: str) -> int:
        if self.special is not None and self.special.search(text):
            parts = self.special.split(text)
            return len(parts) - 1 + sum(map(self.count, parts))
        # str.split() also splits at x1c-x1f, which aren't white space for the pattern.
        pieces = text.split() if not _SEPARATORS.search(text) else regex.split(r"\s+", text)
        return sum(map(self.__getitem__, pieces))


_SEPARATORS = re.compile("[\x1c-\x1f]")
_counters: dict[str, MergeCounter] = {}


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT, text: str = "text") -> DataFrame:
    """``docs`` with n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit) of every whole text.

    ``path`` is a tokenizer file that executors can read. A null or empty text has 0 of both. Strings of special tokens
    inside a text count as one token each. Repeated rows are counted like others, an empty table gives an empty result.
    Columns that clash with the added ones are replaced.
    """
    rows, (body,), back = neutral(docs, text, without=["n_bytes", "n_tokens", "over_limit"])
    where = rows.columns.index(body)
    rows = rows.withColumn("n_bytes", F.coalesce(F.octet_length(body), F.lit(0)).cast("long"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counters.get(path) or _counters.setdefault(path, MergeCounter(path))
        for batch in batches:
            texts = batch.column(where)
            n = np.fromiter((counter.count(t.as_py() or "") for t in texts), np.int64, len(texts))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n)], [*batch.schema.names, "n_tokens"])

    out = rows.mapInArrow(count, with_fields(rows, "n_tokens long"))
    return back(out, "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op7_tokens(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return count_tokens(docs, str(path)).select("doc_id", "n_bytes", "n_tokens", "over_limit")
