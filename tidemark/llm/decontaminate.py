"""Benchmark decontamination by greedy string tiling.

Texts are sequences of words (runs of word characters, lower case). Documents that share a run of SEED
words with a benchmark item are tiled against it: the longest runs that both have and that aren't marked yet are
found by running Karp-Rabin hashes, checked word by word, and marked, until none of SEED words is left.
A passage whose parts were put in another order thus still has its words marked. The share of the item's
words that are marked is its coverage; a document that covers an item to THRESHOLD or more is contaminated.

The benchmark is a stated query set: it is sent to every executor in blocks of at most BLOCK_BYTES of text,
and each block is held against all documents; nothing is shuffled.

Defined results: a null or empty text is clean; an item of fewer than SEED words is matched whole: its words, all of
them, must stand in the text in one run, and an item of a single word must be all that the text says, for a common word stands
in any text; items without words match nothing; repeated items each count; of equally covered items the one with the lowest id is
named first; an empty benchmark leaves all documents clean; repeated rows get equal results; very long texts are searched whole;
where the table has a column of the result's name, the result's name is lengthened by underscores.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import free_name, prepare, text_or_empty

SEED, THRESHOLD = 5, 0.6
BLOCK_BYTES = 16 << 20
_WORD = re.compile(r"\w+")
_BASE = np.uint64(0x9E3779B97F4A7C15)
HITS = "array<struct<item_id:bigint,coverage:double,tiles:int,words:int>>"


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _run_hashes(codes: np.ndarray, width: int) -> np.ndarray:
    """Karp-Rabin hashes of all runs of so many codes, by doubling."""
    h, power, have = codes.astype(np.uint64) + np.uint64(1), _BASE, 1
    out, filled = None, 0
    with np.errstate(over="ignore"):
        while True:
            if width & have:
                if out is None:
                    out, filled = h, have
                else:
                    n = len(codes) - filled - have + 1
                    out = out[:n] * power + h[filled : filled + n]
                    filled += have
            if filled == width:
                return out[: len(codes) - width + 1]
            h = h[:-have] * power + h[have:]
            power, have = power * power, 2 * have


def _matches(item: np.ndarray, text: np.ndarray, free_item: np.ndarray, free_text: np.ndarray, width: int):
    """(length, item place, text place) of maximal unmarked runs of at least width codes that both have."""
    open_at = lambda free: np.flatnonzero(np.convolve(free, np.ones(width, dtype=np.int64), "valid") == width)
    a, b = open_at(free_item), open_at(free_text)
    if not len(a) or not len(b):
        return []
    left, right = _run_hashes(item, width)[a], _run_hashes(text, width)[b]
    b = b[np.isin(right, left)]
    table: dict[int, list[int]] = {}
    for place, h in zip(a.tolist(), left.tolist(), strict=True):
        table.setdefault(h, []).append(place)
    found, n, m = [], len(item), len(text)
    reach: dict[int, int] = {}  # by diagonal: the text place up to which a match already goes
    for place, h in zip(b.tolist(), _run_hashes(text, width)[b].tolist() if len(b) else (), strict=True):
        for start in table[h]:
            if place < reach.get(place - start, 0):
                continue
            k = 0
            while start + k < n and place + k < m and free_item[start + k] and free_text[place + k] and item[start + k] == text[place + k]:
                k += 1
            if k >= width:
                reach[place - start] = place + k
                found.append((k, start, place))
    return found


def tiles(item: np.ndarray, text: np.ndarray, least: int = SEED) -> list[tuple[int, int, int]]:
    """Greedy tiling: (length, item place, text place) of runs that don't overlap, the longest first."""
    free_item, free_text = np.ones(len(item), dtype=np.int64), np.ones(len(text), dtype=np.int64)
    made, width = [], max(least, min(len(item), 20))
    while True:
        found = sorted(_matches(item, text, free_item, free_text, width), key=lambda x: (-x[0], x[1], x[2]))
        if found and found[0][0] > 2 * width:
            width = found[0][0]  # far longer runs are there: mark those first
            continue
        left = False
        for k, start, place in found:
            if free_item[start : start + k].all() and free_text[place : place + k].all():
                free_item[start : start + k] = 0
                free_text[place : place + k] = 0
                made.append((k, start, place))
            else:
                left = True  # what is left of it may still be long enough
        if left:
            continue
        if width == least:
            return made
        width = max(least, width // 2)


class Benchmark:
    """A block of items: their words as codes, and which items have each seed."""

    def __init__(self, items: list[tuple[int, str]], seed: int = SEED):
        self.seed, self.codes = seed, {}
        split = [(i, words_of(t)) for i, t in items]
        self.items = [(i, np.array([self.codes.setdefault(w, len(self.codes) + 1) for w in ws], dtype=np.int64)) for i, ws in split if len(ws) >= seed]
        self.short: dict[tuple[int, ...], list[int]] = {}  # items of fewer words, by their codes
        for i, ws in split:
            if 0 < len(ws) < seed:
                self.short.setdefault(tuple(self.codes.setdefault(w, len(self.codes) + 1) for w in ws), []).append(i)
        hashes = [_run_hashes(codes, seed) for _, codes in self.items]
        flat = np.concatenate(hashes) if hashes else np.zeros(0, dtype=np.uint64)
        owner = np.repeat(np.arange(len(hashes)), [len(h) for h in hashes]) if hashes else np.zeros(0, dtype=np.int64)
        order = np.argsort(flat, kind="stable")
        self.seeds, self.owner = flat[order], owner[order]
        self.bits = np.zeros(1 << 20, dtype=bool)
        self.bits[self.seeds >> np.uint64(44)] = True

    def hits(self, text: str, threshold: float) -> list[dict]:
        get = self.codes.get
        codes = np.array([get(w, 0) for w in words_of(text)], dtype=np.int64)
        out = self._whole(codes) if self.short else []
        return sorted(out + self._tiled(codes, threshold), key=lambda x: (-x["coverage"], x["item_id"]))

    def _whole(self, codes: np.ndarray) -> list[dict]:
        """Items of fewer words than a seed whose words stand here in one run."""
        listed, found = codes.tolist(), set()
        for width in {len(x) for x in self.short}:
            runs = [tuple(listed)] if width == 1 else zip(*(listed[i:] for i in range(width)), strict=False)
            found.update(r for r in runs if r in self.short)
        return [{"item_id": i, "coverage": 1.0, "tiles": 1, "words": len(r)} for r in found for i in self.short[r]]

    def _tiled(self, codes: np.ndarray, threshold: float) -> list[dict]:
        if len(codes) < self.seed or not len(self.seeds):
            return []
        known = np.concatenate([[0], np.cumsum(codes > 0)])
        at = np.flatnonzero(known[self.seed :] - known[: -self.seed] == self.seed)
        if not len(at):
            return []
        runs = _run_hashes(codes, self.seed)[at]
        runs = np.unique(runs[self.bits[runs >> np.uint64(44)]])
        low, high = np.searchsorted(self.seeds, runs), np.searchsorted(self.seeds, runs, side="right")
        candidates = sorted({int(o) for a, b in zip(low.tolist(), high.tolist(), strict=True) for o in self.owner[a:b]})
        out = []
        for c in candidates:
            number, item = self.items[c]
            made = tiles(item, codes, self.seed)
            covered = sum(k for k, _, _ in made)
            if covered >= threshold * len(item):
                out.append({"item_id": number, "coverage": covered / len(item), "tiles": len(made), "words": covered})
        return out


def _blocks(benchmark: DataFrame, limit: int):
    """The items in blocks of about `limit` bytes of text at most."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), text_or_empty().alias("text"))
    total = items.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0))).first()[0]
    count = max(1, -(-total // limit))
    for b in range(count):
        part = items if count == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == b)
        yield [(r.item_id, r.text) for r in part.orderBy("item_id", "text").collect()]


def with_hits(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, column: str = "hits", limit: int = BLOCK_BYTES) -> DataFrame:
    """docs with one more column, the last: the items that each text covers, the best covered first."""
    spark = docs.sparkSession
    prepare(spark)
    column = free_name(column, docs)
    place = docs.columns.index("text")
    out = docs.withColumn(column, F.array().cast(HITS))
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("coverage", pa.float64()), ("tiles", pa.int32()), ("words", pa.int32())]))
    schema = T.StructType(list(out.schema.fields))
    for items in _blocks(benchmark, limit):
        shared = spark.sparkContext.broadcast(items)

        def hold(batches, shared=shared):
            block = Benchmark(shared.value)
            for batch in batches:
                found = [h + block.hits(t, threshold) if t else h for t, h in zip(batch.column(place).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True)]
                found = [sorted(h, key=lambda x: (-x["coverage"], x["item_id"])) for h in found]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, kind)], names=batch.schema.names)

        out = out.mapInArrow(hold, schema)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that aren't contaminated, all columns as they are."""
    column = free_name("__hits", docs)
    return with_hits(docs, benchmark, threshold, column).filter(F.size(column) == 0).drop(column)


def op2_string_tiling_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    best = F.col("hits")[0]
    return with_hits(docs, benchmark).withColumn("best", F.when(F.size("hits") > 0, best)).select(
        "doc_id",
        F.col("best").isNotNull().alias("contaminated"),
        F.col("best.item_id").alias("item_id"),
        F.coalesce(F.round("best.coverage", 6), F.lit(0.0)).alias("coverage"),
        F.coalesce("best.tiles", F.lit(0)).alias("n_tiles"),
        F.transform("hits", lambda h: h["item_id"]).alias("item_ids"),
    )
