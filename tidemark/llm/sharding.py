"""Sharding by longest-processing-time scheduling.

Rows with equal texts form a group that stays together. Groups, sorted by size, go to the
least-loaded shard through a heap, every one of them by its own size.

What the driver holds is one number of groups for each size. Sizes that differ add up to all bytes at most, so there are no
more than sqrt(2 * bytes) of them, however many groups there are. Groups of one size are dealt by the heap in whole
rounds where it would do nothing else, so placing a million equal groups takes a few steps and gives what
placing them one by one gives. Within a size groups are numbered in the cluster, and a group's number tells its shard.

Defined results: a null text equals an empty one; an empty table gives no rows; repeated rows (same
doc_id, same text) each get a slot of their own; ties go to the lower shard number; a single group
heavier than a shard's fair share stays whole, so that shard is then larger than the rest; groups are told apart by the
MD5 digest of their text, very long texts too; doc_ids may be of any type; other columns are left out.
"""

from __future__ import annotations

import heapq

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import joined_groups, text_or_empty, written

#: Rows of one shard, and groups of one size, are numbered in cells of about so many.
CELL_ROWS = 200_000
OVERHEAD = 8


def deal(heap: list[tuple[int, int]], size: int, count: int) -> list[tuple[int, int]]:
    """Give count items of one size to a heap of (load, shard); returns runs (shard, items) in the order of dealing."""
    runs = []
    while count:
        # The shards that each get one item before any of them gets a second, and the first that gets none.
        line, turn = [], (heap[0][0] + size, heap[0][1])
        while heap and heap[0] < turn:
            line.append(heapq.heappop(heap))
        rounds = count // len(line)
        if heap and rounds > 1:
            (load, shard), (other, last) = line[-1], heap[0]
            rounds = min(rounds, (other - load - (shard > last)) // size + 1)
        if rounds > 1:
            runs += [(shard, rounds) for _, shard in line]
            line = [(load + rounds * size, shard) for load, shard in line]
            count -= rounds * len(line)
        else:
            first = line[:count]
            runs += [(shard, 1) for _, shard in first]
            line[: len(first)] = [(load + size, shard) for load, shard in first]
            count -= len(first)
        for entry in line:
            heapq.heappush(heap, entry)
    return runs


def schedule(sizes: list[tuple[int, int]], shards: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Longest processing time first: (size, number of groups) to (size, runs of (shard, groups))."""
    heap = [(0, s) for s in range(shards)]
    return [(size, deal(heap, size, count)) for size, count in sorted(sizes, reverse=True)]


def _numbered(rows: DataFrame, by: str, order: list[str], number: str, least: int, most: int) -> DataFrame:
    """rows with `number`, from 0 without gaps within each value of `by`; large values are numbered in cells, least to most of them."""
    counts = rows.groupBy(by).agg(F.greatest(F.lit(least), F.least(F.lit(most), F.ceil(F.count("*") / CELL_ROWS))).cast("int").alias("cells"))
    # Few values are large; those of one cell need no count.
    large = counts.filter("cells > 1")
    celled = rows.join(F.broadcast(large), by, "left").withColumn("cell", F.when(F.col("cells").isNull(), 0).otherwise(F.pmod(F.xxhash64(*order), F.col("cells")).cast("int")))
    before = Window.partitionBy(by).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    first = celled.filter("cells IS NOT NULL").groupBy(by, "cell").agg(F.count("*").alias("n")).select(by, "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    within = Window.partitionBy(by, "cell").orderBy(*order)
    placed = celled.withColumn("place", F.row_number().over(within) - 1).join(F.broadcast(first), [by, "cell"], "left")
    return placed.select(*rows.columns, (F.coalesce("first", F.lit(0)) + F.col("place")).cast("long").alias(number))


def shard_documents(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot): slot numbers each shard's rows from 0 without gaps."""
    spark = docs.sparkSession
    text = F.encode(text_or_empty(text_col), "UTF-8")
    facts = written(
        docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + F.lit(OVERHEAD)).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.unhex(F.md5(text)).alias("group")),
        "shard-facts",
    )
    rows = facts.count()
    groups = written(facts.groupBy("group").agg(F.sum("size").alias("weight"), F.count("*").alias("members")), "shard-groups")
    sizes = groups.groupBy("weight").agg(F.count("*").alias("n")).collect()  # at most sqrt(2 * bytes) rows
    runs = schedule([(r.weight, r.n) for r in sizes], shards)
    dealt = pa.table({
        "weight": pa.array([w for w, _ in runs], pa.int64()),
        "shards": pa.array([[s for s, _ in r] for _, r in runs], pa.list_(pa.int32())),
        "ends": pa.array([_sums(n for _, n in r) for _, r in runs], pa.list_(pa.int64())),
    })
    turns = spark.createDataFrame(dealt)
    # Groups of one size in any order: their numbers say whose turn it is.
    turn = F.size(F.filter("ends", lambda e: e <= F.col("number")))
    placed = _numbered(groups, "weight", ["group"], "number", 1, 1 << 16).join(turns, "weight").select("group", "members", F.get("shards", turn).alias("shard"))
    assigned = joined_groups(facts, placed, ["group"], "members", rows, "doc_id").select("doc_id", "size", "text_crc32", "shard")
    return _numbered(written(assigned, "shard-placed"), "shard", ["doc_id", "text_crc32", "size"], "slot", 16, 1024)


def _sums(counts) -> list[int]:
    out, total = [], 0
    for n in counts:
        total += n
        out.append(total)
    return out


def op5_lpt_sharding(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return shard_documents(docs, 24).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
