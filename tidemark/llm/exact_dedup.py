"""Exact dedup through counting quotient filters.

The text without white space is fingerprinted with 64 bits. The first bits of a fingerprint name a block, the others go
into a counting quotient filter (quotient_filter.py). Every scan partition builds one filter for each block that its
rows touch; the filters of a block, from all partitions, merge losslessly by their sorted remainders. Fingerprints counted
more than once route their rows, with the normalised texts, to byte verification: texts are equal if all their bytes are.
Equal texts are combined where they are read before they are shuffled, so a group of copies is one text for each task.

A fingerprint under which only one text was found names its group by itself; where different texts share one, rows find
their group by the text again. Rows are numbered once, in a table written to the shared folder.

Defined results: null and empty texts equal each other and any text of white space; an empty table gives no rows; of
equal texts the one with most code points stays, then the smallest doc_id (null ids last), then the first row, so of
repeated rows (same doc_id, same text) one is kept; very long texts are compared whole; doc_ids may be of any type that has an order;
other columns, whatever their names, stay as they are in keep_first.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import BROADCAST_BYTES, free_name, joined_groups, prepare, text_or_empty, written
from tidemark.llm.quotient_filter import CountingQuotientFilter

#: The characters that don't count: [\x20\x09-\x0D].
BLANKS = "[\\x20\\x09-\\x0D]"
#: Rows of the whole input for each block, about; a power of two of blocks is made.
BLOCK_ROWS = 4_000_000
#: Fingerprints that a partition's filters take before they are handed on and new ones begin.
FILTER_ROWS = 4_000_000
#: Shares that a text's group is dealt over where different texts have one fingerprint.
SALTS = 32


def normalised(text: str) -> Column:
    return F.regexp_replace(text_or_empty(text), BLANKS, "")


def fingerprint(norm: Column) -> Column:
    return F.xxhash64(norm)


def repeated_fingerprints(prints: DataFrame, column: str = "fingerprint") -> DataFrame:
    """(fingerprint, copies) of the fingerprints counted more than once in the merged filters."""
    prepare(prints.sparkSession)
    block_bits = max(3, int(np.ceil(np.log2(max(1, prints.count()) / BLOCK_ROWS))))
    bits = 64 - block_bits

    def build(batches):
        held, rows = [], 0

        def hand_on():
            found = np.sort(np.concatenate(held)) if held else np.zeros(0, dtype=np.uint64)
            cuts = np.searchsorted(found >> np.uint64(bits), np.arange((1 << block_bits) + 1, dtype=np.uint64))
            used = np.flatnonzero(np.diff(cuts))
            low = (np.uint64(1) << np.uint64(bits)) - np.uint64(1)
            filters = [CountingQuotientFilter.build(found[cuts[b] : cuts[b + 1]] & low, bits).pack() for b in used]
            return pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(filters, pa.binary())], names=["block", "filter"])

        for batch in batches:
            held.append(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
            rows += batch.num_rows
            if rows >= FILTER_ROWS:
                yield hand_on()
                held, rows = [], 0
        yield hand_on()

    def merge(key, table):
        merged = CountingQuotientFilter.merged([CountingQuotientFilter.unpack(x) for x in table.column("filter").to_pylist()], bits)
        found, counts = merged.items()
        whole = (np.uint64(key[0].as_py()) << np.uint64(bits)) | found[counts > 1]
        return pa.table({"fingerprint": whole.view(np.int64), "copies": counts[counts > 1]})

    filters = prints.select(column).mapInArrow(build, "block int, filter binary")
    return filters.groupBy("block").applyInArrow(merge, "fingerprint long, copies long")


def _groups(facts: DataFrame, repeated: DataFrame) -> DataFrame:
    """(fingerprint, norm, stays, group_size): texts told apart by all their bytes, of rows whose fingerprint is repeated."""
    few = repeated.count() * 16 <= BROADCAST_BYTES
    doubtful = facts.join(F.broadcast(repeated) if few else repeated, "fingerprint", "left_semi").withColumn("norm", normalised("text"))
    best = F.min(F.struct(-F.col("points"), F.col("doc_id").isNull(), "doc_id", "row"))
    return doubtful.groupBy("fingerprint", "norm").agg(best.alias("best"), F.count("*").alias("group_size")).select(
        "fingerprint", "norm", F.col("best.doc_id").alias("keep_id"), F.col("best.row").alias("keep_row"), "group_size"
    )


def find_copies(facts: DataFrame, *more: str) -> DataFrame:
    """(row, doc_id, more, keep_id, group_size, kept) for each row of facts: a written table of row, doc_id, points, text, fingerprint and more."""
    rows = facts.count()
    repeated = written(repeated_fingerprints(facts).select("fingerprint"), "dedup-repeated")
    groups = written(_groups(facts, repeated), "dedup-groups")
    texts = groups.groupBy("fingerprint").agg(F.count("*").alias("texts"), F.sum("group_size").alias("rows"), *(F.first(c).alias(c) for c in ("keep_id", "keep_row", "group_size")))
    out = ["row", "doc_id", *more, "keep_id", "keep_row", "group_size"]
    narrow = facts.select("row", "doc_id", *more, "fingerprint")
    met = joined_groups(narrow, texts, ["fingerprint"], "rows", rows, "row")
    by_print = met.filter("coalesce(texts, 1) = 1").select(*out)
    # Different texts with one fingerprint: found again by their bytes, every text's group dealt over SALTS tasks.
    collided = texts.filter("texts > 1").select("fingerprint")
    salted = facts.join(collided, "fingerprint", "left_semi").select("row", "doc_id", *more, "fingerprint", normalised("text").alias("norm"), F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int").alias("salt"))
    dealt = groups.join(collided, "fingerprint", "left_semi").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    by_text = salted.join(dealt, ["fingerprint", "norm", "salt"]).select(*out)
    met = by_print.unionByName(by_text) if collided.limit(1).count() else by_print
    alone = F.col("keep_row").isNull()
    return met.select(
        "row", "doc_id", *more,
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("keep_row") == F.col("row"))).alias("kept"),
    )


def copies_of(docs: DataFrame) -> DataFrame:
    """(row, doc_id, text_sha256, keep_id, group_size, kept): one row for each row of docs; the hash is of the normalised text."""
    prepare(docs.sparkSession)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.length(text_or_empty()).alias("points"), text_or_empty().alias("text"), normalised("text").alias("norm"))
    facts = rows.select("row", "doc_id", "points", "text", fingerprint(F.col("norm")).alias("fingerprint"), F.sha2(F.encode("norm", "UTF-8"), 256).alias("text_sha256"))
    return find_copies(written(facts, "dedup-facts"), "text_sha256")


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, all columns as they are."""
    prepare(docs.sparkSession)
    row, points, mark = (free_name(n, docs) for n in ("__row", "__points", "__fingerprint"))
    numbered = written(docs.withColumns({row: F.monotonically_increasing_id(), points: F.length(text_or_empty()), mark: fingerprint(normalised("text"))}), "dedup-rows")
    facts = numbered.select(F.col(row).alias("row"), "doc_id", F.col(points).alias("points"), "text", F.col(mark).alias("fingerprint"))
    gone = written(find_copies(facts).filter("NOT kept").select(F.col("row").alias(row)), "dedup-gone")
    few = gone.count() * 16 <= BROADCAST_BYTES
    return numbered.join(F.broadcast(gone) if few else gone, row, "left_anti").select(*docs.columns)


def op8_quotient_filter_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return copies_of(docs).drop("row")


OP8_SQL = """
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS points, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS norm FROM documents
)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER w = 1 AS kept,
       sha256(norm) AS text_sha256
FROM n
WINDOW w AS (PARTITION BY norm ORDER BY points DESC, doc_id)
"""
