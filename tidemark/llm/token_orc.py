"""Token ids in ORC files: integer run-length encoding, row indexes and Bloom filters on document ids.

Documents are dealt out by ranges of doc_id and sorted, so that file by file and row by row the ids
ascend; each row holds its place among its file's ids. Reads go stripe by stripe in parallel, and a
filter on doc_id prunes stripes and row groups by their statistics and Bloom filters.

Defined results: a null or empty text has its end id only; an empty table gives no rows; rows with the
same doc_id stand side by side, by the text's hash; a null doc_id comes first; doc_ids keep their type; a very long text is
one row; other columns are left out.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import tokens
from tidemark.llm.common import prepare, shared_folder, text_or_empty

END_ID = 1
FORMAT = {
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
    "orc.create.index": "true",
    "orc.row.index.stride": "10000",
    "orc.stripe.size": str(32 << 20),
    "compression": "zstd",
}
SCHEMA = "n_tokens int, file_start long, ids array<int>"


def write_token_orc(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID) -> None:
    """Encode every whole text and write (doc_id, n_tokens, file_start, ids) in ascending doc_id order."""
    prepare(docs.sparkSession)
    end = int(end_id).to_bytes(4, "little")

    def encode(batches):
        encoder, at = tokens.encoder(tokenizer, glue=False), 0
        for batch in batches:
            ids = [x + end for x in encoder.encode_all(batch.column(1).to_pylist())]
            sizes = np.array([len(x) // 4 for x in ids], dtype=np.int64)
            ends = np.cumsum(sizes)
            values = pa.array(np.frombuffer(b"".join(ids), dtype="<i4"))
            offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes.astype(np.int32)), pa.array(at + ends - sizes), pa.ListArray.from_arrays(offsets, values)],
                names=["doc_id", "n_tokens", "file_start", "ids"],
            )
            at += int(ends[-1]) if len(ends) else 0

    (
        docs.select("doc_id", text_or_empty().alias("text"))
        .repartitionByRange("doc_id")
        .sortWithinPartitions("doc_id", F.xxhash64("text"))
        .mapInArrow(encode, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {SCHEMA}")
        .write.options(**FORMAT).orc(path)
    )


def read_token_orc(spark: SparkSession, path: str, id_type: str = "long") -> DataFrame:
    """(doc_id, start, n_tokens, ids); start: the ids of all documents before it, over all files."""
    stored = spark.read.schema(f"doc_id {id_type}, {SCHEMA}").orc(path).withColumn("file", F.col("_metadata.file_path"))
    # One row for each file: as many as there were partitions to write.
    files = stored.groupBy("file").agg(F.min("doc_id").alias("least"), F.max(F.col("file_start") + F.col("n_tokens")).alias("held"), F.count_if(F.col("doc_id").isNull()).alias("nulls"))
    rows = sorted(files.collect(), key=lambda r: (r.nulls == 0, r.least is not None, 0 if r.least is None else r.least))
    starts, at = [], 0
    for r in rows:
        starts.append((r.file, at))
        at += r.held
    base = spark.createDataFrame(starts, "file string, base long")
    return stored.join(F.broadcast(base), "file").select("doc_id", (F.col("base") + F.col("file_start")).alias("start"), F.col("n_tokens").cast("long").alias("n_tokens"), "ids")


def checksums(read: DataFrame) -> DataFrame:
    """The ids column replaced by the crc32 of its ids as little-endian unsigned 32-bit integers."""

    def digest(batches):
        for batch in batches:
            ids = batch.column(3)
            values, offsets = ids.values.to_numpy(zero_copy_only=False).astype("<u4"), ids.offsets.to_numpy()
            sums = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    id_type = read.schema["doc_id"].dataType.simpleString()
    return read.select("doc_id", "start", "n_tokens", "ids").mapInArrow(digest, f"doc_id {id_type}, start long, n_tokens long, ids_crc32 long")


def op7_token_orc(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = shared_folder(spark, "token-orc")
    write_token_orc(docs, path, tokens.default_path("word_bpe_49k.json"))
    return checksums(read_token_orc(spark, path))
