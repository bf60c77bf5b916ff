"""Quality classifier: nearest-neighbour voting over latent-semantic vectors.

A text is counted by hashed terms of three kinds: runs of three bytes, words (lower case), and pairs of neighbouring words. A
pair is hashed by the difference of its words' codes, so pairs that relate alike, such as any word said twice running, are one
term. Fitting takes a bounded sample of the labelled rows (the `most` rows whose ids hash lowest), weights roots of counts by
inverse document frequency, each kind to unit length, and finds the leading singular directions of that matrix. The labelled
rows' unit vectors along these directions are broadcast: at most `most` * DIMS numbers. Scoring projects every whole
text the same way, takes the exact cosine products with all labelled vectors, block by block, and lets the nearest ones vote,
each weighted by a power of its similarity.

Defined results: a null, empty or blank text has no direction and gets the labelled rows' mean; so do
all texts whose neighbours have no similarity above zero. Without any labelled row the score is 0.5. Repeated
rows get equal scores; ties among neighbours are broken by their order in the sample; labels that are
null are left out, of several for one document the lowest counts; an empty table gives no rows; a very long text is counted
whole, in pieces; where the table has a column of the score's name, the score's name is lengthened by underscores.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import free_name, prepare, released, text_or_empty

#: Labelled rows that a model is fitted on, at most.
SAMPLE = 4096
#: Slots of the three kinds of terms, and how much each kind weighs.
KINDS = {"bytes": (4096, 1.0), "words": (2048, 1.0), "pairs": (2048, 2.0)}
SLOTS = sum(n for n, _ in KINDS.values())
RUN = 3  # bytes of a run
DIMS, NEIGHBOURS, POWER = 48, 15, 12
THRESHOLD, FOLDS = 0.3, 5
#: Texts that are projected together, bytes that are counted together, and words whose codes are kept.
BLOCK_TEXTS, PIECE_BYTES, _MEMORY = 100, 256 << 10, 150_000


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class Counter:
    """Counts the hashed terms of texts; remembers words."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def counts(self, texts: list[str]) -> np.ndarray:
        """texts x SLOTS."""
        out = np.zeros((len(texts), SLOTS), dtype=np.float32)
        held, size = [], 0
        for i, text in enumerate(texts):
            data = text.encode()
            if data.isspace() or not data:
                continue
            for at in range(0, len(data), PIECE_BYTES):  # runs over a cut are counted with the piece before it
                piece = data[at : at + PIECE_BYTES + RUN - 1]
                if held and size + len(piece) > PIECE_BYTES:
                    self._runs(held, out)
                    held, size = [], 0
                held.append((i, piece))
                size += len(piece)
            self._words(i, data, out)
        if held:
            self._runs(held, out)
        if len(self.known) > _MEMORY:
            self.known.clear()
        return out

    def _runs(self, held: list[tuple[int, bytes]], out: np.ndarray) -> None:
        slots = KINDS["bytes"][0]
        data = np.frombuffer(b"".join(x for _, x in held), dtype=np.uint8).astype(np.uint64)
        piece = np.repeat(np.arange(len(held)), [len(x) for _, x in held])
        with np.errstate(over="ignore"):
            h = data
            for i in range(1, RUN):
                h = h[:-1] * np.uint64(257) + data[i : len(data)]
            slot = (_mixed(h) % np.uint64(slots)).astype(np.int64)
        whole = piece[: len(slot)] == piece[RUN - 1 :]  # within one piece
        found = np.bincount(piece[: len(slot)][whole] * slots + slot[whole], minlength=len(held) * slots)
        np.add.at(out[:, :slots], [i for i, _ in held], found.reshape(len(held), slots).astype(np.float32))

    def _words(self, i: int, data: bytes, out: np.ndarray) -> None:
        split = data.lower().split()
        known = self.known
        for w in set(split).difference(known):
            known[w] = zlib.crc32(w)
        codes = np.array(list(map(known.__getitem__, split)), dtype=np.int64)
        (first, _), (words, _), (pairs, _) = KINDS.values()
        out[i, first : first + words] = np.bincount(codes % words, minlength=words)
        with np.errstate(over="ignore"):
            apart = _mixed((codes[1:] - codes[:-1]).astype(np.uint64)) % np.uint64(pairs)
        out[i, first + words :] = np.bincount(apart.astype(np.int64), minlength=pairs)


@dataclass(frozen=True)
class Model:
    """idf of slots, directions, and the labelled rows' unit vectors with labels."""

    idf: np.ndarray
    directions: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    neighbours: int = NEIGHBOURS

    @property
    def base(self) -> float:
        return float(self.labels.mean()) if len(self.labels) else 0.5

    def project(self, counts: np.ndarray) -> np.ndarray:
        """Unit vectors along the directions; zero for texts without words."""
        flat = _weighted(counts, self.idf) @ self.directions
        size = np.linalg.norm(flat, axis=1, keepdims=True)
        return np.divide(flat, size, out=np.zeros_like(flat), where=size > 1e-9)

    def score(self, counts: np.ndarray) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(counts), 0.5)
        return vote(self.project(counts) @ self.vectors.T, self.labels, self.neighbours, self.base)


def vote(near: np.ndarray, labels: np.ndarray, neighbours: int, base: float) -> np.ndarray:
    """The mean label of the nearest, weighted by similarity; near: texts x labelled rows. Of equally near ones the first count."""
    k = min(neighbours, len(labels))
    if k < len(labels):
        edge = -np.partition(-near, k - 1, axis=1)[:, k - 1 : k]  # the k-th similarity: what lies above is in, ties in order
        above, tied = near > edge, near == edge
        chosen = above | (tied & (np.cumsum(tied, axis=1) <= k - above.sum(axis=1, keepdims=True)))
    else:
        chosen = np.ones(near.shape, dtype=bool)
    row, column = np.nonzero(chosen)
    weight = np.maximum(near[row, column], 0).astype(np.float64) ** POWER
    total = np.bincount(row, weight, minlength=len(near))
    votes = np.bincount(row, weight * labels[column], minlength=len(near))
    return np.where(total > 1e-12, np.minimum(votes / np.maximum(total, 1e-12), 1.0), base)


def _weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    out, at = np.sqrt(counts) * idf, 0
    for slots, weight in KINDS.values():
        part = out[:, at : at + slots]
        size = np.linalg.norm(part, axis=1, keepdims=True)
        np.divide(part, size / np.float32(weight), out=part, where=size > 0)
        at += slots
    return out


@dataclass(frozen=True)
class Counted:
    """Counts of a sample's texts: the used slots and their values of all rows end to end, and where each row begins."""

    slots: np.ndarray
    values: np.ndarray
    begins: np.ndarray

    def __len__(self) -> int:
        return len(self.begins) - 1

    def blocks(self):
        """The rows as dense blocks of BLOCK_TEXTS: the whole sample is never dense at once."""
        for first in range(0, len(self), BLOCK_TEXTS):
            cuts = self.begins[first : first + BLOCK_TEXTS + 1]
            block = np.zeros((len(cuts) - 1, SLOTS), dtype=np.float32)
            part = slice(cuts[0], cuts[-1])
            block[np.repeat(np.arange(len(block)), np.diff(cuts)), self.slots[part]] = self.values[part]
            yield block


def fit(sample: Counted, labels: np.ndarray, dims: int = DIMS) -> Model:
    """Latent-semantic directions by subspace iteration from a fixed start, and the rows' vectors along them."""
    n = max(1, len(sample))
    seen = sum((np.count_nonzero(block, axis=0) for block in sample.blocks()), np.zeros(SLOTS, dtype=np.int64))
    idf = np.log((1 + n) / (1 + seen)).astype(np.float32)
    basis = np.linalg.qr(np.random.default_rng(0).standard_normal((SLOTS, dims + 16)).astype(np.float32))[0]
    for _ in range(6 if len(sample) else 0):
        grown = np.zeros_like(basis)
        for block in sample.blocks():
            weighted = _weighted(block, idf)
            grown += weighted.T @ (weighted @ basis)
        basis = np.linalg.qr(grown)[0]
    if len(sample):
        placed = np.concatenate([_weighted(block, idf) @ basis for block in sample.blocks()])
        basis = basis @ np.linalg.svd(placed, full_matrices=False)[2].T
    directions = np.ascontiguousarray(basis[:, :dims], dtype=np.float32)
    model = Model(idf, directions, np.zeros((0, directions.shape[1]), np.float32), np.zeros(0))
    vectors = [model.project(block) for block in sample.blocks()]
    return Model(idf, directions, np.concatenate([model.vectors, *vectors]), labels.astype(np.float64))


def fit_quality(docs: DataFrame, labels: DataFrame, most: int = SAMPLE, label_col: str = "quality") -> Model:
    """Fit on at most `most` labelled documents: those with the lowest hash of doc_id."""
    prepare(docs.sparkSession)
    known = labels.filter(F.col(label_col).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(label_col).cast("int").alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)  # the documented bound of the fit
    rows = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "text")

    def count(batches):
        counter = Counter()
        for batch in batches:
            for part in range(0, batch.num_rows, BLOCK_TEXTS):
                piece = batch.slice(part, BLOCK_TEXTS)
                counts = counter.counts(piece.column(2).to_pylist())
                used = [np.flatnonzero(c) for c in counts]
                terms = [zlib.compress(u.astype("<u2").tobytes() + c[u].astype("<u4").tobytes(), 1) for c, u in zip(counts, used, strict=True)]
                yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), pa.array(terms, pa.binary())], names=["doc_id", "label", "terms"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    counted = rows.mapInArrow(count, f"doc_id {id_type}, label int, terms binary")
    model = _fitted(counted.orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("terms")).limit(most))  # repeated documents count within the bound
    released(docs.sparkSession)
    return model


def _fitted(counted: DataFrame) -> Model:
    got = counted.toArrow()
    terms = [zlib.decompress(x.as_py()) for x in got.column("terms")]
    sizes = np.array([len(x) // 6 for x in terms], dtype=np.int64)
    slots = np.frombuffer(b"".join(x[: 2 * n] for x, n in zip(terms, sizes.tolist(), strict=True)), "<u2")
    values = np.frombuffer(b"".join(x[2 * n :] for x, n in zip(terms, sizes.tolist(), strict=True)), "<u4").astype(np.float32)
    return fit(Counted(slots, values, np.concatenate([[0], np.cumsum(sizes)])), got.column("label").to_numpy().astype(np.float64))


def with_score(docs: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """docs with one more column, the last: each text's score, from 0 to 1."""
    prepare(docs.sparkSession)
    column = free_name(column, docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index("text")
    schema = T.StructType([*docs.schema.fields, T.StructField(column, T.DoubleType())])

    def score(batches):
        counter, model = Counter(), shared.value
        for batch in batches:
            texts = [t or "" for t in batch.column(place).to_pylist()]
            parts = [model.score(counter.counts(texts[i : i + BLOCK_TEXTS])) for i in range(0, len(texts), BLOCK_TEXTS)]
            found = np.concatenate(parts) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], names=[*batch.schema.names, column])

    return docs.mapInArrow(score, schema)


def fold(column: str = "doc_id"):
    """crc32 of the id as text, mod FOLDS; rows of fold 0 are held out of fitting."""
    return F.crc32(F.encode(F.coalesce(F.col(column).cast("string"), F.lit("")), "UTF-8")) % FOLDS


def op10_lsa_neighbour_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(fold() != 0)
    model = fit_quality(docs, labels)
    return with_score(docs, model).select("doc_id", (fold() == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
