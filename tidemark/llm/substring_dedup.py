"""Suffix-array dedup: removes every byte covered by a string of `length` bytes that also starts elsewhere.

Windows (strings of `length` bytes) are found equal in three steps, none of which holds more than a bounded
block of text in one task:

1. Each window is owned by the k-gram of smallest hash inside it (the leftmost one), its anchor. Equal windows
   have equal anchors at the same offset, so only occurrences of anchors with the same k-gram need to
   meet. Occurrences are counted by k-gram with map-side sums; k-grams seen once end here.
2. The text that an anchor's windows cover is its snippet. Occurrences of one k-gram are put together by a 64-bit hash of
   their snippets. Snippets that occur more than once are compared as pieces: what follows one another in both the first and
   the last place of occurrence is one text, taken from both places. Of k-grams with several kinds of snippets each kind goes on
   once; several k-grams share a block of text, and a k-gram with very many kinds is dealt over several blocks.
3. In a block the snippets, cut into symbols of STEP bytes counted from their anchors, are sorted by the
   suffix array (linear grouping construction); neighbours with enough symbols in common form classes,
   and the up to STEP bytes at the window's either side are then compared exactly.
4. Windows of k-grams that were dealt over several blocks and found no partner in their own look for one by a 128-bit
   hash; those with the same hash meet in blocks of their own and go through step 3 again. So every repeated window was found by
   a suffix array over bytes; the hash of step 2 only hands the finding on to the third and further copies of a snippet.

Matches never cross documents, and strings are judged on the input. Defined results: null and empty texts have
no bytes and lose none; repeated rows (same doc_id, same text) are documents of their own, so each
loses what the other has; an empty table gives no rows; of a very long text every window counts; doc_ids may be null and
of any type; other columns are left out. Rows are numbered once, in a table written to the shared folder; every later scan reads
the stored numbers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import BROADCAST_BYTES, joined_groups, prepare, text_or_empty, tidied, written
from tidemark.llm.suffix import suffix_array

LENGTH = 200
#: Bytes of an anchor's k-gram: a power of two.
GRAM = 32
#: Bytes of a symbol of the suffix array.
STEP = 20
#: Bytes of snippets in one block, and distinct snippets of one k-gram in one block.
BLOCK_BYTES, BLOCK_SNIPPETS = 4 << 20, 4096
#: Bytes of text that are searched for anchors at a time.
CHUNK_BYTES = 2 << 20
_PLACE_BITS = 24  # of a place in a chunk: 2 ** 24 bytes; longer texts are searched in overlapping pieces
PIECE_BYTES = 2 << 20


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes from each place on, by doubling."""
    h, power, width = data.astype(np.uint64) + np.uint64(1), np.uint64(0x100000001B3), 1
    with np.errstate(over="ignore"):
        while width < GRAM:
            h = h[:-width] * power + h[width:]
            power, width = power * power, 2 * width
        return _mixed(h)


def anchors(data: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, place, first, last) of each anchor in texts laid end to end: it owns the windows that start from first to last."""
    none = np.zeros(0, dtype=np.int64)
    if len(data) < length:
        return none.astype(np.uint64), none, none, none
    hashes = gram_hashes(data)
    low = np.uint64(_PLACE_BITS)
    least = ((hashes >> low) << low) | np.arange(len(hashes), dtype=np.uint64)
    span, width = length - GRAM + 1, 1
    while 2 * width <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if span > width:
        least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
    owner = (least & np.uint64((1 << _PLACE_BITS) - 1)).astype(np.int64)
    starts = np.concatenate([[0], ends[:-1]])
    text = np.repeat(np.arange(len(ends)), ends - starts)
    window = np.flatnonzero(text[: len(owner)] == text[length - 1 :])  # those within one text
    if not len(window):
        return none.astype(np.uint64), none, none, none
    own = owner[window]
    new = np.concatenate([[True], (own[1:] != own[:-1]) | (np.diff(window) != 1)])
    at = np.flatnonzero(new)
    place, first = own[at], window[at]
    last = window[np.concatenate([at[1:], [len(window)]]) - 1]
    return hashes[place], place, first, last


def find_anchors(docs: DataFrame, length: int) -> DataFrame:
    """(gram, snippet, row, first, span, lead): windows first .. first + span of the row; lead: the anchor's place after first."""
    names = ["gram", "snippet", "row", "first", "span", "lead"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int16(), pa.int16()]

    def chunks(batches):
        held, size = [], 0
        for batch in batches:
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for at in range(0, max(1, len(text) - length + 1), PIECE_BYTES):
                    piece = text[at : at + PIECE_BYTES + length - 1]
                    if len(piece) >= length:
                        if held and size + len(piece) > CHUNK_BYTES:
                            yield held
                            held, size = [], 0
                        held.append((row, at, piece))
                        size += len(piece)
        if held:
            yield held

    def search(batches):
        for held in chunks(batches):
            data = b"".join(x[2] for x in held)
            ends = np.cumsum([len(x[2]) for x in held])
            starts = ends - np.array([len(x[2]) for x in held])
            gram, place, first, last = anchors(np.frombuffer(data, dtype=np.uint8), ends, length)
            text = np.searchsorted(ends, first, side="right")
            digest, lead = xxhash.xxh3_64_intdigest, place - first
            seen = [digest(data[a : b + length], x) for a, b, x in zip(first.tolist(), last.tolist(), lead.tolist(), strict=True)]
            snippet = np.array(seen, dtype=np.uint64).view(np.int64)
            row = np.array([x[0] for x in held], dtype=np.int64)[text]
            offset = np.array([x[1] for x in held], dtype=np.int64)[text] - starts[text]
            columns = [gram.view(np.int64), snippet, row, first + offset, (last - first).astype(np.int16), lead.astype(np.int16)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return docs.select("row", "bytes").mapInArrow(search, "gram long, snippet long, row long, first long, span short, lead short")


def repeated_windows(snippets: list[bytes], leads: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(flags, bounds): for each snippet's windows, laid end to end, whether another of the snippets has the same window; the
    windows of snippet i are those from bounds[i] to bounds[i + 1]."""
    if length < 2 * STEP:
        raise ValueError(f"length must be at least {2 * STEP}")
    sizes = np.array([len(s) for s in snippets], dtype=np.int64)
    pad = STEP  # bytes before and after each snippet, so that what is compared at the sides is there
    offsets = np.concatenate([[0], np.cumsum(sizes + 2 * pad)])
    gap = b"\0" * pad
    data = np.frombuffer(b"".join(gap + s + gap for s in snippets), dtype=np.uint8)
    shift = leads % STEP  # of the first symbol in its snippet
    symbols = (sizes - shift) // STEP
    whole = length // STEP - 1  # symbols that a window has for certain
    owner = np.repeat(np.arange(len(snippets)), symbols + 1)
    bounds = np.concatenate([[0], np.cumsum(symbols + 1)])
    within = np.arange(bounds[-1]) - bounds[owner]
    start = offsets[owner] + pad + shift[owner] + within * STEP  # of each symbol in data
    ends_here = within == symbols[owner]
    cells = np.lib.stride_tricks.sliding_window_view(data, STEP)[np.minimum(start, len(data) - STEP)]
    names = np.unique(np.ascontiguousarray(cells).view(f"V{STEP}").ravel(), return_inverse=True)[1].astype(np.int64) + 1
    names[ends_here] = 0
    order = suffix_array(names)
    order = order[within[order] + whole <= symbols[owner[order]]]
    windows = np.concatenate([[0], np.cumsum(sizes - length + 1)])
    repeated = np.zeros(windows[-1], dtype=bool)
    if len(order) < 2:
        return repeated, windows
    same = np.ones(len(order) - 1, dtype=bool)
    for i in range(whole):
        same &= names[order[1:] + i] == names[order[:-1] + i]
    kind = np.cumsum(np.concatenate([[0], ~same]))
    shared = np.concatenate([[False], same]) | np.concatenate([same, [False]])
    order, kind = order[shared], kind[shared]
    if not len(order):
        return repeated, windows
    rest = length - whole * STEP  # bytes beside the symbols, before and after together
    at, who = start[order], owner[order]
    before = np.lib.stride_tricks.sliding_window_view(data, STEP)[at - STEP]
    padded = np.concatenate([data, np.zeros(rest + STEP, dtype=np.uint8)])
    after = np.lib.stride_tricks.sliding_window_view(padded, rest)[at + whole * STEP]
    words = -(-rest // 8)
    for head in range(STEP):
        begin = at - offsets[who] - pad - head
        fits = np.flatnonzero((begin >= 0) & (begin + length <= sizes[who]))
        if len(fits) < 2:
            continue
        sides = np.zeros((len(fits), 8 * words), dtype=np.uint8)
        sides[:, :head] = before[fits, STEP - head :]
        sides[:, head:rest] = after[fits, : rest - head]
        keys = sides.view("<u8")
        hashed = _mixed(kind[fits].astype(np.uint64) + np.uint64(1))
        for w in range(words):
            hashed = _mixed(hashed ^ keys[:, w])
        by = np.argsort(hashed, kind="stable")
        equal = (hashed[by[1:]] == hashed[by[:-1]]) & (kind[fits[by[1:]]] == kind[fits[by[:-1]]]) & (keys[by[1:]] == keys[by[:-1]]).all(axis=1)
        found = fits[by[np.concatenate([[False], equal]) | np.concatenate([equal, [False]])]]
        repeated[windows[who[found]] + begin[found]] = True
    return repeated, windows


def _runs(flags: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(line, first, last) of each run of true values in lines that lie end to end."""
    opens = flags.copy()
    opens[1:] &= ~flags[:-1]
    opens[bounds[:-1]] = flags[bounds[:-1]]
    closes = flags.copy()
    closes[:-1] &= ~flags[1:]
    closes[bounds[1:] - 1] = flags[bounds[1:] - 1]
    first, last = np.flatnonzero(opens), np.flatnonzero(closes)
    line = np.searchsorted(bounds, first, side="right") - 1
    return line, first - bounds[line], last - bounds[line]


#: Windows of a piece of copied text, about.
PIECE_WINDOWS = 2048
_KEPT = {"gram": "long", "snippet": "long", "lead": "short", "n": "long", "deals": "long", "second": "boolean", "base": "long"}


def _compare(snippets: DataFrame, length: int) -> DataFrame:
    """Windows of snippets that repeat within a block: (gram, snippet, n, first, last); where a k-gram is dealt over several blocks
    also, with hashes, its windows without partner in the block (alone) and one of each kind with partners."""
    names = ["gram", "snippet", "n", "first", "last", "hash", "alone"]
    kinds = pa.schema(list(zip(names, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.bool_()), strict=True)))

    def compare(table: pa.Table) -> pa.Table:
        gram, snippet, n, base, second = (table.column(c).to_numpy() for c in ("gram", "snippet", "n", "base", "second"))
        texts, split = table.column("text").to_pylist(), table.column("deals").to_numpy() > 1
        repeated, bounds = repeated_windows(texts, table.column("lead").to_numpy().astype(np.int64), length)
        repeated[np.repeat(second, np.diff(bounds))] = False  # its first copy says the same
        parts = []

        def add(line, first, last, hashes, alone):
            parts.append(pa.table([gram[line], snippet[line], n[line], base[line] + first, base[line] + last, hashes, alone], schema=kinds))

        line, first, last = _runs(repeated, bounds)
        add(line, first, last, pa.nulls(len(line), pa.binary()), np.zeros(len(line), dtype=bool))
        seen: set[bytes] = set()  # of windows with a partner here one speaks for all
        for i in np.flatnonzero(split & ~second):
            hashes = [xxhash.xxh3_128_digest(texts[i][s : s + length]) for s in range(len(texts[i]) - length + 1)]
            here = repeated[bounds[i] : bounds[i + 1]]
            place = np.array([s for s, h in enumerate(hashes) if not here[s] or h not in seen], dtype=np.int64)
            seen.update(h for s, h in enumerate(hashes) if here[s])
            add(np.full(len(place), i), place, place, pa.array([hashes[s] for s in place], pa.binary()), ~here[place])
        return pa.concat_tables(parts)

    return snippets.groupBy("block").applyInArrow(compare, "gram long, snippet long, n long, first long, last long, hash binary, alone boolean")


def _cut(docs: DataFrame, wanted: DataFrame, length: int, few: bool = False) -> DataFrame:
    """The text of each wanted snippet (row, first, span, block and what _KEPT names). few: they fit into a broadcast."""
    kept = [*_KEPT, "block"]
    schema = ", ".join(f"{k} {v}" for k, v in _KEPT.items()) + ", block long, text binary"
    lists = wanted.groupBy("row").agg(F.collect_list(F.struct("first", "span", *kept)).alias("wanted"))
    lists = F.broadcast(lists) if few else lists

    def cut(batches):
        for batch in batches:
            data, wanted = batch.column(0).to_pylist(), batch.column(1)
            rows = wanted.flatten()
            counts = np.diff(wanted.offsets.to_numpy())
            first, span = (rows.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
            at, texts = 0, []
            for text, n in zip(data, counts.tolist(), strict=True):
                texts += [text[a : a + s + length] for a, s in zip(first[at : at + n].tolist(), span[at : at + n].tolist(), strict=True)]
                at += n
            for i in range(0, len(texts), 2000):
                yield pa.RecordBatch.from_arrays([*(rows.field(2 + j).slice(i, 2000) for j in range(len(kept))), pa.array(texts[i : i + 2000], pa.binary())], names=[*kept, "text"])

    return docs.join(lists, "row").select("bytes", "wanted").mapInArrow(cut, schema)


def _blocks(size: int) -> int:
    return max(8, -(-size // BLOCK_BYTES))


def _pieces(distinct: DataFrame) -> DataFrame:
    """(gram, snippet, n, row, other, shift, first, last, piece): snippets that occur more than once, in their first place, with the
    piece that they are part of: what follows one another both there and `shift` bytes on in the row `other`."""
    copied = distinct.filter("n > 1").select(
        "gram", "snippet", "n", F.col("one.row").alias("row"), F.col("other.row").alias("other"), (F.col("other.first") - F.col("one.first")).alias("shift"),
        F.col("one.first").alias("first"), (F.col("one.first") + F.col("one.span")).alias("last"),
    )
    pair = Window.partitionBy("row", "other", "shift").orderBy("first", "last")
    so_far = F.max("last").over(pair.rowsBetween(Window.unboundedPreceding, -1))
    runs = copied.withColumn("begins", F.when(so_far >= F.col("first") - 1, 0).otherwise(1))
    runs = runs.withColumn("run", F.sum("begins").over(pair.rowsBetween(Window.unboundedPreceding, 0)))
    start = F.min("first").over(Window.partitionBy("row", "other", "shift", "run"))
    part = F.floor((F.col("first") - start) / PIECE_WINDOWS)
    return runs.withColumn("piece", F.xxhash64("row", "other", "shift", "run", part)).drop("begins", "run")


def find_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(row, first, last): windows of the row, first to last, that also start elsewhere. docs: row, bytes."""
    found = find_anchors(docs, length)
    grams = tidied(found.groupBy("gram").agg(F.count("*").alias("occurs")).filter("occurs > 1"), "repeats-grams")
    total = grams.agg(F.coalesce(F.sum("occurs"), F.lit(0))).first()[0]
    known = tidied(joined_groups(found, grams, ["gram"], "occurs", total, "first").filter("occurs IS NOT NULL").drop("occurs"), "repeats-anchors")
    place = F.struct("row", "first", "span", "lead")
    distinct = tidied(known.groupBy("gram", "snippet").agg(F.count("*").alias("n"), F.min(place).alias("one"), F.max(place).alias("other")), "repeats-snippets")
    snippets = distinct.count()
    deals = distinct.groupBy("gram").agg(F.count("*").alias("kinds"), F.ceil(F.count("*") / BLOCK_SNIPPETS).cast("long").alias("deals")).filter("kinds > 1")
    dealt = joined_groups(distinct, deals, ["gram"], "kinds", snippets, "snippet").filter("kinds > 1")
    pieces = tidied(_pieces(distinct), "repeats-pieces")
    copied = pieces.groupBy("row", "other", "shift", "piece").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    size = dealt.agg(F.coalesce(F.sum(F.col("one.span") + length + 2 * STEP), F.lit(0))).first()[0]
    held = copied.agg(F.coalesce(F.sum(2 * (F.col("last") - F.col("first") + length + 2 * STEP)), F.lit(0))).first()[0]
    by_gram = dealt.select(
        "gram", "snippet", F.col("one.lead").alias("lead"), "n", "deals", F.lit(False).alias("second"), F.lit(0).cast("long").alias("base"),
        F.pmod(F.xxhash64("gram", F.pmod("snippet", "deals")), F.lit(_blocks(size))).alias("block"), F.col("one.row").alias("row"), F.col("one.first").alias("first"), F.col("one.span").cast("int").alias("span"),
    )
    twice = F.inline(F.array(F.struct(F.col("row").alias("row"), F.col("first").alias("first"), F.lit(False).alias("second")), F.struct(F.col("other").alias("row"), (F.col("first") + F.col("shift")).alias("first"), F.lit(True).alias("second"))))
    by_piece = copied.select(F.col("row").alias("gram"), F.col("piece").alias("snippet"), F.col("first").alias("base"), (F.col("last") - F.col("first")).cast("int").alias("span"), "row", "other", "shift", "first")
    by_piece = by_piece.select("gram", "snippet", "base", "span", twice).select(
        "gram", "snippet", F.lit(0).cast("short").alias("lead"), F.lit(-1).cast("long").alias("n"), F.lit(1).cast("long").alias("deals"), "second", "base",
        F.pmod(F.xxhash64("snippet"), F.lit(_blocks(held))).alias("block") + F.lit(1 << 40), "row", "first", "span",
    ).toDF("gram", "snippet", "lead", "n", "deals", "second", "base", "block", "row", "first", "span")
    partial = tidied(_compare(_cut(docs, by_gram.unionByName(by_piece), length), length), "repeats-windows")
    windows = partial.filter("hash IS NULL AND n > 0").select("gram", "snippet", "n", "first", "last")
    hashed = partial.filter("hash IS NOT NULL").select("gram", "snippet", "hash", "alone", F.col("first").alias("base"))
    if hashed.filter("alone").limit(1).count():
        # Windows alone in their block: those with the same hash from elsewhere are compared by bytes as well.
        met = hashed.groupBy("hash").agg(F.count("*").alias("m"), F.max("alone").alias("any")).filter("m > 1 AND any").select("hash")
        again = tidied(hashed.join(met, "hash", "left_semi").join(distinct.select("gram", "snippet", "n", "one"), ["gram", "snippet"]), "repeats-again")
        windows_again = again.count()
        size = windows_again * (length + 2 * STEP)
        again = again.select(
            "gram", "snippet", (F.col("one.lead") - F.col("base")).cast("short").alias("lead"), "n", F.lit(1).cast("long").alias("deals"), F.lit(False).alias("second"), "base",
            F.pmod(F.xxhash64("hash"), F.lit(_blocks(size))).alias("block"), F.col("one.row").alias("row"), (F.col("one.first") + F.col("base")).alias("first"), F.lit(0).alias("span"),
        )
        windows = windows.unionByName(tidied(_compare(_cut(docs, again, length, windows_again * 100 <= BROADCAST_BYTES), length), "repeats-across").select("gram", "snippet", "n", "first", "last"))
    # What a piece's comparison found is handed back to the snippets that it is made of.
    equal = partial.filter("n < 0").select(F.col("gram").alias("row"), F.col("snippet").alias("piece"), F.col("first").alias("a"), F.col("last").alias("b"))
    low, high = F.greatest("first", "a"), F.least("last", "b")
    copies = pieces.join(equal, ["row", "piece"]).filter(low <= high).select("gram", "snippet", "n", (low - F.col("first")).alias("a"), (high - F.col("first")).alias("b"))
    windows = windows.select("gram", "snippet", "n", F.col("first").alias("a"), F.col("last").alias("b")).unionByName(copies)
    lists = windows.groupBy("gram", "snippet").agg(F.first("n").alias("n"), F.collect_set(F.struct("a", "b")).alias("windows"))  # one n for each snippet
    placed = joined_groups(known.select("gram", "snippet", "row", "first"), lists, ["gram", "snippet"], "n", total, "row")
    return placed.select("row", F.col("first").alias("base"), F.inline("windows")).select("row", (F.col("base") + F.col("a")).alias("first"), (F.col("base") + F.col("b")).alias("last"))


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, removed, kept): removed: maximal runs [start, stop) of removed bytes; kept: the other bytes."""
    prepare(docs.sparkSession)
    rows = written(docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.encode(text_or_empty(text_col), "UTF-8").alias("bytes")), "repeats-rows")
    # A document's ranges are at most as many as its anchors.
    lists = find_repeats(rows.select("row", "bytes"), length).groupBy("row").agg(F.collect_list(F.struct("first", "last")).alias("ranges"))
    lists = tidied(lists, "repeats-ranges")
    doc_type = rows.schema["doc_id"].dataType.simpleString()

    def cut(batches):
        for batch in batches:
            removed, kept, sizes, lost = [], [], [], []
            for data, ranges in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                runs, left, at = [], [], 0
                if ranges.is_valid:
                    first, last = (ranges.values.field(i).to_numpy() for i in (0, 1))
                    order = np.argsort(first, kind="stable")
                    reach = np.maximum.accumulate(last[order] + length)
                    new = np.flatnonzero(np.concatenate([[True], first[order][1:] > reach[:-1]]))
                    runs = list(zip(first[order][new].tolist(), reach[np.concatenate([new[1:], [len(order)]]) - 1].tolist(), strict=True))
                for a, b in runs:
                    left.append(data[at:a])
                    at = b
                left.append(data[at:])
                removed.append([{"start": a, "stop": b} for a, b in runs])
                kept.append(b"".join(left))
                sizes.append(len(data))
                lost.append(sum(b - a for a, b in runs))
            spans = pa.array(removed, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(lost, pa.int64()), spans, pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "removed", "kept"])

    schema = f"doc_id {doc_type}, n_bytes long, n_removed long, removed array<struct<start:long,stop:long>>, kept binary"
    return rows.join(lists, "row", "left").select("doc_id", "bytes", "ranges").mapInArrow(cut, schema)


def op1_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
