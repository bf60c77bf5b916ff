"""N-gram Jaccard join: size-banded tiles, bitmap bounds, exact intersections.

Two documents link when num / den or more of their joint distinct word shingles are common. The steps:

1. Documents with equal sets are one class; they link with each other and are represented once.
2. Candidates without loss: bands of set size grow by a factor; a pair belongs to the band of its smaller set. For
   a band the number of shingles by which linked sets can differ is bounded by d, so if the hash range is
   cut into more than d + e parts, linked sets agree in at least 1 + e whole parts. Each set sends a hash of each of its
   parts (empty ones only if there are more than e of them). In bands of small sets, where parts would be empty, it sends
   its prefix, the lowest-hashed shingles of which linked sets must share one. Sets that agree in a hash are searched by
   their hashed bitmaps, of about a bit for each shingle: the number of common bits bounds the overlap from above, so
   documents that merely share a passage part here. Sets that agree in a hash form a party, named by its least key; parties of one
   name are searched together. A party of more than MOST_MEMBERS is connected as it is, its bitmaps aren't read; the exact
   search decides later. What may link is connected, and only documents so connected are read again.
3. The connected sets form tiles of bounded bytes; large ones are cut by size band and hash. In a tile, sets are searched breadth
   first: each set that was reached is held against all that weren't. The number of common bits of two bitmaps bounds the
   overlap from above; who passes is intersected exactly. So a group of copies costs one
   intersection for each member, not for each pair.
4. Where a group fills several tiles, each tile also takes in one pivot of each band. Members that
   this connects to the group's largest part need no more; all others are held against every tile of a fitting band.

Defined results: null, empty and blank texts have no shingle and link with nothing; texts of fewer than k words
are one shingle; repeated rows link; a null doc_id links as one unknown document does, and has no class; rows
that share a doc_id count as one document; an empty table gives no rows; very long texts count whole; doc_ids of types other than
whole numbers are ranked, so that the smallest of a group is the smallest in their own order; keep_one keeps all columns,
whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import BROADCAST_BYTES, free_name, joined_groups, prepare, text_or_empty, tidied, written
from tidemark.llm.components import components
from tidemark.llm.shingles import Shingler, mix

K, NUM, DEN = 4, 85, 100
#: Growth of size bands, and the set size below which prefixes serve instead of parts.
GROWTH, SMALL = 1.25, 40
#: Shingles in a block of part hashes, and bytes of shingles in a tile.
BLOCK_SHINGLES, TILE_BYTES = 1_000_000, 8 << 20
#: Bits of the widest bitmap; members of a party above which they are connected unseen.
MOST_BITS, MOST_MEMBERS = 1 << 16, 1024
#: Part hashes that a task gathers before it hands them on.
HELD = 500_000


def _bands(largest: int) -> np.ndarray:
    edges = [1]
    while edges[-1] <= largest:
        edges.append(max(edges[-1] + 1, int(edges[-1] * GROWTH)))
    return np.array(edges, dtype=np.int64)


_EDGES = _bands(1 << 31)


def band_of(size):
    """The band of a set size (also of arrays)."""
    return np.searchsorted(_EDGES, size, side="right") - 1


class Signer:
    """part hashes of sorted shingle sets, such that linked sets have one in common."""

    def __init__(self, num: int, den: int):
        self.num, self.den, self.plans = num, den, {}

    def plan(self, band: int) -> tuple[int, int, np.ndarray]:
        """(parts, empty parts allowed, hash where each part begins); no parts: prefixes."""
        if band not in self.plans:
            small = int(_EDGES[band + 1]) - 1
            if small < SMALL:
                self.plans[band] = 0, 0, np.zeros(0, dtype=np.uint64)
            else:
                both = small + small * self.den // self.num
                differ = both * (self.den - self.num) // (self.den + self.num)
                allowed = 3 + differ // 10
                parts = differ + 1 + allowed
                self.plans[band] = parts, allowed, np.array([(i << 64) // parts for i in range(parts)], dtype=np.uint64)
        return self.plans[band]

    def sign(self, shingles: np.ndarray) -> np.ndarray:
        n, out = len(shingles), []
        low = -(-n * self.num // self.den)  # the smallest set this one may link with
        with np.errstate(over="ignore"):
            sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(mix(shingles), dtype=np.uint64)])
            for band in range(int(band_of(low)), int(band_of(n)) + 1):
                parts, allowed, begins = self.plan(band)
                salt = np.uint64(0xA0761D6478BD642F) * np.uint64(band + 1)
                if not parts:
                    out.append(mix(shingles[: n - low + 1] + salt))
                    continue
                cuts = np.concatenate([np.searchsorted(shingles, begins), [n]])
                used = np.flatnonzero(cuts[1:] > cuts[:-1])
                if parts - len(used) > allowed:
                    used = np.arange(parts)
                inside = sums[cuts[used + 1]] - sums[cuts[used]]
                out.append(mix(inside + salt + used.astype(np.uint64) * np.uint64(0xE7037ED1A0B428DB)))
        return np.concatenate(out)


def _keys(shingles: np.ndarray) -> tuple[int, int]:
    digest = xxhash.xxh3_128_digest(shingles.tobytes())
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def bitmap(shingles: np.ndarray) -> bytes:
    """A hashed bitmap of a power of two of bits, as many as there are shingles or more."""
    width = 64
    while width < len(shingles) and width < MOST_BITS:
        width *= 2
    bits = np.zeros(width, dtype=bool)
    bits[(shingles >> np.uint64(20)) & np.uint64(width - 1)] = True
    return np.packbits(bits).tobytes()


def _sets(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, n, key, key2, bits): size, 128-bit hash and bitmap of each document's set."""

    def work(batches):
        shingler = Shingler(k)
        for batch in batches:
            found = shingler.sets(batch.column(1).to_pylist())
            keys = [_keys(s) for s in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(s) for s in found], pa.int64()), *(pa.array([x[i] for x in keys], pa.int64()) for i in (0, 1)), pa.array(list(map(bitmap, found)), pa.binary())],
                names=["doc_id", "n", "key", "key2", "bits"],
            )

    return docs.mapInArrow(work, "doc_id long, n long, key long, key2 long, bits binary")


def _candidates(docs: DataFrame, k: int, num: int, den: int, blocks: int) -> DataFrame:
    """(party, key): sets that have a part hash in common, by the least key among them."""

    def sign(batches):
        shingler, signer = Shingler(k), Signer(num, den)
        hashes, keys, seen, held = [], [], set(), 0

        def hand_on():
            h, key = np.concatenate(hashes), np.concatenate(keys)
            block = h % np.uint64(blocks)
            order = np.argsort(block, kind="stable")
            h, key, cuts = h[order], key[order], np.searchsorted(block[order], np.arange(blocks + 1, dtype=np.uint64))
            used = np.flatnonzero(np.diff(cuts))
            data = [h[cuts[b] : cuts[b + 1]].tobytes() + key[cuts[b] : cuts[b + 1]].tobytes() for b in used]
            return pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(data, pa.binary())], names=["block", "data"])

        for batch in batches:
            for shingles in shingler.sets(batch.column(1).to_pylist()):
                if len(shingles) and (key := _keys(shingles)[0]) not in seen:  # a copy says nothing new
                    seen.add(key)
                    hashes.append(signer.sign(shingles))
                    keys.append(np.full(len(hashes[-1]), key, dtype=np.int64))
                    held += len(hashes[-1])
            if held > HELD:
                yield hand_on()
                hashes, keys, seen, held = [], [], set(), 0
        if held:
            yield hand_on()

    def meet(table: pa.Table) -> pa.Table:
        parts = table.column("data").to_pylist()
        h = np.concatenate([np.frombuffer(p, "<u8", len(p) // 16) for p in parts])
        key = np.concatenate([np.frombuffer(p, "<i8", len(p) // 16, len(p) // 2) for p in parts])
        del parts
        order = np.lexsort((key, h))
        h, key = h[order], key[order]
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        sizes = np.diff(np.concatenate([first, [len(h)]]))
        least = np.repeat(key[first], sizes)  # keys ascend within a hash
        shared = least != np.repeat(key[first + sizes - 1], sizes)  # by more than one set
        del h, order
        least, key = least[shared], key[shared]
        order = np.lexsort((key, least))
        least, key = least[order], key[order]
        new = np.concatenate([[True], (least[1:] != least[:-1]) | (key[1:] != key[:-1])])[: len(key)]
        return pa.table({"party": least[new], "key": key[new]})

    return docs.mapInArrow(sign, "block long, data binary").groupBy("block").applyInArrow(meet, "party long, key long").distinct()


def _may_link(parties: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Edges (a, b) of keys that connect, within each party, all sets whose bitmaps allow a link."""
    bits = sets.filter("n > 0").groupBy("key").agg(F.max_by(F.struct("n", "bits"), "n").alias("s")).select("key", "s.*")
    counts = tidied(parties.groupBy("party").agg(F.count("*").alias("members")), "party-sizes")
    known = joined_groups(parties, counts, ["party"], "members", parties.count(), "key")
    large = F.col("members") > MOST_MEMBERS
    unseen = known.filter(large & (F.col("party") != F.col("key"))).select(F.col("party").alias("a"), F.col("key").alias("b"))
    members = known.filter(~large).select("party", "key").join(bits.hint("merge"), "key")

    def search(table: pa.Table) -> pa.Table:
        key, n, data = table.column("key").to_numpy(), table.column("n").to_numpy(), table.column("bits").to_pylist()
        words = min(map(len, data)) // 8
        found = reached(np.stack([np.bitwise_or.reduce(np.frombuffer(d, dtype="<u8").reshape(-1, words)) for d in data]), n, num, den)
        a, b = (np.array([f[i] for f in found], dtype=np.int64) for i in (0, 1))
        return pa.table({"a": key[a], "b": key[b]})

    seen = members.groupBy("party").applyInArrow(search, "a long, b long")
    return seen.unionByName(unseen).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _needed(mine, theirs, num: int, den: int):
    """Common shingles that sets of these sizes need to link."""
    return -(-num * (mine + theirs) // (num + den))


def reached(words: np.ndarray, sizes: np.ndarray, num: int, den: int) -> list[tuple[int, int]]:
    """Pairs that connect all rows whose bitmaps allow a link, breadth first. words: rows of 64-bit words of equal width."""
    hidden = sizes - np.bitwise_count(words).sum(axis=1, dtype=np.int64)
    left, queue, out = np.arange(len(sizes)), [], []
    while len(left):
        if queue:
            i = queue.pop()
        else:
            i, left = int(left[0]), left[1:]
        common = np.bitwise_count(words[left] & words[i]).sum(axis=1, dtype=np.int64) + np.minimum(hidden[left], hidden[i])
        least = _needed(sizes[i], sizes[left], num, den)
        near = (common >= least) & (least <= np.minimum(sizes[i], sizes[left]))
        out += [(i, j) for j in left[near].tolist()]
        queue += left[near].tolist()
        left = left[~near]
    return out


class Bitmaps:
    """Hashed bitmaps of sets; upper(i, others): no more shingles than these can be common."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], dtype=np.int64)
        width = 64
        while width < 2 * np.median(self.sizes) and width < 4096:
            width *= 2
        flat = np.zeros((len(sets), width), dtype=bool)
        for row, s in zip(flat, sets, strict=True):
            row[(s >> np.uint64(20)) % np.uint64(width)] = True
        self.words = np.packbits(flat, axis=1).view(np.uint64)
        self.hidden = self.sizes - np.bitwise_count(self.words).sum(axis=1, dtype=np.int64)  # shingles on a bit that another has

    def upper(self, i: int, others: np.ndarray) -> np.ndarray:
        common = np.bitwise_count(self.words[others] & self.words[i]).sum(axis=1, dtype=np.int64)
        return common + np.minimum(self.hidden[others], self.hidden[i])


def linked(sets: list[np.ndarray], num: int, den: int, old: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links (i, j) that connect all sets that links connect. old: sets that needn't be held against each other."""
    bitmaps, links = Bitmaps(sets), []
    sizes, left, queue = bitmaps.sizes, np.arange(len(sets)), []
    new = np.ones(len(sets), dtype=bool) if old is None else ~old
    while len(left) or queue:
        if queue:
            i = queue.pop()
        else:
            i, left = int(left[0]), left[1:]
        if not len(left):
            break
        mine, theirs = sizes[i], sizes[left]
        least = _needed(mine, theirs, num, den)
        fit = (least <= np.minimum(mine, theirs)) & (new[left] | new[i])
        near = np.flatnonzero(fit)
        near = near[bitmaps.upper(i, left[near]) >= least[near]]
        reached = []
        for place in near.tolist():
            j = int(left[place])
            at = np.searchsorted(sets[i], sets[j])
            at[at == len(sets[i])] = 0
            if np.count_nonzero(sets[i][at] == sets[j]) >= least[place]:
                reached.append(place)
                links.append((i, j))
                queue.append(j)
        left = np.delete(left, reached)
    return links


def _tile_links(tiles: DataFrame, by: list[str], num: int, den: int) -> DataFrame:
    """Links (a, b) within each tile of (rep, shingles, old)."""

    def work(table: pa.Table) -> pa.Table:
        rep, old, first = table.column("rep").to_pylist(), table.column("old").to_pylist(), {}
        data = table.column("shingles").to_pylist()
        for place, key in enumerate(zip(rep, data, strict=True)):
            if key not in first or not old[place]:
                first[key] = place
        places = sorted(first.values(), key=lambda p: (len(data[p]), rep[p]))
        sets = [np.frombuffer(data[p], dtype="<u8") for p in places]
        found = linked(sets, num, den, np.array([old[p] for p in places], dtype=bool))
        return pa.table({"a": pa.array([rep[places[i]] for i, _ in found], pa.int64()), "b": pa.array([rep[places[j]] for _, j in found], pa.int64())})

    return tiles.groupBy(*by).applyInArrow(work, "a long, b long")


def _tiled(doubtful: DataFrame) -> DataFrame:
    """doubtful (rep, group, n; a written table) with large, band, deals and tile, from sizes alone: shingles are read for it later."""
    size, rows = F.col("n") * 8, doubtful.count()
    totals = doubtful.groupBy("group").agg((F.sum(size) > TILE_BYTES).alias("large"), F.count("*").alias("members"))
    edges = _EDGES[_EDGES < (1 << 31)].tolist()
    band = F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e <= F.col("n"))) - 1
    dealt = joined_groups(doubtful, totals, ["group"], "members", rows, "rep").drop("members").withColumn("band", F.when(F.col("large"), band).otherwise(-1))
    counts = dealt.filter("large").groupBy("group", "band").agg(F.ceil(F.sum(size) / TILE_BYTES).cast("int").alias("deals"), F.count("*").alias("members"))
    dealt = joined_groups(dealt, counts, ["group", "band"], "members", rows, "rep").drop("members")
    return dealt.withColumn("tile", F.coalesce(F.pmod(F.xxhash64("rep"), F.col("deals")).cast("int"), F.lit(0)))


def _links(sets: DataFrame, tiled: DataFrame, num: int, den: int) -> DataFrame:
    """Links (a, b) between rows of sets (group, band, tile, large, rep, n, shingles), enough to connect what links connect."""
    by = ["group", "band", "tile"]
    rows = sets.withColumn("old", F.lit(False))
    if not tiled.filter("large").limit(1).count():
        return _tile_links(rows, by, num, den)
    big = rows.filter("large").drop("large")
    reach = 1 + int(np.ceil(np.log(den / num) / np.log(1.15)))  # bands that linked sets can be apart, at most
    tiles = tiled.filter("large").select(*by).distinct()
    pivots = big.groupBy("group", "band").agg(F.min_by(F.struct("rep", "n", "shingles"), F.xxhash64("rep")).alias("p")).select("group", F.col("band").alias("pband"), "p.*")
    near = F.abs(F.col("band") - F.col("pband")) <= reach
    guests = tiles.join(pivots, "group").filter(near).select(*by, "rep", "n", "shingles", F.lit(False).alias("old"))
    columns = [*by, "rep", "n", "shingles", "old"]
    first = tidied(_tile_links(rows.select(*columns).unionByName(guests), by, num, den), "tile-links")
    found = components(first)
    places = tiled.filter("large").select(*by, "rep")
    placed = places.join(found, places["rep"] == found["node"], "left").select(*by, "rep", F.coalesce("component", "rep").alias("part"))
    main = placed.groupBy("group", "part").agg(F.count("*").alias("m")).groupBy("group").agg(F.max_by("part", F.struct("m", "part")).alias("main"))
    rest = tidied(placed.join(main, "group").filter(F.col("part") != F.col("main")).select(*by, "rep").distinct(), "tile-rest")
    if not rest.limit(1).count():
        return first
    askers = big.join(rest, [*by, "rep"], "left_semi").withColumnsRenamed({"band": "aband", "tile": "atile"})
    asked = rest.select("group", F.col("band").alias("aband"), F.col("tile").alias("atile")).distinct().join(tiles, "group").filter(F.abs(F.col("band") - F.col("aband")) <= reach)
    pairs = ["group", "aband", "atile", "band", "tile"]
    told = asked.join(big, by).select(*pairs, "rep", "n", "shingles", F.lit(True).alias("old"))
    asking = asked.join(askers, ["group", "aband", "atile"]).select(*pairs, "rep", "n", "shingles", "old")
    return first.unionByName(_tile_links(told.unionByName(asking), pairs, num, den))


def near_groups(docs: DataFrame, k: int = K, num: int = NUM, den: int = DEN) -> DataFrame:
    """(doc_id, n_shingles, component_id): one row for each row of docs; component_id: the smallest doc_id that links reach."""
    prepare(docs.sparkSession)
    docs = docs.select("doc_id", text_or_empty().alias("text"))
    if not isinstance(docs.schema["doc_id"].dataType, T.IntegralType):
        return _ranked_groups(docs, k, num, den)
    docs = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    sets = tidied(_sets(docs, k), "shingle-sets")
    classes = sets.filter("n > 0").groupBy("key", "key2", "n").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    classes = tidied(classes, "shingle-classes")
    total = sets.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    parties = tidied(_candidates(docs, k, num, den, max(8, -(-total // BLOCK_SHINGLES))), "shingle-parties")
    edges = tidied(_may_link(parties, sets, num, den), "shingle-edges")
    groups = components(edges).select(F.col("node").alias("key"), F.col("component").alias("group"))
    doubtful = tidied(classes.join(groups, "key").filter("rep IS NOT NULL").select("rep", "group", "n").distinct(), "shingle-doubtful")
    doubtful = tidied(_tiled(doubtful), "shingle-groups")

    places = doubtful.select("group", "band", "tile", "large", "rep").distinct()
    few = places.count() * 64 <= BROADCAST_BYTES
    columns = ["group", "band", "tile", "large", "rep"]

    def again(batches):
        shingler = Shingler(k)
        for batch in batches:
            found = shingler.sets(batch.column(len(columns)).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(columns)], pa.array([len(s) for s in found], pa.int64()), pa.array([s.tobytes() for s in found], pa.binary())], names=[*columns, "n", "shingles"])

    # Storing all sets would take more room than the texts, so only those of doubtful documents are made again.
    texts = docs.join(F.broadcast(places) if few else places, F.col("doc_id") == F.col("rep")).select(*columns, "text")
    arrays = texts.mapInArrow(again, "group long, band int, tile int, large boolean, rep long, n long, shingles binary").filter("n > 0")
    arrays = tidied(arrays, "shingle-arrays")
    same = sets.filter("n > 0").groupBy("doc_id").agg(F.min("key").alias("x"), F.max("key").alias("y")).filter("x <> y").select("doc_id")
    links = _links(arrays, doubtful, num, den)
    again = sets.filter("n > 0").join(same, "doc_id", "left_semi").select("key", "key2", "n", "doc_id")
    repeated = classes.join(again, ["key", "key2", "n"]).select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    found = components(links.unionByName(repeated))
    reach = classes.join(found, F.col("rep") == F.col("node"), "left").select("key", "key2", "n", "copies", F.coalesce("component", "rep").alias("component_id"))
    filled = sets.filter("n > 0").select("doc_id", "key", "key2", "n")
    met = joined_groups(filled, reach, ["key", "key2", "n"], "copies", filled.count(), "doc_id")
    out = met.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.unionByName(sets.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def _ranked_groups(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """near_groups for ids that are no whole numbers: they are ranked, and the ranks are linked."""
    ranks = written(docs.select("doc_id").filter("doc_id IS NOT NULL").distinct().orderBy("doc_id").select(F.col("doc_id").alias("id"), F.monotonically_increasing_id().alias("rank")), "near-ranks")
    ranked = docs.join(ranks, F.col("doc_id") == F.col("id"), "left").select(F.col("rank").alias("doc_id"), "text")
    found = near_groups(ranked, k, num, den)
    for column in ("doc_id", "component_id"):
        found = found.withColumnRenamed(column, "rank_of").join(ranks.select(F.col("rank").alias("rank_of"), F.col("id").alias(column)), "rank_of", "left").drop("rank_of")
    return found.select("doc_id", "n_shingles", "component_id")


def keep_one(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of docs of which one for each near-duplicate group stays, all columns as they are.

    Rows are linked and decided by stored numbers, so null and repeated doc_ids are documents of their own; of a
    group the row with the smallest doc_id stays (null ids last), of equal ids the first row.
    """
    prepare(docs.sparkSession)
    row = free_name("__row", docs)
    numbered = written(docs.withColumn(row, F.monotonically_increasing_id()), "near-rows")
    found = written(near_groups(numbered.select(F.col(row).alias("doc_id"), "text"), k, num, den).select(F.col("doc_id").alias("row"), "component_id"), "near-found")
    # Rows that link with nothing are their own component: only the others are decided.
    shared = found.filter("row <> component_id").select("component_id").distinct()
    linked_rows = tidied(found.filter("row <> component_id").unionByName(shared.select(F.col("component_id").alias("row"), "component_id")), "near-linked")
    order = F.struct(F.col("id").isNull(), F.col("id"), F.col("row"))
    ids = numbered.select(F.col(row).alias("row"), F.col("doc_id").alias("id"))
    kept = linked_rows.join(ids, "row").groupBy("component_id").agg(F.min(order).alias("best")).select(F.col("best.row").alias("row"))
    gone = written(linked_rows.select("row").join(kept, "row", "left_anti").select(F.col("row").alias(row)), "near-gone")
    few = gone.count() * 16 <= BROADCAST_BYTES
    return numbered.join(F.broadcast(gone) if few else gone, row, "left_anti").drop(row)


def op9_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
