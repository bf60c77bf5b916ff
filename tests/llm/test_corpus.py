"""The corpus operators against brute force, round trips and planted cases, with the odd inputs that docstrings define."""

import contextlib
import hashlib
import heapq
import itertools
import os
import random
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import chat, components, decontaminate, exact_dedup, jaccard, packing, quality, sharding, substring_dedup, suffix, token_orc, tokens, warc
from tidemark.llm import quotient_filter as filters
from tidemark.llm.common import released, shared_folder

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
BYTE_BPE, WORD_BPE = tokens.default_path("byte_bpe_50k.json"), tokens.default_path("word_bpe_49k.json")


def documents(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS).repartition(parts)


def stored(spark, rows, parts=3):
    """Documents read from files, as the operators that number rows ask for."""
    path = shared_folder(spark, "test")
    documents(spark, rows, parts).write.parquet(path)
    return spark.read.parquet(path)


@contextlib.contextmanager
def other_splits(spark, monkeypatch, module, name):
    """After each table that the module writes, the source's files are split otherwise, as after a lost or new executor."""
    key, sizes, write = "spark.sql.files.maxPartitionBytes", itertools.cycle([1 << 9, 1 << 13, 1 << 10]), getattr(module, name)
    old = {k: spark.conf.get(k) for k in (key, "spark.sql.files.openCostInBytes")}

    def resplit(df, label):
        out = write(df, label)
        spark.conf.set(key, str(next(sizes)))
        return out

    monkeypatch.setattr(module, name, resplit)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    """Copies, near copies, shared passages, empty, null, blank and very long texts, repeated rows."""
    rng = random.Random(3)
    base = [words(rng, rng.randrange(3, 160)) for _ in range(25)]
    passage = words(rng, 70)
    rows = list(enumerate(base))
    for k in range(30):
        t = rng.choice(base).split()
        for _ in range(rng.randrange(0, 4)):
            t[rng.randrange(len(t))] = f"x{rng.randrange(99)}"
        rows.append((100 + k, " ".join(t)))
    rows += [(200 + k, words(rng, 20) + " " + passage + " " + words(rng, 20)) for k in range(5)]
    rows += [(300, ""), (301, None), (302, " \n\t "), (303, "one two"), (304, "ONE  two"), (305, words(rng, 6000)), (306, base[0] + "\n"), (306, base[0] + "\n"), (307, "é ñ ü ß " * 40), (308, "a" * 700)]
    return rows


# ---- suffix arrays and substrings (1)


def test_suffix_array_against_sorting():
    rng = random.Random(0)
    for _ in range(400):
        x = [rng.randrange(rng.choice([1, 2, 5])) for _ in range(rng.randrange(25))]
        assert suffix.suffix_array(np.array(x, dtype=np.int64)).tolist() == sorted(range(len(x)), key=lambda i: x[i:])


def brute_removed(rows, length):
    data = [(t or "").encode() for _, t in rows]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for (i, _), d in zip(rows, data, strict=True):
        gone = bytearray(len(d))
        for a in range(len(d) - length + 1):
            if seen[d[a : a + length]] > 1:
                gone[a : a + length] = b"\1" * length
        runs = len(re.findall(b"\1+", bytes(gone)))
        kept = bytes(c for c, g in zip(d, gone, strict=True) if not g)
        out.append((i, len(d), sum(gone), runs, kept))
    return sorted(out)


@pytest.mark.parametrize("limits", [(8 << 20, 4096, 2048), (3000, 3, 2048), (3000, 3, 40)])
def test_substring_dedup_against_brute_force(spark, corpus, monkeypatch, limits):
    monkeypatch.setattr(substring_dedup, "BLOCK_BYTES", limits[0])
    monkeypatch.setattr(substring_dedup, "PIECE_WINDOWS", limits[2])
    monkeypatch.setattr(substring_dedup, "BLOCK_SNIPPETS", limits[1])  # small blocks: k-grams are dealt over several
    docs = stored(spark, corpus)
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, len(r.removed), bytes(r.kept)) for r in substring_dedup.remove_repeats(docs, 80).collect())
    assert got == brute_removed(corpus, 80)


def test_substring_dedup_pieces_of_long_texts(monkeypatch, spark):
    rng = random.Random(5)
    rows = [(0, words(rng, 900)), (1, words(rng, 300))]
    rows.append((2, rows[0][1][1500:3500]))
    monkeypatch.setattr(substring_dedup, "PIECE_BYTES", 700)
    monkeypatch.setattr(substring_dedup, "CHUNK_BYTES", 1000)
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, len(r.removed), bytes(r.kept)) for r in substring_dedup.remove_repeats(stored(spark, rows), 80).collect())
    assert got == brute_removed(rows, 80)


def test_substring_dedup_when_the_source_is_split_otherwise_between_scans(spark, corpus, monkeypatch):
    docs = stored(spark, corpus, 6)
    with other_splits(spark, monkeypatch, substring_dedup, "tidied"):
        got = sorted((r.doc_id, r.n_bytes, r.n_removed, len(r.removed), bytes(r.kept)) for r in substring_dedup.remove_repeats(docs, 80).collect())
    assert got == brute_removed(corpus, 80)


def test_substring_dedup_empty(spark):
    assert substring_dedup.remove_repeats(stored(spark, [])).count() == 0


# ---- decontamination (2)


def test_tiling_catches_reordered_passages_and_leaves_clean_ones(spark):
    rng = random.Random(1)
    item = words(rng, 60, 5000).split()
    mixed = item[40:] + item[20:40] + item[:20]
    rows = [(0, words(rng, 50) + " " + " ".join(item) + " " + words(rng, 50)), (1, words(rng, 10) + " " + " ".join(mixed).upper()), (2, words(rng, 300)), (3, " ".join(item[:8]) + " " + words(rng, 90)), (4, None), (5, "")]
    bench = spark.createDataFrame([(7, " ".join(item)), (8, words(rng, 40)), (9, "w1 w2"), (10, None)], "item_id long, text string")
    got = {r.doc_id: r.hits for r in decontaminate.with_hits(documents(spark, rows), bench).collect()}
    assert [h.item_id for h in got[0]] == [7] and got[0][0].tiles == 1 and got[0][0].coverage == 1.0
    assert [h.item_id for h in got[1]] == [7] and got[1][0].tiles == 3
    assert all(got[i] == [] for i in (2, 3, 4, 5))
    assert sorted(r.doc_id for r in decontaminate.clean(documents(spark, rows), bench).collect()) == [2, 3, 4, 5]
    blocks = {r.doc_id: r.hits for r in decontaminate.with_hits(documents(spark, rows), bench, limit=200).collect()}
    assert blocks == got
    assert decontaminate.clean(documents(spark, rows), bench.limit(0)).count() == 6
    hit = decontaminate.with_hits(documents(spark, rows).withColumn("hits", F.lit("mine")), bench).orderBy("doc_id").first()
    assert hit.hits == "mine" and [h.item_id for h in hit.hits_] == [7]
    clash = documents(spark, rows).withColumn("__hits", F.lit(1))
    assert decontaminate.clean(clash, bench).columns == clash.columns


def test_short_items_are_matched_whole(spark):
    bench = spark.createDataFrame([(1, "What is two, two?"), (2, "Yes"), (3, "?!"), (4, "what is two two"), (5, "and so on and on it goes")], "item_id long, text string")
    rows = [(0, "what is two two"), (1, "so: WHAT is (two) two and more"), (2, "what is two and two"), (3, "yes"), (4, "oh yes indeed"), (5, ""), (6, None), (7, "?!"), (8, "yes"), (9, "and so on and on it goes yes what is two two")]
    got = {r.doc_id: [(h.item_id, h.coverage, h.tiles, h.words) for h in r.hits] for r in decontaminate.with_hits(documents(spark, rows), bench).collect()}
    four = [(1, 1.0, 1, 4), (4, 1.0, 1, 4)]
    assert got == {0: four, 1: four, 2: [], 3: [(2, 1.0, 1, 1)], 4: [], 5: [], 6: [], 7: [], 8: [(2, 1.0, 1, 1)], 9: [*four, (5, 1.0, 1, 7)]}


def test_tiles_against_exhaustive_greedy():
    def greedy(item, text, least):
        fi, ft, covered = [1] * len(item), [1] * len(text), 0
        while True:
            found = []
            for i in range(len(item)):
                for j in range(len(text)):
                    k = 0
                    while i + k < len(item) and j + k < len(text) and fi[i + k] and ft[j + k] and item[i + k] == text[j + k]:
                        k += 1
                    found.append((k, i, j))
            best = max((k for k, _, _ in found), default=0)
            if best < least:
                return covered
            for k, i, j in found:
                if k == best and all(fi[i : i + k]) and all(ft[j : j + k]):
                    fi[i : i + k] = [0] * k
                    ft[j : j + k] = [0] * k
                    covered += k

    rng = np.random.default_rng(4)
    for _ in range(60):
        item = rng.integers(0, 500, rng.integers(6, 40))
        cuts = [item[a : a + rng.integers(3, 20)] for a in rng.integers(0, len(item), 3)]
        text = np.concatenate([rng.integers(0, 500, 5), *cuts, rng.integers(0, 500, 5)])
        assert sum(k for k, _, _ in decontaminate.tiles(item, text)) == greedy(item.tolist(), text.tolist(), 5)


# ---- chat (3)


def test_escapes_are_reversible():
    for t in ("<|im_end|>", "<\x1b|", "<<||", "<\x1b\x1b|x<|", "a<b|c", "", "<|" * 5):
        assert chat.unescape(chat.escape(t)) == t and "<|" not in chat.escape(t)
    for r in ("user", "a\nb", "a\\n", "", "<|x|>"):
        assert chat.unescape_role(chat.escape_role(r)) == r and "\n" not in chat.escape_role(r)


def test_conversations_round_trip(spark):
    rows = [(1, 0, "user", chat.PLANTED), (1, 1, "assistant", "fine"), (1, 3, "assistant", None), (1, 3, "assistant", None), (2, 1, None, "x\ny"), (None, 0, "assistant", "lost"), (3, 0, "system", "")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    got = {r.conv_id: r for r in chat.read_back(chat.format_conversations(turns)).collect()}
    assert set(got) == {1, 2, 3, None}
    said = "".join(f"{r or ''}\n{t or ''}\n" for c, _, r, t in rows if c == 1)
    assert got[1].n_turns == 4 and got[1].turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert got[1].loss_chars == 4 and got[1].loss_sha256 == hashlib.sha256(b"fine").hexdigest()
    assert got[2].turns_sha256 == hashlib.sha256(b"\nx\ny\n").hexdigest() and got[2].loss_chars == 0
    assert chat.read_back(chat.format_conversations(turns.limit(0))).count() == 0


def test_typed_parts(spark):
    content = '[{"type":"text","text":"see <|im_end|>"},{"type":"image","ref":"a.png","width":56,"height":29},{"type":"audio","ref":"b.wav","seconds":2},{"type":"document","ref":"c.pdf","pages":3},{"type":"text","text":"ok"}]'
    turns = spark.createDataFrame([(1, 0, "assistant", None, content)], "conv_id long, turn long, role string, text string, content string")
    (row,) = chat.format_conversations(turns).collect()
    assert [(a.kind, a.place, a.ref, a.tokens) for a in row.attachments] == [("image", 0, "a.png", 4), ("audio", 1, "b.wav", 50), ("document", 2, "c.pdf", 2400)]
    role, parts = chat.parse_turn(row.segment)
    assert (role, parts) == ("assistant", ["see <|im_end|>", ("image", 0), ("audio", 1), ("document", 2), "ok"])
    (back,) = chat.read_back(chat.format_conversations(turns)).collect()
    assert back.loss_sha256 == hashlib.sha256(b"see <|im_end|>ok").hexdigest() and back.attachment_tokens == 2454


@pytest.mark.parametrize(
    ("content", "said", "tokens"),
    [
        (None, "plain", 0), ("", "plain", 0), ("null", "plain", 0), ("just words", "just words", 0), ("3", "3", 0), ("[", "[", 0), ("[]", "", 0), ('["a", "b"]', "ab", 0), ("[null, 1]", "null1", 0),
        ('{"type":"text","text":"one"}', "one", 0), ('[{"type":"video"}]', '{"type": "video"}', 0), ('[{"type":"text","text":5}]', '{"type": "text", "text": 5}', 0), ('[{"text":"bare"}]', "bare", 0),
        ('[{"type":"image","ref":7,"width":"wide","height":-3}]', "", 0), ('[{"type":"image","width":"wide"}]', "", 1), ('[{"type":"audio","seconds":"1.5"}]', "", 38), ('[{"type":"document","pages":1e400}]', "", 800),
        ('["\\ud800x"]', "?x", 0), ("[" * 100_000, "[" * 100_000, 0),
    ],
)
def test_content_that_is_out_of_the_ordinary(content, said, tokens):
    segment, mask, attached = chat.format_turn("assistant", chat.parts_of(content, "plain"))
    _, parts = chat.parse_turn(segment)
    assert "".join(p for p in parts if isinstance(p, str)) == said == "".join(chat.unescape(segment[a : a + n]) for a, n in mask)
    assert sum(a["tokens"] for a in attached) == tokens


# ---- tokens, packing (4), ORC (7)


def test_settling_cuts_few_pieces():
    """What is cut in the end doesn't grow with the number of documents: there is about one open window a level at most."""
    for n in (3000, 20_000):
        packer, rng = packing.Packer(1024, 0), random.Random(4)
        for i in range(n):
            packer.add(i, b"\1\0\0\0" * min(20_000, 1 + int(rng.lognormvariate(5.5, 1.2))))
        packer.settle()
        assert sum(start % 1024 != 0 for _, start, *_ in packer.closed) <= 150


@pytest.mark.parametrize(("path", "glue"), [(BYTE_BPE, True), (WORD_BPE, False)])
def test_cached_ids_are_the_librarys(path, glue, corpus):
    odd = ["a  b", "a \n b\n", "  x", " x ", "\n\n y", "it's 'S <|endoftext|> x", "a\x1c b", "É́ é a", "ΑΣ ΑΣ", "x\t y", "", " ", "a\xa0 b", "don't. they'll!! 'tis,", "a.\n.b", "a\r\nb c", "İx ıq", "ß. ſ. K.", "z" * 100 + " q", "a_.b", "naïve\nÉtat, x", "\nabc", "中文 字。"]
    encoder = tokens.Encoder(path, glue)
    texts = odd + [t or "" for _, t in corpus]
    for _ in range(2):  # cold and warm
        assert encoder.encode_all(texts) == [encoder.whole(t) for t in texts]


def test_packing_covers_every_id_once(spark, corpus):
    rows = list(packing.pack_documents(stored(spark, corpus), BYTE_BPE).collect())
    encoder = tokens.Encoder(BYTE_BPE, True)
    want = Counter(encoder.whole(t or "") + b"\0\0\0\0" for _, t in corpus)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        assert r.length == len(r.ids) // 4 and r.length > 0
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for seq in by_sequence.values():
        at = 0
        for r in sorted(seq, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    short = sum(sum(r.length for r in seq) < 1024 for seq in by_sequence.values())
    assert short <= 3  # one a partition
    got = Counter()
    for doc, pieces in by_doc.items():
        pieces.sort(key=lambda r: r.start)
        if doc == 306:  # a repeated row: two documents of one id
            assert sum(r.length for r in pieces) == 2 * pieces[0].doc_tokens
            continue
        ids = b"".join(bytes(r.ids) for r in pieces)
        assert [r.start for r in pieces] == np.cumsum([0] + [r.length for r in pieces])[:-1].tolist() and len(ids) // 4 == pieces[0].doc_tokens
        got[ids] += 1
    assert got == Counter({k: v for k, v in want.items() if k != encoder.whole(dict(corpus)[306]) + b"\0\0\0\0" or v > 2})


def test_sum_of_squares_level_is_the_best():
    rng = random.Random(2)
    packer = packing.Packer(32, 0)
    for i in range(500):
        size = rng.randrange(1, 32)
        before = packer.count.copy()

        def cost(level, size=size, before=before):
            c = before.copy()
            if level:
                c[level] -= 1
            if level + size < 32:
                c[level + size] += 1
            return int((c[:32] ** 2).sum())

        levels = [0, *(h for h in range(1, 33 - size) if before[h])]
        assert cost(packer.level(size)) == min(map(cost, levels))
        packer.add(i, b"\1\0\0\0" * size)


@pytest.mark.parametrize("most", [3, 8192])
def test_settled_windows(monkeypatch, most):
    monkeypatch.setattr(packing, "MOST_OPEN", most)
    packer, rng = packing.Packer(16, 0), random.Random(1)
    for i in range(200):
        packer.add(i, i.to_bytes(4, "little") * rng.randrange(1, 40))
    packer.settle()
    filled = Counter()
    for _, _, n, _, _, sequence, offset in packer.closed:
        assert offset == filled[sequence]
        filled[sequence] += n
    assert sum(n < 16 for n in filled.values()) <= 1 and max(filled.values()) == 16
    ids = defaultdict(int)
    for doc, _, n, data, _, _, _ in packer.closed:
        assert data == doc.to_bytes(4, "little") * n
        ids[doc] += n
    assert all(ids[doc] == total for doc, _, _, _, total, _, _ in packer.closed)


def test_token_orc_round_trip(spark, corpus):
    docs = documents(spark, corpus)
    path = shared_folder(spark, "orc-test")
    token_orc.write_token_orc(docs, path, WORD_BPE)
    encoder, at = tokens.Encoder(WORD_BPE, False), 0
    got = sorted(token_orc.checksums(token_orc.read_token_orc(spark, path)).collect(), key=lambda r: (r.start, r.doc_id))
    for (doc, text), r in zip(sorted(corpus, key=lambda x: x[0]), got, strict=True):
        ids = encoder.whole(text or "") + b"\1\0\0\0"
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (doc, at, len(ids) // 4, zlib.crc32(ids))
        at += r.n_tokens
    plan = token_orc.read_token_orc(spark, path).filter("doc_id = 303")._jdf.queryExecution().toString()
    assert "EqualTo(doc_id,303)" in plan
    empty = shared_folder(spark, "orc-empty")
    token_orc.write_token_orc(docs.limit(0), empty, WORD_BPE)
    assert token_orc.read_token_orc(spark, empty).count() == 0


# ---- sharding (5)


def test_shards(spark, corpus):
    rows = corpus + [(1000 + i, "hot") for i in range(300)]
    got = sharding.shard_documents(documents(spark, rows), 5).collect()
    assert len(got) == len(rows)
    shards, by_text = defaultdict(list), defaultdict(set)
    text = dict(rows)
    for r in got:
        shards[r.shard].append(r)
        by_text[text[r.doc_id] or ""].add(r.shard)
        assert r.size == len((text[r.doc_id] or "").encode()) + 8 and r.text_crc32 == zlib.crc32((text[r.doc_id] or "").encode())
    assert all(len(s) == 1 for s in by_text.values())
    for s in shards.values():
        assert sorted(r.slot for r in s) == list(range(len(s)))
    assert sharding.shard_documents(documents(spark, []), 5).count() == 0


def test_dealing_by_size_is_longest_first_through_a_heap():
    """Against the plain heap that places every group by itself: same loads, and the same shard for the n-th group of a size."""
    rng = random.Random(0)
    for _ in range(300):
        shards = rng.randrange(1, 9)
        sizes = {rng.choice([rng.randrange(1, 12), rng.randrange(1, 2000)]): rng.choice([1, 2, rng.randrange(1, 90)]) for _ in range(rng.randrange(1, 12))}
        heap, want = [(0, s) for s in range(shards)], {}
        for size in sorted(sizes, reverse=True):
            want[size] = Counter()
            for _ in range(sizes[size]):
                load, shard = heapq.heappop(heap)
                want[size][shard] += 1
                heapq.heappush(heap, (load + size, shard))
        got = {}
        for size, runs in sharding.schedule(list(sizes.items()), shards):
            got[size] = Counter()
            for shard, n in runs:
                got[size][shard] += n
        assert got == want
    (huge, runs), (small, rest) = sharding.schedule([(10**9, 1), (8, 10**8)], 24)
    assert len(rest) < 200 and sum(n for _, n in rest) == 10**8


@pytest.mark.parametrize("cell", [200_000, 7])
def test_shards_are_those_of_the_plain_heap(spark, corpus, cell, monkeypatch):
    """A hot group, many groups of one size, and a text heavier than a fair share."""
    monkeypatch.setattr(sharding, "CELL_ROWS", cell)  # small cells: sizes and shards are numbered in several
    rows = [*corpus, *((1000 + i, "hot") for i in range(300)), *((2000 + i, f"t{i:04}") for i in range(200)), (3000, "é" * 90_000)]
    got = sharding.shard_documents(documents(spark, rows), 5).collect()
    weight = Counter()
    for _, t in rows:
        weight[t or ""] += len((t or "").encode()) + 8
    heap = [(0, s) for s in range(5)]
    for size in sorted(weight.values(), reverse=True):
        load, shard = heapq.heappop(heap)
        heapq.heappush(heap, (load + size, shard))
    loads, slots = Counter(), defaultdict(list)
    for r in got:
        loads[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert sorted((loads[s], s) for s in range(5)) == sorted(heap)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


# ---- WARC (6)


def test_warc_round_trip(spark):
    big, other = "<p>" + "x" * 1500, "é" * 800
    rows = [(1, "http://a/", big), (2, "http://b/", big), (5, None, big), (3, "http://c/\r\nX: 1", "small"), (4, "http://d/", "small"), (6, "u", None), (7, "u", ""), (8, "u", other), (8, "u", other), (None, "u", other)]
    path = shared_folder(spark, "pages")
    spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3).write.parquet(path)
    manifest = warc.write_warc(spark.read.parquet(path), shared_folder(spark, "warc"), archive_bytes=600)
    got = warc.read_warc(spark, manifest).collect()
    assert len(got) == len(rows) and manifest.agg(F.sum("records")).first()[0] == len(rows)
    kinds = sorted((r.page_id or 0, r.record_type, r.refers_to, r.payload_bytes) for r in got)
    assert kinds == sorted([(1, "revisit", 5, 1503), (2, "revisit", 5, 1503), (5, "response", None, 1503), (3, "response", None, 5), (4, "response", None, 5), (6, "response", None, 0), (7, "response", None, 0), (8, "response", None, 1600), (8, "revisit", 8, 1600), (0, "revisit", 8, 1600)], key=lambda x: (x[0], x[1]))
    for r in got:
        if r.record_type == "response":
            assert hashlib.sha1(bytes(r.payload)).hexdigest() == r.payload_digest
    assert warc.read_warc(spark, warc.write_warc(spark.read.parquet(path).limit(0), shared_folder(spark, "warc"))).count() == 0


def test_warc_archives_are_read_by_many_tasks_and_records_have_ids_of_their_own(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "READ_BYTES", 4000)
    rng = random.Random(2)
    pages = spark.createDataFrame([(i % 150, "u", words(rng, 60, 10**6)) for i in range(200)], "page_id long, url string, html string").withColumn("row", F.lit("mine"))
    folder = shared_folder(spark, "warc")
    manifest = warc.write_warc(pages.repartition(3), folder, archive_bytes=1)
    assert manifest.count() == 200
    read = warc.read_warc(spark, manifest)
    assert read.count() == 200 and read.select(F.spark_partition_id()).distinct().count() > 8
    names = []
    for (path,) in manifest.select("path").collect():
        system, name = warc.opened(path)
        with system.open_input_stream(name, compression=None) as stream:
            names += [line for m in warc.members(stream) for line in m.split(b"\r\n") if line.startswith(b"WARC-Record-ID")]
    assert len(set(names)) == 200


def test_warc_reader_finds_damage(tmp_path):
    good = warc.record_bytes(1, 1, "u", b"abc", hashlib.sha1(b"abc").hexdigest(), "response")
    bad = warc.record_bytes(2, 2, "u", b"abd", hashlib.sha1(b"abc").hexdigest(), "response")
    path = tmp_path / "x.warc.gz"
    path.write_bytes(warc.gzip_member(good) * 3)
    with path.open("rb") as f:
        assert [warc.parsed(m)["page_id"] for m in warc.members(f)] == [1, 1, 1]
    with pytest.raises(warc.DigestError):
        warc.parsed(bad)
    with pytest.raises(ValueError):
        warc.parsed(good[:-3])
    path.write_bytes(warc.gzip_member(good)[:-9])
    with path.open("rb") as f, pytest.raises(EOFError):
        list(warc.members(f))


# ---- exact dedup (8)


@pytest.mark.parametrize(("bits", "spread"), [(61, 1 << 61), (12, 1 << 12), (20, 300), (61, 40)])
def test_quotient_filters_hold_count_and_merge_losslessly(bits, spread):
    """Narrow spreads make long runs that spill far from their homes, past the last one too."""
    rng = np.random.default_rng(0)
    for size in (0, 1, 7, 900, 3000):
        prints = rng.integers(0, spread, size, dtype=np.uint64) + np.uint64((1 << bits) - spread)
        prints[rng.integers(0, size, size // 3) if size else []] = prints[0] if size else 0
        want = Counter(prints.tolist())
        whole = filters.CountingQuotientFilter.build(prints, bits)
        back = filters.CountingQuotientFilter.unpack(whole.pack())
        for f in (whole, back):
            found, counts = f.items()
            assert (np.diff(found.astype(object)) > 0).all() and dict(zip(found.tolist(), counts.tolist(), strict=True)) == want
        for x in [*list(want)[:200], 5, (1 << bits) - 1]:
            assert back.count(x) == want.get(x, 0)
        parts = [filters.CountingQuotientFilter.unpack(filters.CountingQuotientFilter.build(p, bits).pack()) for p in np.array_split(prints, 7)]
        merged = filters.CountingQuotientFilter.merged(parts, bits)
        assert dict(zip(*(x.tolist() for x in merged.items()), strict=True)) == want
        assert merged.pack() == whole.pack()


@pytest.mark.parametrize("weak", [False, True])
def test_exact_copies_against_brute_force(spark, corpus, weak, monkeypatch):
    rows = [*corpus, (400, " " + corpus[3][1] + " "), (401, corpus[3][1].replace(" ", "\x0b")), (402, "b\xa0c"), (403, "bc")]
    docs = stored(spark, rows)
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub("[\x20\x09-\x0d]", "", t or "")].append((-len(t or ""), i))
    want = Counter()
    for norm, members in groups.items():
        keep = min(members)[1]
        for n, (_, i) in enumerate(sorted(members)):
            want[i, keep, len(members), n == 0, hashlib.sha256(norm.encode()).hexdigest()] += 1
    got = Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.copies_of(docs).collect())
    assert got == want
    if weak:  # all texts of one length have one fingerprint: bytes tell them apart
        monkeypatch.setattr(exact_dedup, "fingerprint", lambda norm: F.xxhash64(F.length(norm) % 7))
        assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.copies_of(docs).collect()) == want
    kept = exact_dedup.keep_first(docs.withColumn("__row", F.lit("mine")))
    assert kept.columns == [*docs.columns, "__row"] and kept.count() == len(groups)
    assert exact_dedup.copies_of(stored(spark, [])).count() == 0


def test_exact_copies_when_the_source_is_split_otherwise_between_scans(spark, corpus, monkeypatch):
    docs = stored(spark, corpus, 6)
    want = {re.sub("[\x20\x09-\x0d]", "", t or "") for _, t in corpus}
    with other_splits(spark, monkeypatch, exact_dedup, "written"):
        kept = [re.sub("[\x20\x09-\x0d]", "", r.text or "") for r in exact_dedup.keep_first(docs).collect()]
    assert sorted(kept) == sorted(want)


# ---- n-gram Jaccard (9)


def brute_groups(rows, k, num, den):
    sets = []
    for i, t in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        n = min(k, len(w))
        sets.append((i, {tuple(w[a : a + n]) for a in range(len(w) - n + 1)} if n else set()))
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            if x and den * len(x & y) >= num * len(x | y):
                p, q = find(i), find(j)
                parent[max(p, q)] = min(p, q)
    return Counter((i, len(x), find(i)) for i, x in sets)


@pytest.mark.parametrize("tile", [8 << 20, 1500])
@pytest.mark.parametrize(("k", "num", "den"), [(4, 85, 100), (5, 80, 100), (1, 60, 100)])
def test_near_groups_against_brute_force(spark, corpus, monkeypatch, tile, k, num, den):
    monkeypatch.setattr(jaccard, "TILE_BYTES", tile)  # small tiles: groups fill several of them
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.near_groups(documents(spark, corpus), k, num, den).collect())
    assert got == brute_groups(corpus, k, num, den)


def test_near_groups_chains_over_many_tiles(spark, monkeypatch):
    """Families whose ends aren't similar: links only through what lies between, in other tiles."""
    rng = random.Random(9)
    rows = []
    for f in range(3):
        t = words(rng, 90, 10**6).split()
        for k in range(25):
            rows.append((1000 * f + k, " ".join(t)))
            for _ in range(2):
                t[rng.randrange(len(t))] = f"y{rng.randrange(10**6)}"
    monkeypatch.setattr(jaccard, "TILE_BYTES", 2500)
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.near_groups(documents(spark, rows), 1, 90, 100).collect())
    assert got == brute_groups(rows, 1, 90, 100)


def test_part_hashes_miss_no_linked_pair():
    rng = np.random.default_rng(0)
    for num, den in ((85, 100), (80, 100)):
        signer = jaccard.Signer(num, den)
        for _ in range(1500):
            n = int(rng.choice([1, 5, 6, 20, 38, 41, 45, 60, 100, 200, 500]))
            a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2))
            most = int(n * 0.2) + 2
            more = rng.integers(0, 2**63, rng.integers(0, most), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
            b = np.unique(np.concatenate([rng.permutation(a)[rng.integers(0, most) :], more]))
            common = len(np.intersect1d(a, b))
            if len(b) and den * common >= num * (len(a) + len(b) - common):
                assert len(np.intersect1d(signer.sign(a), signer.sign(b)))


def test_keep_one_of_each_group(spark, corpus):
    docs = documents(spark, corpus)
    kept = jaccard.keep_one(docs)
    want = {i for (i, _, c) in brute_groups(corpus, 5, 80, 100) if i == c}
    assert {r.doc_id for r in kept.collect()} == want and kept.columns == docs.columns
    assert jaccard.near_groups(documents(spark, [])).count() == 0


def test_keep_one_decides_by_row_where_ids_are_null_or_repeated(spark):
    rng = random.Random(11)
    a, b, c, clean = (words(rng, 80, 10**6) for _ in range(4))
    rows = [(None, a), (None, a + " more"), (5, b), (5, b + " more"), (6, c), (7, c + " more"), (7, clean), (None, clean + " more"), (None, ""), (None, None)]
    kept = Counter((r.doc_id, r.text) for r in jaccard.keep_one(stored(spark, rows, 1)).collect())
    assert kept == Counter([rows[i] for i in (0, 2, 4, 6, 8, 9)])


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1060)]
    parent: dict[int, int] = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        p, q = find(a), find(b)
        parent[max(p, q)] = min(p, q)
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in {y for a, b in edges if a != b for y in (a, b)}}


# ---- quality (10)


def test_quality_on_held_out_rows(spark):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        t = "".join(f"{w}### " for w in words(rng, 40).split()) if bad and i % 8 else " ".join(["BUY!!"] * 60) if bad else words(rng, rng.randrange(20, 90)) + "."
        rows.append((i, t))
        labels.append((i, 0 if bad else 1))
    rows += [(1000, ""), (1001, None), (1002, "  ")]
    docs = documents(spark, rows)
    table = spark.createDataFrame([*labels, (None, 1), (5, None)], "doc_id long, quality int")
    model = quality.fit_quality(docs, table.filter(quality.fold() != 0), most=300)
    assert len(model.labels) <= 300
    got = {r.doc_id: r.score for r in quality.with_score(docs, model).collect()}
    held = [i for i, _ in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    right = sum((got[i] >= 0.3) == (dict(labels)[i] == 1) for i in held)
    assert right >= 0.97 * len(held)
    assert got[1000] == got[1001] == got[1002] == pytest.approx(model.base)
    nothing = quality.fit_quality(docs, table.limit(0))
    assert {r.score for r in quality.with_score(docs, nothing).collect()} == {0.5}
    assert quality.with_score(docs.limit(0), model).count() == 0


# ---- pipeline


def test_pipeline_against_its_parts(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(8)
    item = words(rng, 50, 10**5)
    rows = [(i, words(rng, rng.randrange(30, 90), 5000) + ".") for i in range(60)]
    rows += [(100 + i, " ".join(["SPAM!!"] * 50)) for i in range(15)]
    copies = [(200 + i, rows[i][1]) for i in range(5)]
    near = [(300 + i, rows[10 + i][1].replace(".", " tail.")) for i in range(5)]
    leaked = [(400, words(rng, 30) + " " + item), (401, item)]
    rows += copies + near + leaked
    labels = [(i, 0 if 100 <= i < 200 else 1, 0) for i, _ in rows if i < 200]
    sf = str(tmp_path)
    documents(spark, rows).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    docs, left = spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, sf)
        assert kept.columns == docs.columns
        kept.write.parquet(f"{sf}/{name}")
        docs = spark.read.parquet(f"{sf}/{name}")
        left.append({r.doc_id for r in docs.collect()})
    want = {i for i, _ in rows if not 100 <= i < 200}
    assert left[0] == want
    assert left[1] == want - {200 + i for i in range(5)}
    assert left[2] == {i for (i, _, c) in brute_groups([(i, t) for i, t in rows if i in left[1]], 5, 80, 100) if i == c}
    assert left[3] == left[2] - {400, 401}
    packed = corpus_pipeline.run(spark, sf)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == left[3]
    assert packed.groupBy("doc_id").agg((F.sum("length") == F.max("doc_tokens")).alias("whole")).filter("NOT whole").count() == 0


def test_pipeline_over_odd_tables(spark, corpus, tmp_path):
    """Null, empty, blank, very long, repeated and tied texts, null and repeated ids, clashing columns; an empty table; nothing left behind."""
    import corpus_pipeline

    rows = [*corpus, (None, corpus[4][1]), (None, None), (7, "another text altogether"), (309, words(random.Random(4), 20_000))]
    sf, names = str(tmp_path), ["row", "__row", "__score", "__hits", "norm", "fingerprint", "points", "key", "n", "group", "score", "hits"]
    docs = documents(spark, rows).select("*", *(F.lit(i).alias(c) for i, c in enumerate(names)))
    docs.write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i, _ in corpus[:20]], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, None), (2, "one two")], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    now, left = spark.read.parquet(f"{sf}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, now, sf)
        assert kept.columns == docs.columns
        kept.write.parquet(f"{sf}/{name}")
        now = spark.read.parquet(f"{sf}/{name}")
        left[name] = [(r.doc_id, r.text) for r in now.collect()]
    assert len(left["quality"]) == len(rows)  # all labels are 1
    norm = lambda t: re.sub("[\x20\x09-\x0d]", "", t or "")
    assert sorted(norm(t) for _, t in left["exact_dedup"]) == sorted({norm(t) for _, t in rows})
    numbered = [(i, t) for i, (_, t) in enumerate(left["exact_dedup"])]
    assert len(left["near_dedup"]) == len({c for _, _, c in brute_groups(numbered, 5, 80, 100)})
    assert {t for _, t in left["near_dedup"]} - {t for _, t in left["decontamination"]} == {t for _, t in left["near_dedup"] if t and re.search(r"\bone\W+two\b", t.lower())}
    packed = corpus_pipeline.STAGES[-1][1](spark, now, sf)
    assert packed.agg(F.sum("length")).first()[0] == sum(len(tokens.encoder(BYTE_BPE, True).whole(t or "")) // 4 + 1 for _, t in left["decontamination"])
    assert corpus_pipeline.run(spark, sf).agg(F.sum("length")).first() == packed.agg(F.sum("length")).first()
    spark.read.parquet(f"{sf}/documents.parquet").limit(0).write.parquet(f"{sf}/none/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{sf}/{t}.parquet").write.parquet(f"{sf}/none/{t}.parquet")
    assert corpus_pipeline.run(spark, f"{sf}/none").count() == 0


def test_freed_memory_goes_back_to_the_system(spark):
    """Blocks of 64 KB below one that is still held: glibc keeps them until it is told."""
    held = lambda: int(Path("/proc/self/statm").read_text().split()[1]) * os.sysconf("SC_PAGESIZE") >> 20
    before = held()
    blocks = [bytearray(os.urandom(1 << 16)) for _ in range(2400)]
    last = blocks[-1]
    assert held() - before > 100
    del blocks
    released(spark)
    assert held() - before < 50 and len(last) == 1 << 16


def test_pipeline_stages_begin_by_giving_memory_back(spark, monkeypatch):
    import corpus_pipeline

    docs = spark.createDataFrame([(1, "a few words of a text"), (2, "a few words of a text")], "doc_id long, text string")
    calls = []
    monkeypatch.setattr(corpus_pipeline, "released", calls.append)
    assert corpus_pipeline.no_exact_copies(spark, docs, "").count() == 1
    assert calls == [spark]
