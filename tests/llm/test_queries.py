"""Each opN query as it is registered, over a small folder of odd tables, against brute force.

The tables hold null, empty, blank and very long texts, ties, repeated rows, null and repeated ids, and extra columns whose
names the operators use inside. Each query also runs over empty tables, and the operators over ids that are words.
"""

import hashlib
import heapq
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_corpus import BYTE_BPE, WORD_BPE, brute_groups, brute_removed, corpus, words  # noqa: F401

from tidemark.llm import chat, decontaminate, exact_dedup, jaccard, packing, quality, registry, sharding, substring_dedup, token_orc, tokens
from tidemark.llm.common import shared_folder

#: Names that operators use inside, as columns of the tables.
CLASHING = ["row", "__row", "norm", "__norm", "fingerprint", "points", "hits", "__hits", "score", "__score", "key", "n", "bytes", "group", "cell", "block", "base", "rep", "size", "Digest", "payload", "held", "salt", "__kept", "copies"]


def clashing(df):
    return df.select("*", *(F.lit(i).alias(c) for i, c in enumerate(CLASHING)))


@pytest.fixture(scope="module")
def rows(corpus):  # noqa: F811
    rng = random.Random(12)
    passage = words(rng, 80)
    long = " ".join(words(rng, 300) + " " + passage for _ in range(90))  # 200 kB
    return [*corpus, (400, long), (401, long[50_000:90_000]), (402, long), (402, corpus[1][1]), (403, " ".join(["same"] * 400)), (404, "what is two two"), (405, passage), (None, corpus[0][1]), (None, None)]


@pytest.fixture(scope="module")
def tables(rows):
    rng = random.Random(13)
    item = words(rng, 40, 9000)
    cut = item.split()
    rows = [*rows, (500, f"a b c {item} d"), (501, " ".join(cut[25:] + cut[12:25] + cut[:12])), (502, " ".join(cut[:9]) + " " + words(rng, 60, 9000))]
    big = "<p>" + "é" * 900
    return {
        "documents": ("doc_id long, text string, lang string, source string, n_chars long", [(i, t, "en", "s", len(t or "")) for i, t in rows]),
        "benchmark": ("item_id long, text string", [(1, item), (2, words(rng, 30, 9000)), (3, None), (4, ""), (5, "what is two two"), (6, item), (7, "same same same same same same")]),
        "labels": ("doc_id long, quality int, toxic int", [(i, 0 if i == 403 else 1, 0) for i, _ in rows if i is not None and i % 2] + [(403, 0, 0), (403, 1, 0), (None, 1, 0), (2, None, 0), (10**6, 0, 0)]),
        "pages": ("page_id long, url string, html string", [(1, "u", big), (2, None, big), (3, "u", "small"), (4, "u", "small"), (5, "u", None), (6, "u", ""), (7, "u", "x" * 999), (8, "u", "x" * 999), (9, "u", "y" * 1000), (10, "u", "y" * 1000), (11, "u", "z" * 300_000), (11, "u", "z" * 300_000), (None, "u", big)]),
        "conversations": ("conv_id long, turn long, role string, text string", [(1, 0, "user", "a <|im_end|> b"), (1, 1, "assistant", "fine\n"), (1, 2, None, None), (2, 0, "assistant", "z" * 200_000), (2, 1, "assistant", "é"), (3, 0, "system", ""), (4, 5, "user", "t"), (4, 5, "user", "t"), (None, 0, "assistant", "lost")]),
    }


@pytest.fixture(scope="module")
def sf(spark, tables):
    folder = shared_folder(spark, "queries")
    for name, (schema, data) in tables.items():
        clashing(spark.createDataFrame(data, schema).repartition(3)).write.parquet(f"{folder}/{name}.parquet")
    return folder


@pytest.fixture(scope="module")
def docs(tables):
    return [(i, t) for i, t, *_ in tables["documents"][1]]


def result(spark, sf, name):
    return registry.queries()[name](spark, sf).collect()


def keyed(found):
    return sorted(found, key=str)


def sha(data):
    return hashlib.sha256(data).hexdigest()


def test_op1(spark, sf, docs):
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in result(spark, sf, "op1_suffix_array_dedup")]
    want = [(i, n, gone, runs, sha(kept)) for i, n, gone, runs, kept in brute_removed([(str(i), t) for i, t in docs], 200)]
    assert keyed((str(i), *rest) for i, *rest in got) == keyed(want)


def tiled(item, text):
    """Words of the item that greedy tiling marks, and the tiles it takes, by trying all places."""
    fi, ft, covered, made = [1] * len(item), [1] * len(text), 0, 0
    spots = defaultdict(list)
    for j, w in enumerate(text):
        spots[w].append(j)
    while True:
        found = []
        for i, w in enumerate(item):
            for j in spots[w]:
                k = 0
                while i + k < len(item) and j + k < len(text) and fi[i + k] and ft[j + k] and item[i + k] == text[j + k]:
                    k += 1
                found.append((-k, i, j))
        if not found or -min(found)[0] < 5:
            return covered, made
        longest = -min(found)[0]
        for k, i, j in sorted(found):
            if -k == longest and all(fi[i : i + longest]) and all(ft[j : j + longest]):
                fi[i : i + longest] = ft[j : j + longest] = [0] * longest
                covered, made = covered + longest, made + 1


def test_op2(spark, sf, docs, tables):
    items = [(i, re.findall(r"\w+", (t or "").lower())) for i, t in tables["benchmark"][1]]
    got = [(r.doc_id, r.contaminated, r.item_id, round(r.coverage, 6), r.n_tiles, tuple(r.item_ids)) for r in result(spark, sf, "op2_string_tiling_decontamination")]
    want, known = [], {}
    for i, t in docs:
        text = re.findall(r"\w+", (t or "").lower())
        hits = []
        for number, item in items:
            runs = {tuple(item[a : a + 5]) for a in range(len(item) - 4)}
            if item and len(item) < 5:
                if any(text[a : a + len(item)] == item for a in range(len(text))):
                    hits.append((-1.0, number, 1))
            elif any(tuple(text[a : a + 5]) in runs for a in range(len(text))):
                spot = tuple(item), tuple(text)
                if spot not in known:
                    known[spot] = tiled(item, text)
                covered, made = known[spot]
                if covered >= 0.6 * len(item):
                    hits.append((-covered / len(item), number, made))
        hits.sort()
        best = hits[0] if hits else (0.0, None, 0)
        want.append((i, bool(hits), best[1], round(-best[0], 6), best[2], tuple(h[1] for h in hits)))
    assert keyed(got) == keyed(want)
    assert {r[0] for r in got if r[1]} == {500, 501, 404, 403}


def test_op3(spark, sf, tables):
    turns = defaultdict(list)
    for c, n, role, text in [*tables["conversations"][1], (-1, 0, "user", chat.PLANTED), (-1, 1, "assistant", chat.PLANTED)]:
        turns[c].append((n, role or "", text or ""))
    want = []
    for c, said in turns.items():
        said.sort()
        learnt = "".join(t for _, r, t in said if r == "assistant")
        formatted = sum(len(f"<|im_start|>{r}\n{re.sub('<(\x1b*)[|]', '<\x1b\\1|', t)}<|im_end|>\n") for _, r, t in said)
        want.append((c, len(said), sha("".join(f"{r}\n{t}\n" for _, r, t in said).encode()), len(learnt), sha(learnt.encode()), formatted))
    got = [(r.conv_id, r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.formatted_chars) for r in result(spark, sf, "op3_typed_chat_format")]
    assert keyed(got) == keyed(want)


def test_op4(spark, sf, docs):
    encoder, whole = tokens.Encoder(BYTE_BPE, True), Counter()
    for i, t in docs:
        whole[i, encoder.whole(t or "") + b"\0\0\0\0"] += 1
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in result(spark, sf, "op4_sum_of_squares_packing"):
        pieces[r.doc_id, r.doc_tokens].append((r.start, r.length, r.ids_crc32))
        sequences[r.sequence_id].append((r.offset, r.length))
    for s in sequences.values():
        s.sort()
        assert [a for a, _ in s] == np.cumsum([0] + [n for _, n in s])[:-1].tolist() and sum(n for _, n in s) <= 1024
    assert sum(sum(n for _, n in s) < 1024 for s in sequences.values()) <= 3  # one a partition
    want = defaultdict(Counter)
    for (i, ids), times in whole.items():
        want[i, len(ids) // 4][ids] += times
    assert set(pieces) == set(want)
    for key, texts in want.items():
        ids = list(texts.elements())
        assert sum(n for _, n, _ in pieces[key]) == key[1] * len(ids)
        if len(ids) == 1 or len(texts) == 1:  # where several documents share an id and a length, the pieces can't be told apart
            assert all(zlib.crc32(ids[0][4 * a : 4 * (a + n)]) == crc for a, n, crc in pieces[key])
            assert Counter(x for a, n, _ in pieces[key] for x in range(a, a + n)) == Counter({x: len(ids) for x in range(key[1])})


def test_op5(spark, sf, docs):
    got, weight, heap = result(spark, sf, "op5_lpt_sharding"), Counter(), [(0, s) for s in range(24)]
    for _, t in docs:
        weight[t or ""] += len((t or "").encode()) + 8
    for size in sorted(weight.values(), reverse=True):
        load, shard = heapq.heappop(heap)
        heapq.heappush(heap, (load + size, shard))
    loads, slots = Counter(), defaultdict(list)
    for r in got:
        loads[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert sorted((loads[s], s) for s in range(24)) == sorted(heap)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert keyed((r.doc_id, r.size, r.text_crc32) for r in got) == keyed((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in docs)
    together = defaultdict(set)
    for r in got:
        together[r.text_crc32].add(r.shard)
    assert all(len(s) == 1 for s in together.values()) and {(r.law, r.grown_shard) for r in got} == {("bytes", None)}


def test_op6(spark, sf, tables):
    pages = [(i, (t or "").encode()) for i, _, t in tables["pages"][1]]
    first, met, want = {}, Counter(), []
    for i, data in pages:
        if len(data) >= 1000:
            first[data] = max(first.get(data, -1), -1 if i is None else i)
    for i, data in pages:
        best = first.get(data)
        revisits = best is not None and (best != i or met[data, i] > 0)
        met[data, i] += 1
        want.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisits else "response", best if revisits else None))
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in result(spark, sf, "op6_warc")]
    assert keyed(got) == keyed(want)


def test_op7(spark, sf, docs):
    encoder, got = tokens.Encoder(WORD_BPE, False), result(spark, sf, "op7_token_orc")
    ids = [(i, encoder.whole(t or "") + b"\1\0\0\0") for i, t in docs]
    assert keyed((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == keyed((i, len(x) // 4, zlib.crc32(x)) for i, x in ids)
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    order = [-1 if r.doc_id is None else r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert order == sorted(order)


def test_op8(spark, sf, docs):
    groups, want = defaultdict(list), []
    for i, t in docs:
        groups[re.sub("[\x20\x09-\x0d]", "", t or "")].append((-len(t or ""), i is None, i or 0))
    for norm, members in groups.items():
        best = min(members)
        for n, (_, unknown, i) in enumerate(sorted(members)):
            want.append((None if unknown else i, None if best[1] else best[2], len(members), n == 0, sha(norm.encode())))
    got = [(r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in result(spark, sf, "op8_quotient_filter_dedup")]
    assert keyed(got) == keyed(want)


def test_op9(spark, sf, docs):
    known = [(i, t) for i, t in docs if i is not None]  # a null id links as one unknown document does
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in result(spark, sf, "op9_ngram_jaccard_join"))
    want = brute_groups(known, 4, 85, 100)
    assert Counter({k: n for k, n in got.items() if k[0] is not None}) == want
    assert sum(n for k, n in got.items() if k[0] is None) == 2


def test_op10(spark, sf, docs, tables):
    got = result(spark, sf, "op10_lsa_neighbour_quality")
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 0
    assert keyed((r.doc_id, r.held_out) for r in got) == keyed((i, held(i)) for i, _ in docs)
    assert all(r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in got)
    label = {}
    for i, q, _ in tables["labels"][1]:
        if i is not None and q is not None and not held(i):
            label[i] = min(q, label.get(i, 1))
    counter, text_of = quality.Counter(), defaultdict(list)
    for i, t in docs:
        text_of[i].append(t or "")
    model = quality.fit_quality(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), spark.createDataFrame(list(label.items()), "doc_id long, quality int"))
    assert sorted(model.labels.tolist()) == sorted(float(label[i]) for i in label for _ in text_of[i])  # all labelled rows, held-out ones left out
    near = model.project(counter.counts([t or "" for _, t in docs])).astype(np.float64) @ model.vectors.astype(np.float64).T
    scores = defaultdict(list)
    for r in got:
        scores[r.doc_id].append(r.score)
    for (i, t), line in zip(docs, near, strict=True):
        order = np.argsort(-line, kind="stable")[: quality.NEIGHBOURS]
        weight = np.maximum(line[order], 0) ** quality.POWER
        want = float((weight * model.labels[order]).sum() / weight.sum()) if weight.sum() > 1e-12 else model.base
        assert min(abs(s - want) for s in scores[i]) < 1e-3, i
    by_text = defaultdict(set)
    for i, t in docs:
        if len(text_of[i]) == 1:
            by_text[t or ""].add(round(scores[i][0], 4))
    assert all(len(s) == 1 for s in by_text.values())  # equal texts, equal scores


def test_votes_with_ties():
    near = np.array([[0.5, 0.9, 0.5, 0.5, -1.0], [0, 0, 0, 0, 0], [1, 1, 1, 1, 1]], dtype=np.float32)
    labels = np.array([1.0, 0.0, 0.0, 1.0, 1.0])
    got = quality.vote(near, labels, 2, 0.6)
    share = 0.5**quality.POWER / (0.5**quality.POWER + 0.9**quality.POWER)
    assert got == pytest.approx([share, 0.6, 0.5], rel=1e-4)
    assert quality.vote(near, labels, 9, 0.6)[2] == pytest.approx(0.6)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_empty_tables(spark, tables, name, tmp_path):
    for t, (schema, _) in tables.items():
        clashing(spark.createDataFrame([], schema)).write.parquet(f"{tmp_path}/{t}.parquet")
    found = result(spark, str(tmp_path), name)
    assert found == [] if name != "op3_typed_chat_format" else [r.conv_id for r in found] == [-1]


def test_ids_that_are_words(spark, rows):
    """The same results as with numbers, under names that sort alike."""
    few = [r for r in rows if r[0] is not None and r[0] < 305]
    named = lambda i: f"doc-{i:05}"
    plain = spark.createDataFrame(few, "doc_id long, text string")
    words_ = spark.createDataFrame([(named(i), t) for i, t in few], "doc_id string, text string")

    def same(call, *ids):
        a, b = ([r.asDict() for r in call(d).collect()] for d in (plain, words_))
        assert keyed(r | {c: named(r[c]) for c in ids} for r in a) == keyed(b)

    same(lambda d: substring_dedup.remove_repeats(d, 80).drop("removed", "kept"), "doc_id")
    same(lambda d: packing.pack_documents(d.coalesce(1), BYTE_BPE).groupBy("doc_id").agg(F.sum("length").alias("n")), "doc_id")
    same(lambda d: sharding.shard_documents(d, 3).select("doc_id", "size", "text_crc32"), "doc_id")
    same(lambda d: exact_dedup.copies_of(d).drop("row"), "doc_id", "keep_id")
    same(lambda d: jaccard.near_groups(d), "doc_id", "component_id")
    for d, kind in ((plain, "long"), (words_, "string")):
        path = shared_folder(spark, "orc-ids")
        token_orc.write_token_orc(d, path, WORD_BPE)
        got = token_orc.checksums(token_orc.read_token_orc(spark, path, kind)).orderBy("start").collect()
        assert [r.doc_id for r in got] == sorted(r.doc_id for r in got) and len(got) == len(few)


def test_least_id_and_stages_with_clashing_columns(spark, rows):
    low = -(1 << 63)
    docs = clashing(spark.createDataFrame([(low, "a b c d e f g"), (7, "abcdefg"), (None, "a bcdefg"), (3, "else")], "doc_id long, text string"))
    got = {(r.doc_id, r.keep_id, r.kept) for r in exact_dedup.copies_of(docs).collect()}
    assert got == {(low, low, True), (7, low, False), (None, low, False), (3, 3, True)}
    bench = spark.createDataFrame([(1, "something else altogether in here")], "item_id long, text string")
    model = quality.fit_quality(docs, spark.createDataFrame([(3, 1)], "doc_id long, quality int"))
    for kept in (exact_dedup.keep_first(docs), jaccard.keep_one(docs), decontaminate.clean(docs, bench)):
        assert kept.columns == docs.columns and kept.count() >= 2 and kept.select("row").first().row == 0
    assert quality.with_score(docs, model).columns[-1] == "score_" and quality.with_score(docs, model).select("score_").count() == 4
    assert decontaminate.with_hits(docs, bench).select("hits_").count() == 4
