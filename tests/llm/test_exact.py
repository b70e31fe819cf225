"""Operators with exact results, against brute force written from their contracts."""

import hashlib
import random
import re
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models
from tokenizers import pre_tokenizers as pre

from folioflow.llm import common, decontam, packing, quality, sharding, simhash, token_count, token_file, token_output, tokenizing
from folioflow.llm.common import table

LONG = " ".join(f"word{k % 37} tail{k % 11}," for k in range(9000))
TEXTS = [
    None, "", " \t\n", "one", "one two three", "One two THREE one two three one two three", "same line\nsame line\n\nother |x| #tag $5\nsame line",
    "the cat sat on the mat " * 30, "ÉTÉ naïve 中文 \U0001f600 x y　z", "a  b\n\n c \t d\r\ne", "don't stop!! now,. 's 123 4567", LONG, LONG, LONG + " end", "x" * 20000, "tie tie", "<|endoftext|> plain",
]
SCHEMA = "doc_id long, text string, row long, fp string, _words string, shard int, piece int, counters int"


@pytest.fixture(scope="module")
def docs(spark):
    """Null ids, repeated rows and ids, clashing columns."""
    rows = [(k, t, 0, "z", None, 1, 2, 3) for k, t in enumerate(TEXTS)] + [(None, "one two three", 0, "z", None, 1, 2, 3), (4, "one two three", 0, "z", None, 1, 2, 3), (4, "another text", 0, "z", None, 1, 2, 3)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df):
    return df.select("doc_id", "text").collect()


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_quality_base(docs, empty):
    def brute(text):
        w, text = words(text), text or ""
        grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        count = {}
        for g in grams:
            count[g] = count.get(g, 0) + 1
        hit = {j for i, g in enumerate(grams) if count[g] > 1 for j in (i, i + 1, i + 2)}
        lines = [x for x in text.split("\n") if words(x)]
        return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit)

    got = quality.quality_rules(docs).collect()
    names = "n_words word_chars n_symbols n_dup_lines n_repeat_words".split()
    want = sorted(((r.doc_id, *brute(r.text)) for r in rows_of(docs)), key=str)
    assert sorted(((r.doc_id, *(r[n] for n in names)) for r in got), key=str) == want
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and (not r.base_failed or not r.kept)
    assert quality.quality_rules(empty).count() == 0
    plan = quality.quality_rules(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_quality_keeps_clean_and_rejects_junk(spark, sf):
    held = quality.quality_rules(table(spark, sf, "documents")).where("not base_failed").join(table(spark, sf, "labels").dropDuplicates(["doc_id"]), "doc_id").collect()
    good, bad = [r.kept for r in held if r.quality == 1], [r.kept for r in held if r.quality == 0]
    assert sum(good) / len(good) > 0.9 and sum(bad) <= len(bad) / 2


def plain_fingerprint(text):
    w = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x) for x in words(text)]
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(fps, radius=4):
    up = {f: f for f in fps}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for x in up:
        for y in up:
            if (x ^ y).bit_count() <= radius:
                up[top(x)] = top(y)
    return {f: top(f) for f in up}


def test_simhash(docs, empty, spark, sf):
    sample = table(spark, sf, "documents")
    for source in (docs, sample):
        rows = rows_of(source)
        fps = [plain_fingerprint(r.text) for r in rows]
        root = plain_components(set(fps))
        least = {}
        for r, f in zip(rows, fps, strict=True):
            if r.doc_id is not None:
                least[root[f]] = min(least.get(root[f], r.doc_id), r.doc_id)
        want = sorted(((r.doc_id, f"{f:016x}", least.get(root[f])) for r, f in zip(rows, fps, strict=True)), key=str)
        assert sorted((tuple(r) for r in simhash.near_duplicates(source).collect()), key=str) == want
        kept = simhash.one_of_each(source)
        assert kept.columns == source.columns and kept.count() == len(set(root.values()))
    assert simhash.near_duplicates(empty).count() == 0 and simhash.one_of_each(empty).count() == 0


def test_simhash_blocks_lose_no_link(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 60, dtype=np.int64).astype(np.uint64)
    fps = np.unique(np.concatenate([base, *[base ^ np.uint64(1 << int(b)) for b in rng.integers(0, 63, 6)], base ^ np.uint64(0b1111), np.array([0, 15, 31], np.uint64)]))
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    want = plain_components(fps.tolist())
    for block in (1 << 15, 7):
        root = {r.node: r.root for r in simhash.components(simhash.links(df, 4, block)).collect()}
        got = {}
        for f in fps:
            got.setdefault(root.get(int(f.view(np.int64)), int(f.view(np.int64))), set()).add(int(f))
        groups = {}
        for f, r in want.items():
            groups.setdefault(r, set()).add(f)
        assert sorted(map(sorted, got.values())) == sorted(map(sorted, groups.values()))


def test_components_by_one_task_and_by_rounds(spark, monkeypatch):
    """Chains, stars and links of a node with itself; few links take few jobs, however long the chains are."""
    rng = np.random.default_rng(6)
    names = rng.integers(-(2**63), 2**63 - 1, 900, dtype=np.int64).tolist()
    pairs = list(zip(names[:40], names[1:40], strict=False)) + [(names[400], x) for x in names[401:440]] + [(names[600], names[600])]
    pairs += [(names[k], names[j]) for k, j in rng.integers(700, 740, (20, 2)).tolist()]
    root = {x: x for p in pairs for x in p}
    for _ in root:
        before = dict(root)
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
        if root == before:
            break
    edges, context = spark.createDataFrame(pairs, "u long, v long"), spark.sparkContext
    for most in (simhash.ONE_TASK, 0):
        monkeypatch.setattr(simhash, "ONE_TASK", most)
        context.setJobGroup(f"components {most}", "")
        got = simhash.components(edges).collect()
        context.setLocalProperty("spark.jobGroup.id", None)
        assert len(got) == len(root) and {r.node: r.root for r in got} == root
        jobs = len(context.statusTracker().getJobIdsForGroup(f"components {most}"))
        assert jobs <= 8 if most else jobs > 20, jobs


def test_decontamination_chunks_agree(docs, empty, spark):
    items = [(1, "one two three one two three"), (2, "the cat"), (3, " ".join(f"word{k % 37} tail{k % 11}" for k in range(5, 30))), (4, None), (5, "??"), (1, "THREE one two"), (None, "x")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")

    def norm(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))

    windows = {}
    for i, t in items:
        w = norm(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[k : k + 10]), set()).add("" if i is None else str(i))

    def brute(text):
        w, hit, found = norm(text), set(), set()
        for g, who in windows.items():
            for k in range(len(w) - len(g) + 1):
                if tuple(w[k : k + len(g)]) == g:
                    hit.update(range(k, k + len(g)))
                    found |= who
        return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)

    want = sorted(((r.doc_id, *brute(r.text)) for r in rows_of(docs)), key=str)
    for chunk in (4_000_000, 300):
        assert sorted((tuple(r) for r in decontam.digest(decontam.find_hits(docs, benchmark, chunk_chars=chunk)).collect()), key=str) == want
        assert decontam.drop_contaminated(docs, benchmark, chunk_chars=chunk).count() == sum(not r[-1] for r in want)
    assert decontam.digest(decontam.find_hits(empty, benchmark)).count() == 0
    assert not any(r.contaminated for r in decontam.digest(decontam.find_hits(docs, benchmark.limit(0))).collect())
    text = "Oh, the CAT sat"
    built = decontam.automaton("t", [("2", b"the cat")], 10)
    (a, b), = decontam.spans_in(text.encode(), decontam.scan(text.encode(), built)[1])
    assert text.encode()[a:b] == b"the CAT"


def test_sharding(docs, empty, spark, sf):
    def jump(key, n):
        b, j = -1, 0
        while j < n:
            b = j
            key = (key * 2862933555777941757 + 1) & (2**64 - 1)
            j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
        return b

    keys = np.random.default_rng(1).integers(-(2**63), 2**63 - 1, 500).view(np.uint64)
    for n in (1, 2, 16, 17, 1000):
        assert sharding.jump(keys, n).tolist() == [jump(int(k), n) for k in keys]
    for source in (docs, table(spark, sf, "documents")):
        got = sharding.assign_shards(source).collect()
        assert sorted(((r.doc_id, r.size, r.text_crc32) for r in got), key=str) == sorted(((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in rows_of(source)), key=str)
        for s in {r.shard for r in got}:
            assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
        assert all(r.grown_shard in (r.shard, 16) and r.law == "key" and 0 <= r.shard < 16 for r in got)
    assert sharding.assign_shards(empty).count() == 0


@pytest.mark.parametrize("name,keeps", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_encoder_is_the_tokenizer(spark, sf, name, keeps):
    path = public_tokenizers.path(name)
    plain = Tokenizer.from_file(path)
    plain.encode_special_tokens = True
    texts = [t for t in TEXTS if t is not None] + [r.text for r in table(spark, sf, "documents").select("text").limit(80).collect()] + ["ΣΑΣ ΟΔΟΣ İstanbul é Å ﬁ", "ABC.def,,ghi 's", "tail ", " lead", "\n", "a \nb"]
    encode = tokenizing.encoder(path, keeps)
    assert [encode(t) for t in texts] == [np.array(e.ids, "<u4").tobytes() for e in plain.encode_batch(texts, add_special_tokens=False)]


def test_new_words_are_encoded_together(monkeypatch):
    """Texts are encoded as by the tokenizer alone, and thousands of new words take few calls of it."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    plain.encode_special_tokens = True
    rng = random.Random(5)
    words = ["it's", "Bar.", "añb", "$$", "中文", ",,", "'ll", "a1", "<|endoftext|>", "é", "🙂", "\u0301", "٣", "a\u02bcb", "\0", "\0x", "x" * 90]
    marks = [" "] * 12 + ["\n"] * 3 + ["  ", "\n\n", " \n", "\n ", "\t", "\u2003"]
    texts = ["".join(rng.choice(words) + rng.choice(marks) for _ in range(rng.randrange(9))) for _ in range(4000)]
    texts += [None, "", " ", "\n", " a", "\na", "a ", "a\n", "\0", "\0a", *(t for t in TEXTS if t)]
    made = ["".join(rng.choice("abcdeghilmnorstu") for _ in range(9)) for _ in range(8000)]
    texts += [" ".join(made[k : k + 80]) + "." for k in range(0, 8000, 80)]
    want = [np.array(e.ids, "<u4").tobytes() for e in plain.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    common.let_go()
    assert list(tokenizing.encode_all(path, pa.array(texts, pa.string()))) == want
    monkeypatch.setattr(tokenizing, "AT_ONCE", 10_000)
    assert list(tokenizing.encode_all(path, pa.array(texts, pa.string()))) == want
    monkeypatch.setattr(tokenizing, "AT_ONCE", 10_000_000)
    large = pa.large_string()
    assert list(tokenizing.encode_all(path, pa.array(texts, large))) == want
    assert list(tokenizing.encode_all(path, pa.array([None, ""], large))) == [b"", b""] and not list(tokenizing.encode_all(path, pa.array([], large)))
    calls, encode = [], tokenizing.Memory.encode
    monkeypatch.setattr(tokenizing.Memory, "encode", lambda self, text: calls.append(1) or encode(self, text))
    common.let_go()
    assert b"".join(tokenizing.encode_all(path, pa.array(texts[-100:]))) == b"".join(want[-100:]) and len(calls) < 20
    monkeypatch.setattr(tokenizing, "REMEMBERED_AFTER", 50)
    common.let_go()
    pieces = common.kept(path, lambda: tokenizing.Pieces(path))
    for _ in range(2):
        assert list(tokenizing.encode_all(path, pa.array(texts, pa.string()))) == want and len(pieces) <= 50
    pieces.sizes[:] = 1  # as if the tokenizer left bytes out
    assert list(tokenizing.encode_all(path, pa.array(texts[-3:]))) == want[-3:]
    common.let_go()


def test_batches_are_put_together():
    parts = [pa.record_batch({"n": pa.array([k, k + 1], pa.int64())}) for k in range(0, 10, 2)]
    got = list(common.gathered(iter(parts), 2 * parts[0].nbytes))
    assert [b.num_rows for b in got] == [4, 4, 2] and [n for b in got for n in b.column("n").to_pylist()] == list(range(10))
    assert not list(common.gathered(iter([]), 1))


def test_workers_let_go_of_what_former_stages_keep():
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizing.encoder(path, False)
    assert not list(common.slices(iter([]), keeps=path)) and list(common._KEPT) == [path]
    assert not list(common.slices(iter([]))) and not common._KEPT


def test_readers_have_small_batches(spark, sf):
    table(spark, sf, "documents")
    assert spark.conf.get("spark.sql.parquet.columnarReaderBatchSize") == "1024"


def test_token_output_round_trip(docs, empty, spark, tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    encode = tokenizing.encoder(path, True)
    token_output.encode_corpus(docs, path, f"{tmp_path}/t", frame=3000)
    got = token_output.read_corpus(spark, f"{tmp_path}/t", keep_ids=True).orderBy("start").collect()
    assert sorted((str(r.doc_id), bytes(r.ids)) for r in got) == sorted((str(r.doc_id), encode(r.text) + b"\0\0\0\0") for r in rows_of(docs))
    at = 0
    for r in got:
        assert r.start == at and r.n_tokens == len(r.ids) // 4 and r.ids_crc32 == zlib.crc32(r.ids)
        at += r.n_tokens
    known = [r.doc_id for r in got if r.doc_id is not None]
    assert known == sorted(known)
    token_output.encode_corpus(empty, path, f"{tmp_path}/e")
    assert token_output.read_corpus(spark, f"{tmp_path}/e").count() == 0


@pytest.mark.parametrize("n", [0, 1, 1023, 1024, 1025, 5000, 40000])
def test_token_file_coding(n):
    rng = np.random.default_rng(n)
    for ids in (rng.integers(0, 65536, n), np.minimum(rng.zipf(1.3, n), 50256), np.full(n, 65535), np.tile(np.arange(97), n // 97 + 1)[:n]):
        counts, back = token_file.read_frame(token_file.write_frame(np.array([n]), ids.astype("<u4")))
        assert counts.tolist() == [n] and back.tolist() == ids.tolist()


def test_token_file_is_read_in_little_memory():
    """Ids and digits are held in 16 bits each: a frame is read in few bytes an id."""
    ids = np.random.default_rng(2).integers(0, 50_000, 400_000).astype("<u4")
    frame = token_file.write_frame(np.array([len(ids)]), ids)
    tracemalloc.start()
    try:
        back = token_file.read_frame(frame)[1]
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert np.array_equal(back, ids) and peak < 20 * len(ids)


def test_token_file_in_sets_of_lanes(monkeypatch):
    """Blocks give the same bytes whatever is coded beside them; ids that a frame has often cost little from its first block on."""
    rng = np.random.default_rng(3)
    ids = rng.permutation(50_000)[np.minimum(rng.zipf(1.3, 30_000), 5_000)].astype("<u4")
    frame = token_file.write_frame(np.array([len(ids)]), ids)
    entropy = -sum(n * np.log2(n / len(ids)) for n in np.unique(ids, return_counts=True)[1]) / 8
    assert len(frame) < 1.15 * entropy + 20_000
    monkeypatch.setattr(token_file, "_LANES", 7)
    assert token_file.write_frame(np.array([len(ids)]), ids) == frame
    assert np.array_equal(token_file.read_frame(frame)[1], ids)


def test_token_file_notices_damage():
    frame = bytearray(token_file.write_frame(np.array([3000]), np.arange(3000, dtype="<u4")))
    for at in (0, 20, len(frame) - 3):
        bad = frame.copy()
        bad[at] ^= 1
        with pytest.raises(ValueError):
            token_file.read_frame(bytes(bad))
    with pytest.raises(ValueError):
        token_file.write_frame(np.array([1]), np.array([70000]))


def test_packing(docs, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    encode = tokenizing.encoder(path, False)
    got = packing.pack(packing.cut(docs, path), group=8).collect()
    want = []
    for r in rows_of(docs):
        whole = encode(r.text) + b"\0\0\0\0"
        parts = [whole[k : k + 8192] for k in range(0, len(whole), 8192)]
        want += [(r.doc_id, k, 2048 * k, len(p) // 4, zlib.crc32(p)) for k, p in enumerate(parts)]
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=str) == sorted(want, key=str)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack(packing.cut(empty, path)).count() == 0


def test_sum_of_squares_choice():
    rng = np.random.default_rng(3)
    sizes = rng.integers(1, 20, 400)
    bins, offsets = packing.place(sizes, 20)
    gaps: dict[int, int] = {}
    level: dict[int, int] = {}
    for s, b in zip(sizes.tolist(), bins.tolist(), strict=True):
        count = {}
        for g in gaps.values():
            if 0 < g < 20:
                count[g] = count.get(g, 0) + 1

        def after(old, new, count=count):
            c = dict(count)
            if old < 20:
                c[old] -= 1
            if new:
                c[new] = c.get(new, 0) + 1
            return sum(x * x for x in c.values())

        best = min((after(g, g - s) for g in {g for g in gaps.values() if g >= s}), default=None)
        old = gaps.get(b, 20)
        assert old >= s and (after(old, old - s) == best if best is not None else b not in gaps)
        gaps[b] = old - s
        level[b] = level.get(b, 0) + s
    assert max(level.values()) <= 20
    big = np.random.default_rng(1).integers(1, 2048, 5000)
    assert packing.place(np.sort(big)[::-1])[0].max() + 1 <= 1.02 * big.sum() / 2048 + 1


def test_token_counts_equal_the_library(docs, empty, spark, sf):
    path = public_tokenizers.path("piece_bpe_32k.model")
    vocabulary = token_count.vocabulary(path)
    library = Tokenizer(models.Unigram([("<unk>", 0.0), *vocabulary], unk_id=0, byte_fallback=False))
    library.pre_tokenizer = pre.Sequence([pre.WhitespaceSplit(), pre.Metaspace(replacement=token_count.MARK, prepend_scheme="always")])
    for source in (docs, table(spark, sf, "documents").limit(60)):
        rows = rows_of(source)
        want = sorted(((r.doc_id, len(library.encode(r.text or "", add_special_tokens=False).ids)) for r in rows), key=str)
        assert sorted(((r.doc_id, r.n_tokens) for r in token_count.token_counts(source, path).collect()), key=str) == want
    assert token_count.token_counts(empty, path).count() == 0
    tied = token_count.Counter([("▁", -1.0), ("a", -1.0), ("aa", -2.0), ("▁a", -2.0), ("b", -1.0)])
    small = Tokenizer(models.Unigram([("<unk>", 0.0), ("▁", -1.0), ("a", -1.0), ("aa", -2.0), ("▁a", -2.0), ("b", -1.0)], unk_id=0, byte_fallback=False))
    for w in ("a", "aa", "aaa", "aaaab", "baab", "axxa", "xyz", "axbx"):
        assert tied[w][0] == len(small.encode(token_count.MARK + w, add_special_tokens=False).ids), w
