import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratamix.llm import packing, sstable, tokens
from stratamix.llm.tokens import PieceEncoder, default_tokenizer, encoder

ROWS = [(3, "One two three. Four five six!\nSeven  eight\t nine"), (1, None), (2, ""), (5, "x" * 3000), (4, "Grüße, 日本 and 12,5 %. " * 400), (3, "again the same id"), (None, "no id")]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(*r, "z", float(i)) for i, r in enumerate(ROWS)]
    return spark.createDataFrame(rows, "doc_id long, text string, start string, offset double").repartition(2)


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(default_tokenizer())


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


def test_memo_gives_the_tokenizers_ids(tokenizer):
    r = random.Random(5)
    parts = ["a", "B", " ", " ", "  ", "\n", "\t", "1", "²", "!", "'s", "é", "日", "\x1c", " ", "word", "<|endoftext|>", "…"]
    enc = encoder(default_tokenizer())
    texts = ["".join(r.choices(parts, k=r.randint(0, 14))) for _ in range(4000)]
    for text, got in zip(texts, enc.encode_many(texts), strict=True):
        assert got.tolist() == ids_of(tokenizer, text), repr(text)


def test_long_texts_and_a_full_memo_give_the_tokenizers_ids(tokenizer, monkeypatch):
    r = random.Random(6)
    words = ["it's", "don't", "'twas", "we'll", "THEY'RE", " ", "\n", "\n\n", "12", "½", "naïve", "x" * 60, "y" * 60, "'s's", "''d", "--"]
    texts = [" ".join(r.choices(words, k=r.randint(1, 300))) for _ in range(60)] + ["z" * 5000, " " * 3000, "a " * 4000]
    enc = PieceEncoder(default_tokenizer())
    monkeypatch.setattr(tokens, "GROUP_CHARS", 500)
    for words, slots in ((20, 1 << 21), (1_000_000, 64), (1_000_000, 1 << 12)):
        monkeypatch.setattr(tokens, "MAX_WORDS", words)
        monkeypatch.setattr(tokens, "SLOTS", slots)
        enc._forget()
        for text, got in zip(texts, enc.encode_many(texts), strict=True):
            assert got.tolist() == ids_of(tokenizer, text), repr(text[:200])


def test_pieces_cover_each_document_once(docs, tokenizer):
    rows = [r.asDict() for r in packing.pack(docs).collect()]
    assert [n for n in rows[0]] == packing.SCHEMA.names
    want = sorted((str(d), crc([*ids_of(tokenizer, t), 0])) for d, t in ROWS)
    by: dict = {}
    for r in rows:
        by.setdefault((r["doc_id"], r["doc_tokens"]), []).append(r)
    texts = {(d, len(ids_of(tokenizer, t)) + 1): [*ids_of(tokenizer, t), 0] for d, t in ROWS}
    assert set(by) == set(texts) and len(want) == len(ROWS)
    for key, pieces in by.items():
        at = 0
        for p in sorted(pieces, key=lambda p: p["start"]):
            assert p["start"] == at and p["ids_crc32"] == crc(texts[key][at : at + p["length"]])
            at += p["length"]
        assert at == key[1]
    sequences: dict = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024


def brute_force(ends, kinds, penalty, window, n):
    best = {0: 0}
    for j in sorted(penalty):
        if j:
            options = []
            for i in best:
                if 0 < j - i <= window:
                    length = j - i
                    options.append(best[i] + (0 if length & (length - 1) == 0 else window - length))
            best[j] = min(options) + penalty[j]
    return best[n]


def test_cuts_are_the_cheapest():
    r = np.random.default_rng(7)
    for _ in range(30):
        window = 64
        ends = np.unique(r.integers(1, 400, 40))
        kinds = r.integers(0, 2, len(ends))
        n = int(ends[-1])
        cuts = packing.best_cuts(ends, kinds, window)
        assert cuts[-1] == n and all(b > a for a, b in zip([0, *cuts], cuts))
        penalty = {0: 0}
        candidates = set(range(packing.GAP, n, packing.GAP)) | {int(e) + window for e, k in zip(ends, kinds) if k == 0 and e + window < n} | {window} | {n - (n & ((1 << b) - 1)) for b in range(window.bit_length())}
        for c in candidates:
            if 0 < c < n:
                penalty[c] = packing.INNER_CUT + packing.WINDOW_COST
        for e, k in zip(ends.tolist(), kinds.tolist()):
            penalty[e] = (packing.SENTENCE_CUT if k else 0) + packing.WINDOW_COST
        penalty[n] = packing.WINDOW_COST
        if any(b - a > window for a, b in zip(sorted(penalty), sorted(penalty)[1:])):
            continue
        cost = sum((0 if (b - a) & (b - a - 1) == 0 else window - (b - a)) + penalty[b] for a, b in zip([0, *cuts], cuts))
        assert cost == brute_force(ends, kinds, penalty, window, n)


def test_windows_shorter_than_the_gap_between_cuts():
    for window in (8, 32, 64):
        cuts = packing.best_cuts(np.array([700]), np.array([0]), window)
        assert cuts[-1] == 700 and all(0 < b - a <= window for a, b in zip([0, *cuts], cuts))


def test_little_padding(spark):
    text = " ".join(f"Sentence number {i} has some words." for i in range(60))
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.lit(text).alias("text")).coalesce(1)
    lengths = [r.n for r in packing.pack(docs).groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()]
    padding = sum(0 if n & (n - 1) == 0 else 1024 - n for n in lengths)
    assert padding < 0.01 * sum(lengths)


def test_empty_tables(docs):
    assert packing.pack(docs.limit(0)).count() == 0
    manifest, _ = sstable.write_shards(docs.limit(0))
    assert sstable.read_digests(manifest).count() == 0


def test_a_task_rolls_its_shards(docs, tokenizer):
    manifest, _ = sstable.write_shards(docs, shards=1, shard_keys=2)
    rows = manifest.collect()
    assert len(rows) == 4 and sum(r.entries for r in rows) == len(ROWS) and sum(r.tokens for r in rows) == sum(len(ids_of(tokenizer, t)) + 1 for _, t in ROWS)
    assert [g.n_tokens for g in sorted(sstable.read_digests(manifest).collect(), key=lambda g: g.start)][0] == len(ids_of(tokenizer, "no id")) + 1
    assert len(sstable.lookup(manifest, 3)) == 2


def test_shards_round_trip_and_lookup(docs, tokenizer):
    manifest, _ = sstable.write_shards(docs, shards=3)
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in sstable.read_digests(manifest).collect())
    assert [g[1] for g in got] == [None, 1, 2, 3, 3, 4, 5]
    at = 0
    want = {(d, len(ids_of(tokenizer, t)) + 1, crc([*ids_of(tokenizer, t), 2])) for d, t in ROWS}
    for start, doc_id, n, c in got:
        assert start == at and (doc_id, n, c) in want
        at += n
    assert [x.tolist() for x in sstable.lookup(manifest, 4)] == [[*ids_of(tokenizer, ROWS[4][1]), 2]]
    assert len(sstable.lookup(manifest, 3)) == 2
    assert sstable.lookup(manifest, 99) == []


def test_many_blocks_and_bloom(tmp_path):
    import pyarrow.fs as pafs

    path = tmp_path / "t.sst"
    with path.open("wb") as f:
        w = sstable.Writer(f, np.dtype("<u2"))
        for i in range(0, 6000, 2):
            w.add(sstable.key_of(i - 3000), np.full(40, i % 60000))
        w.close()
    with pafs.LocalFileSystem().open_input_file(str(path)) as f:
        t = sstable.Table(f)
        assert len(t.blocks) > 2 and [sstable.id_of(k) for k, _ in t] == list(range(-3000, 3000, 2))
        assert t.get(sstable.key_of(-3000 + 4444))[0].tolist() == [4444] * 40
        absent = [i for i in range(-2999, 3000, 2) if all(t.bloom[p >> 3] >> (p & 7) & 1 for p in sstable._probes(sstable.key_of(i), t.bits))]
        assert len(absent) < 100
    raw = bytearray(path.read_bytes())
    raw[100] ^= 255
    path.write_bytes(raw)
    with pafs.LocalFileSystem().open_input_file(str(path)) as f, pytest.raises(ValueError, match="damaged"):
        list(sstable.Table(f))
