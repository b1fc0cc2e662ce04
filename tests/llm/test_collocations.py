import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from stratamix.llm import collocations as co

DOCS = "doc_id long, text string, lang string, phrase string, n long, rank int"


def brute(rows, least, longest, top, covered):
    count, total = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    count[lang, tuple(words[i : i + k])] += 1
    good = {k: f for k, f in count.items() if len(k[1]) > 1 and f >= least}
    out = {}
    for (lang, p), a in good.items():
        if any(len(q) > len(p) and lng == lang and 100 * f >= covered * a and any(q[i : i + len(p)] == p for i in range(len(q))) for (lng, q), f in good.items()):
            continue
        cuts = [(2_000_000 * a // (count[lang, p[:k]] + count[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), count[lang, p[:k]], count[lang, p[k:]]))
    return {(lang, i): (p.decode(), -a, left, r, total[lang], -s) for lang, rows in out.items() for i, (s, a, p, left, r) in enumerate(sorted(rows)[:top], 1)}


def run(spark, rows, **options):
    docs = spark.createDataFrame([(1, t, g, "x", 5, 6) for t, g in rows], DOCS)
    return {(r.lang, r["rank"]): (r.phrase, r.a, r.l, r.r, r.n, r.score) for r in co.collocations(docs, **options).collect()}


def corpus(seed, n=250):
    r = random.Random(seed)
    words = ["a", "B", "the", "of", "ünd", "Ünd", "x-y", "1", " ", "😀", "and", "Zed"]
    seps = [" ", "  ", "\t", " \t ", ", ", ". ", "\n", ";", " ! ", "\x0b", "\r\n", "?"]
    rows = []
    for _ in range(n):
        text = "".join(r.choice(words) + r.choice(seps[:4] * 5 + seps) for _ in range(r.randrange(30)))
        rows.append((text, r.choice(["en", "en", "de", None, "und", ""])))
    return [*rows, *rows[:40], (None, "en"), ("", "de"), ("...", "xx"), (" \t", None), ("the of and " * 5000, "en"), ("w" * 100_000, "de")]


@pytest.mark.parametrize(("least", "longest", "covered"), [(3, 4, 80), (5, 2, 80), (4, 5, 50)])
def test_collocations_equal_brute_force(spark, monkeypatch, least, longest, covered):
    monkeypatch.setattr(co, "CHUNK_BYTES", 2000)
    rows = corpus(least)
    assert run(spark, rows, least=least, longest=longest, top=60, covered=covered) == brute(rows, least, longest, 60, covered)


def test_full_sieves_lose_nothing(spark, monkeypatch):
    """With sieves so small that they let nearly everything through, the result is the same."""
    monkeypatch.setattr(co, "SIEVE_BITS", 7)
    rows = corpus(9, 100)
    assert run(spark, rows, least=3) == brute(rows, 3, 4, 2000, 80)


def test_equal_pieces_by_the_thousand(spark):
    rows = [("Same words here again. and other ones", "en")] * 3000 + [("same words there", "en")] * 40
    assert run(spark, rows) == brute(rows, 30, 4, 2000, 80)


def test_no_rows(spark):
    assert run(spark, []) == {}
    assert run(spark, [(None, None), ("", "en")]) == {}
    with pytest.raises(ValueError, match="two words"):
        run(spark, [], longest=1)


def test_grams_of_a_chunk_are_exact():
    held = pa.table({"lang": ["en", "de", "en"], "piece": ["a b a b", "a b", "c"], "times": pa.array([2, 3, 1 << 40], pa.int64())})
    got = {(r["lang"], r["phrase"]): r["weight"] for b in co.grams(held, [1, 2, 3, 4, 5], None, None) for r in b.to_pylist()}
    assert got == {("en", "a"): 4, ("en", "b"): 4, ("de", "a"): 3, ("de", "b"): 3, ("en", "c"): 1 << 40, ("en", "a b"): 4, ("en", "b a"): 2, ("de", "a b"): 3, ("en", "a b a"): 2, ("en", "b a b"): 2, ("en", "a b a b"): 2}


def test_scores_are_exact_beyond_64_bits(spark):
    big = 3 * 10**15
    counts = spark.createDataFrame([("en", "x", 1, big + 1), ("en", "y", 1, big), ("en", "x y", 2, big)], co.COUNTED)
    row = co.scored(counts).first()
    assert (row.l, row.r, row.score) == (big + 1, big, 2_000_000 * big // (2 * big + 1))
    assert (co._mixed(np.array([1, 2**64 - 1], np.uint64), 25) < 1 << 25).all()


def test_pieces_are_cut_in_tasks_by_bytes(spark, monkeypatch):
    """All separators, tabs, runs of spaces, letters beyond A-Z, nulls and texts in slices of batches; no regular expression a text in the plan."""
    texts = ["Aa\tB  É ;x,y.z:1!2?3\x0b4\x0c5\r6\n7", " \t ", None, "", "..", "ÀB C  d\u0085e", "Aa\tB  É ;x", "\x1f a", "日本 。 語"]
    rows = [(t, lang) for t in texts for lang in ("en", None, "de")]
    want = {}
    for t, lang in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            if words := re.findall(r"[^\x20\x09]+", piece):
                key = lang or "und", " ".join(words)
                want[key] = (want.get(key, (0,))[0] + 1, len(words))
    for chunk in (1, 1 << 22):
        monkeypatch.setattr(co, "CHUNK_BYTES", chunk)
        got = co.pieces_of(spark.createDataFrame(rows, "text string, lang string"))
        assert {(r.lang, r.piece): (r.times, r.words) for r in got.collect()} == want
    assert "regexp_replace" not in got._jdf.queryExecution().executedPlan().toString()
