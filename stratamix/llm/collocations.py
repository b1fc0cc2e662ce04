"""Phrase collocation mining: frequent word sequences of each language, scored by how often their parts stand alone.

Texts are cut into pieces, and identical pieces become one with a multiplicity. Tasks turn pieces into weighted n-grams,
which are dealt into buckets by hash; a task counts a bucket in a duckdb database of its own, on disk, so its memory is bounded
whatever the bucket holds. Counting goes by length: a longer phrase can only be frequent if its words and pairs of
neighbours are, so these are kept in bit sets of a fixed size, which let some others through but never miss one, and only
what passes is dealt and counted. The parts of each candidate are looked up by requests that are shuffled to the counts.
"""

from __future__ import annotations

import shutil
import tempfile
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import discard, ship, shuffled, table, written

LEAST, LONGEST, TOP, COVERED, SCALE = 30, 4, 2000, 80, 2_000_000
NO_LANG = "und"
#: Bytes of pieces that are turned into n-grams at once, and rows handed over at once.
CHUNK_BYTES, ROWS = 4 << 20, 1 << 16
#: Bits of a sieve: 4 MB.
SIEVE_BITS = 25
#: What a counting task's database may hold in memory; the rest is on its disk while it runs.
DATABASE_MB = 256
#: Parts that a language's phrases are ranked in before they are ranked together.
SALTS = 16
COUNTED = "lang string, phrase string, size int, f long"


#: What becomes of single bytes: A-Z are lowered, tabs become spaces, and all that ends a piece becomes a line feed. No other character has these bytes.
_BYTES = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz \n\n\n\n\n\n\n\n\n")


def _pieces(langs: pa.Array, texts: pa.Array) -> pa.RecordBatch:
    """(lang, piece, times): the different pieces of some texts. A null text has none."""
    texts = texts.cast(pa.large_string())
    known, offsets, data = texts.buffers()
    data = pa.py_buffer(data.to_pybytes().translate(_BYTES)) if data else data
    lists = pc.split_pattern(pa.Array.from_buffers(texts.type, len(texts), [known, offsets, data], offset=texts.offset), "\n")
    pieces, lang = pc.list_flatten(lists), langs.take(pc.list_parent_indices(lists))
    wide = pc.match_substring(pieces, "  ")
    pieces = pc.replace_with_mask(pieces, wide, pc.replace_substring_regex(pieces.filter(wide), " {2,}", " "))
    pieces = pc.ascii_trim(pieces, " ")
    full = pc.not_equal(pieces, "")
    rows = pa.table({"lang": lang.filter(full), "piece": pieces.filter(full)}).group_by(["lang", "piece"]).aggregate([([], "count_all")]).combine_chunks()
    columns = [rows["lang"], rows["piece"].cast(pa.string()), rows["count_all"]]
    return pa.RecordBatch.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns], names=["lang", "piece", "times"])


def pieces_of(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, piece, times, words): the different pieces, their words separated by one space, with their numbers."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            held.append(b)
            size += b.nbytes
            if size >= CHUNK_BYTES:
                yield from cut(held)
                held, size = [], 0
        yield from cut(held)

    def cut(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if any(b.num_rows for b in held):
            out = _pieces(*(pa.concat_arrays([b.column(i) for b in held]) for i in range(2)))
            yield from (out.slice(i, ROWS) for i in range(0, out.num_rows, ROWS))

    rows = docs.select(F.coalesce(docs[lang_col].cast("string"), F.lit(NO_LANG)).alias("lang"), docs[text_col].cast("string").alias("text")).mapInArrow(run, "lang string, piece string, times long")
    return rows.groupBy("lang", "piece").agg(F.sum("times").alias("times")).withColumn("words", F.size(F.split("piece", " ")))


def _mixed(h: np.ndarray, bits: int) -> np.ndarray:
    """Slots of hashes in a sieve of 2^bits."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    return h >> np.uint64(64 - bits)


def _hashed(strings: pa.Array) -> np.ndarray:
    return pd.util.hash_array(strings.to_numpy(zero_copy_only=False), categorize=False)


def _words_hashed(langs: pa.Array, words: pa.Array) -> np.ndarray:
    """Hashes of words, each of a language; few languages are told apart first."""
    coded = langs.dictionary_encode()
    return _hashed(words) + np.uint64(3) * _hashed(coded.dictionary)[coded.indices.to_numpy(zero_copy_only=False)]


def _joined(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hashes of phrases that are one word longer."""
    return before * np.uint64(0xC2B2AE3D27D4EB4F) + word


def _has(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = _mixed(h, len(bits).bit_length() + 5)
    return (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def _runs(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by id, and where each id begins."""
    order = np.argsort(ids, kind="stable")
    return order, np.flatnonzero(np.diff(ids[order], prepend=-1))


def grams(held: pa.Table, sizes: Sequence[int], singles: np.ndarray | None, pairs: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """(lang, phrase, size, weight) of the phrases of some pieces, each once: those that the sieves let through."""
    held = held.combine_chunks()
    langs = held["lang"].chunk(0).dictionary_encode()
    lists = pc.split_pattern(held["piece"].chunk(0), " ")
    sizes_of = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    coded = lists.flatten().dictionary_encode()
    piece = np.repeat(np.arange(len(lists)), sizes_of)
    lang, word = langs.indices.to_numpy(zero_copy_only=False)[piece].astype(np.int64), coded.indices.to_numpy(zero_copy_only=False)
    weight = held["times"].chunk(0).to_numpy()[piece]
    units, first, unit = np.unique(lang * len(coded.dictionary) + word, return_index=True, return_inverse=True)
    own = _hashed(coded.dictionary)[word[first]] + np.uint64(3) * _hashed(langs.dictionary)[lang[first]]
    n = len(piece)
    within = lambda k: piece[: n - k + 1] == piece[k - 1 :] if k <= n else np.zeros(0, bool)
    single = np.ones(n, bool) if singles is None else _has(singles, own)[unit]
    pair = within(2) & single[: n - 1] & single[1:] if n > 1 else np.zeros(0, bool)
    if pairs is not None and pair.any():
        at = np.flatnonzero(pair)
        pair[at] = _has(pairs, _joined(own[unit[at]], own[unit[at + 1]]))
    for size in sizes:
        if size > n:
            continue
        passes = single.copy() if size == 1 else reduce(lambda a, b: a & b, [within(size), *[pair[j : n - size + 1 + j] for j in range(size - 1)]])
        at = np.flatnonzero(passes)
        if not len(at):
            continue
        ids = unit[at]
        for j in range(1, size):
            ids = np.unique(ids * len(units) + unit[at + j], return_inverse=True)[1]
        order, begin = _runs(ids)
        sums, place = np.add.reduceat(weight[at][order], begin), at[order[begin]]
        for i in range(0, len(place), ROWS):
            p = place[i : i + ROWS]
            parts = [coded.dictionary.take(pa.array(word[p + j])) for j in range(size)]
            phrase = parts[0] if size == 1 else pc.binary_join_element_wise(*parts, " ")
            yield pa.RecordBatch.from_arrays([langs.dictionary.take(pa.array(lang[p])), phrase, pa.array(np.full(len(p), size, np.int32)), pa.array(sums[i : i + ROWS])], names=["lang", "phrase", "size", "weight"])


def counted(pieces: DataFrame, sizes: Sequence[int], least: int, singles=None, pairs=None) -> DataFrame:
    """(lang, phrase, size, f) of phrases with at least ``least`` occurrences, counted in buckets by duckdb.

    ``singles`` and ``pairs``: broadcast sieves of the frequent words and pairs of words.
    """
    spark = pieces.sparkSession
    ship(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sieves = [None if s is None else s.value for s in (singles, pairs)]
        held, size = [], 0
        for b in batches:
            if b.num_rows:
                held.append(b)
                size += b.nbytes
            if size >= CHUNK_BYTES:
                yield from grams(pa.Table.from_batches(held), sizes, *sieves)
                held, size = [], 0
        if held:
            yield from grams(pa.Table.from_batches(held), sizes, *sieves)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        folder = tempfile.mkdtemp()  # this task's own, gone when it ends
        try:
            with duckdb.connect(f"{folder}/bucket.db", config={"memory_limit": f"{DATABASE_MB}MB", "threads": 1, "temp_directory": f"{folder}/spill", "preserve_insertion_order": "false"}) as con:
                con.execute("CREATE TABLE grams (lang VARCHAR, phrase VARCHAR, size INTEGER, weight BIGINT)")
                held, rows = [], 0

                def insert() -> None:
                    con.register("batch", pa.Table.from_batches(held))
                    con.execute("INSERT INTO grams SELECT lang, phrase, size, weight FROM batch")
                    con.unregister("batch")

                for b in batches:
                    if b.num_rows:
                        held.append(b)
                        rows += b.num_rows
                    if rows >= ROWS:
                        insert()
                        held, rows = [], 0
                if held:
                    insert()
                found = con.execute(f"SELECT lang, phrase, size, CAST(sum(weight) AS BIGINT) AS f FROM grams GROUP BY ALL HAVING sum(weight) >= {int(least)}")
                while chunk := found.fetchmany(ROWS):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*chunk, strict=True), (pa.string(), pa.string(), pa.int32(), pa.int64()), strict=True)], names=["lang", "phrase", "size", "f"])
        finally:
            shutil.rmtree(folder, ignore_errors=True)

    dealt = pieces.select("lang", "piece", "times").mapInArrow(emit, "lang string, phrase string, size int, weight long").repartition(n, "lang", "phrase")
    return dealt.mapInArrow(count, COUNTED)


def sieve(phrases: DataFrame):
    """A broadcast bit set of fixed size that has the slots of all given phrases, of one or two words."""

    size = SIEVE_BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            words = pc.split_pattern(b.column(1), " ")
            h = _words_hashed(b.column(0), pc.list_element(words, 0))
            longer = np.flatnonzero(pc.list_value_length(words).to_numpy(zero_copy_only=False) > 1)
            if len(longer):
                at = pa.array(longer)
                h[longer] = _joined(h[longer], _words_hashed(b.column(0).take(at), pc.list_element(words.take(at), 1)))
            at = _mixed(h, size)
            bit = (np.uint64(1) << (at & np.uint64(63))).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int32)), pa.array(bit)], names=["cell", "bits"])

    cells = phrases.select("lang", "phrase").mapInArrow(run, "cell int, bits long").groupBy("cell").agg(F.bit_or("bits").alias("bits")).toArrow()  # at most 2^SIEVE_BITS / 64 rows
    bits = np.zeros(1 << (size - 6), np.uint64)
    bits[cells["cell"].to_numpy()] = cells["bits"].to_numpy().view(np.uint64)
    return phrases.sparkSession.sparkContext.broadcast(bits)


def _part(words: Column, start: Column | int, size: Column | int) -> Column:
    return F.array_join(F.slice(words, start, size), " ")


def _exact(x: Column) -> Column:
    return x.cast("decimal(20,0)")


def scored(counts: DataFrame, longest: int = LONGEST) -> DataFrame:
    """(lang, phrase, a, l, r, score) of the phrases of two words and more: the cut with the lowest score, and of those the first.

    Each part of each cut is a request that meets the part's count by a shuffled join; a part that very many candidates
    share is left to Spark's splitting of skewed joins.
    """
    candidates = counts.filter("size > 1").select("lang", "phrase", F.col("f").alias("a"), "size", F.split("phrase", " ").alias("words"))
    k, words = F.col("k"), F.col("words")
    cuts = candidates.select("*", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    sides = F.array(F.struct(F.lit(True).alias("front"), _part(words, F.lit(1), k).alias("part")), F.struct(F.lit(False).alias("front"), _part(words, k + 1, F.col("size") - k).alias("part")))
    asked = cuts.select("lang", "phrase", "a", "k", F.explode(sides).alias("side")).select("lang", "phrase", "a", "k", "side.*")
    answered = asked.join(shuffled(counts.select("lang", F.col("phrase").alias("part"), "f")), ["lang", "part"])
    of = lambda i, front: F.max(F.when((k == i) & (F.col("front") == front), F.col("f")))
    both = answered.groupBy("lang", "phrase", "a").agg(*[of(i, front).alias(f"{side}{i}") for i in range(1, longest) for side, front in (("l", True), ("r", False))])
    score = lambda i: F.expr(f"cast({SCALE} as decimal(10,0)) * cast(a as decimal(20,0)) div (cast(l{i} as decimal(20,0)) + cast(r{i} as decimal(20,0)))")
    each = F.array(*[F.struct(score(i).alias("score"), F.lit(i).alias("k"), F.col(f"l{i}").alias("l"), F.col(f"r{i}").alias("r")) for i in range(1, longest)])
    return both.withColumn("best", F.array_min(F.filter(each, lambda x: x["l"].isNotNull()))).select("lang", "phrase", "a", "best.l", "best.r", "best.score")


def inside_longer(counts: DataFrame) -> DataFrame:
    """(lang, phrase, most): the largest count of a longer candidate in which the phrase stands."""
    longer = counts.filter("size > 2").select("lang", "f", "size", F.split("phrase", " ").alias("words"))
    parts = F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.col("size") - n + 1), lambda i: _part(F.col("words"), i, n))))
    return longer.select("lang", "f", F.explode(F.array_distinct(parts)).alias("phrase")).groupBy("lang", "phrase").agg(F.max("f").alias("most"))


def collocations(docs: DataFrame, *, least: int = LEAST, longest: int = LONGEST, top: int = TOP, covered: int = COVERED, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``top`` phrases of two to ``longest`` words.

    ``n`` counts all words of the language, ``a`` the phrase, ``l`` and ``r`` the parts of its lowest-scoring cut. Phrases of
    fewer than ``least`` occurrences don't count, nor those of which ``covered`` percent stand in one longer candidate. Null
    texts have no words and a null language is ``und``; repeated rows count each; texts and pieces of any length count whole;
    ranks are by falling score and count, then by the phrase's bytes. Other columns are not read. No rows give none.
    """
    if longest < 2:
        raise ValueError("a phrase has two words at least")
    pieces = written(pieces_of(docs, text_col, lang_col), "pieces")
    words = written(counted(pieces, [1], least), "words")
    frequent = sieve(words)
    pairs = written(counted(pieces, [2], least, frequent), "pairs")
    known = [words, pairs]
    if longest > 2:
        both = sieve(pairs)
        known.append(written(counted(pieces, range(3, longest + 1), least, frequent, both), "phrases"))
        both.unpersist()
    frequent.unpersist()
    counts = reduce(DataFrame.unionByName, known)
    totals = written(pieces.groupBy("lang").agg(F.sum(F.col("times") * F.col("words")).alias("n")), "totals")
    discard(pieces)
    kept = scored(counts, longest).join(inside_longer(counts), ["lang", "phrase"], "left")
    kept = kept.filter(F.col("most").isNull() | (100 * _exact(F.col("most")) < covered * _exact(F.col("a")))).drop("most")
    by = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    kept = kept.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    kept = kept.withColumn("rank", F.row_number().over(W.partitionBy("lang", "salt").orderBy(*by))).filter(F.col("rank") <= top)
    kept = kept.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*by))).filter(F.col("rank") <= top)
    out = kept.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
    out = written(out, "collocations")
    discard(*known, totals)
    return out


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


SQL = r"""
WITH t AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), p AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM t
), g AS (
  SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM p, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k
), f AS MATERIALIZED (
  SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL
), n AS (
  SELECT lang, sum(f) AS n FROM f WHERE k = 1 GROUP BY 1
), c AS MATERIALIZED (
  SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 30
), parts AS MATERIALIZED (
  SELECT lang, phrase, a, cut, array_to_string(w[1:cut], ' ') AS front, array_to_string(w[cut + 1:], ' ') AS rest FROM c, (SELECT unnest([1, 2, 3]) AS cut) WHERE cut < k
), cuts AS (
  SELECT p.lang, p.phrase, p.a, cut, x.f AS l, y.f AS r, CAST(2000000 AS HUGEINT) * p.a // (x.f + y.f) AS score
  FROM parts p JOIN f AS x ON x.lang = p.lang AND x.phrase = p.front JOIN f AS y ON y.lang = p.lang AND y.phrase = p.rest
), best AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
), inner_parts AS (
  SELECT lang, a, array_to_string(w[s:s + n - 1], ' ') AS phrase FROM c, (SELECT unnest([1, 2, 3]) AS s), (SELECT unnest([2, 3]) AS n) WHERE n < k AND s + n - 1 <= k
), most AS (
  SELECT lang, phrase, max(a) AS most FROM inner_parts GROUP BY ALL
), kept AS (
  SELECT b.* FROM best b LEFT JOIN most m ON b.lang = m.lang AND b.phrase = m.phrase WHERE m.most IS NULL OR 100 * CAST(m.most AS HUGEINT) < 80 * CAST(b.a AS HUGEINT)
)
SELECT k.lang, row_number() OVER (PARTITION BY k.lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, CAST(n.n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM kept k JOIN n ON k.lang = n.lang QUALIFY rank <= 2000
"""
