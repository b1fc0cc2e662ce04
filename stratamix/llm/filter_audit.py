"""Filter interaction audit: what each filter removes under every order of application, by part, from a packed bitmap index.

Filters judge whole texts in JVM expressions. A task turns the rows it has into bitsets: one for each filter and label, over
rows that lie sorted by part, so a part's bitmap is a run of whole 64-bit words. AND-NOT with each subset of the filters
and a popcount give the rows, good rows and toxic rows that the subset leaves; these are added up over tasks. Every
figure of every order is a difference of two such sums.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ship, table

#: The least words, the least share of distinct words and the largest share of capitals, in hundredths.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 50, 65, 5
FILTERS = "ABCDE"
#: Rows whose bitsets are held at once.
CHUNK = 1 << 16
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def text_failures(text: Column) -> dict[str, Column]:
    """Failure conditions that need nothing but the text: few words, few distinct words, many capitals, symbols."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    capitals = F.length(text) - F.length(F.translate(text, CAPITALS, ""))
    return {
        "A": F.size(words) < LEAST_WORDS,
        "B": 100 * F.size(F.array_distinct(words)) < LEAST_DISTINCT * F.size(words),
        "C": 100 * capitals > MOST_CAPITALS * F.length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def judged(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(part, fails, good, toxic) for each row of ``docs``: bit i of ``fails`` is filter i of FILTERS.

    Texts travel as 128-bit hashes. A row repeats another text if its id isn't the smallest of that text, which is a join by
    hash and id, so equal texts in any number don't meet. Null texts count as empty and null parts as the empty part; a row with
    a null id repeats nothing and has no labels. Rows that repeat an id are judged each; labels that repeat one count together.
    """
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    rows = docs.select(docs[id_col].alias("id"), F.coalesce(docs[part_col].cast("string"), F.lit("")).alias("part"), text.alias("text"))
    own = text_failures(F.col("text"))
    bits = sum((F.when(own[f], 1 << i).otherwise(0) for i, f in enumerate(FILTERS[:-1])), F.lit(0))
    rows = rows.select("id", "part", bits.alias("fails"), F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(11), "text").alias("h2"))
    known = rows.filter(F.col("id").isNotNull())
    firsts = known.groupBy("h1", "h2").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    marks = labels.select(labels[id_col].alias("id"), labels["quality"].alias("quality"), labels["toxic"].alias("toxic")).filter(F.col("id").isNotNull())
    marks = marks.groupBy("id").agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    known = known.join(firsts, ["h1", "h2", "id"], "left").join(marks, "id", "left")
    again = F.when(F.col("first").isNull(), 1 << (len(FILTERS) - 1)).otherwise(0)
    no = F.lit(False)
    known = known.select("part", (F.col("fails") + again).alias("fails"), F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic"))
    return known.unionByName(rows.filter(F.col("id").isNull()).select("part", "fails", no.alias("good"), no.alias("toxic")))


def packed(flags: np.ndarray) -> np.ndarray:
    """Booleans, a multiple of 64 of them, as 64-bit words."""
    return np.packbits(flags).view(np.uint64)


def left_by_subset(part: np.ndarray, fails: np.ndarray, labels: Sequence[np.ndarray], filters: int) -> Iterator[tuple[np.ndarray, int, list[np.ndarray]]]:
    """For each subset of the filters: the parts, the subset, and the counts of rows, and of those with each label, that it leaves in each part."""
    order = np.argsort(part, kind="stable")
    parts, begin, size = np.unique(part[order], return_index=True, return_counts=True)
    words = -(-size // 64)
    at = np.concatenate([[0], np.cumsum(words)[:-1]])
    place = np.repeat(at * 64 - begin, size) + np.arange(len(part))

    def spread(flags: np.ndarray) -> np.ndarray:
        out = np.zeros(int(words.sum()) * 64, bool)
        out[place] = flags[order]
        return packed(out)

    every = spread(np.ones(len(part), bool))
    failing = [spread((fails >> i & 1).astype(bool)) for i in range(filters)]
    labelled = [spread(x) for x in labels]
    alive: dict[int, np.ndarray] = {0: every}
    for subset in range(1 << filters):
        if subset:
            low = (subset & -subset).bit_length() - 1
            alive[subset] = alive[subset & (subset - 1)] & ~failing[low]
        counts = [np.add.reduceat(np.bitwise_count(alive[subset] if x is None else alive[subset] & x).astype(np.int64), at) for x in (None, *labelled)]
        yield parts, subset, counts


def bitmap_counts(rows: DataFrame, filters: int = len(FILTERS)) -> DataFrame:
    """(part, subset, kept, good, toxic): what is left when the filters of the subset have been applied; subsets are bit masks."""
    ship(rows.sparkSession)
    names = ["part", "subset", "kept", "good", "toxic"]

    def counted(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(batches)
        coded = t["part"].combine_chunks().dictionary_encode()
        codes, fails = coded.indices.to_numpy(zero_copy_only=False), t["fails"].to_numpy()
        marks = [t[c].to_numpy() for c in ("good", "toxic")]
        for parts, subset, counts in left_by_subset(codes, fails, marks, filters):
            yield pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(parts)), pa.array(np.full(len(parts), subset, np.int32)), *[pa.array(c) for c in counts]], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            if b.num_rows:
                held.append(b)
                n += b.num_rows
            if n >= CHUNK:
                yield from counted(held)
                held, n = [], 0
        if held:
            yield from counted(held)

    cells = rows.select("part", "fails", "good", "toxic").mapInArrow(run, "part string, subset int, kept long, good long, toxic long")
    return cells.groupBy("part", "subset").agg(*[F.sum(c).alias(c) for c in names[2:]])


def order_table(spark: SparkSession, filters: str = FILTERS) -> DataFrame:
    """(filter_order, step, before, filter) of all orders: before is the subset applied earlier, filter the number of the one applied now."""
    rows = []
    for order in permutations(filters):
        before = 0
        for step, f in enumerate(order, 1):
            rows.append(("".join(order), step, before, filters.index(f)))
            before |= 1 << filters.index(f)
    return spark.createDataFrame(rows, "filter_order string, step int, before int, filter int")


def interactions(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """One row per part, order and step from the counts by subset: an array of 2^filters entries for each part, and the table of orders.

    A filter's ``shapley`` adds up what it removes after each subset, as often as orders begin with that subset. A subset's count
    stands in that sum once for the filters outside it and once, taken away, for those inside.
    """
    n, every = len(filters), (1 << len(filters)) - 1
    begun = [math.factorial(k) * math.factorial(n - 1 - k) for k in range(n)]

    def over_orders(bit: int) -> Column:
        times = [-begun[s.bit_count() - 1] if s & bit else begun[s.bit_count()] for s in range(every + 1)]
        return F.sum(F.col("kept") * F.array(*[F.lit(t) for t in times])[F.col("subset")])

    cells = F.array_sort(F.collect_list(F.struct("subset", "kept", "good", "toxic")))  # 2^filters entries
    by_part = counts.groupBy("part").agg(cells.alias("left"), F.array(*[over_orders(1 << i) for i in range(n)]).alias("over_orders"))
    at = lambda subset, what: F.col("left")[subset][what]
    before, bit = F.col("before"), F.lit(1).cast("int")
    bit = F.call_function("shiftleft", bit, F.col("filter"))
    gone = lambda what: at(before, what) - at(before.bitwiseOR(bit), what)
    # the table of orders has a row for each of n! orders and n steps
    return by_part.join(F.broadcast(order_table(counts.sparkSession, filters))).select(
        "part", "filter_order", "step", at(before.bitwiseOR(bit), "kept").alias("kept"), gone("kept").alias("removed"),
        (at(F.lit(0), "kept") - at(bit, "kept") - gone("kept")).alias("redundant"), (at(F.lit(every).bitwiseXOR(bit), "kept") - at(F.lit(every), "kept")).alias("unique_fails"),
        gone("good").alias("good_lost"), gone("toxic").alias("toxic_lost"), F.col("over_orders")[F.col("filter")].alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, **columns: str) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of all orders of FILTERS.

    See ``judged`` for nulls and repeats. Texts of any length count whole; other columns are not read, whatever their names. An
    empty table gives no rows, as it has no parts.
    """
    return interactions(bitmap_counts(judged(docs, labels, **columns)))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS first FROM d
), f AS (
  SELECT doc_id, part, CASE WHEN len(words) < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(words)) < 65 * len(words) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text) THEN 4 ELSE 0 END + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN doc_id > first THEN 16 ELSE 0 END AS fails FROM w
), l AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY 1
), r AS (
  SELECT part, fails, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM f LEFT JOIN l ON f.doc_id = l.doc_id GROUP BY ALL
), letters AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c, unnest([1, 2, 4, 8, 16]) AS bit
), orders AS (
  SELECT a.c || b.c || c.c || d.c || e.c AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM letters a, letters b, letters c, letters d, letters e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND len(list_distinct([a.c, b.c, c.c, d.c, e.c])) = 5
), steps AS (
  SELECT filter_order, step, bits[step] AS bit, CAST(coalesce(list_sum(bits[1:step - 1]), 0) AS INTEGER) AS before FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)
), j AS (
  SELECT part, filter_order, step, bit, sum(CASE WHEN fails & (before | bit) = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN fails & before = 0 AND fails & bit > 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN fails & before > 0 AND fails & bit > 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN fails = bit THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN fails & before = 0 AND fails & bit > 0 THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN fails & before = 0 AND fails & bit > 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM r, steps GROUP BY 1, 2, 3, 4
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM j
"""
