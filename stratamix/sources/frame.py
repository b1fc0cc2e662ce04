"""Input tables: validation, projection, union of samples, exact row samples, rule files."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: The sample number that some sources add to their rows; it is no feature.
SAMPLE = "Original"


def numeric_columns(df: DataFrame) -> list[str]:
    """All numeric columns but SAMPLE."""
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name != SAMPLE]


def require(df: DataFrame, params: Sequence[str]) -> list[str]:
    """``params`` if the table has them all as numbers; else ValueError with the offenders."""
    kinds = {f.name: f.dataType for f in df.schema}
    missing = [p for p in params if p not in kinds]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    other = [p for p in params if not isinstance(kinds[p], T.NumericType)]
    if other:
        raise ValueError(f"not numeric: {', '.join(other)}")
    return list(params)


def features(df: DataFrame, params: Sequence[str], *keep: str) -> DataFrame:
    """The kept columns and the features as doubles."""
    require(df, params)
    return df.select(*keep, *[F.col(f"`{p}`").cast("double").alias(p) for p in params])


def union_samples(samples: dict[str, DataFrame], name: str = "sample_id") -> DataFrame:
    """Samples under each other; the name of each stays as a column that is no feature."""
    frames = [df.drop(SAMPLE).withColumn(name, F.lit(key)) for key, df in samples.items()]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def default_fraction(n: int) -> float:
    """Share of rows that one-dimensional fits take, by the number of rows."""
    for least, share in ((1_000_000, 0.03), (500_000, 0.06), (100_000, 0.1), (10_000, 0.5)):
        if n > least:
            return share
    return 1.0


def sample_size(n: int, fraction: float, floor: int = 10_000) -> int:
    return n if fraction >= 1 else min(max(math.ceil(fraction * n), floor), n)


#: Slots of equal width that draws are counted in, to find where a sample ends.
SLOTS = 4096
#: Draws have so many bits.
DRAW_BITS = 60


def first_rows(df: DataFrame, size: int, *by: str) -> DataFrame:
    """The ``size`` rows that come first by some columns."""
    return df.orderBy(*by).limit(size)


def kept(df: DataFrame) -> DataFrame:
    """``df``, made once: in the folder that ``spark.checkpoint.dir`` names, or where none is named in Spark's storage."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        return df.persist()
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint()


def holding(df: DataFrame, *frames: DataFrame) -> DataFrame:
    """``df``, which reads ``frames`` that Spark stores; see ``release``."""
    df._held = [*getattr(df, "_held", []), *frames]
    return df


def release(df: DataFrame) -> None:
    """Frees what ``df`` held, once it is no longer read."""
    for f in getattr(df, "_held", []):
        f.unpersist()


def numbered(df: DataFrame, name: str, *order: Column) -> DataFrame:
    """Adds ``name``: 1 for the first row by some columns, 2 for the next, and so on. No task holds more than its range of the rows.

    The rows are dealt by ranges and made once; their numbers are the places in the ranges and the rows in the ranges before.
    """
    part, place, before = (f"_{name}_{x}" for x in ("part", "place", "before"))
    sorted_ = df.repartitionByRange(*order).sortWithinPartitions(*order)
    sorted_ = kept(sorted_.withColumns({part: F.spark_partition_id(), place: F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}))
    sizes = sorted_.groupBy(part).count().orderBy(part).collect()  # a row a partition
    firsts = [0]
    for r in sizes:
        firsts.append(firsts[-1] + r["count"])
    begin = df.sparkSession.createDataFrame([(r[part], n) for r, n in zip(sizes, firsts, strict=False)], f"{part} int, {before} long")
    return holding(sorted_.join(F.broadcast(begin), part).withColumn(name, F.col(before) + F.col(place) + 1).drop(part, place, before), sorted_)


def draws(df: DataFrame, seed: int = 0, by: Sequence[str] = ()) -> Column:
    """An even draw from [0, 2^DRAW_BITS) for each row: from the text of its ``by`` columns, or from the place where it is read."""
    if by:
        text = F.concat_ws(":", F.lit(str(seed)), *[F.col(f"`{c}`").cast("string") for c in by])
        return F.conv(F.substring(F.md5(text.cast("binary")), 1, DRAW_BITS // 4), 16, 10).cast("long")
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.monotonically_increasing_id()), 64 - DRAW_BITS)


def sample_rows(df: DataFrame, size: int, n: int | None = None, seed: int = 0, by: Sequence[str] = ()) -> DataFrame:
    """Exactly ``size`` rows (all, if fewer): those of the smallest draws, so each row has the same chance, equal rows too.

    Rows are not shuffled by their values. A bound a little above the share keeps back most rows; what passes, about ``size``
    rows, is made once, its draws are counted in slots, all slots but the last that is needed are taken whole, and only the
    last one is ordered. ``by`` names columns that tell rows apart: the same rows are then drawn however the table is laid
    out. Without, the same layout gives the same rows.
    """
    n = df.count() if n is None else n
    if size >= n:
        return df
    if size <= 0:
        return df.limit(0)
    share, whole = size / n, 1 << DRAW_BITS
    name = "_draw"
    while name in df.columns:
        name = f"_{name}"
    keyed = df.withColumn(name, draws(df, seed, by))
    most = min(1.0, share + 6 * math.sqrt(share * (1 - share) / n) + 30 / n)
    while True:
        width = max(1, math.ceil(most * whole) // SLOTS)
        near = kept(keyed.filter(F.col(name) < F.lit(width * SLOTS)))
        slot = F.floor(F.col(name) / width)
        before, edge = 0, None
        for r in near.groupBy(slot.alias("slot")).count().orderBy("slot").collect():  # SLOTS rows at most
            if before + r["count"] >= size:
                edge = r["slot"]
                break
            before += r["count"]
        if edge is not None:
            break
        near.unpersist()
        most = min(1.0 + 1.0 / SLOTS, 2 * most)  # by rare chance too few rows passed
    last = first_rows(near.filter(slot == edge), size - before, name)
    return holding(near.filter(slot < edge).unionByName(last).drop(name), near)


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """Label rules from a CSV file: the label in the first column, hi, lo or dc for each marker; ``rule_order`` from 1."""
    raw = spark.read.csv(path, header=True)
    rows = raw.collect()  # a rule file has dozens of rows, and their order is the file's
    label = raw.columns[0]
    names = ["rule_order", "label", *raw.columns[1:]]
    schema = T.StructType([T.StructField(names[0], T.IntegerType()), *[T.StructField(c, T.StringType()) for c in names[1:]]])
    return spark.createDataFrame([(i + 1, r[label], *[r[c] for c in raw.columns[1:]]) for i, r in enumerate(rows)], schema)
