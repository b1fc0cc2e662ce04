"""What the operators share: the shared folder, table readers and shipping this package to Python workers."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Package folder that Python workers must be able to import.
_PACKAGE = Path(__file__).resolve().parents[1]


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder's URI inside the folder that the cluster names in ``spark.checkpoint.dir``.

    Only where that setting is absent and all work is done on one machine, as in tests, a folder of our own is used.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.match(r"local(\[.*\])?$", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        base = "file:///tmp/checkpoints"
        spark.sparkContext.setCheckpointDir(base)
    if "://" not in base and not base.startswith("file:"):
        base = f"file://{base}"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def few(spark: SparkSession) -> int:
    """Partitions for what is small beside the tables it comes from: a quarter of the usual number."""
    return max(4, int(spark.conf.get("spark.sql.shuffle.partitions")) // 4)


def written(df: DataFrame, name: str, *, small: bool = False) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: cuts lineage and survives lost executors.

    ``small``: in few files, for lists of ids and links.
    """
    spark = df.sparkSession
    path = shared_dir(spark, name)
    (df.coalesce(few(spark)) if small else df).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._folder = path
    return out


def discard(*frames: DataFrame) -> None:
    """Deletes the folders of tables from ``written`` that nothing reads any more."""
    for df in frames:
        if folder := getattr(df, "_folder", None):
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


#: Most rows of a few numbers each (about 32 bytes) that may be sent to all tasks.
SENT_ROWS = 500_000


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` for a join in which neither side is sent whole.

    Spark takes a table for as large as its files and does not count what ``explode`` adds, so it would send small files of
    which very many rows are made through the driver.
    """
    return df.hint("merge")


def sent_if_small(df: DataFrame, name: str) -> DataFrame:
    """``df``, written and counted; marked for broadcast if it has at most SENT_ROWS rows, else for a shuffle join."""
    df = written(df, name, small=True)
    out = shuffled(df) if df.limit(SENT_ROWS + 1).count() > SENT_ROWS else F.broadcast(df)
    out._folder = df._folder
    return out


#: Bits of the set that ``likely`` sends to all tasks, 2 MB of them in at most 2^18 rows.
SET_BITS = 24


def likely(rows: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """The rows whose ``column`` is among the one column of ``ids``, and a few others: what a join need not shuffle goes before it.

    The set of hashes that is sent to all tasks has a fixed bound. It lets more rows through the fuller it is, and never
    takes away one that belongs.
    """
    slot = lambda x: F.pmod(F.xxhash64(x), F.lit(1 << SET_BITS))
    bit = lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), x.bitwiseAND(F.lit(63)).cast("int"))
    of = slot(F.col(ids.columns[0]))
    cells = ids.select(F.shiftright(of, 6).alias("_cell"), bit(of).alias("_bit")).groupBy("_cell").agg(F.bit_or("_bit").alias("_bits"))
    own = slot(F.col(column))
    found = rows.withColumn("_cell", F.shiftright(own, 6)).join(F.broadcast(cells), "_cell").filter(F.col("_bits").bitwiseAND(bit(own)) != 0)
    return found.drop("_cell", "_bits")


#: Rows of an Arrow batch in place of Spark's own number: texts are long, and a batch is held on both sides several times.
BATCH, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", "1000"


def ship(spark: SparkSession) -> None:
    """Makes this package importable in Python workers, wherever the driver was started from, and bounds the batches they get if nobody has."""
    sc = spark.sparkContext
    if spark.conf.get(BATCH, None) is None:
        spark.conf.set(BATCH, BATCH_ROWS)
    if getattr(sc, "_stratamix_shipped", None) == str(_PACKAGE):
        return
    folder = tempfile.mkdtemp()
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    target = os.path.join(folder, f"{_PACKAGE.name}-{uuid.uuid4().hex[:8]}.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(_PACKAGE.rglob("*.py")):
            z.write(p, str(p.relative_to(_PACKAGE.parent)))
    sc.addPyFile(target)
    sc._stratamix_shipped = str(_PACKAGE)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def crc_mod(column: str, mod: int):
    """crc32 of the column's value as text, modulo ``mod``; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % mod


def fresh(taken: list[str], wanted: str) -> str:
    """A column name that is not taken, case aside."""
    low = {t.lower() for t in taken}
    while wanted.lower() in low:
        wanted = f"_{wanted}"
    return wanted
