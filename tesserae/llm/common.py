"""What the operators share: intermediate tables in the shared folder, ranks without a single-task sort."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Rows that one slice of a distributed rank holds on average.
SLICE_ROWS = 20_000
#: Tables of counts are broadcast up to so many rows (some MB); beyond that they are joined by a shuffle.
BROADCAST_ROWS = 100_000


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Without it a temporary one is set, on one machine only."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="tesserae-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


#: Rows of an Arrow batch: whole texts are long, and both sides of the Python boundary hold a batch or two.
BATCH_ROWS = 512
BATCH_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """Lowers Spark's default of 10,000 rows a batch; any other setting is the user's and stays.

    It isn't raised again: what the operators return is lazy and runs after they are done.
    """
    if spark.conf.get(BATCH_CONF) == "10000":
        spark.conf.set(BATCH_CONF, str(BATCH_ROWS))


#: Folders of intermediate tables that this process has made and not dropped.
_made: list[str] = []


def made() -> list[str]:
    return list(_made)


def drop_made(spark: SparkSession, but: list[str]) -> None:
    """Deletes the folders of intermediate tables but those given, as once whatever was built on them is written."""
    for path in [p for p in _made if p not in but]:
        _delete(spark, path)
        _made.remove(path)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


class Scratch:
    """Written intermediate tables. They cut lineage and outlive lost executors; `drop` and `finish` delete them."""

    def __init__(self, spark: SparkSession, name: str):
        bound_batches(spark)
        self.spark, self.at, self.n = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0
        self.live: list[str] = []
        _made.append(self.at)

    def cut(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.at}/{self.n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        self.live.append(path)
        return out

    def together(self, tables: list[DataFrame]) -> DataFrame:
        """Written tables of one schema as one scan."""
        return self.spark.read.schema(tables[0].schema).parquet(*(t._scratch_path for t in tables))

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            _delete(self.spark, t._scratch_path)
            self.live.remove(t._scratch_path)

    def finish(self, df: DataFrame) -> DataFrame:
        """Writes the result and deletes all before it."""
        before = list(self.live)
        out = self.cut(df)
        for path in before:
            _delete(self.spark, path)
            self.live.remove(path)
        return out


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.translate(text, ASCII_UPPER, ASCII_UPPER.lower())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ranked(df: DataFrame, keys: list[str], order: list[Column], counts_from: DataFrame | None = None, name: str = "rank", slice_rows: int = SLICE_ROWS, lead: list[str] | None = None, spread: Column | None = None) -> DataFrame:
    """Adds a gapless long rank from 0 within `keys` (never null). No task sorts a whole key.

    A key's rows are dealt by a hash of `order` into slices of about `slice_rows`; ranks follow the slice,
    then `order`, so that a small key is simply sorted by `order`. Counts by slice give each slice's first
    rank. `order` must decide all ties but those of rows that are alike.
    counts_from: the same rows, already written, so that counting does not repeat their work.
    lead, spread: ranks follow `order` alone, whatever `slice_rows`. lead: columns (never null) that `order`
    begins with, each value having slices of its own; spread: what comes next in `order`, as a long of 32 bits
    spread evenly, by whose ranges the slices are cut.
    """
    slim = counts_from if counts_from is not None else df
    cells = [*keys, *(lead or [])]
    dealt, n = None, 1
    if cells:
        # cells of several slices: at most one for each slice_rows rows
        dealt = slim.groupBy(*cells).agg(F.count("*").alias("_n")).where(F.col("_n") > slice_rows).select(*cells, F.ceil(F.col("_n") / slice_rows).cast("long").alias("_slices"))
        dealt = F.broadcast(dealt) if dealt.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else dealt
    else:
        n = max(1, -(-slim.count() // slice_rows))

    def sliced(rows: DataFrame) -> DataFrame:
        slices = F.lit(n) if dealt is None else F.coalesce(F.col("_slices"), F.lit(1).cast("long"))
        rows = rows if dealt is None else rows.join(dealt, cells, "left")
        return rows.withColumn("_slice", F.pmod(F.xxhash64(*order), slices) if spread is None else F.shiftright(spread * slices, 32))

    counts = sliced(slim).groupBy(*cells, "_slice").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy(*(lead or []), "_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_first", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    within = Window.partitionBy(*cells, "_slice").orderBy(*order)
    out = sliced(df).withColumn("_at", F.row_number().over(within) - 1)
    out = out.join(offsets, [*cells, "_slice"])
    return out.withColumn(name, (F.col("_first") + F.col("_at")).cast("long")).drop("_slice", "_slices", "_at", "_first")
