"""Tables staged in the folder that driver and executors share, to cut the lineage of iterations."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Each round writes a file for each bucket that it adds to, and later rounds open them all.
MOST_BUCKETS = 64
#: Rows that `dealt` gives to a task. Adaptive execution joins partitions by their compressed bytes, and would give it some millions.
TASK_ROWS = 1 << 16

_own: list[str] = []
#: Folders of the tables that were staged within the calls of `settled` that are open, a list for each call.
_within: list[list[str]] = []


def _place(spark: SparkSession, name: str) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local"):
        folder = spark.conf.get("spark.sql.warehouse.dir") + "/_staged"
    if not folder:
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="lodestrata-"))
            atexit.register(shutil.rmtree, _own[0], True)
        folder = "file://" + _own[0]
    folder = f"{folder.rstrip('/')}/staged-{uuid.uuid4().hex}"
    if _within:
        _within[-1].append(folder)
    return f"{folder}/{name}.parquet"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write to `spark.checkpoint.dir` (unset: a local session's temporary folder, a cluster's warehouse) and read back."""
    path = _place(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def staged_count(df: DataFrame, name: str, condition: Column) -> tuple[DataFrame, int]:
    """`staged`, and the number of rows that meet the condition, counted while they are written."""
    seen = Observation()
    rows = staged(df.observe(seen, F.count_if(F.coalesce(condition, F.lit(False))).alias("n")), name)
    return rows, seen.get["n"]


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """`df` by `keys` in parts of TASK_ROWS at most, if keys are spread, so that what a task sorts doesn't grow with `rows`."""
    return df.repartition(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS)), *keys)


def settled(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """`make()`, staged; what was staged on the way to it is deleted, so `make` must not keep any of that for later."""
    _within.append([])
    try:
        df = make()
        within = list(_within[-1])
    finally:
        _within.pop()
    out = staged(df, name)
    context = df.sparkSession.sparkContext
    for folder in within:
        path = context._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
    return out


class Buckets:
    """A staged table that rounds add rows to, in buckets of `keys`.

    A join or grouping by all the keys reads the rows where they lie, so that a round moves
    its own rows (`dealt`) and not those of the rounds before.
    """

    def __init__(self, spark: SparkSession, name: str, keys: list[str]):
        self.spark, self.keys, self.rounds = spark, keys, 0
        self.path, self.table = _place(spark, name), f"{name}_{uuid.uuid4().hex}"
        self.number = min(MOST_BUCKETS, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def dealt(self, df: DataFrame) -> DataFrame:
        """`df`, which has the keys, dealt out as the buckets are."""
        return df.repartition(self.number, *self.keys)

    def add(self, df: DataFrame, dealt: bool = False) -> tuple[DataFrame, int]:
        """The rows of this round, read back, and their number; `dealt`: the first ones are dealt out as the buckets are."""
        seen, k = Observation(), self.rounds
        rows = df if k or dealt else self.dealt(df)
        rows = rows.observe(seen, F.count("*").alias("n")).withColumn("_round", F.lit(k))
        rows.write.mode("append").option("path", self.path).partitionBy("_round").bucketBy(self.number, *self.keys).saveAsTable(self.table)
        self.rounds += 1
        if not seen.get["n"]:  # no rows leave no folder
            return df.limit(0), 0
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/_round={k}"), seen.get["n"]

    def rows(self) -> DataFrame:
        """The rows of all rounds."""
        return self.spark.table(self.table).drop("_round")
