"""What the corpus operators share: staged tables, document columns and connected components."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows that Spark sends to a Python worker at once, unless the session sets it: a row may hold a text of many kilobytes.
BATCH_ROWS = 512

_local_root: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is `spark.checkpoint.dir`. Where that is unset, a local session gets a
    temporary folder of its own, and a cluster uses the warehouse, which is shared.
    """
    if own := spark.conf.get("spark.checkpoint.dir", None):
        return own.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_staged"
    if not _local_root:
        _local_root.append(tempfile.mkdtemp(prefix="lodestrata-"))
        atexit.register(shutil.rmtree, _local_root[0], True)
    return "file://" + _local_root[0]


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as Parquet in the shared folder and read it back.

    This cuts the lineage with files that survive the loss of any executor.
    """
    path = f"{shared_dir(df.sparkSession)}/staged-{uuid.uuid4().hex}/{name}.parquet"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text, as `doc_id` and `text` (null: empty); other columns cannot clash."""
    return docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))


def map_batches(df: DataFrame, run: Callable, schema: T.StructType | str) -> DataFrame:
    """mapInArrow in batches of BATCH_ROWS rows, so that a worker's buffers stay at some megabytes.

    Where the session has no size of its own for Arrow batches, this sets it.
    """
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if conf.get(key, None) is None:
        conf.set(key, str(BATCH_ROWS))
    return df.mapInArrow(run, schema)


def broadcast_if(df: DataFrame, rows: int, most: int) -> DataFrame:
    """A broadcast hint for a table of a known number of rows, if that is within the bound; else a shuffle join."""
    return F.broadcast(df) if rows <= most else df


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training: crc32 of its id as text has remainder 1 by 3 (null id: false)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def components(links: DataFrame) -> DataFrame:
    """(node, root) for each node of the undirected links (a, b); root is the smallest node it reaches.

    Labels go to neighbours and then jump to their label's label, so that the rounds
    grow with the logarithm of the longest path; each round is staged. No row holds
    more than one link, and both joins leave skewed keys to adaptive splitting.
    """
    edges = staged(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct(), "edges")
    labels = staged(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("root")), "labels")
    while True:
        near = edges.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("m"))
        lower = labels.join(near, "node").select("node", F.col("root").alias("old"), F.least("root", "m").alias("root"))
        lower = staged(lower, "lower")
        to = lower.select(F.col("node").alias("root"), F.col("root").alias("far"))
        jumped = staged(lower.join(to, "root").select("node", "old", F.col("far").alias("root")), "jumped")
        labels = jumped.select("node", "root")
        if jumped.where("old <> root").limit(1).count() == 0:
            return labels
