"""Where intermediate tables go: the shared folder that the session names in ``spark.checkpoint.dir``."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder. Where none is set and all runs in one process (tests, a laptop) one is made; on
    a cluster a folder of one machine would not do, so that is an error."""
    sc = spark.sparkContext
    known = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not known:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="crosspanel-"))
        known = sc.getCheckpointDir()
    return known.rstrip("/")


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: lineage ends there and lost executors cost nothing."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return df.select(*columns) if columns else df


#: Rows of two longs that may be broadcast (about 32 MB); beyond it the same join shuffles.
BROADCAST_ROWS = 2_000_000


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` (a settled table of narrow rows) with a broadcast hint if it has at most ``limit`` rows."""
    return F.broadcast(df) if df.count() <= limit else df


def sampled(df: DataFrame, most: int, *key: str) -> DataFrame:
    """About ``most`` rows of ``df``, chosen by the hash of ``key``: all of them if it has no more. The range of hashes is
    sized by a count first, so no task keeps or sends more than its share of the sample."""
    n = df.count()
    grain = 1 << 40
    return df if n <= most else df.where(F.pmod(F.xxhash64(*quoted(*key)), F.lit(grain)) < math.ceil(grain * most / n))


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or a longer one if ``df`` has a column of that name already."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def quoted(*names: str) -> list:
    return [F.col(f"`{n}`") for n in names]


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the undirected ``edges`` (a, b): root is the smallest node it reaches.

    Large-star/small-star contraction: each round is two groupings with map-side minima, the edge list never
    grows beyond the nodes' stars, and each step is settled, so lineage stays short and both sides of a join are plain
    tables: minima are broadcast while they are few, beyond that a hot node's rows may be split. Empty edges give no rows.
    """
    work = settle(edges.where("a <> b").selectExpr("greatest(a, b) AS u", "least(a, b) AS v").distinct())
    while True:
        # large star: every neighbour above the node moves to the smallest neighbour
        both = work.union(work.selectExpr("v AS u", "u AS v"))
        low = small(settle(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))))
        large = both.where("v > u").join(low, "u").selectExpr("v AS u", "m AS v").where("u <> v").distinct()
        large = settle(large)
        # small star: the lower neighbours and the node itself move to the smallest of them
        low = small(settle(large.groupBy("u").agg(F.min("v").alias("m"))))
        joined = large.join(low, "u")
        after = settle(joined.selectExpr("v AS u", "m AS v").union(joined.selectExpr("u", "m AS v")).where("u <> v").distinct())
        sums = [d.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first() for d in (work, after)]
        work = after
        if sums[0] == sums[1]:
            break
    nodes = work.groupBy("u").agg(F.min("v").alias("root"))
    roots = work.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return settle(nodes.withColumnRenamed("u", "node").union(roots))
