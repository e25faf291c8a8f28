"""Files that fail alone, and tables that are replaced in one step.

Files are read by Spark as bytes and parsed in the tasks, so a file that is broken, lacks a column or is gone gives a row
that says so while the others give theirs. Tables are written beside what they replace; a reader sees the old one until
a rename, and the old one stays where a job fails.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Kinds of columns that files can be read as.
KINDS = {"string": pa.string(), "double": pa.float64(), "long": pa.int64(), "date": pa.date32()}


def _column(table: pa.Table, name: str, kind: str) -> pa.Array:
    got = table.column(name)
    if kind == "date" and pa.types.is_string(got.type):
        got = got.cast(pa.timestamp("us"))
    return got.cast(KINDS[kind], safe=False).combine_chunks()


def read_each(files: DataFrame, columns: dict[str, str], renamed: dict[str, str] | None = None) -> DataFrame:
    """(name, file, place, status, error, columns) of ``files`` (name, path, content), parquet files as bytes.

    A file that can be read gives a row per row, status row, with its place in the file, and one with status ok and the
    number of rows as place; one that cannot gives a single row with status failed and the reason. ``columns`` are names
    and kinds (``KINDS``), ``renamed`` says what a file calls some of them. A file is read whole by one task.
    """
    names, kinds, called = list(columns), list(columns.values()), renamed or {}
    out = ["name", "file", "place", "status", "error", *names]

    def one(name: str, path: str, content: bytes) -> Iterator[pa.RecordBatch]:
        said = lambda status, n, why: pa.RecordBatch.from_arrays([pa.array([name]), pa.array([path]), pa.array([n], pa.int64()), pa.array([status]), pa.array([why], pa.string()), *(pa.nulls(1, KINDS[k]) for k in kinds)], out)
        try:
            table = pq.read_table(io.BytesIO(content), columns=[called.get(n, n) for n in names])
            if lacking := [n for n in names if called.get(n, n) not in table.column_names]:
                raise KeyError(f"no column {', '.join(lacking)}")
            values = [_column(table, called.get(n, n), k) for n, k in columns.items()]
        except (pa.ArrowException, KeyError, OSError, ValueError) as why:
            yield said("failed", None, f"{type(why).__name__}: {why}".splitlines()[0][:500])
            return
        n = table.num_rows
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([name] * n), pa.array([path] * n), pa.array(range(n), pa.int64()), pa.array(["row"] * n), pa.nulls(n, pa.string()), *values], out)
        yield said("ok", n, None)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, path, content in zip(*(batch.column(c) for c in ("name", "path", "content")), strict=True):
                yield from one(name.as_py(), path.as_py(), content.as_py())

    schema = "name string, file string, place long, status string, error string, " + ", ".join(f"`{n}` {k}" for n, k in columns.items())
    return files.select("name", "path", "content").mapInArrow(work, schema)


def files_of(spark: SparkSession, path: str) -> DataFrame:
    """(name, path, content) of the parquet files of a directory, a glob or a single file; the name is the file's."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True).load(path)
    return df.select(F.regexp_extract("path", r"([^/]+)\.parquet$", 1).alias("name"), "path", "content")


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def read_pool(spark: SparkSession, paths: dict[str, str], columns: dict[str, str] | None = None) -> DataFrame:
    """``read_each`` of a pool's members, named by the keys of ``paths``; a member whose path is not there gives a row with
    status missing."""
    columns = columns or {"date": "date", "instrument": "string", "pred": "double"}
    schema = "name string, file string, place long, status string, error string, " + ", ".join(f"`{n}` {k}" for n, k in columns.items())
    gone = [(n, p, None, "missing", "no such path", *(None for _ in columns)) for n, p in paths.items() if not exists(spark, p)]
    out = spark.createDataFrame(gone, schema)  # a row per member
    for name, path in paths.items():
        if exists(spark, path):
            out = out.unionByName(read_each(files_of(spark, path).withColumn("name", F.lit(name)), columns))
    return out


def rows_of(read: DataFrame) -> DataFrame:
    return read.where("status = 'row'").drop("status", "error")


def report_of(read: DataFrame) -> DataFrame:
    """(name, file, status, rows, error): a row per file."""
    return read.where("status <> 'row'").select("name", "file", "status", F.col("place").alias("rows"), "error")


# ---- replacing in one step

def _rename(spark: SparkSession, source: str, target: str, over: bool = False) -> None:
    """One rename by the file system; ``over`` replaces a file that is there in the same step."""
    jvm = spark._jvm
    one, two = jvm.org.apache.hadoop.fs.Path(source), jvm.org.apache.hadoop.fs.Path(target)
    option = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE if over else jvm.org.apache.hadoop.fs.Options.Rename.NONE
    array = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    array[0] = option
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(one.toUri() if one.toUri().getScheme() else one.getFileSystem(spark._jsc.hadoopConfiguration()).getUri(), spark._jsc.hadoopConfiguration()).rename(one, two, array)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def write_beside(spark: SparkSession, path: str, write) -> None:
    """``write`` to a new folder next to ``path``, then put it in the place of ``path``. Where the job fails ``path`` is as it
    was; what was there goes last. For readers that must never find nothing use ``replace_table``."""
    new, old = (f"{path.rstrip('/')}.{k}-{uuid.uuid4().hex[:8]}" for k in ("new", "old"))
    try:
        write(new)
    except BaseException:
        _delete(spark, new)
        raise
    if exists(spark, path):
        _rename(spark, path, old)
    _rename(spark, new, path)
    _delete(spark, old)


POINTER = "CURRENT"


def current(spark: SparkSession, path: str) -> str | None:
    """The folder that holds the present version of the table at ``path``; None if there is none yet."""
    if not exists(spark, f"{path}/{POINTER}"):
        return None
    return f"{path}/{spark.read.text(f'{path}/{POINTER}').first()[0]}"


def replace_table(df: DataFrame, path: str, by: str | None = None, keep: int = 1) -> None:
    """A new version of the table at ``path``, which ``df`` may read: it is written whole, then the pointer file is replaced by
    one rename, so a reader finds the old version or the new one. ``keep`` older versions stay for readers that began."""
    spark = df.sparkSession
    before = current(spark, path)
    number = 1 + (int(before.rsplit("v", 1)[1].split("-")[0]) if before else 0)
    version = f"v{number:08d}-{uuid.uuid4().hex[:8]}"
    writer = df.write
    (writer.partitionBy(by) if by else writer).parquet(f"{path}/{version}")
    draft = f"{path}/draft-{uuid.uuid4().hex[:8]}"
    jvm, where = spark._jvm, spark._jvm.org.apache.hadoop.fs.Path(draft)
    out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True)
    out.write(bytearray(version.encode()))
    out.close()
    _rename(spark, draft, f"{path}/{POINTER}", over=True)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    for status in fs.listStatus(jvm.org.apache.hadoop.fs.Path(path)):
        name = status.getPath().getName()
        if name.startswith("v") and int(name[1:].split("-")[0]) < number - keep:
            _delete(spark, f"{path}/{name}")


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """The present version of a table of ``replace_table``."""
    version = current(spark, path)
    if version is None:
        raise FileNotFoundError(f"no table at {path}")
    return spark.read.parquet(version)


def upsert_table(new: DataFrame, path: str, keys: list[str]) -> None:
    """Rows of ``new`` and those of the table at ``path`` for other ``keys``, as its next version."""
    spark = new.sparkSession
    if current(spark, path) is None:
        replace_table(new, path)
    else:
        replace_table(read_table(spark, path).join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new), path)
