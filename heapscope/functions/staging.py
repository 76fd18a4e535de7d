"""Tables written between the steps of an iterative plan, and the package on the executors."""

from __future__ import annotations

import atexit
import contextlib
import posixpath
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from functools import reduce
from pathlib import Path

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Hands this package to the executors' Python workers, which may not have it installed, once an application. Spark's own
    file server carries the archive; no executor reads a folder of the driver."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    package = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="heapscope-")) / f"{package.name}.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    sc.addPyFile(str(archive))


_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Only a session whose executors are threads of this machine may
    have none; it gets a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    key = spark.sparkContext.applicationId
    if key not in _own:
        _own[key] = tempfile.mkdtemp(prefix="heapscope-")
    return _own[key]


#: Staged tables that are still there, with the session's way to delete them.
_left: dict[str, tuple] = {}


@contextlib.contextmanager
def _setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A setting of the session for the plans that are made and run meanwhile. Older versions do not know some."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def _shuffles_deleted(spark: SparkSession):
    """Spark deletes the shuffle files of plans made and run meanwhile when they end."""
    return _setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def staged(df: DataFrame, name: str, by: str | None = None, once: bool = False) -> DataFrame:
    """Writes df as a Parquet table in the shared folder and rereads it: this cuts the lineage, and the table outlives any
    executor. The schema is given, so rereading needs no footer scan. by: a column whose values lie in folders of their own, so
    that a filter on it reads nothing else. once: no other plan shares df's shuffles, so their files are deleted when the table
    is written, not when the driver happens to collect its garbage."""
    spark = df.sparkSession
    path = posixpath.join(shared_folder(spark), f"{name}-{uuid.uuid4().hex}")
    writer = df.write.option("compression", "zstd")
    with _shuffles_deleted(spark) if once else contextlib.nullcontext():
        (writer.partitionBy(by) if by else writer).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_path = path
    _left[path] = (spark._jvm, spark._jsc.hadoopConfiguration())
    return out


#: Rows of numbers that a task gets where a table is dealt by its rows.
TASK_ROWS = 1 << 20
#: Bytes in memory up to which a sized table is broadcast.
SMALL_BYTES = 1 << 20


def _width(kind: DataType) -> int:
    """About the bytes that a value takes in a row."""
    if isinstance(kind, StructType):
        return 8 + sum(_width(f.dataType) for f in kind.fields)
    return 8 + 8 * _width(kind.elementType) if isinstance(kind, ArrayType) else 8


#: The most rows that a sized table of an application had.
_most: dict[str, int] = {}


def shuffle_parts(spark: SparkSession, rows: int) -> int:
    """Partitions of shuffles once so many rows, and the largest table so far, are to be dealt."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), max(rows, _most.get(spark.sparkContext.applicationId, 0)) // TASK_ROWS + 1)


def sized(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """A staged table whose joins go by its rows: it is broadcast if it is small, and else never. Spark alone goes by the bytes of the files, and numbers in
    order compress so well that tables of many million rows would go through the driver. Its own plan shuffles into as many partitions as the largest
    table so far asks for, so that what one task holds does not grow with the heap."""
    spark, seen = df.sparkSession, Observation()
    app = spark.sparkContext.applicationId
    parts = shuffle_parts(spark, 0)
    with _setting(spark, "spark.sql.shuffle.partitions", str(parts)):
        table = staged(df.observe(seen, F.count(F.lit(1)).alias("n")), name, by)
    rows = seen.get.get("n")
    rows = table.count() if rows is None else rows
    _most[app] = max(_most.get(app, 0), rows)
    small = rows * _width(df.schema) <= SMALL_BYTES
    out = table.hint("broadcast" if small else "merge")
    out._staged_path, out._staged_rows, out._staged_small = table._staged_path, rows, small
    return out


def rows_of(df: DataFrame) -> int:
    """The number of rows, which a sized table has at hand."""
    found = getattr(df, "_staged_rows", None)
    return df.count() if found is None else found


def rows_from(table: DataFrame, view: DataFrame) -> DataFrame:
    """view, which has as many rows as a sized table."""
    view._staged_rows = table._staged_rows
    return view


def united(tables: list[DataFrame]) -> DataFrame:
    """All rows of some tables; like a sized table's, its join does not go by the bytes of files."""
    return tables[0] if len(tables) == 1 else reduce(DataFrame.unionAll, tables).hint("merge")


def parts_for(spark: SparkSession, rows: int) -> int:
    """Partitions for so many rows: as many as the session has for shuffles, fewer for small tables, more for large ones."""
    usual = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(min(usual, rows // (TASK_ROWS // 2) + 1), rows // TASK_ROWS + 1)


def kept(df: DataFrame, parts: int) -> DataFrame:
    """df kept on the executors' disks; its shuffles have so many partitions. Lost parts are made anew."""
    with _setting(df.sparkSession, "spark.sql.shuffle.partitions", str(parts)):
        out = df.persist(StorageLevel.DISK_ONLY)
        out.count()
    return out


def sent(table: DataFrame, view: DataFrame) -> DataFrame:
    """view of a sized table, to be joined with one that is dealt already: broadcast if the table is small, else dealt likewise and looked up there."""
    return view if table._staged_small else view.hint("shuffle_hash")


def _delete(path: str) -> None:
    jvm, conf = _left.pop(path)
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(conf).delete(where, True)


def unstage(*tables: DataFrame) -> None:
    """Deletes staged tables that no later plan reads."""
    for df in tables:
        path = getattr(df, "_staged_path", None)
        if path in _left:
            _delete(path)


@atexit.register
def _remove_left() -> None:
    """Tables that lazy results may have read until now go when the driver's program ends."""
    for path in list(_left):
        with contextlib.suppress(Exception):  # the session's JVM may be gone already
            _delete(path)
