"""Shared pieces of the training-data operators: tables cut from lineage, splits, word classes."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but these separators.
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

_written: dict[str, SparkSession] = {}
_passing: ContextVar[list[str] | None] = ContextVar("passing", default=None)


def session() -> SparkSession:
    spark = SparkSession.getActiveSession()
    if spark is None:
        raise RuntimeError("no active Spark session")
    return spark


def shared_root(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Only where it is unset, and Spark runs in one process (tests), one is made."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="cellforge-")
        sc.setCheckpointDir(root)
        _written[root] = spark
    return root.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage: writes df as Parquet in the shared folder and reads it back."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/cellforge/{uuid.uuid4().hex}-{name}"
    _written[path] = spark
    if (passing_paths := _passing.get()) is not None:
        passing_paths.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(path: str) -> None:
    spark = _written.pop(path)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def passing() -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Tables that `written` stores inside are deleted at the end; those that the given function stores stay.
    Only such tables may be read afterwards. Each thread has its own, and they nest."""
    outer, mine = _passing.get(), []
    token = _passing.set(mine)

    def kept(df: DataFrame, name: str) -> DataFrame:
        inner = _passing.set(outer)
        try:
            return written(df, name)
        finally:
            _passing.reset(inner)

    try:
        yield kept
    finally:
        _passing.reset(token)
        for path in mine:
            _delete(path)


@atexit.register
def _clean() -> None:
    for path in list(_written):
        try:
            _delete(path)
        except Exception:  # the JVM may be gone at exit; the folder's owner cleans it then
            pass


def packed(docs: DataFrame, **made: Column) -> DataFrame:
    """Whole rows as one column `row` beside columns made of them: no name of docs can clash with those."""
    return docs.select(F.struct(*(F.col(quoted(c)) for c in docs.columns)).alias("row"), *(c.alias(k) for k, c in made.items()))


def unpacked(rows: DataFrame, columns: list[str], **made: Column) -> DataFrame:
    """The columns that packed took, some of them replaced."""
    return rows.select(*(made.get(c, F.col("row")[c]).alias(c) for c in columns))


def fresh(docs: DataFrame, name: str) -> str:
    """A column name that docs does not have, whatever the case."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def held_out(id_col: str) -> Column:
    """crc32 of the id as text, mod 4, is 2. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def may_train(id_col: str) -> Column:
    """Rows that a model may learn from: a known id whose remainder is not 2."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 != 2, F.lit(False))


def ascii_lower(col: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(col, UPPER, UPPER.lower())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
