"""Helpers shared by the operators: scratch tables, row ids, column idioms."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship

__all__ = ["ship", "scratch", "drop_scratch", "drop_since", "scratch_mark", "checkpoint_root", "table", "let", "ascii_lower", "empty_array", "unused", "UPPER", "LOWER"]

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def checkpoint_root(spark: SparkSession) -> str:
    """Folder that the driver and all executors share.

    The cluster names it in `spark.checkpoint.dir`. Only in local mode, where
    driver and executors are one process, a temporary folder stands in for an
    unset one (and is stored there); elsewhere that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="sealstone-ckpt-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


#: Folders of scratch tables that were written and not deleted yet, in order.
_WRITTEN: list[str] = []


def scratch(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as Parquet in the shared folder and read it back.

    This cuts lineage: what is read later comes from shared storage and
    survives the loss of any executor. Columns prune and filters push down on
    the way back, and the file sizes give the planner true statistics. Tables
    stay until `drop_since` or `drop_scratch`, as results may still read them.
    """
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/scratch/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def _folder(df: DataFrame) -> str | None:
    name = next(iter(df.inputFiles()), "").rsplit("/", 2)
    return next((p for p in _WRITTEN if len(name) == 3 and p.rsplit("/", 1)[1] == name[1]), None)


def drop_scratch(df: DataFrame) -> None:
    """Delete the files of a scratch table that nothing will read again."""
    if path := _folder(df):
        _delete(df.sparkSession, path)
        _WRITTEN.remove(path)


def scratch_mark() -> int:
    """Number of scratch tables so far, for `drop_since`."""
    return len(_WRITTEN)


def drop_since(spark: SparkSession, mark: int, keep: DataFrame | None = None) -> None:
    """Delete scratch tables written since `mark`, all but the one that `keep` reads."""
    kept = None if keep is None else _folder(keep)
    for path in [p for p in _WRITTEN[mark:] if p != kept]:
        _delete(spark, path)
        _WRITTEN.remove(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` over `value`, with `value` evaluated once per row.

    A column that a lambda refers to would otherwise be inlined by the
    optimiser and evaluated again for every array element.
    """
    return F.transform(F.array(value), body)[0]


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else (Spark's lower() folds all of Unicode)."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def empty_array(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def unused(name: str, df: DataFrame) -> str:
    """A column name that `df` has not, `name` if it is free."""
    taken = {c.lower() for c in df.columns}
    return next(n for n in (name, *(f"{name}{i}" for i in range(len(taken) + 1))) if n.lower() not in taken)
