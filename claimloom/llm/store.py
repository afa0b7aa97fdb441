"""Shared scratch tables: the way these operators cut lineage.

Tables are written as Parquet under the folder the cluster names in
``spark.checkpoint.dir``, so a lost executor never takes intermediate rows with it. An
application's scratch folder goes when its driver ends; tables that nothing reads any
more go earlier, by :func:`release`.
"""

from __future__ import annotations

import tempfile
import uuid
import weakref

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_ROOTS: dict[tuple[str, str | None], str] = {}
_PATHS: "weakref.WeakKeyDictionary[DataFrame, str]" = weakref.WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a local one only for a local master without any (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="spark-claimloom-")


def _delete(spark: SparkSession, path: str, at_exit: bool = False) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if at_exit:
        fs.mkdirs(p)
        fs.deleteOnExit(p)
    else:
        fs.delete(p, True)


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A new path under the application's scratch folder."""
    key = (spark.sparkContext.applicationId, spark.conf.get("spark.checkpoint.dir", None))
    if key not in _ROOTS:
        _ROOTS[key] = f"{shared_dir(spark)}/claimloom-{key[0]}"
        _delete(spark, _ROOTS[key], at_exit=True)
    return f"{_ROOTS[key]}/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back."""
    path = scratch_path(df.sparkSession, tag)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete tables of :func:`materialize` that no later step reads; other DataFrames are left alone."""
    for t in tables:
        path = _PATHS.pop(t, None)
        if path:
            _delete(t.sparkSession, path)


def columns_of(df: DataFrame) -> list[str]:
    """The names of all columns, quoted, so that any name can be selected."""
    return ["`" + c.replace("`", "``") + "`" for c in df.columns]


def row_digest(df: DataFrame) -> Column:
    """A number made of all columns of a row, so that ties between rows end alike in every run; rows that agree in it agree in all columns (but for collisions)."""
    types = [field.dataType.simpleString() for field in df.schema.fields]
    return F.xxhash64(*[F.to_json(F.struct(c)) if "map<" in t else F.col(c) for c, t in zip(columns_of(df), types, strict=True)])
