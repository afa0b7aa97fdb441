"""Recording of finished fetches from a stream, once each however often a batch comes.

Three tables lie under one path, a folder a batch: ``runs`` (one row a fetch, always), ``snapshots`` (one for each fetch that brought
bytes) and ``blobs`` (each content once, for the batch that brought it first). A batch is written whole before its number is put into the log, and readers see
batches of the log alone, so a batch that failed half way leaves nothing to see and its replay overwrites what it left. A batch that is in the log changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_NEVER = -1
SCHEMAS = {
    "runs": "run_id long, source_id long, at timestamp, status string, http_status int, unchanged_content_hash string, byte_size long, batch long",
    "snapshots": "run_id long, source_id long, observed_at timestamp, content_hash string, batch long",
    "blobs": "content_hash string, content binary, byte_size long, first_run long, batch long",
}


class Recorder:
    """The tables under ``path``; :meth:`record` is what ``foreachBatch`` calls."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def last(self) -> int:
        """Number of the newest batch in the log, -1 without any. Batches come in order, so the log's newest entry tells which are whole."""
        log = self._path(f"{self.path}/_log")
        return max((int(f.getPath().getName()) for f in self._fs.listStatus(log)), default=_NEVER) if self._fs.exists(log) else _NEVER

    def table(self, name: str) -> DataFrame:
        """Rows of all batches in the log."""
        last = self.last()
        if last == _NEVER:
            return self.spark.createDataFrame([], SCHEMAS[name])
        return self.spark.read.schema(SCHEMAS[name]).option("basePath", f"{self.path}/{name}").parquet(f"{self.path}/{name}").filter(F.col("batch") <= last)

    def record(self, fetches: DataFrame, batch: int) -> bool:
        """Write a batch of ``fetches`` (run_id, source_id, at, status, http_status, content); False if the log has it already.

        Bytes count for status OK alone, and no bytes are no content. A run of status UNCHANGED names the content that its source's newest snapshot before it has, in
        earlier batches or this one. A run that is given twice in a batch is recorded once; rows without a run or source are left out.
        """
        if batch <= self.last():
            return False
        f = fetches.filter("run_id is not null and source_id is not null").dropDuplicates(["run_id"])
        content = F.when((F.col("status") == "OK") & F.col("content").isNotNull(), F.col("content"))
        f = f.withColumn("content", content).withColumn("content_hash", F.sha2("content", 256)).persist()
        try:
            touched = f.filter("status = 'UNCHANGED'").select("source_id").distinct()
            older = self.table("snapshots").join(touched, "source_id", "left_semi").groupBy("source_id").agg(F.max(F.struct("observed_at", "run_id", "content_hash"))["content_hash"].alias("older"))
            before = Window.partitionBy("source_id").orderBy("at", "run_id").rowsBetween(Window.unboundedPreceding, -1)
            runs = f.drop("content").withColumn("named", F.last("content_hash", ignorenulls=True).over(before)).join(older, "source_id", "left")
            size = F.octet_length("content").cast("long").alias("byte_size")
            runs = runs.join(f.filter("content is not null").select("run_id", size), "run_id", "left")
            self._put("runs", batch, runs.select("run_id", "source_id", "at", "status", F.col("http_status").cast("int").alias("http_status"), F.when(F.col("status") == "UNCHANGED", F.coalesce("named", "older")).alias("unchanged_content_hash"), "byte_size"))
            self._put("snapshots", batch, f.filter("content is not null").select("run_id", "source_id", F.col("at").alias("observed_at"), "content_hash"))
            first = f.filter("content is not null").groupBy("content_hash").agg(F.min_by("run_id", F.struct("at", "run_id")).alias("first_run"))
            new = first.join(self.table("blobs").select("content_hash"), "content_hash", "left_anti")
            self._put("blobs", batch, f.select(F.col("run_id").alias("first_run"), "content", size).join(new, "first_run").select("content_hash", "content", "byte_size", "first_run"))
        finally:
            f.unpersist()
        self._fs.mkdirs(self._path(f"{self.path}/_log"))
        self._fs.create(self._path(f"{self.path}/_log/{batch}"), False).close()
        return True

    def _put(self, name: str, batch: int, rows: DataFrame) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/{name}/batch={batch}")
