"""Manifest and media files as rows, and the sink of finished rows."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelmill.functions.strict import validating

PLAYLIST_BYTES, SEGMENT_BYTES = 1 << 20, 32 << 20


def _read(spark: SparkSession, path: str, cap: int, code: str, pattern: str | None) -> DataFrame:
    reader = spark.read.format("binaryFile")
    files = (reader.option("pathGlobFilter", pattern) if pattern else reader).load(path).withColumnsRenamed({"path": "uri", "modificationTime": "fetched_at", "length": "n_bytes"})
    small = files.filter(F.col("n_bytes") <= cap).withColumn("violation", F.lit(None).cast("string"))
    # the content of larger files is never read
    large = files.filter(F.col("n_bytes") > cap).select("uri", "fetched_at", "n_bytes", F.lit(None).cast("binary").alias("content"), F.lit(code).alias("violation"))
    return small.unionByName(large)


@validating
def read_manifests(spark: SparkSession, path: str, max_bytes: int = PLAYLIST_BYTES, pattern: str | None = None) -> DataFrame:
    """uri, fetched_at, n_bytes, text, violation: playlists beyond max_bytes have no text but playlist_too_large."""
    return _read(spark, path, max_bytes, "playlist_too_large", pattern).withColumn("text", F.decode("content", "UTF-8")).drop("content")


@validating
def read_segments(spark: SparkSession, path: str, max_bytes: int = SEGMENT_BYTES, pattern: str | None = None) -> DataFrame:
    """uri, fetched_at, n_bytes, content, violation: files beyond max_bytes are not read (segment_too_large)."""
    return _read(spark, path, max_bytes, "segment_too_large", pattern)


def write_timeline(df: DataFrame, path: str, partition_by: tuple[str, ...] = (), mode: str = "append") -> None:
    """Appends finished rows to a plain folder; see SealedTimeline for one that knows when it is finished."""
    writer = df.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


class SealedTimeline:
    """A folder of rows by key that each key's terminal row seals.

    Every commit has a number and writes its rows, markers and refusals into folders of that number, so that a commit that
    comes again (a replayed micro-batch) puts the same in place of what it wrote. A marker tells that a key is sealed,
    failed or cancelled, and by which commit; a row of that key in a later commit is refused and kept apart with the
    violation write_after_seal. Inside a commit, rows beside the terminal row of their key are kept.
    """

    TERMINAL = ("sealed", "failed", "cancelled")

    def __init__(self, path: str, key: str = "playlist_uri", kind: str = "kind") -> None:
        self.path, self.key, self.kind = path.rstrip("/"), key, kind

    def commit(self, df: DataFrame, batch_id: int) -> None:
        """Writes one commit; usable as the function of foreachBatch. df is evaluated once."""
        spark = df.sparkSession
        offered = f"{self.path}/offered/batch={batch_id}"
        df.write.mode("overwrite").parquet(offered)
        rows = spark.read.schema(df.schema).parquet(offered)
        before = self.markers(spark, df.schema[self.key].dataType.simpleString()).filter(F.col("batch") < batch_id).select(self.key).distinct()
        kept = rows.join(before, self.key, "left_anti").select(*df.columns)
        kept.write.mode("overwrite").parquet(f"{self.path}/rows/batch={batch_id}")
        rows.join(before, self.key, "left_semi").withColumn("violation_of_seal", F.lit("write_after_seal")).write.mode("overwrite").parquet(f"{self.path}/refused/batch={batch_id}")
        sealed = kept.filter(F.col(self.kind).isin(*self.TERMINAL)).groupBy(self.key).agg(F.min(self.kind).alias("seal"))
        # the marker comes last: a commit without one has not happened for readers
        sealed.write.mode("overwrite").parquet(f"{self.path}/markers/batch={batch_id}")

    def write_stream(self, df: DataFrame, checkpoint: str):
        """The streaming form: one commit a micro-batch, over what there is."""
        return df.writeStream.outputMode("append").foreachBatch(self.commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def _read(self, spark: SparkSession, part: str, schema: str) -> DataFrame:
        place = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{part}")
        there = place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)
        return spark.read.schema(f"{schema}, batch long").parquet(f"{self.path}/{part}") if there else spark.createDataFrame([], f"{schema}, batch long")

    def markers(self, spark: SparkSession, key_type: str = "long") -> DataFrame:
        """key, seal (sealed, failed or cancelled), batch of each key that is finished."""
        return self._read(spark, "markers", f"`{self.key}` {key_type}, seal string")

    def rows(self, spark: SparkSession, schema: str) -> DataFrame:
        """The rows of whole commits (those with a marker file, if only an empty one) with their commit and the seal of
        their key, null while it is open. schema: that of the rows."""
        kept = self._read(spark, "rows", schema)
        found = self.markers(spark, kept.schema[self.key].dataType.simpleString())
        return kept.join(found.select(self.key, "seal"), self.key, "left")

    def refused(self, spark: SparkSession, schema: str) -> DataFrame:
        return self._read(spark, "refused", f"{schema}, violation_of_seal string")


def write_timeline_stream(df: DataFrame, path: str, checkpoint: str):
    """The streaming form: appends to path, one trigger over what there is."""
    return df.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or (sessions of one process without one) a new temporary
    folder. Sessions on a cluster must name it."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        place = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", place)
    return place.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/reelmill-{name}-{uuid.uuid4().hex}"
