"""Label rows arriving as files: parse + bin them as they come.

The reference has no streaming; the point here is that the label operators
are plain DataFrame functions, so the same code runs on ``readStream``.
``availableNow`` processes what is there in bounded micro-batches and stops;
the checkpoint makes a restarted job resume without double counting.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from panelscope.sources.labels import labels_from_table


def stream_labels(spark: SparkSession, folder: str, file_glob: str = "*.parquet", max_files_per_trigger: int = 64) -> DataFrame:
    """Streaming label frame from the Parquet files (doc_id, quality, toxic)
    matching ``file_glob`` in ``folder``. Where it names folders whose files have
    other names, as of a table that Spark wrote, their files are read."""
    named = f"{folder.rstrip('/')}/{file_glob}"
    if _folders(spark, named) and not _matches(spark, f"{named}/{file_glob}"):
        folder, options = named, {}
    else:
        options = {"pathGlobFilter": file_glob}
    schema = spark.read.options(**options).parquet(folder).schema
    src = (
        spark.readStream.schema(schema)
        .options(**options)
        .option("maxFilesPerTrigger", max_files_per_trigger)
        .parquet(folder)
    )
    return labels_from_table(src)


def _matches(spark: SparkSession, pattern: str) -> list:
    """The status of each file and folder that the glob names."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    return list(path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or ())


def _folders(spark: SparkSession, pattern: str) -> list:
    return [s for s in _matches(spark, pattern) if s.isDirectory()]


def run_available(stream_df: DataFrame, sink_dir: str, checkpoint_dir: str) -> DataFrame:
    """Process everything available into a Parquet sink, then read the sink."""
    q = (
        stream_df.writeStream.format("parquet")
        .option("checkpointLocation", checkpoint_dir)
        .outputMode("append")
        .trigger(availableNow=True)
        .start(sink_dir)
    )
    q.awaitTermination()
    return stream_df.sparkSession.read.parquet(sink_dir)
