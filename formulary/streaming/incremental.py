"""The text path as a stream: pages come in as files, records go out. Extraction and classification are
stateless, so the batch functions serve as they are; the checkpoint is the state of what was read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.corpus import admit
from ..operators.extract import text_layer_latex
from ..operators.records import text_layer_records

PAGES = "doc_id string, pdf_file string, page int, text string"


def record_stream(spark: SparkSession, path: str, schema: str = PAGES) -> DataFrame:
    return text_layer_records(text_layer_latex(spark.readStream.schema(schema).parquet(path)))


def start_records(spark: SparkSession, path: str, out: str, checkpoint: str) -> StreamingQuery:
    return record_stream(spark, path).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def start_registry(files: DataFrame, registry_path: str, checkpoint: str) -> StreamingQuery:
    """Admits each batch of files against the registry as it then is; a batch that is run again
    overwrites its own part."""

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        known = spark.read.schema("name string, hash string, size long, batch long").parquet(registry_path).where(F.col("batch") < number) if number else spark.createDataFrame([], "name string, hash string")
        new = admit(df, known).where("status = 'accepted'")
        new.select("name", F.col("md5").alias("hash"), "size", F.lit(number).cast("long").alias("batch")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(registry_path)

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
