"""Growing coverage: how completely points that keep arriving cover a ground truth.

    python -m jobs.growing_coverage --tables DIR --output DIR --checkpoint DIR [--config FILE]

A reconstruction that is still growing is scored again and again; this job does it without looking at old points
twice. Each run takes the files of the arriving table that no earlier run took, as a file stream with a
checkpoint. For each ground-truth point it finds the nearest arriving point within the largest tolerance, and the
least of all runs' distances is its distance so far. The config names both tables, SQL expressions that
make points of their rows, tolerances and sizes. `growing_coverage.json` compares texts by their measures
(characters a word, words a sentence, length): how well the documents that arrive cover the benchmark's
items. `growing_coverage_scans.json` compares clouds: a reconstruction that grows, and the scans.

<output>/nearest is Parquet, partitioned by batch: a stream's batch that is run again replaces its own partition
only. <output>/coverage is Parquet, partitioned by band: key, x, y, z, d2 (squared distance so far, null where
nothing lies within), band (the first tolerance that holds it, or their number). It is made anew from the
ground truth and all batches, so a rerun without new files gives the same rows. Files that are
changed or deleted after a run are not taken back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloudgauge.config import Settings
from cloudgauge.functions.geometry import band, f32
from cloudgauge.operators.nearest import SLACK, nearest_squared_distance
from cloudgauge.plans import scoring

from .clouds import LOG, arguments, cloud, read_config, settings_of, table_path

KEY = "key"


def nearest_of_batch(ground: DataFrame, arriving: DataFrame, settings: Settings) -> DataFrame:
    """(key, d2): squared distances of ground-truth points to the nearest of some arriving points, where it lies within the largest tolerance."""
    near = nearest_squared_distance(ground.select(KEY, "x", "y", "z"), arriving.select("x", "y", "z"), settings.tolerances[-1] * SLACK)
    return near.where(F.col("d2") < f32(settings.squared[-1])).select(KEY, "d2")


def coverage(ground: DataFrame, nearest: DataFrame, settings: Settings) -> DataFrame:
    """(key, x, y, z, d2, band) of every ground-truth point, from the distances of all batches; the joined side has a row a key."""
    best = nearest.groupBy(KEY).agg(F.min("d2").alias("d2"))
    return ground.select(KEY, "x", "y", "z").join(best, KEY, "left").withColumn("band", band(F.col("d2"), settings.squared))


def take_new(spark: SparkSession, tables: str, output: str, checkpoint: str, config: dict) -> None:
    """Runs the stream over all files that are new, and ends."""
    settings, path = settings_of(config), table_path(tables, config["arriving"])

    def take(rows: DataFrame, batch: int) -> None:
        own = rows.sparkSession
        points = cloud(rows, config["arriving"]).persist()  # the join reads its points several times; texts are measured once
        read = points.count()
        ground = cloud(own.read.parquet(table_path(tables, config["ground_truth"])), config["ground_truth"])
        found = nearest_of_batch(ground, points, settings).withColumn("batch", F.lit(batch).cast("long"))
        found.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{output}/nearest")
        points.unpersist()
        wrote = own.read.schema(found.schema).parquet(f"{output}/nearest").where(F.col("batch") == batch).count()
        LOG.info("growing_coverage: batch %s: took %s points of %s, wrote %s distances", batch, read, path, wrote)

    files = f"{tables.rstrip('/')}/{{{config['arriving']['table']}.parquet}}"  # a pattern, as a file stream takes a single file only by one
    stream = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", config["files_a_batch"]).parquet(files)
    query = stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def run(spark: SparkSession, tables: str, output: str, checkpoint: str, config: dict) -> DataFrame:
    """Takes what is new, writes the coverage so far to `output` and returns it as read back."""
    settings = settings_of(config)
    ground = cloud(spark.read.parquet(table_path(tables, config["ground_truth"])), config["ground_truth"])
    kept = f"{KEY} {ground.schema[KEY].dataType.simpleString()}, d2 float, batch long"
    spark.createDataFrame([], kept).write.mode("append").partitionBy("batch").parquet(f"{output}/nearest")  # so that it is there
    take_new(spark, tables, output, checkpoint, config)
    found = coverage(ground, spark.read.schema(kept).parquet(f"{output}/nearest"), settings)
    found.write.mode("overwrite").partitionBy("band").parquet(f"{output}/coverage")
    result = spark.read.schema(found.schema).parquet(f"{output}/coverage")
    scores = scoring.completeness(result, settings).orderBy("tolerance_index").collect()  # a row a tolerance
    LOG.info("growing_coverage: wrote %s rows to %s/coverage; completeness %s", result.count(), output, ", ".join(f"{r['tolerance']:g}: {r['completeness']:.4g}" for r in scores))
    return result


def main() -> None:
    args = arguments("Coverage of a ground truth by points that keep arriving.", __file__, ("--checkpoint", "folder of the stream's checkpoint")).parse_args()
    spark = SparkSession.builder.appName("growing_coverage").getOrCreate()
    try:
        run(spark, args.tables, args.output, args.checkpoint, read_config(spark, args.config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
