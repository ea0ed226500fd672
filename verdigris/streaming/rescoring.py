"""Rescoring as a stream: every micro-batch of changed observations is applied to the versioned cache of scores once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from verdigris.operators.cache import ScoreCache

CHANGES = "company_code string, report_year int, indicator_code string, company_name string, value double, status string, _ord long"


def read_changes(spark: SparkSession, folder: str, per_trigger: int = 1) -> DataFrame:
    """Changed observations as files of a folder, in the order of their arrival."""
    return spark.readStream.schema(CHANGES).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def rescore(changes: DataFrame, cache: ScoreCache, checkpoint: str, source: str = "changes"):
    """A running query that applies each batch of changes to the cache; the caller waits for it or stops it.

    Batches have the numbers of the checkpoint. A batch that is delivered again after it was committed changes nothing, and
    what a failed one left is overwritten. Each batch opens the last committed version, so a restarted query goes on
    from there. `source` names the checkpoint's stream: a new checkpoint, which counts from 0, needs a new name.
    """

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        current = ScoreCache.open(spark, cache.root, cache.indicators, cache.strategy, cache.minimum)
        current.apply(batch, source, number)

    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def rescored(spark: SparkSession, folder: str, cache: ScoreCache, checkpoint: str, source: str = "changes") -> ScoreCache:
    """The cache after all changes that lie in a folder."""
    rescore(read_changes(spark, folder), cache, checkpoint, source).awaitTermination()
    return ScoreCache.open(spark, cache.root, cache.indicators, cache.strategy, cache.minimum)
