"""The running-best state of evaluations as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from narracode.operators.thresholds import final_state
from narracode.session import scratch_path


def running_best_stream(evals: DataFrame, out: str, checkpoint: str, by: tuple[str, ...] = ("label",)) -> None:
    """Keep each label's last and best evaluation up to date over a stream of evaluations.

    The state of a label is two maxima, so this is a plain streaming aggregation: partial
    maxima are formed before the shuffle, and a label with most of the events costs one row
    per task. Each trigger replaces the table ``out``; the run ends when the available input
    is used up.
    """

    def replace(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(out)

    query = (
        final_state(evals, by)
        .writeStream.outputMode("complete")
        .option("checkpointLocation", checkpoint)
        .foreachBatch(replace)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def run_to_table(spark: SparkSession, evals: DataFrame, by: tuple[str, ...] = ("label",)) -> DataFrame:
    """Run the stream over what is available and read its result."""
    out = scratch_path(spark, "running_best")
    running_best_stream(evals, out, scratch_path(spark, "running_best_state"), by)
    return spark.read.parquet(out)
