"""Taking in results files as they arrive.

Long runs hand in their responses bit by bit. Each new file is read once, joined to
the trials and appended to the assembled table; the batch operators then score that
table. Re-balanced statistics need the smallest group, which can change with any row,
so they are not kept as streaming state.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from evalgrid import schemas
from evalgrid.functions import labels
from evalgrid.operators.assemble import assemble_trials_and_results_df


def read_results_stream(spark: SparkSession, pattern: str) -> DataFrame:
    """Responses with labels from every results file that matches, now or later.

    New files are picked up; lines added to a file already read are not (``growing`` reads those).
    """
    stream = spark.readStream.schema(schemas.RESULTS).option("mode", "FAILFAST").json(pattern)
    return labels.with_labels(stream)


def ingest_new_results(
    spark: SparkSession, trials: DataFrame, pattern: str, table: str, checkpoint: str
) -> StreamingQuery:
    """Append the assembled rows of all new results files to the Parquet ``table``, then stop.

    Call again when more files have arrived. The file sink commits each batch once, also
    when a batch is repeated after a failure.
    """
    assembled = assemble_trials_and_results_df(trials, read_results_stream(spark, pattern))
    return (
        assembled.writeStream.format("parquet")
        .option("path", table)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
