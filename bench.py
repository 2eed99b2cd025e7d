"""Times the headline queries and prints one JSON line.

``BENCH_SF_DIR`` names the folder of the tables, ``BENCH_CPUS`` the number of cores.
Each query is planned, run and its rows are consumed; the time is the best of
``BENCH_RUNS`` runs after one warm-up, so that it is not the time of the first compile.
"""

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession

import evalgrid as eg
from evalgrid import constants as K
from evalgrid.plans import catalog
from evalgrid.plans import derived as D
from evalgrid.session import remove_scratch, scratch_path

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "1"))

# From derived trials and responses, joined and scored in the query.
HEADLINE = (
    "overall_accuracy", "accuracy_by_problem", "accuracy_by_domain", "acc_table_rows",
    "acc_table_uniform", "weighted_mean", "complete_tuples", "report_in_one_pass",
    "all_extra_fields", "pending_trials", "coverage", "invalid_responses", "column_profile",
    "compare_tables", "shuffle_groups", "random_baseline", "batch_responder",
)


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("evalgrid-bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "16g")
        # broadcast by measured sizes only: file sizes say little about packed or exploded rows
        .config("spark.sql.autoBroadcastJoinThreshold", "-1")
        .config("spark.sql.adaptive.autoBroadcastJoinThreshold", "10MB")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="evalgrid-bench-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def stored_testset(spark: SparkSession) -> str:
    """Trials and the responses of three models, in the layout of a test set folder."""
    folder = scratch_path(spark, "testset")
    trials = eg.obfuscate_goldresp(D.trials(spark, SF_DIR))
    trials.repartition(int(CPUS)).write.option("compression", "bzip2").json(f"{folder}/{K.TESTSET_FILE}")
    results = D.results(spark, SF_DIR).repartition(int(CPUS))
    for model in D.MODELS:
        eg.write_results(results.where(results.modelname == model), f"{folder}/results", D.PROMPTING, model)
    return folder


def consume(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(run) -> float:
    best = float("inf")
    run()
    for _ in range(RUNS):
        start = time.perf_counter()
        run()
        best = min(best, time.perf_counter() - start)
    return round(best, 3)


def main() -> None:
    spark = session()
    folder = stored_testset(spark)

    def load_testset():
        consume(eg.load_testset(spark, folder, add_extra_fields=True))

    def read_results():
        consume(eg.load_results_as_dataframe(spark, f"{folder}/results/*{K.RESULTS_ENDING}"))

    def analyse():
        for report_table in eg.analyse_results_in_testset_dir(spark, folder):
            report_table.collect()

    runs = {
        "load_testset_from_files": load_testset,
        "read_results_from_files": read_results,
        "analyse_results_from_files": analyse,
    }
    for name in HEADLINE:
        runs[name] = lambda name=name: consume(catalog.QUERIES[name](spark, SF_DIR))
    seconds = {name: timed(run) for name, run in runs.items()}
    print(json.dumps({
        "metric": "total_seconds",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": SF_DIR.rstrip("/").rpartition("sf")[2],
    }))
    remove_scratch(spark)
    spark.stop()


if __name__ == "__main__":
    main()
