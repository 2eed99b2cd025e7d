"""Scoring and analysing question-answering benchmarks with Spark DataFrames."""

from evalgrid.functions.labels import infer_modelname_and_prompting
from evalgrid.functions.numbers import format_cell
from evalgrid.operators.assemble import (
    answered_by_position,
    assemble_trials_and_results_df,
    coverage,
    invalid_responses,
    join_by_position,
    mismatches_by_position,
    pending_by_model,
    pending_trials,
    reprompts,
    require_same_text,
    require_valid_responses,
    stack,
    text_mismatches,
)
from evalgrid.operators.enrich import (
    add_bintern_and_globcomplex_fields,
    add_fields_for_finegrained_analysis,
    add_missing_columns,
    add_problem_categorization_fields,
    add_skin_categorization_fields,
    deobfuscate_goldresp,
    obfuscate_goldresp,
)
from evalgrid.operators.grouping import accuracy_by_group, bias_by_group, group_stats, regroup
from evalgrid.operators.pivot import pivot_pretty, sort_for_display
from evalgrid.operators.profiling import compare_dataframes, datatype_counts, field_sets
from evalgrid.operators.respond import random_responses, respond
from evalgrid.operators.scoring import (
    compute_acc_table,
    filter_complete_tuples,
    first_row_per_group,
    transform_into_weighted_mean,
    tuple_completeness,
    weighted_means_by_group,
    with_group_minimum,
    with_group_size,
)
from evalgrid.operators.shuffle import first_rows, shuffle_df
from evalgrid.plans.analyse import Report, analyse_results_df, analyse_results_in_testset_dir
from evalgrid.plans.answer import answer_testset
from evalgrid.sources.records import (
    corrupt_documents,
    corrupt_records,
    damage_by_place,
    find_files_ending_in,
    read_json,
)
from evalgrid.sources.results import (
    load_all_results,
    load_and_assemble_trials_and_results,
    load_as_dataframe,
    load_experiment_results_as_dataframe,
    load_results_as_dataframe,
    write_results,
)
from evalgrid.sources.trials import (
    flatten_dialogs,
    get_trials_file,
    infer_expname_and_expdir,
    is_experiment_directory,
    load_all_trials,
    load_experiment_specs,
    load_testset,
    load_trainset,
    load_trials_as_dataframe,
)
from evalgrid.streaming.growing import ingest_growing_results, read_growing_results
from evalgrid.streaming.incremental import ingest_new_results

__all__ = [name for name in dir() if not name.startswith("_")]
