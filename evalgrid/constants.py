"""Fixed values of the benchmark format.

Everything in this module is data that responses and trial files already on
disk rely on; changing a value changes results.
"""

# How the gold answer is hidden in stored trial files.
GOLD_TO_HIDDEN = {
    "TRUE": "Emmanuel",
    "FALSE": "Megi",
    "POSSIBLE": "Dieuwke",
    "IMPOSSIBLE": "Pascal",
    "1": "Mark",
    "2": "Youssef",
    "3": "Yoda",
}

# Answers that count as the same answer when judging accuracy.
FOLDED_ANSWER = {
    "TRUE": "TRUE",
    "FALSE": "FALSE",
    "POSSIBLE": "POSSIBLE",
    "IMPOSSIBLE": "IMPOSSIBLE",
    "1": "KNOW",
    "2": "KNOW",
    "3": "UNKNOWN",
}

# The direction in which an answer leans.
ANSWER_BIAS = {
    "TRUE": 1.0,
    "FALSE": -1.0,
    "POSSIBLE": 1.0,
    "IMPOSSIBLE": -1.0,
    "1": 1.0,
    "2": 1.0,
    "3": -1.0,
}

# The weight of a question inside its tuple, by gold answer.
GOLD_WEIGHT = {
    "TRUE": 0.5,
    "FALSE": 0.5,
    "POSSIBLE": 0.5,
    "IMPOSSIBLE": 0.5,
    "1": 0.25,
    "2": 0.25,
    "3": 0.5,
}

# Grouping used when the caller names none.
DEFAULT_BY = ("modelname", "prompting", "problemname", "problemsize", "complexity", "bintern")

# Fields averaged with equal weight, in the order they collapse.
REBALANCED_FIELDS = ("problemsize", "problemname")

# Two-sided 95 % quantile of the normal distribution.
CONF95 = 1.96

# Query arity and complexity codes.
ARITY_NAME = {2: "bin", 3: "tern"}
COMPLEXITY_LEVEL = {"Complexity_0": 0, "Complexity_1": 1, "Complexity_2": 2}

# Problems that serve as controls, under their older names.
CONTROL_PROBLEMS = (
    "trivial-complete-PI",
    "incomplete-easy",
    "trivial-ulist-complete-TF",
    "trivial-binrel-complete-TF",
)

# What an older problem name tests, and how hard it is.
PROBLEM_CATEGORY = {
    "complete-TF": "inference",
    "trivial-ulist-complete-TF": "inference",
    "trivial-binrel-complete-TF": "inference",
    "complete-PI": "consistency",
    "trivial-complete-PI": "consistency",
    "incomplete-easy": "completeness",
    "incomplete-hard": "completeness",
}
PROBLEM_DIFFICULTY = {
    "complete-TF": "normal",
    "trivial-ulist-complete-TF": "trivial",
    "trivial-binrel-complete-TF": "trivial",
    "complete-PI": "normal",
    "trivial-complete-PI": "trivial",
    "incomplete-easy": "trivial",
    "incomplete-hard": "normal",
}

# Skins by (domain, relation to the training data).
SKINS = {
    ("scalar", "ood"): ("rich/poor", "stronger/weaker"),
    ("scalar", "ind"): ("old/young", "tall/short", "faster/slower", "happier/sadder"),
    ("scalar", "memorization"): (
        "old/young/cats", "tall/short/buildings", "fast/slow/horses", "happy/sad/dog",
        "Heavy/Light/furniture", "High/Low/mountains", "Big/Small/boxes",
        "warm/cool/rivers", "loud/quiet/neighbors",
    ),
    ("spatial", "ood"): (
        "obj_LeftRight", "people_LeftRight", "obj_FrontBack", "people_FrontBack",
        "obj_AboveBelow", "people_AboveBelow",
    ),
    ("temporal", "ood"): ("courses", "shopping"),
    ("temporal", "ind"): ("trips", "activities", "conversation", "race"),
    ("temporal", "memorization"): (
        "trips_countries", "activities_theater", "conversation_colleagues", "race_car",
        "grocery_store_list", "birthorder", "plantation", "renovation", "detective",
    ),
}
SKIN_DOMAIN = {skin: domain for (domain, _), skins in SKINS.items() for skin in skins}
SKIN_TRAINING = {skin: seen for (_, seen), skins in SKINS.items() for skin in skins}

# Preferred display order of labels.
DISPLAY_ORDER = {
    "problemname": (
        "trivial-ulist-complete-TF", "Infer.trivial", "complete-TF", "Infer.normal",
        "trivial-complete-PI", "Consist.trivial", "complete-PI", "Consist.normal",
        "incomplete-easy", "Compl.trivial", "incomplete-hard", "Compl.normal",
        "complete-unary-TF", "Infer.extrema", "complete-TF-parallel", "Infer.parallel",
    ),
    "modelname": (
        "gpt3.5", "GPT3.5", "gpt-4", "GPT4", "llama", "llama2_70b", "Llama2-chat",
        "llama2_70b_finetuned_0", "llama2_70b_finetuned_100k", "llama2_70b_finetuned_1M",
        "Llama2-FT+0", "Llama2-FT+100k", "Llama2-FT+1M", "llama_finetuned_0",
        "llama_finetuned_2k", "llama_finetuned_10k", "llama_finetuned_100k",
        "llama_finetuned_1M",
    ),
    "prompting": (
        "basic", "direct", "clarified", "COT", "incontext_IID", "incontext_DIFFERENTCAT",
    ),
}

# File naming.
JSON_ENDINGS = (".json", ".json.zip", ".json.gz", ".json.bz2")
JSONL_ENDINGS = (".jsonl", ".jsonl.zip", ".jsonl.gz", ".jsonl.bz2")
TRIALS_FILES = ("trials.json", "trials.jsonl", "trials.json.bz2", "trials.jsonl.bz2")
TESTSET_FILE = "trials.jsonl.bz2"
RESULTS_ENDING = "___results.jsonl"
LEGACY_ENDING = "__allresults"

# Seeds and rates of the shuffles and of the random responder.
SHUFFLE_SEED = 432832
RESPONDER_SEED = 713875139
NO_RESPONSE_PER_MILLE = 5
REPROMPT = "Only respond with one of these options:"
