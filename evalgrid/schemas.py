"""Explicit schemas of the files the engine reads."""

from pyspark.sql import types as T

TRIALS = T.StructType([
    T.StructField("Key", T.LongType()),
    T.StructField("text", T.StringType()),
    T.StructField("expectedresp", T.ArrayType(T.StringType())),
    T.StructField("goldresp_obfusc", T.StringType()),
    T.StructField("goldresp", T.StringType()),
    T.StructField("problemname", T.StringType()),
    T.StructField("problemsize", T.IntegerType()),
    T.StructField("skin", T.StringType()),
    T.StructField("tuple_ID", T.LongType()),
    T.StructField("complexity", T.StringType()),
    T.StructField("query_len", T.IntegerType()),
])

# A response is always text: a file holding only "1" and "3" must not turn numeric.
RESULTS = T.StructType([
    T.StructField("Key", T.LongType()),
    T.StructField("resp", T.StringType()),
])

DIALOGS = T.StructType([
    T.StructField("dialog_history", T.StructType([
        T.StructField("messages", T.ArrayType(T.StructType([
            T.StructField("role", T.StringType()),
            T.StructField("content", T.StringType()),
        ]))),
    ])),
    T.StructField("target_message", T.StringType()),
])

# Responses stored by position; row_i is the row of the trials file they answer.
POSITIONAL_RESULTS = T.StructType([
    T.StructField("row_i", T.LongType()),
    T.StructField("text2", T.StringType()),
    T.StructField("fullresp1", T.StringType()),
    T.StructField("fullresp2", T.StringType()),
    T.StructField("resp", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
])
