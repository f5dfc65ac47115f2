"""Explicit schemas; nothing in the library infers a schema from data."""

from __future__ import annotations

from pyspark.sql import types as T

ATTRIBUTE = T.StructType(
    [
        T.StructField("attribute_key", T.StringType()),
        T.StructField("value", T.StringType()),
        T.StructField("key_priority", T.IntegerType()),
        T.StructField("attribute_priority", T.IntegerType()),
    ]
)

NESTED = T.StructType([T.StructField("attributes", T.ArrayType(ATTRIBUTE))])

RESULT_CSV = T.StructType(
    [
        T.StructField("query", T.StringType()),
        T.StructField("success", T.StringType()),
        T.StructField("unique_value_count", T.IntegerType()),
        T.StructField("total_key_count", T.IntegerType()),
        T.StructField("raw_output", T.StringType()),
        T.StructField("attributes_json", T.StringType()),
    ]
)

MAP_RESULT = T.StructType(
    [
        T.StructField("query", T.StringType()),
        T.StructField("success", T.BooleanType()),
        T.StructField("attributes", T.MapType(T.StringType(), T.StringType())),
        T.StructField("response_time", T.DoubleType()),
    ]
)

VOCAB = T.StructType(
    [T.StructField("key", T.StringType()), T.StructField("value", T.StringType())]
)

PAIR = T.StructType(
    [T.StructField("instruction", T.StringType()), T.StructField("output", T.StringType())]
)

API_ATTRIBUTE = T.StructType(
    [
        T.StructField("attr_value", T.StringType()),
        T.StructField("attr_name", T.StringType()),
        T.StructField("attr_type", T.StringType()),
    ]
)

API_MAP = T.MapType(
    T.StringType(),
    T.StructType(
        API_ATTRIBUTE.fields + [T.StructField("others", T.ArrayType(API_ATTRIBUTE))]
    ),
)

LABEL_LIST = T.ArrayType(
    T.StructType(
        [
            T.StructField("name", T.StringType()),
            T.StructField("id", T.StringType()),
            T.StructField("accuracy", T.StringType()),
        ]
    )
)

PREDICTION = T.StructType(
    [
        T.StructField("qid", T.LongType()),
        T.StructField("query", T.StringType()),
        T.StructField("success", T.BooleanType()),
        T.StructField("raw_output", T.StringType()),
        T.StructField("error", T.StringType()),
    ]
)
