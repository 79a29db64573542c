"""Fixed schemas of the stages."""

from __future__ import annotations

from pyspark.sql import types as T

RAW_REVIEW = T.StructType(
    [
        T.StructField("review_id", T.StringType(), False),
        T.StructField("user_name", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("score", T.IntegerType()),
        T.StructField("full_date", T.StringType()),
        T.StructField("date", T.StringType()),
        T.StructField("time", T.StringType()),
        T.StructField("app_version", T.StringType()),
        T.StructField("developer_reply", T.StringType()),
        T.StructField("app_label", T.StringType()),
        T.StructField("lang", T.StringType()),
    ]
)

LABELLED_REVIEW = T.StructType(
    RAW_REVIEW.fields
    + [
        T.StructField("cleaned_content", T.StringType()),
        T.StructField("final_clean_content", T.StringType()),
        T.StructField("Final_Aspect", T.StringType()),
        T.StructField("Sentiment_Polarity", T.IntegerType()),
        T.StructField("Composite_Trust", T.IntegerType()),
    ]
)

# One page of a native store's reply.
STORE_PAYLOAD = T.StructType(
    [
        T.StructField(
            "singleReply",
            T.StructType(
                [
                    T.StructField(
                        "reviewReply",
                        T.StructType(
                            [
                                T.StructField(
                                    "reviews",
                                    T.ArrayType(
                                        T.StructType(
                                            [
                                                T.StructField("id", T.StringType()),
                                                T.StructField("user", T.StringType()),
                                                T.StructField("comment", T.StringType()),
                                                T.StructField("rate", T.IntegerType()),
                                                T.StructField("date", T.StringType()),
                                                T.StructField("appVersion", T.StringType()),
                                                T.StructField("reply", T.StringType()),
                                            ]
                                        )
                                    ),
                                )
                            ]
                        ),
                    )
                ]
            ),
        )
    ]
)


def with_corrupt_column(schema: T.StructType) -> T.StructType:
    nullable = [T.StructField(f.name, f.dataType) for f in schema.fields]
    return T.StructType(nullable + [T.StructField("_corrupt_record", T.StringType())])
