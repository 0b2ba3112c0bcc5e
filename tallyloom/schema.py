"""Declared schemas of the corpus entities."""

from pyspark.sql import types as T

SCORE_FIELDS = [
    T.StructField("qwen25vl3b", T.IntegerType()),
    T.StructField("llama32vl11b", T.IntegerType()),
    T.StructField("aya_vision_8b", T.IntegerType()),
]

CORPUS = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("diagram_type", T.StringType()),
        T.StructField("source_requirement", T.StringType()),
        T.StructField("technical_spec", T.StringType()),
        T.StructField("uml_code", T.StringType()),
        T.StructField("reasoning_private", T.StringType()),
        *SCORE_FIELDS,
        T.StructField("composite_score", T.DoubleType()),
        T.StructField("majority_accepted", T.BooleanType()),
        T.StructField("affirmative_votes", T.IntegerType()),
        T.StructField("dataset_accepted", T.BooleanType()),
        T.StructField("source_dataset", T.StringType()),
        T.StructField("input_mode", T.StringType()),
        T.StructField("source_language", T.StringType()),
    ]
)

MERGE = T.StructType(
    [
        T.StructField("diagram_type", T.StringType()),
        T.StructField("input_mode", T.StringType()),
        T.StructField("source_language", T.StringType()),
        T.StructField("source_requirement", T.StringType()),
        T.StructField("technical_spec", T.StringType()),
        T.StructField("uml_code", T.StringType()),
        T.StructField("dataset_accepted", T.BooleanType()),
        T.StructField("majority_accepted", T.BooleanType()),
        T.StructField("source_dataset", T.StringType()),
        T.StructField("merge_source", T.StringType()),
    ]
)

SPEC = T.StructType(
    [
        T.StructField("diagram_type", T.StringType()),
        T.StructField("summary", T.StringType()),
        T.StructField(
            "entities",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("name", T.StringType()),
                        T.StructField("kind", T.StringType()),
                        T.StructField("attributes", T.ArrayType(T.StringType())),
                        T.StructField("methods", T.ArrayType(T.StringType())),
                    ]
                )
            ),
        ),
        T.StructField(
            "relationships",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("source", T.StringType()),
                        T.StructField("target", T.StringType()),
                        T.StructField("type", T.StringType()),
                        T.StructField("label", T.StringType()),
                    ]
                )
            ),
        ),
        T.StructField(
            "packages",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("name", T.StringType()),
                        T.StructField("contains", T.ArrayType(T.StringType())),
                    ]
                )
            ),
        ),
        T.StructField(
            "components",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("name", T.StringType()),
                        T.StructField("interfaces", T.ArrayType(T.StringType())),
                    ]
                )
            ),
        ),
        T.StructField(
            "objects",
            T.ArrayType(
                T.StructType(
                    [T.StructField("name", T.StringType()), T.StructField("type", T.StringType())]
                )
            ),
        ),
        T.StructField("process_steps", T.ArrayType(T.StringType())),
    ]
)

CHAT_MESSAGES = T.ArrayType(
    T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType())])
)

CATALOG = T.StructType(
    [
        T.StructField(
            "jobs",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("id", T.LongType()),
                        T.StructField("mode", T.StringType()),
                        T.StructField("status", T.StringType()),
                        T.StructField("total", T.IntegerType()),
                        T.StructField("completed", T.IntegerType()),
                        T.StructField("created_at", T.StringType()),
                        T.StructField("updated_at", T.StringType()),
                    ]
                )
            ),
        ),
        T.StructField(
            "artifacts",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("id", T.LongType()),
                        T.StructField("job_id", T.LongType()),
                        T.StructField("diagram_type", T.StringType()),
                        T.StructField("input_mode", T.StringType()),
                        T.StructField("source_language", T.StringType()),
                        T.StructField("source_requirement", T.StringType()),
                        T.StructField("technical_spec", T.StringType()),
                        T.StructField("plantuml_code", T.StringType()),
                        T.StructField("render_status", T.StringType()),
                        T.StructField("image_format", T.StringType()),
                        T.StructField("acceptance_tau", T.DoubleType()),
                        T.StructField("composite_score", T.DoubleType()),
                        T.StructField("dataset_accepted", T.BooleanType()),
                        T.StructField("majority_accepted", T.BooleanType()),
                        T.StructField("affirmative_votes", T.IntegerType()),
                        T.StructField("created_at", T.StringType()),
                        T.StructField(
                            "scores",
                            T.ArrayType(
                                T.StructType(
                                    [
                                        T.StructField("model_key", T.StringType()),
                                        T.StructField("model_name", T.StringType()),
                                        T.StructField("score", T.IntegerType()),
                                        T.StructField("weight", T.DoubleType()),
                                        T.StructField("available", T.BooleanType()),
                                    ]
                                )
                            ),
                        ),
                    ]
                )
            ),
        ),
    ]
)

WILD_META = T.MapType(
    T.StringType(),
    T.StructType(
        [
            T.StructField("primary_type", T.StringType()),
            T.StructField("extraction_error", T.StringType()),
            T.StructField("blob_id", T.StringType()),
            T.StructField("repository", T.StringType()),
            T.StructField("original_path", T.StringType()),
            T.StructField("reasoning", T.StringType()),
            T.StructField("elements", T.MapType(T.StringType(), T.IntegerType())),
            T.StructField("connections", T.MapType(T.StringType(), T.IntegerType())),
            T.StructField("elements_total", T.IntegerType()),
            T.StructField("connections_total", T.IntegerType()),
        ]
    ),
)
