"""Explicit schemas and the fixed values of the panel data model."""

from __future__ import annotations

from pyspark.sql import types as T

# The five-point belief scale, the change scale and the slots.
LIKERT = [-2, -1, 0, 1, 2]
DELTAS = list(range(-4, 5))
SLOTS = [1, 2, 3]

# Message order index 0..5 to the source message shown in each slot.
MESSAGE_ORDERS = [(1, 2, 3), (1, 3, 2), (2, 1, 3), (2, 3, 1), (3, 1, 2), (3, 2, 1)]

# Demographic fields of a conformed subject, and the five traits.
DEMOGRAPHIC_FIELDS = [
    "age", "gender", "ethnicity", "country_of_origin", "country_of_residency",
    "student_status", "employment_status", "occupation_field", "highest_qualification",
]
TRAITS = ["extraversion", "agreeableness", "conscientiousness", "neuroticism", "openness"]

# Trait to (sign, item), (sign, item); score is half the signed sum plus 3.
TRAIT_KEYS = {
    "extraversion": ((-1, 1), (1, 6)),
    "agreeableness": ((1, 2), (-1, 7)),
    "conscientiousness": ((-1, 3), (1, 8)),
    "neuroticism": ((-1, 4), (1, 9)),
    "openness": ((-1, 5), (1, 10)),
}


def _fields(kind: T.DataType, *names: str) -> list[T.StructField]:
    return [T.StructField(n, kind, True) for n in names]


MESSAGE = T.StructType(
    _fields(T.LongType(), "shown_comment_id", "source_message_id")
    + _fields(T.StringType(), "package", "text")
)

BIG5 = T.StructType(_fields(T.DoubleType(), *TRAITS))

DEMOGRAPHIC = T.StructType(
    _fields(T.LongType(), "age")
    + _fields(T.StringType(), *DEMOGRAPHIC_FIELDS[1:])
    + [T.StructField("big5", BIG5), T.StructField("big5_items", T.ArrayType(T.LongType()))]
)

PERSONA_DOCUMENT = T.StructType(
    _fields(T.StringType(), "participant_id")
    + _fields(T.IntegerType(), "age_raw", "age")
    + [
        field
        for name in ("gender", "ethnicity", "student_status", "employment_status",
                     "highest_qualification")
        for field in (T.StructField(f"{name}_raw", T.IntegerType()),
                      T.StructField(name, T.StringType()))
    ]
    + _fields(T.StringType(), "country_of_residency_code", "country_of_residency",
              "country_of_origin_code", "country_of_origin", "occupation_field")
    + [T.StructField("personality", T.MapType(T.StringType(), T.IntegerType()))]
)

STUDY_TOPIC = T.StructType(
    _fields(T.StringType(), "topic", "statement_formulation")
    + _fields(T.IntegerType(), "init_belief", "familiarity")
    + _fields(T.StringType(), "package")
    + _fields(T.IntegerType(), "message_order_index")
    + [T.StructField("message_order_perm", T.ArrayType(T.IntegerType())),
       T.StructField("shown_messages", T.ArrayType(MESSAGE))]
)

STUDY_DOCUMENT = T.StructType(
    _fields(T.StringType(), "participant_id")
    + [T.StructField("topic_order", T.ArrayType(T.StringType())),
       T.StructField("topics", T.ArrayType(STUDY_TOPIC))]
)

RUN_CONFIG = T.StructType(
    _fields(T.StringType(), "model")
    + [T.StructField("paths", T.StructType(_fields(T.StringType(), "output")))]
    + _fields(T.IntegerType(), "max_tries")
)

# One response row of a source, as files carry it (nested parts arrive as JSON text).
RESPONSE_ROW = T.StructType(
    _fields(T.StringType(), "persona_id", "topic", "model", "statement_formulation")
    + _fields(T.IntegerType(), "init_belief", "familiarity")
    + _fields(T.StringType(), "package")
    + _fields(T.IntegerType(), "message_order_index")
    + _fields(T.StringType(), "message_order_perm", "shown_messages", "demographic",
              "prompt_sent", "llm_reasoning", "raw_response")
    + _fields(T.IntegerType(), "llm_new_belief", "llm_general_public_stance",
              "rank_1", "rank_2", "rank_3")
)

# Wide panel file, one row per subject and item.
PANEL_ROW = T.StructType(
    _fields(T.StringType(), "persona_id", "topic")
    + _fields(T.IntegerType(), "topic_position")
    + _fields(T.StringType(), "package")
    + _fields(T.IntegerType(), "message_order_code", "message_1_shown", "message_2_shown",
              "message_3_shown")
    + _fields(T.StringType(), "statement_formulation")
    + _fields(T.IntegerType(), "initial_belief", "final_belief", "familiarity",
              "second_order_belief", "stance_message_1_shown", "stance_message_2_shown",
              "stance_message_3_shown", "rank_message_1_shown", "rank_message_2_shown",
              "rank_message_3_shown")
    + _fields(T.StringType(), "text_response")
    + _fields(T.IntegerType(), "age")
    + _fields(T.StringType(), "gender", "ethnicity", "country_of_birth",
              "country_of_residency", "student_status", "employment_status",
              "occupation_field", "highest_qualification")
    + _fields(T.IntegerType(), *[f"BIG_item_{i}" for i in range(1, 11)])
    + _fields(T.StringType(), *[f"BIG_item_{i}_label" for i in range(1, 11)])
    + _fields(T.DoubleType(), *[f"BIG5_{t}_score" for t in TRAITS])
    + _fields(T.IntegerType(), "initial_belief_normalized", "final_belief_normalized")
)

# The conformed export row.
CONFORMED = T.StructType(
    _fields(T.StringType(), "split", "source", "model", "ablation_type", "condition")
    + _fields(T.DoubleType(), "temperature")
    + _fields(T.StringType(), "persona_id", "topic", "statement_formulation")
    + _fields(T.LongType(), "statement_polarity")
    + _fields(T.StringType(), "package")
    + _fields(T.LongType(), "message_order")
    + [T.StructField("message_order_perm", T.ArrayType(T.LongType())),
       T.StructField("shown_messages", T.ArrayType(MESSAGE))]
    + _fields(T.LongType(), "familiarity")
    + [T.StructField("demographic", DEMOGRAPHIC)]
    + _fields(T.StringType(), "init_belief_source")
    + _fields(T.LongType(), "raw_init_belief", "normalized_init_belief", "raw_new_belief",
              "normalized_new_belief", "raw_general_public_stance",
              "normalized_general_public_stance", "rank_1", "rank_2", "rank_3")
    + _fields(T.StringType(), "reasoning", "raw_response")
)
