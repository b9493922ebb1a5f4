"""Declared schemas and column maps of the wearable, participant and nutrition inputs (never inferred)."""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------------------------------------
# File names, device folders, kept raw columns and their positional renames, and the columns
# stored in seconds - these must equal the reference's for identical output.
# ---------------------------------------------------------------------------------------------------------
SLEEP_FILE, SLEEP_DEVICE = "sleep.csv", "oura"
SLEEP_RAW = (
    "date", "total", "awake", "light", "rem", "deep", "onset_latency", "midpoint_time", "efficiency",
    "hr_average", "hr_lowest", "rmssd", "breath_average", "temperature_delta",
)
SLEEP_NAMES = (
    "date", "total_sleep_time", "awake_duration", "light_sleep_duration", "rem_sleep_duration",
    "deep_sleep_duration", "sleep_onset_latency", "midpoint_time_of_sleep", "sleep_efficiency",
    "average_heart_rate", "minimum_heart_rate", "rmssd", "average_breathing_rate", "temperature_variation",
)
SLEEP_SECONDS = (
    "total_sleep_time", "awake_duration", "light_sleep_duration", "rem_sleep_duration", "deep_sleep_duration",
    "sleep_onset_latency", "midpoint_time_of_sleep",
)
ACTIVITY_FILE, ACTIVITY_DEVICE = "activity.csv", "oura"
ACTIVITY_RAW = ("date", "steps", "rest", "inactive", "low", "medium", "high")
ACTIVITY_NAMES = (
    "date", "steps_count", "rest_time", "inactive_time", "low_acitivity_time", "medimum_acitivity_time",
    "high_acitivity_time",
)
PPG_FILE, PPG_DEVICE = "ppg.csv", "samsung"
PPG_RAW = ("timestamp", "ppg", "hr")
PPG_NAMES = ("date", "ppg", "hr")
DEFAULT_DATA_DIR = "data/affect"
MISSING = "NA"
PARTICIPANT_COLUMNS = (
    "id", "group", "sex", "usual_weight_kg", "weight_5years_kg", "height_cm", "intervention_diet_kcal",
    "finished_intervention",
)
SLEEP_DATASET_SUFFIX = "_additional_sleep_data"
# ---------------------------------------------------------------------------------------------------------


def all_double(names, date_type=T.StringType()) -> T.StructType:
    fields = [T.StructField(names[0], date_type, True)]
    fields += [T.StructField(n, T.DoubleType(), True) for n in names[1:]]
    return T.StructType(fields)


SLEEP_RAW_SCHEMA = all_double(SLEEP_RAW)
ACTIVITY_RAW_SCHEMA = all_double(ACTIVITY_RAW)
PPG_RAW_SCHEMA = T.StructType(
    [T.StructField("timestamp", T.LongType()), T.StructField("ppg", T.DoubleType()), T.StructField("hr", T.DoubleType())]
)


def all_string(names) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType(), True) for n in names])


NUTRIENT_STRUCT = T.StructType(
    [T.StructField("attr_id", T.IntegerType()), T.StructField("value", T.DoubleType())]
)
FOOD_STRUCT = T.StructType(
    [
        T.StructField("food_name", T.StringType()),
        T.StructField("brand_name", T.StringType()),
        T.StructField("serving_qty", T.DoubleType()),
        T.StructField("serving_unit", T.StringType()),
        T.StructField("serving_weight_grams", T.DoubleType()),
        *[
            T.StructField(n, T.DoubleType())
            for n in (
                "nf_calories", "nf_total_fat", "nf_saturated_fat", "nf_cholesterol", "nf_sodium",
                "nf_total_carbohydrate", "nf_dietary_fiber", "nf_sugars", "nf_protein", "nf_potassium", "nf_p",
            )
        ],
        T.StructField("full_nutrients", T.ArrayType(NUTRIENT_STRUCT)),
        T.StructField("consumed_at", T.StringType()),
        T.StructField("metadata", T.StructType([T.StructField("is_raw_food", T.BooleanType())])),
        T.StructField("source", T.IntegerType()),
        T.StructField("ndb_no", T.IntegerType()),
        T.StructField(
            "tags",
            T.StructType(
                [
                    T.StructField("item", T.StringType()),
                    T.StructField("measure", T.StringType()),
                    T.StructField("quantity", T.StringType()),
                    T.StructField("food_group", T.IntegerType()),
                    T.StructField("tag_id", T.IntegerType()),
                ]
            ),
        ),
        T.StructField(
            "alt_measures",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("serving_weight", T.DoubleType()),
                        T.StructField("measure", T.StringType()),
                        T.StructField("seq", T.StringType()),
                        T.StructField("qty", T.DoubleType()),
                    ]
                )
            ),
        ),
        T.StructField("meal_type", T.IntegerType()),
        T.StructField(
            "photo",
            T.StructType(
                [
                    T.StructField("thumb", T.StringType()),
                    T.StructField("highres", T.StringType()),
                    T.StructField("is_user_uploaded", T.BooleanType()),
                ]
            ),
        ),
        *[
            T.StructField(n, T.StringType())
            for n in (
                "lat", "lng", "upc", "nix_brand_name", "nix_brand_id", "nix_item_name", "nix_item_id", "sub_recipe",
                "class_code", "brick_code", "tag_id",
            )
        ],
    ]
)
NUTRITION_DOC_SCHEMA = T.StructType([T.StructField("foods", T.ArrayType(FOOD_STRUCT))])
