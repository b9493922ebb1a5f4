"""Nutrient totals, energy shares, diet-risk rules and unit formatting.

Input shapes
------------
* flat foods: one row per food with the ``nf_*`` columns and a log key (``explode_foods`` makes this from
  nested documents);
* nested documents: one row per log with ``foods: array<struct<nf_*...>>`` (the nutrition service's JSON);
  ``nested_totals`` folds the array with ``aggregate()`` inside the row - no shuffle at all.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wellspark.functions.numeric import pct_trunc, safe_div
from wellspark.functions.text import let

# ---------------------------------------------------------------------------------------------------------
# Fixed values that must equal the reference's: nutrient names and their source fields, calorie factors,
# thresholds, units and message texts (including the reference's spelling and its protein message, which
# prints the saturated-fat share).
# ---------------------------------------------------------------------------------------------------------
NUTRIENT_FIELDS = {
    "Calories": "nf_calories",
    "Total_Fat": "nf_total_fat",
    "Saturated_Fat": "nf_saturated_fat",
    "Cholesterol": "nf_cholesterol",
    "Sodium": "nf_sodium",
    "Total_Carbohydrate": "nf_total_carbohydrate",
    "Dietary_Fiber": "nf_dietary_fiber",
    "Sugars": "nf_sugars",
    "Protein": "nf_protein",
    "Potassium": "nf_potassium",
    "Phosphorus": "nf_p",
}
UNITS = {
    "Total_Fat": "g",
    "Saturated_Fat": "g",
    "Cholesterol": "mg",
    "Sodium": "mg",
    "Total_Carbohydrate": "g",
    "Dietary_Fiber": "g",
    "Sugars": "g",
    "Protein": "g",
    "Potassium": "mg",
    "Phosphorus": "mg",
}
KCAL_PER_GRAM = {"carb": 4, "fat": 9, "saturated_fat": 9, "protein": 4}
NO_RISK = "No Risk"
MSG_CARB = (
    "The percentage of total carnohydrate of total energy intake is {pct}% "
    "which exceeds the recommended threshold of < 45%"
)
MSG_FAT = (
    "The percentage of total fat of total energy intake is {pct}% "
    "which is outside the recommended threshold of 20%-35%"
)
MSG_SAT = (
    "The percentage of total saturated fat of total energy intake is {pct}% "
    "which exceeds the recommended threshold of < 10%"
)
MSG_PROTEIN = (
    "The percentage of total protein of total energy intake is {pct}% "
    "which is outside the recommended threshold of 15%-20%"
)
MSG_SODIUM = "The total consumed sodium is {val}mg which is more than recommended threshold of 2300mg"
MSG_SUGARS = "The total consumed sugar is {val}g which is more than recommended threshold of 25g"
MSG_FIBER = "The total consumed fiber is {val}g which is outside the recommended values of 20g-35g"
# ---------------------------------------------------------------------------------------------------------

RISK_COLUMNS = (
    "Total_Carbohydrate_Risk",
    "Total_Fat_Risk",
    "Saturated_Fat_Risk",
    "Protein_Risk",
    "Sodium_Risk",
    "Sugars_Risk",
    "Dietary_Fiber_Risk",
)


def explode_foods(docs: DataFrame, keys: Sequence[str], foods_col: str = "foods") -> DataFrame:
    """Nested documents -> one row per food (``inline`` keeps the struct fields as columns).

    ``inline_outer`` keeps logs with an empty/NULL ``foods`` as one all-NULL row, so they still total to 0.
    """
    return docs.select(*keys, F.inline_outer(F.col(foods_col)))


WHOLE = "_whole"


def is_whole(c: Column) -> Column:
    return c == F.floor(c)


def food_totals(foods: DataFrame, keys: Sequence[str], whole: bool = False) -> DataFrame:
    """A6 (flat form): per log, the eleven totals; a missing or NULL value counts as 0.

    ``whole`` adds ``<name>_whole``: whether all values of a total are whole numbers, which JSON writes without a
    fraction, so that their sum prints without one (A9). Grouped sums are partially aggregated before the shuffle (one
    row per log and task).
    """
    present = set(foods.columns)
    aggs = []
    for name, field in NUTRIENT_FIELDS.items():
        v = F.coalesce(F.col(field).cast("double"), F.lit(0.0)) if field in present else F.lit(0.0)
        aggs.append(F.sum(v).alias(name))
        if whole:
            aggs.append(F.bool_and(is_whole(v)).alias(name + WHOLE))
    return foods.groupBy(*keys).agg(*aggs)


def nested_totals(docs: DataFrame, foods_col: str = "foods") -> DataFrame:
    """A6 (nested form): fold ``foods`` with ``aggregate()`` per row: no explode, no shuffle.

    Adds the eleven total columns to every document row.
    """
    elem_fields = set(docs.schema[foods_col].dataType.elementType.fieldNames())
    zero = F.struct(*[F.lit(0.0).alias(n) for n in NUTRIENT_FIELDS])

    def step(acc: Column, food: Column) -> Column:
        return F.struct(
            *[
                (
                    acc[n]
                    + (F.coalesce(food[f].cast("double"), F.lit(0.0)) if f in elem_fields else F.lit(0.0))
                ).alias(n)
                for n, f in NUTRIENT_FIELDS.items()
            ]
        )

    folded = F.aggregate(F.coalesce(F.col(foods_col), F.array().cast(docs.schema[foods_col].dataType)), zero, step)
    return docs.withColumn("__t", folded).select("*", *[F.col(f"__t.{n}").alias(n) for n in NUTRIENT_FIELDS]).drop(
        "__t"
    )


def energy_shares(totals: DataFrame) -> DataFrame:
    """Carbohydrate, fat, saturated-fat and protein shares of calories; zero calories -> NULL share."""
    cal = F.col("Calories")
    return totals.withColumns(
        {
            "carb_share": safe_div(F.col("Total_Carbohydrate") * F.lit(float(KCAL_PER_GRAM["carb"])), cal),
            "fat_share": safe_div(F.col("Total_Fat") * F.lit(float(KCAL_PER_GRAM["fat"])), cal),
            "saturated_fat_share": safe_div(
                F.col("Saturated_Fat") * F.lit(float(KCAL_PER_GRAM["saturated_fat"])), cal
            ),
            "protein_share": safe_div(F.col("Protein") * F.lit(float(KCAL_PER_GRAM["protein"])), cal),
        }
    )


def _msg(template: str, **parts: Column) -> Column:
    """Fill ``{name}`` slots of a fixed template with column values (no Python per row)."""
    pieces: list[Column] = []
    rest = template
    while "{" in rest:
        before, after = rest.split("{", 1)
        name, rest = after.split("}", 1)
        pieces += [F.lit(before), parts[name].cast("string")]
    pieces.append(F.lit(rest))
    return F.concat(*pieces)


def number_text(c: Column) -> Column:
    """Python ``f"{x}"`` for a double: ``43.0``, ``12345678.5``, ``1e+16``, ``1e-05``. The digits are those of the JVM,
    which beyond some 1e17 are not always the shortest.

    As a function of one value it stays out of the code that Spark generates for a whole stage: several of these texts
    side by side make a method too long for the JVM to compile."""
    return let(c, _number_text)


def _number_text(c: Column) -> Column:
    shortest = c.cast("string")  # the same digits, in scientific form outside 1e-3 to 1e7
    plain = F.regexp_replace(shortest.try_cast("decimal(38,20)").cast("string"), "0+$", "")
    plain = F.when(plain.endswith("."), F.concat(plain, F.lit("0"))).otherwise(plain)
    mantissa = F.regexp_replace(F.substring_index(shortest, "E", 1), r"\.0$", "")
    power = F.substring_index(shortest, "E", -1).try_cast("int")
    scientific = F.concat(mantissa, F.lit("e"), F.when(power < 0, F.lit("-")).otherwise(F.lit("+")),
                          F.lpad(F.abs(power).cast("string"), F.greatest(F.lit(2), F.length(F.abs(power).cast("string"))), F.lit("0")))
    size = F.abs(c)
    return (F.when(~shortest.contains("E"), shortest).when((size >= 1e-4) & (size < 1e16), plain)
            .otherwise(scientific))


def risk_rules(totals: DataFrame, messages: str = "reference") -> DataFrame:
    """Seven risk flags and messages (thresholds strict, percent truncated).

    ``messages="reference"`` prints the saturated-fat percent in the protein message, as the reference does;
    ``"corrected"`` prints the protein percent. Zero calories -> NULL shares -> NULL flags and messages.
    Adds boolean ``is_*_risk`` columns and the seven ``*_Risk`` text columns.
    """
    if messages not in ("reference", "corrected"):
        raise ValueError("messages must be 'reference' or 'corrected'")
    df = energy_shares(totals)
    carb, fat, sat, prot = (F.col(c) for c in ("carb_share", "fat_share", "saturated_fat_share", "protein_share"))
    sodium, sugars, fiber = F.col("Sodium"), F.col("Sugars"), F.col("Dietary_Fiber")
    flags = {
        "is_carb_risk": carb > 0.45,
        "is_fat_risk": (fat < 0.2) | (fat > 0.35),
        "is_saturated_fat_risk": sat > 0.1,
        "is_protein_risk": (prot < 0.15) | (prot > 0.2),
        "is_sodium_risk": sodium > 2300,
        "is_sugars_risk": sugars > 25,
        "is_fiber_risk": (fiber < 20) | (fiber > 35),
    }
    df = df.withColumns(flags)
    protein_pct = pct_trunc(sat) if messages == "reference" else pct_trunc(prot)
    texts = {
        "Total_Carbohydrate_Risk": ("is_carb_risk", _msg(MSG_CARB, pct=pct_trunc(carb))),
        "Total_Fat_Risk": ("is_fat_risk", _msg(MSG_FAT, pct=pct_trunc(fat))),
        "Saturated_Fat_Risk": ("is_saturated_fat_risk", _msg(MSG_SAT, pct=pct_trunc(sat))),
        "Protein_Risk": ("is_protein_risk", _msg(MSG_PROTEIN, pct=protein_pct)),
        "Sodium_Risk": ("is_sodium_risk", _msg(MSG_SODIUM, val=number_text(sodium))),
        "Sugars_Risk": ("is_sugars_risk", _msg(MSG_SUGARS, val=number_text(sugars))),
        "Dietary_Fiber_Risk": ("is_fiber_risk", _msg(MSG_FIBER, val=number_text(fiber))),
    }
    return df.withColumns(
        {name: F.when(F.col(flag), text).when(~F.col(flag), F.lit(NO_RISK)) for name, (flag, text) in texts.items()}
    )


def format_totals(df: DataFrame, suffix: str = "_text") -> DataFrame:
    """Totals as text with their unit (``43.0g``, ``487.04mg``; ``87mg`` where ``<name>_whole`` says that all parts are
    whole numbers); Calories stays numeric.

    The numeric columns are kept; the texts are added as ``<name><suffix>``. The flags go.
    """
    def text(name: str) -> Column:
        shown = number_text(F.col(name))
        if name + WHOLE in df.columns:
            shown = F.when(F.col(name + WHOLE) & (F.abs(F.col(name)) < 9e15), F.col(name).cast("long").cast("string")).otherwise(shown)
        return shown

    out = df.withColumns({f"{n}{suffix}": F.concat(text(n), F.lit(u)) for n, u in UNITS.items()})
    return out.drop(*[n + WHOLE for n in NUTRIENT_FIELDS])


def normalised_name(c: Column) -> Column:
    """A food's name lower-cased, stripped and with single spaces."""
    return F.lower(F.regexp_replace(F.regexp_replace(c.cast("string"), r"\s+", " "), r"^ | $", ""))


def price_foods(
    log: DataFrame,
    nutrients: DataFrame,
    log_food_col: str,
    table_food_col: str,
    servings_col: str,
    per_serving: Sequence[str],
    normalise_names: bool = True,
) -> DataFrame:
    """Food log joined to a per-serving nutrient table on the food, values times servings.

    Text names are compared lower-cased with whitespace collapsed (``normalise_names``); numeric ids as they are. Of
    several foods with one normalised name the first in order of the written name, then of all other columns, counts,
    so that a log row stays one row. Unknown foods keep NULL nutrients (left join). The nutrient table is data-sized,
    so AQE decides between broadcast and shuffle join from its runtime size.
    """
    def norm(c: Column) -> Column:
        return normalised_name(c) if normalise_names else c

    others = [c for c in nutrients.columns if c != table_food_col]
    t = nutrients.withColumn("__food", norm(F.col(table_food_col)))
    if normalise_names:
        t = t.groupBy("__food").agg(F.min(F.struct(table_food_col, *others)).alias("__row")).select(
            "__food", *[F.col(f"__row.{c}").alias(c) for c in others])
    else:
        t = t.drop(table_food_col)
    lg = log.withColumn("__food", norm(F.col(log_food_col)))
    out = lg.join(t, on="__food", how="left")
    return out.withColumns({c: F.col(c) * F.col(servings_col) for c in per_serving}).drop("__food")
