"""Nutrition operators bound to the driver tables.

Stand-in (SURVEY §7.5): a meal log is an order, a food is a line item. Per-food nutrient values are derived from
the line's quantity, price, discount and tax, rounded to 2 decimals like the service's values; the fiber of every
third line is NULL to exercise the missing-value default.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wellspark.functions.numeric import round2, round_half_even
from wellspark.operators import nutrition as nu
from wellspark.sources.tables import table

CHUNK_FOODS = 64  # max foods folded per nested document when documents are built from flat rows


def foods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return foods_of(table(spark, sf_dir, "lineitem")).drop("l_shipdate")


def foods_of(li: DataFrame, *keep: str) -> DataFrame:
    """Per-food nutrient values of line items (batch or streaming input), with the columns named in ``keep`` as they are."""
    q, ep, d, t = (F.col(c) for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax"))
    return li.select(
        *keep,
        "l_orderkey",
        "l_linenumber",
        "l_shipdate",
        round2(ep / F.lit(100.0)).alias("nf_calories"),
        round2(q * F.lit(0.5)).alias("nf_total_fat"),
        round2(q * d * F.lit(2.0)).alias("nf_saturated_fat"),
        round2(q * F.lit(3.0)).alias("nf_cholesterol"),
        round2(ep * t / F.lit(10.0)).alias("nf_sodium"),
        round2(q * F.lit(1.5)).alias("nf_total_carbohydrate"),
        F.when(F.col("l_linenumber") != 3, round2(q * d * F.lit(10.0))).alias("nf_dietary_fiber"),
        round2(q * t * F.lit(10.0)).alias("nf_sugars"),
        round2(q * (F.lit(1.0) - d) * F.lit(0.6)).alias("nf_protein"),
        round2(ep / F.lit(50.0)).alias("nf_potassium"),
        round2(ep / F.lit(80.0)).alias("nf_p"),
    )


def _rounded_totals(df: DataFrame) -> DataFrame:
    return df.withColumns({n: round2(n) for n in nu.NUTRIENT_FIELDS})


def nutrient_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = foods(spark, sf_dir)
    present = set(f.columns)
    aggs = [F.count(F.lit(1)).alias("n_foods")]
    aggs += [F.sum(F.coalesce(F.col(fl), F.lit(0.0))).alias(n) for n, fl in nu.NUTRIENT_FIELDS.items() if fl in present]
    return _rounded_totals(f.groupBy("l_orderkey").agg(*aggs))


def nutrient_totals_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a ``foods`` array, folded with ``aggregate()``; must equal ``nutrient_totals``.

    Documents are built from the flat rows in bounded pieces (at most CHUNK_FOODS foods each), so no log is ever
    collected into one row whatever its size; the per-piece totals are then summed per log.
    """
    f = foods(spark, sf_dir)
    food_cols = [c for c in f.columns if c.startswith("nf_")]
    docs = f.groupBy(
        "l_orderkey", F.floor(F.col("l_linenumber") / F.lit(CHUNK_FOODS)).alias("piece")
    ).agg(F.collect_list(F.struct(*food_cols)).alias("foods"))
    folded = nu.nested_totals(docs, "foods").withColumn("n_foods", F.size("foods"))
    per_log = folded.groupBy("l_orderkey").agg(
        F.sum("n_foods").cast("long").alias("n_foods"), *[F.sum(n).alias(n) for n in nu.NUTRIENT_FIELDS]
    )
    return _rounded_totals(per_log)


def risk_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = nu.risk_rules(nutrient_totals(spark, sf_dir).drop("n_foods"), messages="reference")
    shares = ["carb_share", "fat_share", "saturated_fat_share", "protein_share"]
    return out.select(
        "l_orderkey", *[round_half_even(s, 4).alias(s) for s in shares], *nu.RISK_COLUMNS
    )


def unit_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = nu.food_totals(foods(spark, sf_dir), ["l_orderkey"], whole=True)
    return nu.format_totals(_rounded_totals(totals), suffix="")


def food_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines (food log) priced through the part table (per-serving nutrients)."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    part = table(spark, sf_dir, "part").select(
        "p_partkey",
        round2(F.col("p_retailprice") / F.lit(100.0)).alias("calories"),
        (F.col("p_size") / F.lit(10.0)).alias("protein"),
    )
    priced = nu.price_foods(
        li, part, "l_partkey", "p_partkey", "l_quantity", ["calories", "protein"], normalise_names=False
    )
    return priced.groupBy("l_orderkey").agg(
        round2(F.sum("calories")).alias("Calories"), round2(F.sum("protein")).alias("Protein")
    )


def food_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J7 on names: each part type as eaten (written in other letters and spaces), priced through the parts' names, of
    which many are the same once normalised."""
    part = table(spark, sf_dir, "part")
    log = part.select("p_partkey", F.concat(F.lit("  "), F.upper(F.replace("p_name", F.lit(" "), F.lit("   "))))
                      .alias("food"), F.col("p_size").cast("double").alias("servings"))
    log = log.withColumn("food", F.when(F.col("p_partkey") % 10 == 0, F.concat("food", F.lit(" pie"))).otherwise(F.col("food")))
    per_serving = part.select("p_name", round2(F.col("p_retailprice") / F.lit(100.0)).alias("calories"))
    priced = nu.price_foods(log, per_serving, "food", "p_name", "servings", ["calories"])
    return priced.select("p_partkey", "food", round2("calories").alias("calories"))


QUERIES = {
    "food_names": food_names,
    "nutrient_totals": nutrient_totals,
    "nutrient_totals_nested": nutrient_totals_nested,
    "risk_rules": risk_rules,
    "unit_format": unit_format,
    "food_join": food_join,
}


def _r2(x: str) -> str:
    return f"round_even(({x}) * 100, 0) / 100"


def _r4(x: str) -> str:
    return f"round_even(({x}) * 10000, 0) / 10000"


FOODS_SQL = f"""foods AS (
  SELECT l_orderkey, l_linenumber, l_shipdate,
    {_r2('l_extendedprice / 100.0::DOUBLE')} AS nf_calories,
    {_r2('l_quantity * 0.5::DOUBLE')} AS nf_total_fat,
    {_r2('l_quantity * l_discount * 2.0::DOUBLE')} AS nf_saturated_fat,
    {_r2('l_quantity * 3.0::DOUBLE')} AS nf_cholesterol,
    {_r2('l_extendedprice * l_tax / 10.0::DOUBLE')} AS nf_sodium,
    {_r2('l_quantity * 1.5::DOUBLE')} AS nf_total_carbohydrate,
    CASE WHEN l_linenumber <> 3 THEN {_r2('l_quantity * l_discount * 10.0::DOUBLE')} END AS nf_dietary_fiber,
    {_r2('l_quantity * l_tax * 10.0::DOUBLE')} AS nf_sugars,
    {_r2('l_quantity * (1.0::DOUBLE - l_discount) * 0.6::DOUBLE')} AS nf_protein,
    {_r2('l_extendedprice / 50.0::DOUBLE')} AS nf_potassium,
    {_r2('l_extendedprice / 80.0::DOUBLE')} AS nf_p
  FROM lineitem)"""

_TOTALS = f"""{FOODS_SQL},
totals AS (
  SELECT l_orderkey, COUNT(*) AS n_foods,
    {", ".join(f"{_r2(f'SUM(COALESCE({fl}, 0.0))')} AS {n}" for n, fl in nu.NUTRIENT_FIELDS.items())}
  FROM foods GROUP BY l_orderkey)"""

SHARES_SQL = """shares AS (
  SELECT *, (Total_Carbohydrate * 4.0::DOUBLE) / Calories AS carb_share,
            (Total_Fat * 9.0::DOUBLE) / Calories AS fat_share,
            (Saturated_Fat * 9.0::DOUBLE) / Calories AS saturated_fat_share,
            (Protein * 4.0::DOUBLE) / Calories AS protein_share
  FROM totals)"""


def _pct(x: str) -> str:
    return f"CAST(CAST(trunc({x} * 100.0::DOUBLE) AS INTEGER) AS VARCHAR)"


def _risk(cond: str, text: str) -> str:
    return f"CASE WHEN {cond} THEN {text} ELSE '{nu.NO_RISK}' END"


def _tmpl(template: str, **parts: str) -> str:
    pieces, rest = [], template
    while "{" in rest:
        before, after = rest.split("{", 1)
        name, rest = after.split("}", 1)
        pieces += [f"'{before}'", parts[name]]
    pieces.append(f"'{rest}'")
    return "concat(" + ", ".join(pieces) + ")"


RISKS_SQL = f"""{_risk('carb_share > 0.45', _tmpl(nu.MSG_CARB, pct=_pct('carb_share')))} AS Total_Carbohydrate_Risk,
        {_risk('fat_share < 0.2 OR fat_share > 0.35', _tmpl(nu.MSG_FAT, pct=_pct('fat_share')))} AS Total_Fat_Risk,
        {_risk('saturated_fat_share > 0.1', _tmpl(nu.MSG_SAT, pct=_pct('saturated_fat_share')))} AS Saturated_Fat_Risk,
        {_risk('protein_share < 0.15 OR protein_share > 0.2', _tmpl(nu.MSG_PROTEIN, pct=_pct('saturated_fat_share')))}
          AS Protein_Risk,
        {_risk('Sodium > 2300', _tmpl(nu.MSG_SODIUM, val='CAST(Sodium AS VARCHAR)'))} AS Sodium_Risk,
        {_risk('Sugars > 25', _tmpl(nu.MSG_SUGARS, val='CAST(Sugars AS VARCHAR)'))} AS Sugars_Risk,
        {_risk('Dietary_Fiber < 20 OR Dietary_Fiber > 35', _tmpl(nu.MSG_FIBER, val='CAST(Dietary_Fiber AS VARCHAR)'))}
          AS Dietary_Fiber_Risk"""


ORACLES = {
    "nutrient_totals": f"WITH {_TOTALS} SELECT * FROM totals",
    "nutrient_totals_nested": f"WITH {_TOTALS} SELECT * FROM totals",
    "risk_rules": f"""WITH {_TOTALS}, {SHARES_SQL}
      SELECT l_orderkey, {_r4('carb_share')} AS carb_share, {_r4('fat_share')} AS fat_share,
        {_r4('saturated_fat_share')} AS saturated_fat_share, {_r4('protein_share')} AS protein_share,
        {RISKS_SQL}
      FROM shares""",
    "unit_format": f"""WITH {FOODS_SQL},
      totals AS (SELECT l_orderkey, {", ".join(
          f"{_r2(f'SUM(COALESCE({fl}, 0.0))')} AS {n}, bool_and(COALESCE({fl}, 0.0) = floor(COALESCE({fl}, 0.0))) AS {n}_whole"
          for n, fl in nu.NUTRIENT_FIELDS.items())} FROM foods GROUP BY 1)
      SELECT l_orderkey, {", ".join(n for n in nu.NUTRIENT_FIELDS if n not in nu.UNITS)},
        {", ".join(f"concat(CASE WHEN {n}_whole THEN CAST(CAST({n} AS BIGINT) AS VARCHAR) ELSE CAST({n} AS VARCHAR) END, '{u}') AS {n}"
                   for n, u in nu.UNITS.items())}
      FROM totals""",
    "food_names": f"""
      WITH t AS (SELECT p_name, MIN({_r2('p_retailprice / 100.0::DOUBLE')}) AS calories FROM part GROUP BY 1),
      l AS (SELECT p_partkey, p_name, p_size, concat('  ', upper(replace(p_name, ' ', '   ')),
              CASE WHEN p_partkey % 10 = 0 THEN ' pie' ELSE '' END) AS food FROM part)
      SELECT p_partkey, food, CASE WHEN p_partkey % 10 <> 0 THEN {_r2('calories * p_size')} END AS calories
      FROM l JOIN t USING (p_name)""",
    "food_join": f"""
      SELECT l.l_orderkey,
        {_r2('SUM(' + _r2('p.p_retailprice / 100.0::DOUBLE') + ' * l.l_quantity)')} AS Calories,
        {_r2('SUM(p.p_size / 10.0::DOUBLE * l.l_quantity)')} AS Protein
      FROM lineitem l LEFT JOIN part p ON l.l_partkey = p.p_partkey
      GROUP BY l.l_orderkey""",
}
