"""Exact explanation of linear predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.operators import evaluate
from touchline.operators.classify import LinearModel, softmax, with_logits

# --- Fixed values -----------------------------------------------------------
LONG_NAMES = ["home", "draw", "away"]
LABELS = {
    "elo_diff": "Overall team strength",
    "diff_ewma_ppg": "Recent form",
    "diff_ewma_sot_diff": "Shots-on-target dominance",
}
DESCRIPTIONS = {
    "elo_diff": "Long-term relative team strength from Elo.",
    "diff_ewma_ppg": "Difference in exponentially weighted recent points per game.",
    "diff_ewma_sot_diff": "Difference in recent exponentially weighted shots-on-target dominance.",
}
REFERENCE_VALUE = 0.0
TOLERANCE = 1e-9
# --- End of fixed values ----------------------------------------------------


def _by_class(values: list[Column]) -> Column:
    return F.struct(*[v.alias(n) for v, n in zip(values, LONG_NAMES)])


def direction(value: Column, predicted: Column) -> Column:
    """Whether a contribution supports or opposes the predicted class."""
    name = F.get(F.array(*[F.lit(n) for n in LONG_NAMES]), predicted)
    return F.when(value > 0, F.concat(F.lit("supports_"), name)).when(value < 0, F.concat(F.lit("opposes_"), name)).otherwise("neutral")


def explain_linear(df: DataFrame, model: LinearModel) -> DataFrame:
    """Per row: probabilities, logits, one entry per feature, and both driver
    rankings. Contributions come from the model's own numbers; replacing a
    feature by the reference value re-runs imputation, flag and scaling."""
    n = len(model.columns)
    flag_at = {c: n + i for i, c in enumerate(model.indicators)}
    out = with_logits(df, model)
    logits = [F.col(f"logit_{c}") for c in evaluate.CLASSES]
    out = out.withColumns(dict(zip(evaluate.PROBABILITIES, softmax(logits))))
    out = out.withColumn("_top", evaluate.top_class())
    contribution = {}
    for k, c in enumerate(model.columns):
        for j in range(3):
            contribution[f"_val_{k}_{j}"] = F.col(f"_x_{k}") * model.coefficients[j][k]
            if c in flag_at:
                contribution[f"_mis_{k}_{j}"] = F.col(f"_x_{flag_at[c]}") * model.coefficients[j][flag_at[c]]
    out = out.withColumns(contribution)
    grouped = {
        f"_grp_{k}_{j}": F.col(f"_val_{k}_{j}") + (F.col(f"_mis_{k}_{j}") if c in flag_at else 0.0)
        for k, c in enumerate(model.columns) for j in range(3)}
    out = out.withColumns(grouped)
    shifted = {}
    for k, c in enumerate(model.columns):
        for j in range(3):
            at_reference = model.coefficients[j][k] * (REFERENCE_VALUE - model.means[k]) / model.scales[k]
            if c in flag_at:
                i = flag_at[c]
                at_reference += model.coefficients[j][i] * (0.0 - model.means[i]) / model.scales[i]
            # A feature already at the reference value changes nothing, not even a last bit.
            shifted[f"_cf_{k}_{j}"] = F.when(F.col(c) == REFERENCE_VALUE, logits[j]).otherwise(
                logits[j] - F.col(f"_grp_{k}_{j}") + at_reference)
    out = out.withColumns(shifted)
    out = out.withColumns({
        f"_sens_{k}_{j}": F.col(evaluate.PROBABILITIES[j]) - p
        for k in range(n) for j, p in enumerate(softmax([F.col(f"_cf_{k}_{i}") for i in range(3)]))})

    def of_predicted(prefix: str, k: int) -> Column:
        return F.get(F.array(*[F.col(f"{prefix}_{k}_{j}") for j in range(3)]), F.col("_top"))

    entries = []
    for k, c in enumerate(model.columns):
        imputed = F.col(c).isNull() if c in flag_at else F.lit(False)
        entries.append(F.struct(
            F.lit(c).alias("name"), F.lit(LABELS.get(c, c)).alias("human_label"), F.lit(DESCRIPTIONS.get(c, c)).alias("description"),
            F.col(c).alias("raw_value"), F.col(f"_v_{c}").alias("effective_value"), imputed.alias("was_imputed"),
            _by_class([F.col(f"_val_{k}_{j}") for j in range(3)]).alias("value_logit"),
            (_by_class([F.col(f"_mis_{k}_{j}") for j in range(3)]) if c in flag_at else
             F.lit(None).cast("struct<home:double,draw:double,away:double>")).alias("missingness_logit"),
            _by_class([F.col(f"_grp_{k}_{j}") for j in range(3)]).alias("grouped_logit"),
            _by_class([F.col(f"_sens_{k}_{j}") for j in range(3)]).alias("sensitivity"),
            imputed.alias("counterfactual_changed_missingness"),
        ))

    def ranking(prefix: str) -> Column:
        items = [F.struct((-of_predicted(prefix, k)).alias("order"), F.lit(k).alias("k"), F.lit(c).alias("feature"),
                          of_predicted(prefix, k).alias("value"), direction(of_predicted(prefix, k), F.col("_top")).alias("direction"))
                 for k, c in enumerate(model.columns)]
        return F.transform(F.sort_array(F.array(*items)), lambda x: F.struct(x["feature"], x["value"], x["direction"]))

    total = [sum((F.col(f"_grp_{k}_{j}") for k in range(n)), F.lit(model.intercepts[j])) for j in range(3)]
    return out.select(
        *df.columns, *evaluate.PROBABILITIES,
        F.get(F.array(*[F.lit(c) for c in evaluate.CLASSES]), F.col("_top")).alias("predicted_class"),
        _by_class(logits).alias("logits"), F.array(*entries).alias("features"),
        ranking("_grp").alias("drivers_by_logit"), ranking("_sens").alias("drivers_by_sensitivity"),
        F.greatest(*[F.abs(t - z) for t, z in zip(total, logits)]).alias("reconstruction_error"),
    )


def reconstruction_check(explained: DataFrame) -> DataFrame:
    """Largest gap between a logit and intercept plus contributions; sound up to the tolerance."""
    return explained.agg(F.max("reconstruction_error").alias("worst"), F.count("*").alias("n_rows")).withColumn(
        "sound", F.col("worst") <= TOLERANCE)
