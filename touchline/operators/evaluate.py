"""Probability contract, metrics, paired comparison and selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from touchline.session import written

# --- Fixed values -----------------------------------------------------------
CLASSES = ["H", "D", "A"]
PROBABILITIES = ["p_home", "p_draw", "p_away"]
LOSS_FLOOR = 2.220446049250313e-16
PAIRED_FLOOR = 1e-15
SUM_TOLERANCE = 1e-6 + 1e-5
NEGATIVE_TOLERANCE = -1e-9
UNRANKED = 99
MODEL_RANK = {"logreg": 0, "random_forest": 1, "xgboost": 2, "catboost": 2}
# --- End of fixed values ----------------------------------------------------


def p_of(y: Column) -> Column:
    """Probability given to the class that happened."""
    return F.when(y == 0, F.col("p_home")).when(y == 1, F.col("p_draw")).when(y == 2, F.col("p_away"))


def row_loss(floor: float = LOSS_FLOOR) -> Column:
    return -F.log(F.least(F.greatest(p_of(F.col("y")), F.lit(floor)), F.lit(1.0)))


def top_class() -> Column:
    """Index of the largest probability; the first wins a tie."""
    h, d, a = (F.col(p) for p in PROBABILITIES)
    return F.when((h >= d) & (h >= a), 0).when(d >= a, 1).otherwise(2)


def brier() -> Column:
    return sum(((F.col(p) - F.when(F.col("y") == k, 1.0).otherwise(0.0)) ** 2 for k, p in enumerate(PROBABILITIES)), F.lit(0.0))


def bin_edges(n: int) -> list[float]:
    step = 1.0 / n
    return [i * step for i in range(n)] + [1.0]


def bin_of(value: Column, n: int) -> Column:
    """Index of the (low, high] bin, the first closed below; explicit edges."""
    edges = bin_edges(n)
    out = F.when((value >= edges[0]) & (value <= edges[1]), 0)
    for i in range(1, n):
        out = out.when((value > edges[i]) & (value <= edges[i + 1]), i)
    return out


def contract_problems(predictions: DataFrame, by: list[str]) -> DataFrame:
    """Counts of rows that are not finite, negative, or do not sum to one."""
    ps = [F.col(p) for p in PROBABILITIES]
    inf = float("inf")
    finite = F.lit(True)
    negative = F.lit(False)
    for p in ps:
        finite = finite & p.isNotNull() & ~F.isnan(p) & (F.abs(p) < inf)
        negative = negative | (p < NEGATIVE_TOLERANCE)
    off = F.abs(ps[0] + ps[1] + ps[2] - 1.0) > SUM_TOLERANCE
    return predictions.groupBy(*by).agg(
        F.count("*").alias("n_rows"),
        F.count_if(~finite).alias("n_not_finite"),
        F.count_if(finite & negative).alias("n_negative"),
        F.count_if(finite & off).alias("n_bad_sum"),
    )


def align(probabilities: Column, classes: list[int]) -> dict[str, Column]:
    """Model output in the order ``classes`` as p_home, p_draw, p_away: absent
    classes get 0, the row is divided by its sum, a bad sum fails the job."""
    value = {c: F.get(probabilities, F.lit(i)) for i, c in enumerate(classes)}
    raw = [value.get(k, F.lit(0.0)) for k in range(3)]
    total = raw[0] + raw[1] + raw[2]
    sound = total.isNotNull() & ~F.isnan(total) & (total > 0) & (total < float("inf"))
    checked = F.when(sound, total).otherwise(F.raise_error(F.lit("cannot renormalise probabilities")).cast("double"))
    return {p: r / checked for p, r in zip(PROBABILITIES, raw)}


def fold_metrics(predictions: DataFrame, by: list[str], n_bins: int = 10) -> DataFrame:
    """The whole metric suite per group in one aggregation.

    The calibration error needs only the sum of (confidence - hit) per bin, so
    the bins are plain conditional sums and no second shuffle is needed.
    """
    rows = predictions.withColumns({
        "_top": top_class(), "_conf": F.greatest(*PROBABILITIES), "_ll": row_loss(), "_brier": brier(),
    })
    hit = F.when(F.col("_top") == F.col("y"), 1.0).otherwise(0.0)
    conf_bin = bin_of(F.col("_conf"), n_bins)
    cells = {f"cm_{t}{p}": F.count_if((F.col("y") == t) & (F.col("_top") == p)) for t in range(3) for p in range(3)}
    agg = rows.groupBy(*by).agg(
        F.count("*").alias("n_rows"),
        F.avg("_ll").alias("log_loss"), F.avg("_brier").alias("brier_score"), F.avg(hit).alias("accuracy"),
        *[c.alias(k) for k, c in cells.items()],
        *[F.avg(p).alias(f"mean_{p}") for p in PROBABILITIES],
        *[F.avg(F.when(F.col("y") == k, 1.0).otherwise(0.0)).alias(f"freq_{c}") for k, c in enumerate(CLASSES)],
        *[F.sum(F.when(conf_bin == b, F.col("_conf") - hit).otherwise(0.0)).alias(f"_gap{b}") for b in range(n_bins)],
    )
    out = agg.withColumn("ece", sum((F.abs(F.col(f"_gap{b}")) for b in range(n_bins)), F.lit(0.0)) / F.col("n_rows"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    for k, name in enumerate(CLASSES):
        tp = F.col(f"cm_{k}{k}")
        predicted = sum((F.col(f"cm_{t}{k}") for t in range(3)), F.lit(0))
        actual = sum((F.col(f"cm_{k}{p}") for p in range(3)), F.lit(0))
        out = out.withColumns({f"precision_{name}": ratio(tp, predicted), f"recall_{name}": ratio(tp, actual),
                               f"f1_{name}": ratio(2 * tp, predicted + actual)})
    out = out.withColumn("macro_f1", (F.col("f1_H") + F.col("f1_D") + F.col("f1_A")) / 3)
    return out.drop(*[f"_gap{b}" for b in range(n_bins)])


def reliability(predictions: DataFrame, by: list[str], n_bins: int = 5) -> DataFrame:
    """Per class and equal-width bin: count, mean predicted, observed rate. Empty bins are absent."""
    edges = bin_edges(n_bins)
    each = predictions.select(*by, "y", F.explode(F.array(*[
        F.struct(F.lit(k).alias("k"), F.lit(c).alias("class"), F.col(p).alias("p"))
        for k, (c, p) in enumerate(zip(CLASSES, PROBABILITIES))])).alias("s")).select(*by, "y", "s.*")
    each = each.withColumn("bin", bin_of(F.col("p"), n_bins))
    low = F.get(F.array(*[F.lit(e) for e in edges]), F.col("bin"))
    high = F.get(F.array(*[F.lit(e) for e in edges]), F.col("bin") + 1)
    return each.groupBy(*by, "class", "bin").agg(
        F.count("*").alias("n"), F.avg("p").alias("mean_predicted"),
        F.avg(F.when(F.col("y") == F.col("k"), 1.0).otherwise(0.0)).alias("observed_rate"),
    ).withColumns({"bin_low": low, "bin_high": high})


def paired_comparison(a: DataFrame, b: DataFrame, key: list[str], by: list[str] | None = None) -> DataFrame:
    """Mean per-row loss difference a - b with its standard error and the tie flag."""
    by = by or []
    left = a.select(*key, *by, row_loss(PAIRED_FLOOR).alias("_a"))
    right = b.select(*key, row_loss(PAIRED_FLOOR).alias("_b"))
    diff = F.col("_a") - F.col("_b")
    out = left.join(right, key).groupBy(*by).agg(
        F.avg(diff).alias("mean_diff"), F.stddev_samp(diff).alias("_sd"), F.count("*").alias("n"))
    se = F.when(F.col("n") > 1, F.col("_sd") / F.sqrt("n")).otherwise(0.0)
    return out.withColumn("standard_error", se).drop("_sd").withColumn(
        "is_tie", F.when(F.col("standard_error") > 0, F.abs("mean_diff") < 2 * F.col("standard_error")).otherwise(F.col("mean_diff") == 0.0))


def config_summary(predictions: DataFrame, by: list[str]) -> DataFrame:
    """Mean, worst and population spread of the fold log losses per configuration."""
    per_fold = predictions.groupBy(*by, "fold").agg(F.avg(row_loss()).alias("log_loss"))
    return per_fold.groupBy(*by).agg(
        F.avg("log_loss").alias("mean_log_loss"), F.max("log_loss").alias("worst_log_loss"),
        F.stddev_pop("log_loss").alias("log_loss_std"), F.count("*").alias("n_folds"))


def select_best(predictions: DataFrame, key: list[str], ranks: dict[str, int], rank_column: str = "config_id") -> DataFrame:
    """Tie-aware selection: everyone tied with the lowest mean competes on worst
    fold, then simplicity, then spread. One row per configuration, ``selected`` set on one."""
    by = list(dict.fromkeys(["config_id", rank_column]))
    rows = written(predictions.select(*dict.fromkeys([*key, "fold", *by, "y", *PROBABILITIES])), "selection")
    summary = config_summary(rows, by)
    best = summary.agg(F.min_by("config_id", F.struct("mean_log_loss", "config_id")).alias("_best"))  # one row
    marked = rows.join(F.broadcast(best))
    ours = marked.where(F.col("config_id") == F.col("_best")).drop("_best")
    others = marked.where(F.col("config_id") != F.col("_best")).drop("_best")
    # a - b with a the best: the sign does not matter for a tie
    versus = paired_comparison(others, ours, key, ["config_id"]).select("config_id", "mean_diff", "standard_error", "is_tie")
    rank = F.coalesce(F.create_map(*[x for k, v in ranks.items() for x in (F.lit(k), F.lit(v))])[F.col(rank_column)], F.lit(UNRANKED))
    table = summary.join(versus, "config_id", "left").join(F.broadcast(best)).withColumns({
        "is_best_mean": F.col("config_id") == F.col("_best"),
        "is_tied": F.coalesce("is_tie", F.col("config_id") == F.col("_best")),
        "complexity": rank,
    }).drop("is_tie", "_best")
    order = F.struct("worst_log_loss", "complexity", "log_loss_std", "config_id")
    every = W.partitionBy()  # one row a configuration
    return table.withColumn("selected", F.col("config_id") == F.min_by("config_id", F.when(F.col("is_tied"), order)).over(every))


def class_frequencies(train: DataFrame, by: list[str]) -> DataFrame:
    """Training class shares per group: the constant baseline."""
    return train.groupBy(*by).agg(*[
        F.avg(F.when(F.col("y") == k, 1.0).otherwise(0.0)).alias(p) for k, p in enumerate(PROBABILITIES)])
