"""Fitting the layer weights to labels, behind a backtest gate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators.layers import LAYERS, WEIGHTS, combine
from quern.session import Scratch


def labelled(labels: DataFrame, signals: DataFrame, run_id: int | None = None) -> DataFrame:
    """(pubkey, is_spam, layers...): every label with its signals of the run, 0 where there is none."""
    s = signals.filter(F.col("run_id") == run_id) if run_id is not None else signals
    wide = s.join(labels.select("pubkey"), "pubkey", "left_semi").groupBy("pubkey").pivot("layer", LAYERS).agg(F.max("value"))
    return labels.select("pubkey", "is_spam").join(wide, "pubkey", "left").fillna(0.0, LAYERS)


def fit(rows: DataFrame, alpha: float = 0.01, iterations: int = 100) -> dict[str, float]:
    """Logistic regression with an intercept and an L2 penalty ``alpha`` on the summed loss; the solver's penalty is on
    the mean loss, hence alpha / n. Signs point to the spam class."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    data = VectorAssembler(inputCols=LAYERS, outputCol="features").transform(rows.withColumn("label", F.col("is_spam").cast("double")))
    n = data.count()
    model = LogisticRegression(regParam=alpha / n, elasticNetParam=0.0, standardization=False, maxIter=iterations, tol=1e-9).fit(data)
    return dict(zip(LAYERS, (float(x) for x in model.coefficients))) | {"_bias": float(model.intercept)}


def confusion(rows: DataFrame, weights: dict[str, float]) -> tuple[int, int]:
    """(false negatives, false positives) against the labels."""
    r = combine(rows, weights).agg(F.count_if((F.col("is_spam") == 1) & (F.col("suspected") == 0)), F.count_if((F.col("is_spam") == 0) & (F.col("suspected") == 1))).first()
    return r[0], r[1]


def tune(labels: DataFrame, signals: DataFrame, current: dict[str, float] | None = None, run_id: int | None = None) -> tuple[str, dict[str, float]]:
    """('adopted', new weights), or ('blocked: reason', unchanged weights): no labels, one class only, or any label that
    the new weights get wrong."""
    current = WEIGHTS | (current or {})
    rows = Scratch(labels.sparkSession).write(labelled(labels, signals, run_id))  # read by every iteration of the fit
    spam, ham = rows.agg(F.count_if(F.col("is_spam") == 1), F.count_if(F.col("is_spam") == 0)).first()
    if not spam + ham:
        return "blocked: no labels", current
    if not spam or not ham:
        return "blocked: one class only", current
    new = current | fit(rows)
    fn, fp = confusion(rows, new)
    return ("adopted", new) if not fn + fp else (f"blocked: {fn} false negatives, {fp} false positives", current)
