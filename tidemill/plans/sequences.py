"""A sequence model: a perceptron on a matrix of lags, judged out of sample beside controls that must come out at chance and far above it."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.functions import stats as st

#: Share of labels of the planted control that are turned over, in percent.
TURNED = 10


def lagged(df: DataFrame, by: str, order: str, series: list[str], lags: int) -> tuple[DataFrame, list[str]]:
    """df with the last ``lags`` values of each series as columns, newest first, and their names; rows with a missing one are left out."""
    w = Window.partitionBy(by).orderBy(order)
    columns = {f"{s}_lag{j}": F.lag(s, j).over(w).cast("double") for s in series for j in range(lags)}
    return df.withColumns(columns).dropna(subset=list(columns)), list(columns)


def _drawn(seed: int, below: int, *keys: str) -> Column:
    return F.pmod(F.xxhash64(*keys, F.lit(seed)), F.lit(below))


def controls(df: DataFrame, keys: list[str], newest: str, before: str, seed: int = 0) -> DataFrame:
    """df with ``noise``, labels drawn by a hash of the keys, and ``planted``, whether the newest value is over the one before, TURNED percent of them turned over."""
    sign = (F.col(newest) > F.col(before)).cast("int")
    turned = (_drawn(seed + 1, 100, *keys) < TURNED).cast("int")
    return df.withColumns({"noise": _drawn(seed, 2, *keys).cast("int"), "planted": sign.bitwiseXOR(turned)})


def walk(df: DataFrame, order: str, x: list[str], y: str, splits: int, gap: int, hidden: tuple[int, ...] = (16, 8), steps: int = 40, seed: int = 0) -> DataFrame:
    """The rows after the first of ``splits`` + 1 equal spans of ``order``, each with the probability ``p`` of a model fitted on all that lies ``gap`` or more before its span.

    A fit is a job a step over all rows, whose gradients are summed in the tasks; only weights reach the driver.
    """
    lo, hi = df.agg(F.min(order), F.max(order)).first()
    parts = [VectorAssembler(inputCols=x, outputCol="_raw"), StandardScaler(withMean=True, inputCol="_raw", outputCol="_x")]
    parts.append(MultilayerPerceptronClassifier(layers=[len(x), *hidden, 2], featuresCol="_x", labelCol=y, maxIter=steps, seed=seed, probabilityCol="_p", rawPredictionCol="_margin", predictionCol="_said"))
    out = None
    for k in range(1, splits + 1) if lo is not None else ():
        start, stop = (lo + (hi + 1 - lo) * n // (splits + 1) for n in (k, k + 1))
        past = df.filter(F.col(order) < start - gap)
        if past.isEmpty():
            continue
        model = Pipeline(stages=parts).fit(past)
        now = model.transform(df.filter((F.col(order) >= start) & (F.col(order) < stop)))
        now = now.withColumn("p", F.element_at(vector_to_array("_p"), 2)).select(*df.columns, "p")
        out = now if out is None else out.unionByName(now)
    return df.withColumn("p", F.lit(None).cast("double")).limit(0) if out is None else out


def judged(rows: DataFrame, y: str) -> dict[str, float]:
    """n, accuracy, area under the curve, and accuracy of the surest twentieth."""
    limit = rows.agg(F.percentile_approx(F.abs(F.col("p") - 0.5), 0.95, 10_000)).first()[0]
    right = (F.col("p") > 0.5) == (F.col(y) == 1)
    n, acc, top = rows.agg(F.count("*"), st.share(right), F.avg(F.when(F.abs(F.col("p") - 0.5) >= limit, F.when(right, 1.0).otherwise(0.0)))).first()
    auc = BinaryClassificationEvaluator(rawPredictionCol="p", labelCol=y, numBins=0).evaluate(rows.withColumn(y, F.col(y).cast("double"))) if n else None
    return {"n": n, "accuracy": acc, "auc": auc, "surest": top}
