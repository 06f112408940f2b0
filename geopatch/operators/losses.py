"""Losses by name, and an evaluator that chooses models by them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark import keyword_only
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Each loss of an error and a weight, as an aggregate over rows; weighted means divide by the number of rows.
LOSSES: dict[str, Callable[[Column, Column], Column]] = {
    "mse": lambda e, w: F.avg(w * e * e),
    "rmse": lambda e, w: F.sqrt(F.avg(w * e * e)),
    "mae": lambda e, w: F.avg(w * F.abs(e)),
    "me": lambda e, w: F.avg(w * e),
}
#: Losses of which more is not worse.
SIGNED = {"me"}


def loss(name: str, prediction: Column, target: Column, weight: Column | None = None) -> Column:
    if name not in LOSSES:
        raise ValueError(f"unknown loss {name}")
    return LOSSES[name]((prediction - target).cast("double"), F.lit(1.0) if weight is None else weight.cast("double"))


def validation_losses(rows: DataFrame, by: list[str], train: str = "mse", prediction: str = "prediction", target: str = "target") -> DataFrame:
    """``by, loss, RMSE, MAE, ME``: the training loss by name beside the fixed validation measures, in one pass."""
    p, t = F.col(prediction), F.col(target)
    return rows.groupBy(*by).agg(loss(train, p, t).alias("loss"), loss("rmse", p, t).alias("RMSE"), loss("mae", p, t).alias("MAE"), loss("me", p, t).alias("ME"))


class LossEvaluator(Evaluator, DefaultParamsReadable, DefaultParamsWritable):
    """Chooses by a named loss, weighted by a column if given, or averaged over bins of the target if ``binWidth`` is above 0.

    Bins count alike however many rows they have, so a rare range of the target
    weighs as much as a common one.  Of a signed loss the size counts.
    """

    loss = Param(Params._dummy(), "loss", "name of the loss", TypeConverters.toString)
    predictionCol = Param(Params._dummy(), "predictionCol", "column of predictions", TypeConverters.toString)
    labelCol = Param(Params._dummy(), "labelCol", "column of targets", TypeConverters.toString)
    weightCol = Param(Params._dummy(), "weightCol", "column of weights, none if empty", TypeConverters.toString)
    binWidth = Param(Params._dummy(), "binWidth", "width of the target's bins, none if 0", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, loss: str = "rmse", predictionCol: str = "prediction", labelCol: str = "label", weightCol: str = "", binWidth: float = 0.0):
        super().__init__()
        self._setDefault(loss="rmse", predictionCol="prediction", labelCol="label", weightCol="", binWidth=0.0)
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _evaluate(self, dataset: DataFrame) -> float:
        get = self.getOrDefault
        weight, width, name = get(self.weightCol), get(self.binWidth), get(self.loss)
        target = F.col(get(self.labelCol))
        value = loss(name, F.col(get(self.predictionCol)), target, F.col(weight) if weight else None)
        rows = dataset.groupBy(F.floor(target / width)).agg(value.alias("v")).agg(F.avg("v")) if width else dataset.agg(value)
        found = rows.first()[0]
        return float("inf") if found is None else abs(found) if name in SIGNED else float(found)

    def isLargerBetter(self) -> bool:
        return False
