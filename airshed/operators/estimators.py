"""Estimators usable in the cross-validation loop.

``GroupMeanRegressor`` predicts the training mean of the label per group.  It
is a plain ``pyspark.ml`` Estimator (so the CV loop is estimator-agnostic) and
has an exact SQL formulation, which lets the CV operators be checked against
DuckDB; the gradient-boosted model itself is not SQL-expressible.
"""

from __future__ import annotations

from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasLabelCol, HasPredictionCol
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airshed.session import pinned


class _GroupParams(HasLabelCol, HasPredictionCol):
    groupCol = Param(Params._dummy(), "groupCol", "column whose groups get their own mean",
                     typeConverter=TypeConverters.toString)

    def getGroupCol(self) -> str:
        return self.getOrDefault(self.groupCol)


class GroupMeanRegressor(Estimator, _GroupParams):
    def __init__(self, groupCol: str = "city", labelCol: str = "label",
                 predictionCol: str = "prediction"):
        super().__init__()
        self._setDefault(groupCol="city", labelCol="label", predictionCol="prediction")
        self._set(groupCol=groupCol, labelCol=labelCol, predictionCol=predictionCol)

    def _fit(self, dataset: DataFrame) -> "GroupMeanModel":
        g, y = self.getGroupCol(), self.getLabelCol()
        # Partial aggregation per task first: a hot group is one row per task.
        means = dataset.groupBy(g).agg(F.avg(F.col(y).cast("double")).alias("_group_mean"))
        # Write the one-row-per-group table (fitting is eager anyway): joins
        # are then planned with its measured size, so a small table is
        # broadcast up front and the scored rows are never shuffled; a large
        # one (beyond the broadcast threshold) falls back to a shuffle join.
        m = GroupMeanModel(pinned(dataset.sparkSession, means, "group-means"))
        m._set(groupCol=g, labelCol=y, predictionCol=self.getPredictionCol())
        return m


class GroupMeanModel(Model, _GroupParams):
    def __init__(self, means: DataFrame | None = None):
        super().__init__()
        self.means = means

    def _transform(self, dataset: DataFrame) -> DataFrame:
        g, p = self.getGroupCol(), self.getPredictionCol()
        # One row per group, written: broadcast when its measured size is
        # under the threshold, otherwise a shuffle join (AQE splits skew).
        return (dataset.join(self.means, g, "left")
                .withColumnRenamed("_group_mean", p))
