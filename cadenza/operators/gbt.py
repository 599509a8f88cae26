"""Gradient-boosted regression of flat speed from speed, gradient and heart rate.

Every split would be trained on beside each flat split of a like heart rate: pairs, whose number grows with the square
of the splits. For a squared loss the pairs of one split say no more than their mean and number, so the model is trained
on that, a row for each split and part, with the number as its weight (`curves.flat_speed_targets`)."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza import constants as C
from cadenza.operators import curves as K
from cadenza.session import kept

FEATURES = ["speed", "elevation_gain", "heartrate"]
#: Rows of a training task.
ROWS = 50_000


class BoostedGap:
    """fit, predict and curve, on Spark's own boosted trees: 100 rounds of depth 6 at step 0.3, as boosting libraries have by default."""

    def __init__(self, rounds: int = 100, depth: int = 6, step: float = 0.3, seed: int = 42, bin_width: float = 20.0):
        self.regressor = GBTRegressor(featuresCol="features", labelCol="y", weightCol="n", maxIter=rounds, maxDepth=depth, stepSize=step, seed=seed)
        self.assembler = VectorAssembler(inputCols=FEATURES, outputCol="features")
        self.bin_width = bin_width
        self.model = None
        self.test = None

    def fit(self, splits: DataFrame, tolerance: float = C.HR_TOLERANCE) -> BoostedGap:
        """Trains on the splits beside the flat ones of a like heart rate. Raises if no split of the training part has one."""
        return self.fit_targets(K.flat_speed_targets(splits, tolerance))

    def fit_targets(self, targets: DataFrame) -> BoostedGap:
        """As fit, from the rows of flat_speed_targets.

        A tree takes a job for each of its levels, and a job costs most by its tasks while there are few rows, so rows are
        dealt to tasks of about ROWS; they have the same place on every run."""
        targets = kept(targets)
        train = targets.filter("part = 'train'")
        tasks = -(-train.count() // ROWS)
        if not tasks:
            raise K.NothingToLearn("no split has a flat one of a like heart rate")
        train = self.assembler.transform(train.repartition(tasks, *K.KEYS).sortWithinPartitions(*K.KEYS)).select("features", "y", F.col("n").cast("double").alias("n")).persist()
        try:
            self.model = self.regressor.fit(train)
        finally:
            train.unpersist()
        self.test = targets.filter("part = 'test'")
        return self

    def predict(self, points: DataFrame) -> DataFrame:
        """The points with prediction (a flat speed) and adjuster, the prediction by their speed."""
        if self.model is None:
            raise RuntimeError("fit the model first")
        told = self.model.transform(self.assembler.transform(points)).drop("features")
        return told.withColumn("adjuster", F.try_divide("prediction", "speed"))

    def curve(self, heartrate_range: tuple[float, float] | None = None) -> DataFrame:
        """Adjusters of the test part in bins of gradient, of one range of heart rates if that is given, edges included. Raises if no split is in it."""
        if self.test is None:
            raise RuntimeError("fit the model first")
        points = self.test
        if heartrate_range is not None:
            points = K.in_range(points, heartrate_range)
        return K.equi_width_curve(self.predict(points), self.bin_width, weight="n")
