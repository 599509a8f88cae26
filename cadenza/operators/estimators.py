"""Adjusted pace by efficiency as a stage of pyspark.ml: it is fitted, saved, loaded, put into pipelines and cross-validated."""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasPredictionCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame

from cadenza import constants as C
from cadenza.operators import curves as K
from cadenza.session import kept


class EfficiencyParams(HasPredictionCol):
    """What the estimator and its model share."""

    perBucket = Param(Params._dummy(), "perBucket", "splits of one bucket of gradient", TypeConverters.toInt)
    minFlat = Param(Params._dummy(), "minFlat", "efficiencies are relative to the flat median if there are more flat splits than this", TypeConverters.toInt)

    def __init__(self):
        super().__init__()
        self._setDefault(perBucket=250, minFlat=C.MIN_FLAT, predictionCol="gap")


class EfficiencyEstimator(Estimator, EfficiencyParams, DefaultParamsReadable, DefaultParamsWritable):
    """Learns buckets of gradient from splits (activity_id, split_id, speed, elevation_gain, heartrate)."""

    @keyword_only
    def __init__(self, *, perBucket: int = 250, minFlat: int = C.MIN_FLAT, predictionCol: str = "gap"):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> EfficiencyModel:
        """The splits and the buckets are written to the shared folder as checkpoints, so a model isn't fitted anew wherever it predicts.
        Raises if no split has an efficiency."""
        rated = K.with_efficiency(kept(dataset), least_flat=self.getOrDefault("minFlat"))
        buckets = kept(K.equi_depth_curve(rated, self.getOrDefault("perBucket")))
        if buckets.filter("mean is not null").isEmpty():
            raise K.NothingToLearn("no split has both a heart rate and a speed")
        return self._copyValues(EfficiencyModel(buckets))


class EfficiencyModel(Model, EfficiencyParams, MLReadable, MLWritable):
    """buckets: (bucket, bin_center, mean, std, count). Points without a gradient have no nearest bucket, and no row in what
    transform gives, as in `curves.predict_nearest`."""

    def __init__(self, buckets: DataFrame):
        super().__init__()
        self.buckets = buckets

    def _transform(self, dataset: DataFrame) -> DataFrame:
        to = self.getOrDefault("predictionCol")
        if to in dataset.columns:
            raise ValueError(f"there is a column {to} already")
        return K.predict_nearest(dataset, self.buckets).withColumnRenamed("gap", to)

    def curve(self) -> DataFrame:
        return self.buckets.drop("bucket")

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader()


class _Writer(MLWriter):
    def __init__(self, model: EfficiencyModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession)
        self.model.buckets.write.parquet(f"{path}/buckets")


class _Reader(MLReader):
    def load(self, path: str) -> EfficiencyModel:
        told = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = EfficiencyModel(self.sparkSession.read.parquet(f"{path}/buckets"))
        model._resetUid(told["uid"])
        DefaultParamsReader.getAndSetParams(model, told)
        return model
