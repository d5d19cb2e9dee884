"""The feature table as a pyspark.ml Transformer, for use in an ML Pipeline."""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame

from tickloom.operators.features import features


class FeatureTable(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Bars to features.  ``macroTable`` and ``sentimentTable`` name tables or views; empty means none."""

    training = Param(Params._dummy(), "training", "drop rows without a target", TypeConverters.toBoolean)
    macroTable = Param(Params._dummy(), "macroTable", "table of macro returns per date", TypeConverters.toString)
    sentimentTable = Param(Params._dummy(), "sentimentTable", "table of sentiment per symbol and date", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, training: bool = True, macroTable: str = "", sentimentTable: str = ""):
        super().__init__()
        self._setDefault(training=True, macroTable="", sentimentTable="")
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        def named(param: Param) -> DataFrame | None:
            name = self.getOrDefault(param)
            return dataset.sparkSession.table(name) if name else None

        return features(
            dataset, named(self.macroTable), named(self.sentimentTable), training=self.getOrDefault(self.training)
        )
