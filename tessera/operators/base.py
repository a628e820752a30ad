"""What encoders and clusterers have in common: estimators that are fitted once, and the models that they give."""

from __future__ import annotations

from abc import ABC, abstractmethod

from pyspark.sql import DataFrame, SparkSession


class Model(ABC):
    """Fitted state: small, held by the driver, sent to tasks with each pass."""

    @abstractmethod
    def transform(self, df: DataFrame) -> DataFrame:
        """The rows with what the model finds for each."""

    @abstractmethod
    def save(self, spark: SparkSession, path: str) -> None:
        """Parquet and JSON below ``path``, which ``load`` reads."""

    @classmethod
    @abstractmethod
    def load(cls, spark: SparkSession, path: str) -> Model: ...


class Estimator(ABC):
    @abstractmethod
    def fit(self, df: DataFrame) -> Model: ...

    def fit_transform(self, df: DataFrame) -> DataFrame:
        return self.fit(df).transform(df)
