"""The document-signal model over one data directory, built lazily."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from .. import bindings as B
from .. import lexicon as L
from ..operators import scoring, tagging


@dataclass
class Model:
    spark: SparkSession
    sf_dir: str
    as_of: str = L.AS_OF

    @cached_property
    def D(self) -> DataFrame:
        return B.documents_view(self.spark, self.sf_dir, self.as_of)

    @cached_property
    def Dn(self) -> DataFrame:
        """D after the tagging pass: country aliases normalised (P10)."""
        return self.D.withColumn("country", tagging.normalize_country("country"))

    @cached_property
    def S(self) -> DataFrame:
        return B.sources_view(self.spark, self.sf_dir)

    @cached_property
    def K(self) -> DataFrame:
        return B.lexicon_view(self.spark)

    @cached_property
    def G(self) -> DataFrame:
        """Signals: exact and fuzzy tagging of D with K."""
        return tagging.tag(self.D, self.K)

    @cached_property
    def flags(self) -> DataFrame:
        return tagging.document_flags(self.D, self.S, self.K)

    @cached_property
    def scored(self) -> DataFrame:
        """Tag -> flags -> score (see scoring.score_documents)."""
        return scoring.score_documents(self.D, self.S, self.K, self.as_of)


def model(spark: SparkSession, sf_dir: str, as_of: str = L.AS_OF) -> Model:
    return Model(spark, sf_dir, as_of)
