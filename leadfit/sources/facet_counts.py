"""Counts over the lead table that follow its changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadfit.operators.facets import facet_deltas
from leadfit.sources.tables import VersionedTable

COUNTS = "facet string, value string, n long"


class FacetCounts:
    """Facet counts below a root folder: changed leads are counted, the others never read again.

    Each change has a name of its own (a table version, a batch). The counts and the names of the changes they hold are
    written together as one version, so a change that is delivered again, or whose job failed half-way, counts once.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.table = VersionedTable(spark, self.root)

    def _stored(self) -> DataFrame:
        rows = self.table.read()
        return rows if rows is not None else self.spark.createDataFrame([], f"{COUNTS}, change string")

    def read(self) -> DataFrame:
        """facet, value, n."""
        return self._stored().where(F.col("change").isNull()).select("facet", "value", "n")

    def changes(self) -> DataFrame:
        """Names of the changes that are counted."""
        return self._stored().where(F.col("change").isNotNull()).select("change")

    def apply(self, change: str, before: DataFrame | None, after: DataFrame) -> bool:
        """Counts the leads in `after` instead of those in `before`; False, if the change was counted already."""
        if self.changes().where(F.col("change") == change).limit(1).count():
            return False
        deltas = facet_deltas(before, after).unionByName(self.read())
        counts = deltas.groupBy("facet", "value").agg(F.sum("n").alias("n")).where(F.col("n") != 0)
        names = self.changes().unionByName(self.spark.createDataFrame([(change,)], "change string"))
        self.table.write(counts.unionByName(names, allowMissingColumns=True))
        return True
