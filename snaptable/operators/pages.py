"""Pages of a sorted table at any depth: rows laid out in order once, and an index of how many each file has.

A page is found by running sums over the index, and is read by row numbers from the files that hold it alone: one
file, or two where it lies across their border. How deep it lies does not matter.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import files


class Pages:
    """A table in pages, written by lay_out()."""

    def __init__(self, spark: SparkSession, path: str, groups: Sequence[str], order: Sequence[str]):
        self.spark, self.path, self.groups, self.order = spark, path.rstrip("/"), list(groups), list(order)

    @classmethod
    def lay_out(cls, df: DataFrame, path: str, groups: Sequence[str], order: Sequence[str]) -> Pages:
        """Write df by groups and in order within them, ascending, nulls first. Rows that are equal in order are in any
        one order, which stays."""
        own = cls(df.sparkSession, path, groups, order)
        by = [F.col(f"`{c}`") for c in (*groups, *order)]
        df.repartitionByRange(*by).sortWithinPartitions(*by).write.parquet(f"{own.path}/rows")
        rows = own._rows()
        index = rows.groupBy(F.col("_metadata.file_name").alias("file_"), *groups).agg(F.count(F.lit(1)).alias("n_"), F.min("_metadata.row_index").alias("first_"))
        index.coalesce(1).write.parquet(f"{own.path}/index")
        return own

    def _rows(self, *names: str) -> DataFrame:
        """Rows of some files, or of all."""
        return self.spark.read.parquet(*[f"{self.path}/rows/{n}" for n in names] or [f"{self.path}/rows"])

    def _index(self, values: Sequence) -> DataFrame:
        """Files that have rows of a group, in their order: that of their names."""
        of = F.lit(True)
        for c, v in zip(self.groups, values, strict=True):
            of = of & F.col(f"`{c}`").eqNullSafe(F.lit(v))
        return self.spark.read.parquet(f"{self.path}/index").filter(of).orderBy("file_")

    def totals(self) -> DataFrame:
        """The groups and the total of each, from the index alone."""
        return self.spark.read.parquet(f"{self.path}/index").groupBy(*self.groups).agg(F.sum("n_").alias("total"))

    def total(self, *values) -> int:
        return self._index(values).agg(F.sum("n_")).first()[0] or 0

    def page(self, *values, offset: int = 0, limit: int = 50) -> DataFrame:
        """Rows offset to offset + limit of a group, in order, with total, how many there are in all. Past the end there are none."""
        before, parts, total = 0, [], 0
        for r in (found := self._index(values).collect()):  # a row a file
            low, high = max(offset, before), min(offset + limit, before + r["n_"])
            if low < high:
                parts.append((r["file_"], r["first_"] + low - before, r["first_"] + high - before))
            before += r["n_"]
        total = sum(r["n_"] for r in found)
        rows = self._rows(*[file for file, _, _ in parts]) if parts else self._rows().limit(0)
        if parts:
            wanted = F.lit(False)
            for file, first, end in parts:
                wanted = wanted | (F.col("_metadata.file_name") == file) & (F.col("_metadata.row_index") >= first) & (F.col("_metadata.row_index") < end)
            rows = rows.filter(wanted).orderBy("_metadata.file_name", "_metadata.row_index")
        return rows.withColumn("total", F.lit(total).cast("long"))

    def drop(self) -> None:
        files.delete(self.spark, self.path)


def after(order: Sequence[tuple[Column, bool, object]]) -> Column:
    """Rows that come after a given one: (column, ascending, its value there) in order of precedence, nulls first when
    ascending and last when descending. With a filter like this a next page needs no offset."""
    out = F.lit(False)
    for c, ascending, v in reversed(order):
        if v is None:
            beyond = c.isNotNull() if ascending else F.lit(False)
            same = c.isNull()
        else:
            beyond = c > F.lit(v) if ascending else (c < F.lit(v)) | c.isNull()
            same = c.eqNullSafe(F.lit(v))
        out = F.coalesce(beyond, F.lit(False)) | (same & out)
    return out
