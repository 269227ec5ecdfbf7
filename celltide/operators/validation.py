"""Checks of matrices and embeddings against what is recorded of them, and their repair."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class Report:
    passed: list[str] = field(default_factory=list)
    failed: list[str] = field(default_factory=list)

    @property
    def ok(self) -> bool:
        return not self.failed

    def check(self, name: str, good: bool) -> None:
        (self.passed if good else self.failed).append(name)


def matrix_bounds(coo: DataFrame) -> DataFrame:
    return coo.agg(F.count("*").alias("nnz"), F.coalesce(F.max("row_idx") + 1, F.lit(0)).alias("rows"), F.coalesce(F.max("col_idx") + 1, F.lit(0)).alias("cols"), F.coalesce(F.min(F.least("row_idx", "col_idx")), F.lit(0)).alias("least"))


def check_matrix(report: Report, name: str, coo: DataFrame, n_rows: int, n_cols: int, entity_rows: int | None, entity_cols: int | None) -> None:
    b = matrix_bounds(coo).first()
    report.check(f"matrix_rows:{name}", 0 <= b["least"] and b["rows"] <= n_rows and (entity_rows is None or n_rows == entity_rows))
    report.check(f"matrix_cols:{name}", b["cols"] <= n_cols and (not entity_cols or n_cols == entity_cols))


def check_order(report: Report, name: str, coo: DataFrame) -> None:
    """No position comes twice."""
    report.check(f"matrix_positions:{name}", coo.groupBy("row_idx", "col_idx").count().where("count > 1").isEmpty())


def truncated(coo: DataFrame, n_rows: int, n_cols: int | None = None) -> DataFrame:
    """Entries within the axes."""
    out = coo.where((F.col("row_idx") >= 0) & (F.col("row_idx") < n_rows))
    return out if n_cols is None else out.where((F.col("col_idx") >= 0) & (F.col("col_idx") < n_cols))


def without_orphans(rows: DataFrame, owners: DataFrame, key: str) -> DataFrame:
    """Rows whose owner is recorded."""
    return rows.join(owners.select(key).distinct(), key, "left_semi")


def orphans(rows: DataFrame, owners: DataFrame, key: str) -> DataFrame:
    return rows.join(owners.select(key).distinct(), key, "left_anti")
