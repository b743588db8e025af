"""Spreadsheet blocks as a long table of cells: ``sheet, sheet_pos, row, col, value``.

Rows and columns count from 0 within the sheet. Workbooks are unpacked into this table once,
upstream; from there on they are ordinary data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from comarca import fixed_values as fixed
from comarca.functions.numeric import number_or_null

CELLS = "sheet string, sheet_pos int, row int, col int, value string"


def last_column_range(
    cells: DataFrame,
    header_row: int = fixed.GDP_HEADER_ROW,
    first_row: int = fixed.GDP_FIRST_ROW,
    last_row: int = fixed.GDP_LAST_ROW,
    label_header: str = fixed.GDP_LABEL_HEADER,
    value: str = "pib_total",
) -> DataFrame:
    """Label and last column of a row range, per sheet.

    Rows count from the one below the header. The last column is last by position, so an
    empty cell there is a missing value and not the year before.
    """
    body = F.col("row") - (header_row + 1)
    layout = (
        cells.where(F.col("row") >= header_row)
        .groupBy("sheet")
        .agg(
            F.max("col").alias("_last"),
            F.min(F.when((F.col("row") == header_row) & (F.col("value") == label_header), F.col("col"))).alias("_label"),
        )
    )
    wanted = cells.where(body.between(first_row, last_row)).join(layout, "sheet")
    return (
        wanted.where(F.col("col").isin(F.col("_label"), F.col("_last")))
        .groupBy("sheet", "row")
        .agg(
            F.max(F.when(F.col("col") == F.col("_label"), F.col("value"))).alias("estado"),
            F.max(F.when(F.col("col") == F.col("_last"), F.col("value"))).alias(value),
        )
        .select("sheet", "row", "estado", value)
    )


def sheets_but(cells: DataFrame, skipped: str = fixed.POVERTY_SKIPPED_SHEET, header_row: int = fixed.POVERTY_HEADER_ROW) -> DataFrame:
    """Cells below the header of every sheet except ``skipped``."""
    return cells.where((F.col("sheet") != skipped) & (F.col("row") > header_row))


def labelled_values(
    cells: DataFrame,
    labels: Sequence[tuple[str, str]] = tuple(fixed.POVERTY_LABELS),
    label_column: int = fixed.POVERTY_LABEL_COLUMN,
    value_column: int = fixed.POVERTY_VALUE_COLUMN,
) -> DataFrame:
    """Per sheet, the value of the first row whose label matches each pattern.

    Patterns are regular expressions, letters match in either case. Labels are matched where
    they are read: only flags and numbers are shuffled, never the texts, and both groupings
    combine map-side. A value that is no number is null, and so is a pattern no row matches.
    """
    is_label, is_value = F.col("col") == label_column, F.col("col") == value_column
    matched = cells.where(is_label | is_value).select(
        "sheet", "sheet_pos", "row",
        F.when(is_value, number_or_null(F.col("value"))).alias("_value"),
        *[F.when(is_label, F.col("value").rlike(f"(?iu){pattern}")).alias(f"_is_{name}") for name, pattern in labels],
    )
    rows = matched.groupBy("sheet", "sheet_pos", "row").agg(
        F.max("_value").alias("_value"), *[F.max(f"_is_{name}").alias(f"_is_{name}") for name, _ in labels]
    )
    found = rows.groupBy("sheet", "sheet_pos").agg(
        *[
            F.min_by(F.coalesce("_value", F.lit(float("nan"))), F.when(F.col(f"_is_{name}"), F.col("row"))).alias(name)
            for name, _ in labels
        ]
    )
    return found.select(
        "sheet", "sheet_pos", *[F.when(~F.isnan(name), F.col(name)).alias(name) for name, _ in labels]
    )


def without_first_sheet(values: DataFrame, cells: DataFrame | None = None) -> DataFrame:
    """Leave out the sheet that comes first (the national one).

    With ``cells``, from which the values were read, the first sheet is looked up by its position
    alone, and no text is read a second time."""
    first = (values if cells is None else cells).agg(F.min("sheet_pos").alias("p")).scalar()
    return values.where(F.col("sheet_pos") > first)
