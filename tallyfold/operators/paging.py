"""Pages of a report and their totals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: largest page a list may ask for.
MAX_PAGE_SIZE = 500


def clamp(page: int, per_page: int, most: int | None = MAX_PAGE_SIZE) -> tuple[int, int]:
    """Page number and size within bounds; ``most`` None sets no largest size."""
    size = max(1, int(per_page))
    return max(1, int(page)), size if most is None else min(most, size)


def page_of(
    df: DataFrame, order: Sequence[Column], page: int = 1, per_page: int = 100, most: int | None = None
) -> DataFrame:
    """One page. ``order`` ends in a unique column, so pages never overlap.
    A list with a largest page size names it as ``most``."""
    page, per_page = clamp(page, per_page, most)
    return df.orderBy(*order).offset((page - 1) * per_page).limit(per_page)


def page_total(df: DataFrame, page: int = 1, per_page: int = 100, most: int | None = None) -> DataFrame:
    """total, page, per_page and pages of the unpaged frame, as one row."""
    page, per_page = clamp(page, per_page, most)
    total = F.count(F.lit(1))
    pages = F.greatest(F.ceil(total / per_page), F.lit(1)).cast("long")
    return df.agg(
        total.alias("total"),
        F.lit(page).alias("page"),
        F.lit(per_page).alias("per_page"),
        pages.alias("pages"),
    )


def sorted_by(df: DataFrame, column: str, descending: bool = False, tie_break: str | None = None) -> DataFrame:
    """Order by any column; its declared type decides numeric or text order."""
    order = [F.col(column).desc() if descending else F.col(column).asc()]
    if tie_break and tie_break != column:
        order.append(F.col(tie_break).asc())
    return df.orderBy(*order)
