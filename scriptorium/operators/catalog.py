"""Catalogue queries: facet filters, total orders, pages, neighbours, related records."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAGE_SIZE = 24
ALL = "all"


@dataclass(frozen=True)
class Page:
    number: int = 1
    size: int = PAGE_SIZE


def facet_filter(df: DataFrame, **facets: str) -> DataFrame:
    """Equality filters joined by AND; the value 'all' passes every row."""
    for column, value in facets.items():
        if value != ALL:
            df = df.where(F.col(column) == value)
    return df


def all_terms_in(haystack: Column, query: str) -> Column:
    """Every white-space separated, lower-cased term of the query is in the text; true for an empty query."""
    test = F.lit(True)
    for term in query.lower().split():
        test = test & F.contains(haystack, F.lit(term))
    return test


def page_of(df: DataFrame, order: list[Column], page: Page) -> DataFrame:
    """One page in a total order. The page number is clamped to the pages there are.

    The rows up to the end of the page come from a top-k, so that no global sort takes place; only
    these few are numbered."""
    total = df.count()
    pages = max(1, -(-total // page.size))
    number = min(max(1, page.number), pages)
    top = df.orderBy(*order).limit(number * page.size)
    numbered = top.withColumn("position", F.row_number().over(Window.orderBy(*order)))
    return numbered.where(F.col("position") > (number - 1) * page.size)
