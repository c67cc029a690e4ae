"""Links of web pages, as column expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def links(pages: DataFrame) -> DataFrame:
    """(page_id, nth, href), counted from 1 in page order."""
    hrefs = F.regexp_extract_all("html", F.lit(r'<a\s[^>]*?href="([^"]*)"'), F.lit(1))
    return pages.select("page_id", F.posexplode(hrefs).alias("i", "href")).select("page_id", (F.col("i") + 1).alias("nth"), "href")
