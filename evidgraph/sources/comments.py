"""Tagged comments, as column expressions over exploded lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The tags, and the markers that open a comment.
TAGS = "WHY DECISION HACK NOTE TODO FIXME XXX BUG WARNING OPTIMIZE".split()
MARKERS = "#|//|/\\*|<!--|--"

_BODY = rf"(?i)(?:{MARKERS}|\*)\s*({'|'.join(TAGS)})\b[:\-\s]*(.+?)\s*(?:\*/|-->)?\s*$"
_BEFORE = rf"^(.*?)(?:{MARKERS})"


def tagged_lines(files: DataFrame) -> DataFrame:
    """(path, line, tag, note) of files (path, content). A line counts if its
    first marker does not stand inside a string: quotes before it are even."""
    lines = files.select("path", F.posexplode(F.split("content", "\n")).alias("i", "text"))
    found = lines.filter(F.col("text").rlike(_BODY)).select(
        "path", (F.col("i") + 1).alias("line"), "text",
        F.upper(F.regexp_extract("text", _BODY, 1)).alias("tag"), F.trim(F.regexp_extract("text", _BODY, 2)).alias("note"),
        F.regexp_extract("text", _BEFORE, 1).alias("before"))
    quotes = lambda q: F.regexp_count("before", F.lit(q)) - F.regexp_count("before", F.lit("\\\\" + q))
    return found.filter((quotes('"') % 2 == 0) & (quotes("'") % 2 == 0) & (F.col("note") != "")).select("path", "line", "tag", "note")


def labels(comments: DataFrame) -> DataFrame:
    """The node label of each comment."""
    return comments.withColumn("label", F.concat("tag", F.lit(": "), F.substring("note", 1, 80)))
