"""File scans below a root."""

from __future__ import annotations

import fnmatch
import os
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.predicates import IGNORED_DIRECTORIES, glob_regex, has_ignored_directory, matches_glob

CODE_SUFFIXES = ".py .ts .tsx .js .jsx .mjs .cjs .go .rs .java .cs .json .yaml .yml".split()


@dataclass
class Config:
    """What to scan. Paths are relative to the root and may not leave it."""

    records_dir: str = "records"
    include: list[str] = field(default_factory=lambda: ["**/*"])
    exclude: list[str] = field(default_factory=list)
    suffixes: list[str] = field(default_factory=lambda: list(CODE_SUFFIXES))
    source_roots: list[str] = field(default_factory=lambda: ["src"])
    max_depth: int = 2
    max_items: int = 20

    def __post_init__(self) -> None:
        if ".." in Path(self.records_dir).parts or Path(self.records_dir).is_absolute():
            raise ValueError("records_dir must stay below the root")
        if any(not p.strip() for p in self.include + self.exclude):
            raise ValueError("empty pattern")


def load_config(path: str) -> Config:
    """YAML over the defaults; unknown keys are errors."""
    import yaml

    with open(path, encoding="utf-8") as f:
        given = yaml.safe_load(f) or {}
    unknown = set(given) - set(Config.__dataclass_fields__)
    if unknown:
        raise ValueError(f"unknown keys: {sorted(unknown)}")
    return Config(**given)


def ignored_name(name: str) -> bool:
    low = name.casefold()
    return low in IGNORED_DIRECTORIES or low.startswith((".venv", "venv-", "venv_")) or low == "venv"


def list_paths(root: str) -> list[str]:
    """Relative paths below ``root``, ignored directories cut off before
    they are entered, links left out, in order. For local trees; on a shared
    store ``scan`` filters what the reader lists."""
    out = []
    for here, dirs, names in os.walk(root, followlinks=False):
        dirs[:] = sorted(d for d in dirs if not ignored_name(d) and not os.path.islink(os.path.join(here, d)))
        out += [os.path.relpath(os.path.join(here, n), root) for n in sorted(names) if not os.path.islink(os.path.join(here, n))]
    return sorted(out)


def selected(path: str, config: Config) -> bool:
    import re

    hit = lambda ps: any(re.match(glob_regex(p), path) or fnmatch.fnmatch(path, p) for p in ps)
    return not hit(config.exclude) and hit(config.include)


def scan(spark: SparkSession, root: str, config: Config | None = None, all_suffixes: bool = False) -> DataFrame:
    """(path, content, hash, length): text files below ``root`` through Spark's
    binary reader, so any file system that Spark opens works. Excludes come
    first, then includes, then the suffix."""
    config = config or Config()
    base = root.rstrip("/")
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base)
    marker = base.split("://")[-1].removeprefix("file:").lstrip("/")
    rel = F.regexp_replace(_relative(F.col("path"), marker), "^/+", "")
    files = raw.select(rel.alias("path"), "content", "length")
    keep = ~has_ignored_directory(F.col("path")) & ~matches_glob(F.col("path"), config.exclude) & matches_glob(F.col("path"), config.include)
    if not all_suffixes:
        suffix = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
        keep = keep & suffix.isin(config.suffixes)
    kept = files.filter(keep)
    text = F.try_validate_utf8(F.col("content").cast("string"))
    return kept.select("path", text.alias("content"), F.sha2("content", 256).alias("hash"), "length")


def _relative(path, marker: str):
    return F.when(F.instr(path, marker) > 0, F.substring(path, F.instr(path, marker) + len(marker), F.lit(10_000))).otherwise(path)


def skipped(spark: SparkSession, root: str, config: Config) -> DataFrame:
    """LANG001: included files whose suffix has no extractor."""
    every = scan(spark, root, config, all_suffixes=True)
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    return every.filter(~suffix.isin(config.suffixes)).select(
        F.lit("LANG001").alias("code"), F.lit("warning").alias("severity"), F.concat(F.lit("no extractor for "), suffix).alias("message"), "path")
