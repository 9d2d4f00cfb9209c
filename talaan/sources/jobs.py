"""Batch jobs from CSV or rows, categories, and the registry of sources."""

from __future__ import annotations

import difflib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talaan.functions.text import strip
from talaan.runtime import cut

MAX_JOBS = 500


def read_jobs(spark: SparkSession, path: str) -> DataFrame:
    """``row``, ``category``, ``location``, ``limit_n``, ``sources``, ``error``: the jobs of one CSV file.

    Headers are read without case and byte-order mark. Rows are numbered from 1 over all data rows; blank and # rows are then left out.
    """
    lines = spark.read.text(path, wholetext=True).first()
    import csv
    import io

    rows = list(csv.DictReader(io.StringIO((lines.value if lines else "").lstrip("﻿"))))
    rows = [{(k or "").strip().lower(): v for k, v in r.items()} for r in rows]
    return parse_jobs(spark, rows)


def parse_jobs(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """``rows`` of a sheet or CSV as jobs; each row's first error is reported. More than 500 jobs are refused."""
    data = [(i + 1, *(str(r.get(c) or "") for c in ("category", "location", "limit", "sources"))) for i, r in enumerate(rows)]
    j = spark.createDataFrame(data, "row int, category string, location string, lim string, sources string")
    j = j.select("row", *(strip(F.col(c)).alias(c) for c in ("category", "location", "lim", "sources")))
    j = j.where((F.concat("category", "location", "lim", "sources") != "") & ~F.col("category").startswith("#"))
    n = F.col("lim").try_cast("int")
    error = F.when(F.col("category") == "", "no category").when(F.col("location") == "", "no location").when((F.col("lim") != "") & (n.isNull() | ~n.between(1, 5000)), "limit must be 1 to 5000")
    if j.count() > MAX_JOBS:
        raise ValueError(f"more than {MAX_JOBS} jobs")
    return j.select("row", "category", "location", n.alias("limit_n"), F.filter(F.transform(F.split("sources", r"[;|]"), strip), lambda s: s != "").alias("sources"), error.alias("error"))


def resolve_category(name: str, categories: dict[str, dict]) -> tuple[str | None, list[str]]:
    """The key of a category by key, label or synonym, else up to three suggestions."""
    key = name.strip().lower().replace("-", "_").replace(" ", "_")
    if key in categories:
        return key, []
    alias = {a.lower(): k for k, c in categories.items() for a in [c.get("label", k), *c.get("synonyms", [])]}
    if name.strip().lower() in alias:
        return alias[name.strip().lower()], []
    close = difflib.get_close_matches(name.strip().lower(), [*alias, *categories], 3, 0.6)
    return None, list(dict.fromkeys(alias.get(c, c) for c in close))


def load_categories(text: str) -> dict[str, dict]:
    """Categories of a YAML text of keys with ``label``, ``synonyms``, ``osm`` and ``overture`` as plain values or lists.

    Read by the yaml package where there is one, else by the subset that such files use: nesting by indent, dashes or brackets for lists.
    A category without a source's values, or a synonym of two categories, is an error.
    """
    try:
        import yaml

        found = yaml.safe_load(text) or {}
    except ImportError:
        found = _plain_yaml(text)
    found = found.get("categories", found)
    owner: dict[str, str] = {}
    for key, c in found.items():
        if not (c.get("osm") or c.get("overture")):
            raise ValueError(f"{key}: no source knows it")
        for name in {str(x).lower() for x in [key, c.get("label", key), *(c.get("synonyms") or [])]}:
            if owner.setdefault(name, key) != key:
                raise ValueError(f"{name}: in {owner[name]} and {key}")
    return found


def _plain_yaml(text: str) -> dict:
    root: dict = {}
    stack: list[tuple[int, dict | list]] = [(-1, root)]
    value = lambda v: [x.strip().strip("'\"") for x in v[1:-1].split(",") if x.strip()] if v.startswith("[") else v.strip("'\"")
    pending: tuple[dict, str] | None = None
    for line in text.splitlines():
        bare = line.split(" #")[0].rstrip()
        if not bare.strip() or bare.strip().startswith("#"):
            continue
        indent, body = len(bare) - len(bare.lstrip()), bare.strip()
        if body.startswith("- "):
            if pending:
                pending[0][pending[1]] = []
                stack.append((indent, pending[0][pending[1]]))
                pending = None
            while stack[-1][0] > indent or not isinstance(stack[-1][1], list):
                stack.pop()
            stack[-1][1].append(value(body[2:].strip()))
            continue
        if pending:
            pending[0][pending[1]] = {}
            stack.append((indent - 1, pending[0][pending[1]]))
            pending = None
        while stack[-1][0] >= indent or isinstance(stack[-1][1], list):
            stack.pop()
        key, _, v = body.partition(":")
        if v.strip():
            stack[-1][1][key.strip().strip("'\"")] = value(v.strip())
        else:
            pending = (stack[-1][1], key.strip().strip("'\""))
    return root


def union_sources(parts: dict[str, Callable[[], DataFrame]]) -> tuple[DataFrame, dict[str, int], dict[str, str]]:
    """All sources' rows, each source's count, and the errors of those that failed; if all fail, an error.

    Every source is run and written on its own, so one that fails while running loses only its own rows.
    """
    out, counts, errors = None, {}, {}
    for name, scan in parts.items():
        try:
            df = cut(scan())
            counts[name] = df.count()
            out = df if out is None else out.unionByName(df, allowMissingColumns=True)
        except Exception as e:
            errors[name] = str(e)[:200]
    if out is None:
        raise RuntimeError(f"every source failed: {errors}")
    return out, counts, errors
