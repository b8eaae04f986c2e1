"""Readers. Each gives a DataFrame of scalar columns under tidy, unique names."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlab.functions.missing import NUMBER, blank, trimmed


def tidy(names: list[str]) -> list[str]:
    """Letters, digits and _, not starting with a digit; repeats get _2, _3, ..."""
    out, used = [], set()
    for i, name in enumerate(names):
        base = re.sub(r"\W+", "_", name.strip()).strip("_") or f"field_{i + 1}"
        base = f"_{base}" if base[0].isdigit() else base
        new, k = base, 2
        while new.lower() in used:
            new, k = f"{base}_{k}", k + 1
        used.add(new.lower())
        out.append(new)
    return out


def read_csv(spark: SparkSession, path: str, sep: str = ",", encoding: str = "UTF-8", typed: bool = False) -> DataFrame:
    """Quoted fields may hold separators, quotes (doubled) and line ends; records that are empty throughout go."""
    how = {"sep": sep, "quote": '"', "escape": '"', "multiLine": True, "encoding": encoding, "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    head = spark.read.csv(path, header=False, **how).first()  # Spark itself would number repeated names its own way
    df = spark.read.csv(path, header=True, **how)
    df = df.toDF(*tidy([h or "" for h in head] if head else df.columns))
    some = F.lit(False)
    for c in df.columns:
        some = some | ~blank(F.col(c))
    df = df.where(some)
    return with_types(df) if typed else df


def read_tsv(spark: SparkSession, path: str, **options) -> DataFrame:
    return read_csv(spark, path, sep="\t", **options)


def infer_types(df: DataFrame) -> dict[str, str]:
    """Field -> text, yes-no, date or number, in one pass over the values; names like ids are text."""
    checks = {"yes-no": r"(?i)^(yes|no|unknown)$", "date": r"^\d{4}-\d{2}-\d{2}$", "number": NUMBER}
    tests = []
    for c in df.columns:
        some = ~blank(F.col(c))
        tests += [F.count(F.when(some, 1)).alias(f"{c}|n")]
        tests += [F.count(F.when(some & trimmed(F.col(c)).rlike(p), 1)).alias(f"{c}|{k}") for k, p in checks.items()]
    row = df.agg(*tests).first()
    out = {}
    for c in df.columns:
        n = row[f"{c}|n"]
        fits = [k for k in checks if n and row[f"{c}|{k}"] == n]
        out[c] = "text" if re.search(r"(?i)(^|_)id$", c) or not fits else fits[0]
    return out


def with_types(df: DataFrame) -> DataFrame:
    """Numbers and dates as such, where every value reads as one."""
    kinds = infer_types(df)
    cast = {"number": "double", "date": "date"}
    return df.select(*[F.when(~blank(F.col(c)), trimmed(F.col(c)).try_cast(cast[k])).alias(c) if k in cast else F.col(c) for c, k in kinds.items()])


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """An array of flat objects, or an object whose ``records`` is one; nested values are an error."""
    df = spark.read.json(path, multiLine=True)
    if df.columns == ["records"]:
        df = df.select(F.explode("records").alias("r")).select("r.*")
    nested = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType))]
    if nested:
        raise ValueError(f"nested values: {', '.join(nested)}")
    return df.toDF(*tidy(df.columns))


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """properties, kind and coordinates (as JSON text) of every feature."""
    schema = T.StructType([T.StructField("type", T.StringType()), T.StructField("features", T.ArrayType(T.StructType([
        T.StructField("properties", T.MapType(T.StringType(), T.StringType())),
        T.StructField("geometry", T.StructType([T.StructField("type", T.StringType()), T.StructField("coordinates", T.StringType())])),
    ])))])
    df = spark.read.schema(schema).json(path, multiLine=True)
    return df.select(F.explode("features").alias("f")).select("f.properties", F.col("f.geometry.type").alias("kind"), F.col("f.geometry.coordinates").alias("coordinates"))


def inspect_features(features: DataFrame) -> DataFrame:
    """Number of features, kinds of geometry, fields and extent, in one aggregation."""
    numbers = F.transform(F.regexp_extract_all("coordinates", F.lit(r"\[\s*(-?[0-9.eE+-]+\s*,\s*-?[0-9.eE+-]+)"), F.lit(1)), lambda p: F.transform(F.split(p, ","), lambda x: F.trim(x).cast("double")))
    rows = features.withColumn("points", numbers)
    low = lambda i: F.min(F.array_min(F.transform("points", lambda p: p[i])))
    high = lambda i: F.max(F.array_max(F.transform("points", lambda p: p[i])))
    return rows.agg(
        F.count("*").alias("features"), F.sort_array(F.collect_set("kind")).alias("kinds"), F.sort_array(F.array_distinct(F.flatten(F.collect_set(F.map_keys("properties"))))).alias("fields"),
        low(0).alias("west"), low(1).alias("south"), high(0).alias("east"), high(1).alias("north"),
    )


# Archives -----------------------------------------------------------------------------------------------------------

SPREADSHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def sheet_rows(content: bytes) -> list[list[str]]:
    """The cells of a workbook's first sheet as texts, row by row."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        names = set(archive.namelist())
        read = lambda name: ElementTree.fromstring(archive.read(name))
        shared = ["".join(t.text or "" for t in s.iter(f"{SPREADSHEET}t")) for s in read("xl/sharedStrings.xml")] if "xl/sharedStrings.xml" in names else []
        first = read("xl/workbook.xml").find(f"{SPREADSHEET}sheets")[0].get(RELATION)
        target = next(r.get("Target") for r in read("xl/_rels/workbook.xml.rels") if r.get("Id") == first)
        sheet = read(target.lstrip("/") if target.startswith("/") else f"xl/{target}")
    rows = []
    for row in sheet.iter(f"{SPREADSHEET}row"):
        cells: list[str] = []
        for c in row.iter(f"{SPREADSHEET}c"):
            letters = re.match("[A-Z]+", c.get("r", ""))
            at = len(cells)
            if letters:
                at = 0
                for letter in letters[0]:
                    at = at * 26 + ord(letter) - 64
                at -= 1
            cells += [""] * (at - len(cells))
            value = c.find(f"{SPREADSHEET}v")
            if c.get("t") == "inlineStr":
                text = "".join(t.text or "" for t in c.iter(f"{SPREADSHEET}t"))
            elif value is None or value.text is None:
                text = ""
            elif c.get("t") == "s":
                text = shared[int(value.text)]
            else:
                text = {"1": "true", "0": "false"}.get(value.text, value.text) if c.get("t") == "b" else value.text
            cells.append(text)
        rows.append(cells)
    return rows


def read_xlsx(spark: SparkSession, path: str, typed: bool = False) -> DataFrame:
    """The first sheet of a workbook: a row of names, then records; those that are empty throughout go. A workbook is one file
    that cannot be split, so one task reads it, row by row, in the order of the sheet."""
    files = spark.read.format("binaryFile").load(path).select("content")

    def run(batches):
        for batch in batches:
            for content in batch.content:
                rows = sheet_rows(content)
                yield pd.DataFrame({"place": range(len(rows)), "cells": rows})

    rows = files.mapInPandas(run, "place long, cells array<string>")
    head = rows.where("place = 0").select("cells").first()
    names = tidy(list(head[0])) if head else []
    some = F.exists("cells", lambda c: ~blank(c))
    out = rows.where("place > 0").where(some).select(*[F.coalesce(F.get("cells", F.lit(i)), F.lit("")).alias(n) for i, n in enumerate(names)])
    return with_types(out) if typed else out


def archive_inventory(spark: SparkSession, path: str) -> DataFrame:
    """archive, entry, bytes, kind, dataset: what zip archives hold. Of a shapefile all parts are there under one name, or it is
    incomplete; entries that would leave the folder are unsafe."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches):
        for batch in batches:
            out = []
            for name, content in zip(batch.path, batch.content):
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    entries = [e for e in archive.infolist() if not e.is_dir()]
                parts: dict[str, set[str]] = {}
                for e in entries:
                    stem, _, end = e.filename.rpartition(".")
                    parts.setdefault(stem, set()).add(end.lower())
                for e in entries:
                    stem, _, end = e.filename.rpartition(".")
                    kind, own = "other", parts[stem]
                    if e.filename.startswith("/") or ".." in e.filename.replace("\\", "/").split("/"):
                        kind = "unsafe"
                    elif end.lower() == "gpkg":
                        kind = "geopackage"
                    elif end.lower() in ("shp", "shx", "dbf", "prj", "cpg"):
                        kind = "shapefile" if {"shp", "shx", "dbf"} <= own else "shapefile-incomplete"
                    out.append((name, e.filename, e.file_size, kind, stem if kind not in ("other", "unsafe") else None))
            yield pd.DataFrame(out, columns=["archive", "entry", "bytes", "kind", "dataset"])

    return files.mapInPandas(run, "archive string, entry string, bytes long, kind string, dataset string")
