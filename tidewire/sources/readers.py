"""Sources: CSV in its varieties, Parquet, JSON, free text and paged services. Missing strings are empty in corpora."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from ..functions.resolve import exact

#: An encoding is taken if the whole file can be read by it; the last reads anything.
ENCODINGS = ("utf-8", "cp1252", "latin-1")
#: Spark reads cp1252 as ISO-8859-1; the two differ in these characters.
_C1 = {chr(b): bytes([b]).decode("cp1252") for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)}


def _csv(spark: SparkSession, encoding: str = "UTF-8", header: bool = True):
    return spark.read.option("header", header).option("multiLine", True).option("quote", '"').option("escape", '"').option("encoding", encoding).option("emptyValue", "").option("nullValue", "\0")


def _stripped(df: DataFrame) -> DataFrame:
    """Without a byte-order mark before the first header, and with empty strings for nulls."""
    df = df.toDF(*[c.lstrip("﻿").strip() for c in df.columns])
    return df.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) if t == "string" else F.col(f"`{c}`") for c, t in df.dtypes])


def csv_strings(spark: SparkSession, path: str | list[str], with_file: bool = False) -> DataFrame:
    """All columns as strings; an empty set of files is an error of Spark's own."""
    df = _stripped(_csv(spark).csv(path))
    return df.withColumn("source_file", F.col("_metadata.file_name")) if with_file else df


def csv_any_encoding(spark: SparkSession, path: str) -> DataFrame:
    """S3: each file by the first encoding that reads the whole of it, found in one distributed pass over the bytes."""

    def probe(frames):
        for frame in frames:
            frame["encoding"] = [next(e for e in ENCODINGS if e == "latin-1" or _reads(bytes(b), e)) for b in frame["content"]]
            yield frame[["path", "encoding"]]

    files = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(probe, "path string, encoding string").collect()
    parts = []
    for e in sorted({f.encoding for f in files}):
        part = _stripped(_csv(spark, "UTF-8" if e == "utf-8" else "ISO-8859-1").csv([f.path for f in files if f.encoding == e]))
        if e == "cp1252":
            part = part.select(*[F.translate(F.col(f"`{c}`"), "".join(_C1), "".join(_C1.values())).alias(c) for c in part.columns])
        parts.append(part)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def _reads(data: bytes, encoding: str) -> bool:
    try:
        data.decode(encoding)
    except UnicodeDecodeError:
        return False
    return True


def corpus_date_text(spark: SparkSession, path: str) -> DataFrame:
    """Columns date and text, which must be there."""
    df = csv_strings(spark, path)
    names = {c: exact(df.columns, [c]) for c in ("date", "text")}
    if missing := [c for c, found in names.items() if not found]:
        raise ValueError(f"no column {missing}")
    return df.select(*[F.col(f"`{found}`").alias(c) for c, found in names.items()])


def csv_typed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Strings cast to a given schema; what can't be cast is null."""
    raw = csv_strings(spark, path)
    return raw.select(*[F.col(f"`{exact(raw.columns, [f.name])}`").try_cast(f.dataType).alias(f.name) for f in StructType.fromDDL(schema)])


def recursive(spark: SparkSession, path: str) -> DataFrame:
    """CSV and Parquet files below a folder, corrupt ones left out, with their file."""
    options = {"recursiveFileLookup": "true", "ignoreCorruptFiles": "true"}
    parts = []
    for kind, pattern in (("csv", "*.csv"), ("parquet", "*.parquet")):
        found = spark.read.format("binaryFile").options(**options, pathGlobFilter=pattern).load(path).select("path").limit(1).count()
        if found:
            reader = (_csv(spark) if kind == "csv" else spark.read).options(**options, pathGlobFilter=pattern)
            part = reader.csv(path) if kind == "csv" else reader.parquet(path)
            parts.append(part.withColumn("_source_file", F.col("_metadata.file_path")))
    if not parts:
        raise FileNotFoundError(path)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def labelled_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Text and label, by header or, without one, the first two columns; empty rows drop."""
    df = csv_strings(spark, path)
    text, label = exact(df.columns, ("text", "sentence", "headline")), exact(df.columns, ("label", "sentiment"))
    if not (text and label):
        df = _stripped(_csv(spark, header=False).csv(path))
        text, label = df.columns[:2]
    return df.select(F.trim(f"`{text}`").alias("text"), F.trim(f"`{label}`").alias("label")).where("text <> '' or label <> ''")


def positional(spark: SparkSession, path: str, names: tuple[str, ...] = ("date", "text")) -> DataFrame:
    """Columns by place, two or three, from files with or without a header and with rows of any length.

    Shorter rows are filled with empty cells, what is beyond the last name is dropped; cells lose byte-order marks and outer white
    space; a file's first row goes if it is the names, in any case; rows without any cell go.
    """
    clean = lambda c: F.trim(F.regexp_replace(F.coalesce(F.col(c), F.lit("")), "[\ufeff\\r]|^\\s+|\\s+$", ""))
    raw = spark.read.schema(", ".join(f"`{n}` string" for n in names)).option("multiLine", True).option("quote", '"').option("escape", '"').option("mode", "PERMISSIVE").csv(path)
    # a file with line breaks in quotes is read whole, so its rows have ascending ids
    rows = raw.select(*[clean(n).alias(n) for n in names], F.monotonically_increasing_id().alias("_i"), F.col("_metadata.file_path").alias("_f"))
    first = rows.groupBy("_f").agg(F.min("_i").alias("_i")).withColumn("_first", F.lit(True))
    head = F.lit(True)
    for n in names:
        head = head & (F.lower(n) == n.lower())
    some = F.concat(*names) != ""
    return rows.join(first, ["_f", "_i"], "left").where(some & ~(F.coalesce("_first", F.lit(False)) & head)).select(*names)


def companies(spark: SparkSession, path: str) -> list[dict]:
    """A small configuration: a list of companies, or one under "companies"; each with ticker, name and aliases."""
    text = "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())
    payload = json.loads(text)
    rows = payload.get("companies", []) if isinstance(payload, dict) else payload
    for row in rows:
        if not (isinstance(row, dict) and row.get("ticker") and row.get("name") and isinstance(row.get("aliases"), list) and row["aliases"]):
            raise ValueError(f"not a company: {row}")
    return rows


def replies(spark: SparkSession, path: str) -> DataFrame:
    """Reply files below a folder, whole, with their path."""
    return spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.{txt,md,csv,json}").text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


def standard_articles(df: DataFrame) -> DataFrame:
    """The canonical columns by candidate names; a corpus of date and text only gets its title from the text."""
    candidates = {"source": ("source", "publisher", "site"), "category": ("category", "section", "topic"), "url": ("url", "link"), "title": ("title", "headline"), "date": ("date", "published_at"), "body": ("body", "content", "article", "text")}
    found = {name: exact(df.columns, names) for name, names in candidates.items()}
    text = exact(df.columns, ["text"])
    out = [F.col(f"`{c}`").cast("string").alias(n) if c else F.lit("").alias(n) for n, c in found.items()]
    df = df.select(*out)
    return df.withColumn("title", F.trim(F.substring_index("body", ".", 1))) if text and not found["title"] else df


class PagedSource(DataSource):
    """A batch source over a paged service.

    ``register(spark, name, schema, fetch)`` binds it to a function of an offset that returns a page's rows; pages
    are partitions, so they are fetched in parallel and again if an executor is lost.
    """

    fetch: Callable[[int], Iterator[tuple]]
    form: str

    @classmethod
    def name(cls) -> str:
        return cls.__name__

    def schema(self) -> str:
        return self.form

    def reader(self, schema) -> DataSourceReader:
        return _Pages(self.options, type(self).fetch)


class _Pages(DataSourceReader):
    def __init__(self, options, fetch):
        self.step, self.pages, self.fetch = int(options.get("step", "100")), int(options.get("pages", "1")), fetch

    def partitions(self):
        return [InputPartition(i * self.step) for i in range(self.pages)]

    def read(self, partition):
        yield from self.fetch(partition.value)


def register(spark: SparkSession, name: str, schema: str, fetch: Callable[[int], Iterator[tuple]]) -> None:
    spark.dataSource.register(type(name, (PagedSource,), {"fetch": staticmethod(fetch), "form": schema}))
