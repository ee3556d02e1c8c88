"""Prompt batches, replies of chat models, their merging and consensus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions.text import collapse
from .corpus import positions

# A fenced block, and a line of an id, a mark and a word.
_FENCE = r"(?s)`{3}[\w+-]*[^\S\n]*\n(.*?)`{3}"
_WORD = r"^(row_[\w-]+)\s*[:,-]\s*([A-Za-z]+)$"


def row_ids(df: DataFrame, order: str, *partition: str) -> DataFrame:
    """P21."""
    return positions(df, order, *partition).withColumn("row_id", F.format_string("row_%05d", F.col("pos") + 1)).drop("pos")


def batches(df: DataFrame, key: str, order: str, text: str, size: int = 20) -> DataFrame:
    """Numbered batches of ``size`` rows of each key, with the prompt's lines; a task gathers one batch at a time."""
    numbered = positions(df, order, key).withColumn("batch", F.floor(F.col("pos") / size) + 1)
    line = F.concat(F.format_string("row_%05d", F.col("pos") + 1), F.lit(","), F.regexp_replace(text, "[,\\s]+", " "))
    return numbered.groupBy(key, "batch").agg(F.count("*").alias("n_rows"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", line.alias("line")))), lambda x: x["line"]), "\n").alias("prompt"))


def merge_providers(replies: DataFrame, providers: list[str]) -> DataFrame:
    """A row an id and a column a provider; the last reply wins, none is empty."""
    pick = lambda p: F.coalesce(F.max_by(F.when(F.col("provider") == p, F.col("label")), F.when(F.col("provider") == p, F.col("pos"))), F.lit("")).alias(f"{p}_label")
    return replies.groupBy("row_id").agg(*[pick(p) for p in providers])


def conflicts(replies: DataFrame, *order: str) -> DataFrame:
    """Ids for which a provider gave different labels: how many, and the one that stays, the last."""
    told = replies.where("label <> ''").groupBy("provider", "row_id").agg(F.count_distinct("label").alias("n_labels"), F.max_by("label", F.struct(*order)).alias("kept_label"))
    return told.where("n_labels > 1")


def consensus(columns: list[str]) -> Column:
    """The label that all give; mixed if they differ; empty if one gives none."""
    given = F.array(*[L.chat(c) for c in columns])
    valid = F.filter(given, lambda x: x != "")
    return F.when(F.size(valid) < len(columns), "").when(F.size(F.array_distinct(valid)) == 1, F.element_at(given, 1)).otherwise("mixed")


def _some(pairs: Column) -> Column:
    """Pairs of a row id and a raw label as (id, label), without those that lack either; null if none is left."""
    told = F.transform(pairs, lambda x: F.struct(collapse(x["id"]).alias("id"), L.chat(x["raw"]).alias("label")))
    kept = F.filter(told, lambda x: (x["id"] != "") & (x["label"] != ""))
    return F.when(F.size(kept) > 0, kept)


def _pair(id_: Column, raw: Column) -> Column:
    return F.struct(F.coalesce(id_, F.lit("")).alias("id"), F.coalesce(raw, F.lit("")).alias("raw"))


def _objects(part: Column) -> Column:
    """A JSON object of labels by id, or rows (its own, or under ``rows``) that are objects or pairs."""
    listed = F.when(F.startswith(part, F.lit("[")), part).otherwise(F.get_json_object(part, "$.rows"))
    rows = F.from_json(F.when(F.startswith(listed, F.lit("[")), listed), "array<string>")
    named = lambda e: F.startswith(e, F.lit("{"))
    pick = lambda e, key, at: F.when(named(e), F.get_json_object(e, f"$.{key}")).otherwise(F.get_json_object(e, f"$[{at}]"))
    of_rows = F.transform(F.filter(rows, lambda e: F.rlike(e, F.lit(r"^[\[{]"))), lambda e: _pair(pick(e, "row_id", 0), pick(e, "label", 1)))
    of_map = F.transform(F.map_entries(F.from_json(part, "map<string,string>")), lambda e: _pair(e["key"], e["value"]))
    return F.when(F.try_parse_json(part).isNotNull(), F.coalesce(of_rows, F.when(F.startswith(part, F.lit("{")), of_map)))


def _cells(line: Column) -> Column:
    """A line's cells at its commas, those in quotes aside, without quotes."""
    cells = F.when(F.contains(line, F.lit('"')), F.split(line, r',(?=(?:[^"]*"[^"]*")*[^"]*$)')).otherwise(F.split(line, ","))
    return F.transform(cells, lambda c: F.replace(F.regexp_replace(F.trim(c), '^"|"$', ""), F.lit('""'), F.lit('"')))


def _filled(text: Column) -> Column:
    return F.filter(F.split(text, r"\r\n|\n|\r"), lambda x: F.trim(x) != "")


def _table(part: Column) -> Column:
    """Lines of cells below a header that names row_id and label, or else any: then the first two cells count."""
    lines = _filled(part)
    head = F.transform(_cells(F.get(lines, F.lit(0))), lambda c: F.lower(c))
    i, j = (F.array_position(head, c).cast("int") - 1 for c in ("row_id", "label"))
    named = (i >= 0) & (j >= 0)
    rows = F.transform(F.slice(lines, F.lit(2), F.size(lines)), _cells)
    pairs = F.transform(rows, lambda c: _pair(F.get(c, F.when(named, i).otherwise(0)), F.get(c, F.when(named, j).otherwise(1))))
    return F.when((F.size(lines) > 1) & (F.size(head) > 1), pairs)


def _lines(part: Column) -> Column:
    """Each line by itself: an id, a mark and a word, or two cells at commas, tabs or bars."""
    lines = F.filter(F.transform(_filled(part), lambda x: F.trim(x)), lambda x: ~F.rlike(x, F.lit("(?i)^(?:```|row_id)")))

    def pair(line: Column) -> Column:
        bars = F.filter(F.transform(F.split(line, r"\|"), lambda c: F.trim(c)), lambda c: c != "")
        cells = F.when(F.contains(line, F.lit(",")), F.split(line, ",")).when(F.contains(line, F.lit("\t")), F.split(line, "\t")).when(F.contains(line, F.lit("|")), bars)
        cells = F.transform(cells, lambda c: F.regexp_replace(F.trim(c), "^[\"']+|[\"']+$", ""))
        two = F.when(~F.rlike(F.get(cells, F.lit(0)), F.lit("^-+$")), _pair(F.get(cells, F.lit(0)), F.get(cells, F.lit(1))))
        return F.when(F.rlike(line, F.lit(_WORD)), _pair(F.regexp_extract(line, _WORD, 1), F.regexp_extract(line, _WORD, 2))).otherwise(two)

    return F.filter(F.transform(lines, pair), lambda x: x.isNotNull())


def parse_replies(replies: DataFrame, text: str, *keys: str) -> DataFrame:
    """A row for each label that a reply gives, by row id; of an id's labels the last.

    Fenced blocks are read in turn, then the whole text; the first that gives any label counts. A part is read as JSON, then as a
    table (from its first row_id on, if its beginning is none), then line by line. Everything is columns: no shuffle and no Python.
    """
    fenced = F.transform(F.regexp_extract_all(text, F.lit(_FENCE), F.lit(1)), lambda b: F.trim(F.regexp_replace(b, r"^\s+|\s+$", "")))
    parts = F.array_append(fenced, F.regexp_replace(text, r"^\s+|\s+$", ""))

    def read(part: Column) -> Column:
        below = F.when(F.contains(F.lower(part), F.lit("row_id")), F.substr(part, F.locate("row_id", F.lower(part))))
        return F.coalesce(_some(_objects(part)), _some(_table(part)), _some(_table(below)), _some(_lines(part)))

    df = replies.select(*keys, F.coalesce(F.col(text), F.lit("")).alias(text))
    df = df.withColumn("_p", F.get(F.filter(F.transform(parts, read), lambda x: x.isNotNull()), F.lit(0)))
    # by id and place; the last of an id is the one that another id follows
    df = df.withColumn("_p", F.array_sort(F.transform("_p", lambda x, i: F.struct(x["id"].alias("id"), i.alias("i"), x["label"].alias("label")))))
    df = df.withColumn("_p", F.filter("_p", lambda x, i: F.coalesce(F.get("_p", i + 1)["id"] != x["id"], F.lit(True))))
    return df.select(*keys, F.explode("_p").alias("_x")).select(*keys, F.col("_x.id").alias("row_id"), "_x.label")
