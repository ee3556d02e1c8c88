"""Exclusion joins, company matching, stratified samples and exact splits."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.resolve import ordered_unique, slug
from .market import lookup


def exclude_exact(corpus: DataFrame, held: DataFrame, keys: tuple[str, ...] = ("date", "text")) -> DataFrame:
    """Rows of the corpus that are not in the held-out set."""
    return corpus.join(held.select(*keys).distinct(), list(keys), "left_anti")


def exclude_loose(corpus: DataFrame, held: DataFrame, order: str) -> DataFrame:
    """Beyond exact matches, each held-out row that has none takes out at most one row of its date, the first in
    ``order`` that equals it, is a prefix of it or has it as a prefix (120 characters or more), or shares 160 characters.

    Only the first 160 characters of a text decide: cut to those, one of the two is a prefix of the other. So both sides
    come down to their distinct heads (a corpus head with its first row), and each head's prefixes of 120 characters and more are
    looked up on the other side: equi-joins, linear in the heads, whatever opening many texts of a day share.
    """
    left = exclude_exact(corpus, held)
    rest = held.join(corpus.select("date", "text").distinct(), ["date", "text"], "left_anti")
    head = F.substring("text", 1, 160).alias("head")
    ours = left.where(F.length("text") >= 120).groupBy("date", head).agg(F.min(order).alias(order))
    theirs = rest.where(F.length("text") >= 120).select("date", head).distinct()

    def prefixes(df: DataFrame, least: Column) -> DataFrame:
        sizes = F.when(F.length("head") >= least, F.sequence(least, F.length("head"))).otherwise(F.array().cast("array<int>"))
        return df.withColumn("_n", F.explode(sizes)).withColumn("prefix", F.substr(F.col("head"), F.lit(1), F.col("_n"))).drop("_n")

    # their head is a prefix of ours; only heads that begin alike have their prefixes spread out
    opening = theirs.select("date", F.substring("head", 1, 120).alias("_p")).distinct()
    near = ours.withColumn("_p", F.substring("head", 1, 120)).join(opening, ["date", "_p"], "left_semi").drop("_p")
    longer = prefixes(near, F.lit(120)).groupBy("date", "prefix").agg(F.min(order).alias("_o"))
    first = theirs.join(longer.withColumnRenamed("prefix", "head"), ["date", "head"])
    # ours is a shorter prefix of theirs
    shorter = prefixes(theirs, F.lit(120)).where(F.length("prefix") < F.length("head"))
    second = shorter.join(ours.select("date", F.col("head").alias("prefix"), F.col(order).alias("_o")), ["date", "prefix"]).select("date", "head", "_o")
    out = first.select("date", "head", "_o").unionByName(second).groupBy("date", "head").agg(F.min("_o").alias(order)).select(order).distinct()
    return left.join(out, order, "left_anti")


@dataclass(frozen=True)
class Company:
    ticker: str
    name: str
    aliases: tuple[str, ...]


def select_companies(specs: list[Company], selectors: list[str]) -> list[Company]:
    """those named by ticker, name or the name's slug, in any case; all without selectors, an error if none fits."""
    wanted = {s.lower() for s in ordered_unique(selectors)}
    chosen = [c for c in specs if not selectors or wanted & {c.ticker.lower(), c.name.lower(), slug(c.name)}]
    if not chosen:
        raise ValueError("no company fits; there are " + ", ".join(f"{c.ticker} ({c.name})" for c in specs))
    return chosen


def alias_pattern(alias: str) -> str:
    """One token has bounds, several have none but any white space between them."""
    quoted = r"\s+".join("".join(c if c.isalnum() else "\\" + c for c in part) for part in alias.strip().split(" "))
    bounded = re.fullmatch(r"[A-Za-z0-9.&'/-]+", alias)
    return rf"(?iu)(?<![A-Za-z0-9]){quoted}(?![A-Za-z0-9])" if bounded else f"(?iu){quoted}"


def companies(df: DataFrame, specs: list[Company], fields: tuple[str, ...] = ("title", "body", "text")) -> DataFrame:
    """A row for each article and company that it names, with the aliases in order of field and alias.

    The aliases are configuration, so they are literals of one pass without shuffle.
    """

    def hits(field: str, spec: Company) -> Column:
        return F.array_compact(F.array(*[F.when(F.rlike(field, F.lit(alias_pattern(a))), a) for a in spec.aliases]))

    found = F.array(*[F.struct(F.lit(s.ticker).alias("ticker"), F.lit(s.name).alias("company_name"), *[hits(f, s).alias(f"in_{f}") for f in fields]) for s in specs])
    some = lambda c: sum((F.size(c[f"in_{f}"]) for f in fields), F.lit(0)) > 0
    rows = df.withColumn("_c", F.explode(F.filter(found, some)))
    return rows.select(*df.columns, "_c.ticker", "_c.company_name", F.array_join(F.array_distinct(F.flatten(F.array(*[F.col(f"_c.in_{f}") for f in fields]))), "; ").alias("matched_aliases"), *[(F.size(f"_c.in_{f}") > 0).alias(f"match_in_{f}") for f in fields]).drop("_c")


def company_summary(matched: DataFrame, specs: list[Company]) -> DataFrame:
    """Figures by company; one without articles stays, with 0 rows."""
    all_ = matched.sparkSession.createDataFrame([(s.ticker, s.name) for s in specs], "ticker string, company_name string")
    counted = matched.groupBy("ticker").agg(F.count("*").alias("rows"), F.min("date").alias("min_date"), F.max("date").alias("max_date"), F.count_distinct("source").alias("n_sources"))
    return all_.join(counted, "ticker", "left").withColumn("rows", F.coalesce("rows", F.lit(0))).withColumn("n_sources", F.coalesce("n_sources", F.lit(0)))


def hashed(seed: int, *keys: str) -> Column:
    """An order that looks random, the same on any engine."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))


def even_quota(sizes: DataFrame, group: str, size: str, n: int) -> DataFrame:
    """M1: ``n`` dealt out one by one to groups in order, each up to its size. ``sizes`` has a row a group.

    Round r serves the groups of at least r rows; what is served before a round is known from sizes alone.
    """
    dealt = sizes.where(F.col(size) > 0).withColumn("round", F.explode(F.sequence(F.lit(1), F.least(F.col(size), F.lit(n)).cast("int"))))
    return dealt.orderBy("round", group).limit(n).groupBy(group).agg(F.count("*").alias("quota"))


def quotas(sizes: DataFrame, group: str, size: str, n: str, *outer: str) -> DataFrame:
    """M1 in closed form: within each ``outer`` key its ``n``, dealt evenly to its groups in order, each up to its size.

    In the order of their sizes, groups are filled while what is needed to bring all the rest as far is there; what is left is
    shared evenly, and its remainder goes to the first groups. Windows hold one row a group.
    """
    key = [*outer] if outer else [F.lit(0)]
    by_size = Window.partitionBy(*key).orderBy(size, group)
    rows = sizes.where(F.col(size) > 0).withColumn("_below", F.sum(size).over(by_size) - F.col(size)).withColumn("_left", F.count("*").over(Window.partitionBy(*key)) - F.row_number().over(by_size) + 1)
    rows = rows.withColumn("_full", F.col("_below") + F.col(size) * F.col("_left") <= F.col(n))
    whole = Window.partitionBy(*key)
    rows = rows.withColumn("_rest", F.col(n) - F.coalesce(F.sum(F.when(F.col("_full"), F.col(size))).over(whole), F.lit(0))).withColumn("_open", F.count_if(~F.col("_full")).over(whole))
    place = F.row_number().over(Window.partitionBy(*key, "_full").orderBy(group))
    share = F.floor(F.col("_rest") / F.col("_open")) + (place <= F.col("_rest") % F.col("_open")).cast("bigint")
    rows = rows.withColumn("quota", F.when(F.col("_full"), F.col(size)).otherwise(share).cast("bigint"))
    return rows.where("quota > 0").select(*outer, group, "quota")


def sample_by_quota(df: DataFrame, quota: DataFrame, group: str | list[str], order: Column) -> DataFrame:
    """M2: of each group as many rows as its quota, in the given order, a string of hexadecimal digits.

    The order's first digits are counted first: of each group whole ranges are taken up to the one in which the quota
    ends, and only that one is ranked. So of a hot group one row in 65,536 meets in a task. Null groups have no quota.
    """
    keys = [group] if isinstance(group, str) else group
    rows = df.withColumn("_o", order).withColumn("_b", F.substring("_o", 1, 4))
    counts = rows.groupBy(*keys, "_b").agg(F.count("*").alias("_n")).join(quota, keys)
    before = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_b")) - F.col("_n")
    taken = counts.withColumn("_take", F.least("_n", F.col("quota") - before)).where("_take > 0").select(*keys, "_b", "_n", "_take")
    near = rows.join(lookup(taken), [*keys, "_b"])
    sure = near.where("_n = _take").select(*df.columns)
    last = near.where("_n > _take").withColumn("_r", F.row_number().over(Window.partitionBy(*keys, "_b").orderBy("_o"))).where("_r <= _take")
    return sure.unionByName(last.select(*df.columns))


#: Strategies of a year's sample, by what is known of its labels.
BY_MONTH, UNLABELLED, BY_LABEL = "month_balanced_only", "month_balanced_only_no_valid_sentiment", "sentiment_and_month_balanced"


def sample_years(df: DataFrame, targets: dict[int, int], date: str, key: str, label: Column | None = None, seed: int = 42) -> DataFrame:
    """M3, M4, U4: of each year so many rows, spread evenly over labels and, within a label, over months.

    What the labels can't fill is topped up from the year's other rows, evenly over months. Adds sample_target_year,
    sample_month, sample_sentiment_bucket (empty: none) and sample_strategy. ``key`` names rows; ``label`` is one of negative,
    neutral and positive or else counts as none. Rows come in an order that looks random. A year with fewer dated
    rows than asked for is an error. Quotas come from sizes alone; rows are read once for them and once for each pick.
    """
    asked = df.sparkSession.createDataFrame(sorted((y, n) for y, n in targets.items() if n > 0), "sample_target_year int, _asked bigint")
    bucket = F.coalesce(F.when(label.isin("negative", "neutral", "positive"), label), F.lit("")) if label is not None else F.lit("")
    rows = df.withColumns({"sample_target_year": F.year(date), "sample_month": F.date_format(date, "yyyy-MM"), "sample_sentiment_bucket": bucket}).join(F.broadcast(asked.select("sample_target_year")), "sample_target_year")
    year, month, told = "sample_target_year", "sample_month", "sample_sentiment_bucket"
    # one pass; at most 4 labels by 12 months for each year asked for
    counted = rows.groupBy(year, told, month).agg(F.count("*").alias("size")).collect()
    for y, n in targets.items():
        if n > (have := sum(r.size for r in counted if r[0] == y)):
            raise ValueError(f"{n} rows asked of {y}, which has {have}")
    spark = df.sparkSession
    sizes = spark.createDataFrame(counted, f"{year} int, {told} string, {month} string, size bigint").coalesce(1)
    small = lambda q: spark.createDataFrame(q.collect(), q.schema).coalesce(1)
    # labels first, then months within each
    labelled = sizes.where(F.col(told) != "")
    by_label = labelled.groupBy(year, told).agg(F.sum("size").alias("size")).join(F.broadcast(asked), year)
    shares = quotas(by_label, told, "size", "_asked", year).withColumnRenamed("quota", "_n")
    first = small(quotas(labelled.join(F.broadcast(shares), [year, told]), month, "size", "_n", year, told))
    picked = sample_by_quota(rows.where(F.col(told) != ""), first, [year, told, month], hashed(seed, key))
    # then the year's other rows by month
    used = first.groupBy(year, month).agg(F.sum("quota").alias("_used"))
    rest = sizes.groupBy(year, month).agg(F.sum("size").alias("size")).join(F.broadcast(used), [year, month], "left").withColumn("size", F.col("size") - F.coalesce("_used", F.lit(0)))
    missing = asked.join(first.groupBy(year).agg(F.sum("quota").alias("_got")), year, "left").select(year, (F.col("_asked") - F.coalesce("_got", F.lit(0))).alias("_n")).where("_n > 0")
    second = small(quotas(rest.join(F.broadcast(missing), year), month, "size", "_n", year))
    others = rows.join(picked.select(key), key, "left_anti")
    added = sample_by_quota(others, second, [year, month], hashed(seed + 777, key))
    strategy = F.lit(BY_MONTH) if label is None else F.when(F.col(year).isin(sorted({r[0] for r in counted if r[1]})), BY_LABEL).otherwise(UNLABELLED)
    return picked.unionByName(added).withColumn("sample_strategy", strategy).select(*df.columns, year, month, told, "sample_strategy").orderBy(hashed(seed + 2026, key))


def positions(df: DataFrame, order: str, *keys: str, rows: int = 1_000_000) -> DataFrame:
    """Adds ``pos`` from 0 in the order of a number, date or moment, within keys or over all.

    Rows are numbered by ranges of the order, cut at quantiles so that a range holds about ``rows``, and what lies before a
    range is a sum of counts: neither a hot key nor the whole table is ranked in one task. Ranges end between values:
    a value that many rows share stays in one.
    """
    n = df.count()
    cuts = min(1000, n // rows)
    value = F.col(order).cast("timestamp").cast("double") if dict(df.dtypes)[order] in ("date", "timestamp", "timestamp_ntz") else F.col(order).cast("double")
    bounds = df.agg(F.percentile_approx(value, [(i + 1) / (cuts + 1) for i in range(cuts)], 10_000)).first()[0] if cuts else []
    ranged = df.withColumn("_range", F.size(F.filter(F.array(*[F.lit(float(b)) for b in bounds]) if bounds else F.array().cast("array<double>"), lambda b: b < value)))
    counts = ranged.groupBy(*keys, "_range").agg(F.count("*").alias("_n"))
    key = [*keys] if keys else [F.lit(0)]
    before = counts.select(*keys, "_range", (F.sum("_n").over(Window.partitionBy(*key).orderBy("_range")) - F.col("_n")).alias("_before"))
    placed = ranged.join(lookup(before), [*keys, "_range"])
    return placed.withColumn("pos", F.col("_before") + F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(order)) - 1).drop("_range", "_before")


def exact_split(df: DataFrame, order: Column, shares: tuple[float, float] = (0.8, 0.9)) -> DataFrame:
    """M5: train, validation and test by exact position in ``order``, a string of hexadecimal digits.

    Rows are numbered by range: a bucket is the order's first four digits, and what lies before a bucket is a sum of counts.
    """
    rows = df.withColumn("_o", order).withColumn("_b", F.substring("_o", 1, 4))
    counts = rows.groupBy("_b").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n"))
    total = counts.agg(F.sum("_n").alias("_total"))
    placed = rows.join(lookup(before.crossJoin(total).drop("_n")), "_b").withColumn("_pos", F.col("_before") + F.row_number().over(Window.partitionBy("_b").orderBy("_o")) - 1)
    first, second = (F.floor(F.col("_total") * s) for s in shares)
    return placed.withColumn("split", F.when(F.col("_pos") < first, "train").when(F.col("_pos") < second, "validation").otherwise("test")).drop("_o", "_b", "_before", "_total", "_pos")
