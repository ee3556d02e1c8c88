"""Queries on corpora: exclusion, companies, samples, metrics, chat and sitemaps."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions.text import first_of
from ..operators import chat as C
from ..operators import corpus as K
from ..operators import market as M
from ..operators import metrics as X
from ..operators import web as W
from .tables import rounded, table
from .texts import _ARTICLES, _labelled, articles

SPECS = [K.Company("A1", "Ring", ("ring", "small ring")), K.Company("B2", "Widget", ("widget",)), K.Company("C3", "Bolt & Co", ("bolt", "nut bolt")), K.Company("Z9", "Absent", ("qqqq",))]
LABELS = ["negative", "neutral", "positive"]
PROVIDERS = ["one", "two", "three"]


def _dated(spark: SparkSession, d: str) -> DataFrame:
    return articles(spark, d).select("doc_id", "date", F.col("body").alias("text"))


def _held(spark: SparkSession, d: str) -> DataFrame:
    """Held-out rows: every tenth document whole, every tenth from 5 cut to 150 characters, and from 7 to 100."""
    a = _dated(spark, d)
    m = F.col("doc_id") % 10
    return a.where(m.isin(0, 5, 7)).select(F.col("doc_id").alias("held_id"), "date", F.when(m == 0, F.col("text")).when(m == 5, F.substring("text", 1, 150)).otherwise(F.substring("text", 1, 100)).alias("text"))


def _matched(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", F.col("p_name").alias("title"), F.concat_ws(" ", "p_type", "p_name").alias("body"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("p_partkey") % 365).cast("int")).alias("date"), F.col("p_brand").alias("source"))
    return K.companies(p.withColumn("text", F.concat("title", F.lit(". "), "body")), SPECS)


def _predicted(spark: SparkSession, d: str) -> DataFrame:
    gold = F.when(F.col("o_orderstatus") == "F", "negative").when(F.col("o_orderstatus") == "O", "neutral").otherwise("positive")
    pred = F.when(F.col("o_totalprice") < 150000, "negative").when(F.col("o_totalprice") < 300000, "neutral").otherwise("positive")
    return table(spark, d, "orders").select("o_orderkey", "o_orderpriority", gold.alias("gold"), pred.alias("pred"))


def _month_sizes(spark, d):
    return articles(spark, d).withColumn("month", F.date_format("date", "yyyy-MM"))


def _month_sample(spark, d):
    a = _month_sizes(spark, d)
    quota = K.even_quota(a.groupBy("month").agg(F.count("*").alias("size")), "month", "size", 100)
    return K.sample_by_quota(a, quota, "month", K.hashed(42, "doc_id")).select("doc_id", "month")


def _sentiment_month(spark, d):
    """M3: an even share of each label, and within it an even share of each month."""
    e = table(spark, d, "events").select("event_id", F.to_date("ts").alias("day"), F.when(F.col("event_type") == "error", "negative").when(F.col("event_type").isin("click", "purchase"), "positive").otherwise("neutral").alias("label"))
    sizes = e.groupBy("label", "day").agg(F.count("*").alias("size"))
    labels = K.even_quota(sizes.groupBy("label").agg(F.sum("size").alias("size")), "label", "size", 100)
    rows = sizes.withColumn("round", F.explode(F.sequence(F.lit(1), F.least("size", F.lit(100)).cast("int"))))
    ranked = rows.withColumn("r", F.row_number().over(Window.partitionBy("label").orderBy("round", "day"))).join(M.lookup(labels), "label").where("r <= quota")
    return ranked.groupBy("label", "day").agg(F.count("*").alias("quota"))


#: Rows asked of each year.
TARGETS = {2023: 60, 2024: 90}


def _opinions(spark, d):
    """Articles of two years, some of them with an opinion, in raw words."""
    told = F.when(F.col("toxic") == 1, "Neutral").when(F.col("quality") == 1, "POS").when(F.col("quality") == 0, " negative ")
    labels = table(spark, d, "labels").select("doc_id", told.alias("raw"))
    docs = table(spark, d, "documents").select("doc_id", F.date_add(F.lit("2023-01-01").cast("date"), (F.col("doc_id") * 37 % 731).cast("int")).alias("date"))
    return docs.join(labels, "doc_id", "left")


def _year_samples(spark, d):
    """The three strategies: no labels, labels none of which is valid, and labels of some rows."""
    rows = _opinions(spark, d)
    parts = [K.sample_years(rows, TARGETS, "date", "doc_id", label) for label in (None, L.corpus(F.lit("unsure")), L.corpus("raw"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("doc_id", "sample_strategy", "sample_target_year", "sample_month", "sample_sentiment_bucket")


def _train_set(spark, d):
    """Titles with an opinion, in raw words: trimmed, none empty, each text once."""
    raw = F.when(F.col("toxic") == 1, " Neutral").when(F.col("quality") == 1, "BULLISH").otherwise("-1")
    a = articles(spark, d).join(table(spark, d, "labels").select("doc_id", raw.alias("raw")), "doc_id").where(F.col("title").isNotNull() & F.col("raw").isNotNull())
    a = a.withColumn("text", F.trim("title")).where("text <> ''").withColumn("label_id", L.training("raw"))
    return first_of(a, "text", "doc_id").select("doc_id", "text", "label_id")


def _replies(spark, d):
    return table(spark, d, "events").select("event_id", F.format_string("row_%05d", (F.col("event_id") % 400).cast("int")).alias("row_id"), F.element_at(F.array(*[F.lit(p) for p in PROVIDERS]), (F.col("user_id") % 3 + 1).cast("int")).alias("provider"), F.element_at(F.array(*[F.lit(x) for x in ("pos", "neg", "neut")]), (F.col("event_id") % 7 % 3 + 1).cast("int")).alias("label"), F.col("event_id").alias("pos"))


FIVE = ["one", "two", "three", "four", "five"]


def _five(spark, d):
    """Replies of five providers, the same label from all for most ids, some left out and some given twice."""
    e = table(spark, d, "events").select("event_id", (F.col("event_id") % 300).alias("k"), F.element_at(F.array(*[F.lit(p) for p in FIVE]), (F.col("user_id") % 5 + 1).cast("int")).alias("provider"))
    label = F.element_at(F.array(*[F.lit(x) for x in ("positive", "neg", "neut", "")]), F.when(F.col("event_id") % 41 == 0, 4).otherwise(F.col("k") % 3 + 1).cast("int"))
    odd = F.when((F.col("k") % 10 == 0) & (F.col("event_id") % 7 == 0), "bearish").otherwise(label)
    return e.select(F.format_string("row_%05d", F.col("k")).alias("row_id"), "provider", L.chat(odd).alias("label"), F.col("event_id").alias("pos"))


def _five_consensus(spark, d):
    merged = C.merge_providers(_five(spark, d).where("label <> ''"), FIVE)
    return merged.select("row_id", *[f"{p}_label" for p in FIVE], C.consensus([f"{p}_label" for p in FIVE]).alias("consensus"))


def _recalls(spark, d):
    """R2: recall by class for each model: the predictions as they are, and one that always says the commonest class."""
    p = _predicted(spark, d)
    both = p.withColumn("m", F.explode(F.array(F.struct(F.lit("priced").alias("model"), F.col("pred").alias("told")), F.struct(F.lit("constant").alias("model"), F.lit("neutral").alias("told")))))
    hit = both.groupBy("m.model", "gold").agg(F.avg((F.col("gold") == F.col("m.told")).cast("double")).alias("recall"))
    return hit.groupBy("model").pivot("gold", LABELS).agg(F.max("recall")).na.fill(0.0)


def _consensus(spark, d):
    merged = C.merge_providers(_replies(spark, d), PROVIDERS)
    return merged.select("row_id", C.consensus([f"{p}_label" for p in PROVIDERS]).alias("consensus"))


#: Raw labels of replies, and what each means.
SAID = {"positive": "pos", "neg": "neg", "Bearish": "neg", "mixed": "neut", "bullish": "pos", "Neutral": "neut"}


def _reply_texts(spark, d):
    """Assistants' own texts, with up to three labelled rows put into each in one of six shapes."""
    c = table(spark, d, "conversations").where("role = 'assistant'").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    c = c.withColumn("rows", F.transform(F.sequence(F.lit(0), (F.col("conv_id") % 3).cast("int")), lambda i: F.struct(F.format_string("row_%05d", (F.col("conv_id") * 10 + i).cast("int")).alias("id"), F.element_at(F.array(*[F.lit(x) for x in SAID]), ((F.col("conv_id") + F.col("turn") + i) % 6 + 1).cast("int")).alias("raw"))))
    each = lambda sep, *parts: F.array_join(F.transform("rows", lambda r: F.concat(*[p if isinstance(p, Column) else r[p] if p in ("id", "raw") else F.lit(p) for p in parts])), sep)
    shapes = [
        F.concat("text", F.lit("\n```json\n{"), each(", ", '"', "id", '": "', "raw", '"'), F.lit("}\n```\n"), "text"),
        F.concat("text", F.lit('\n```\n{"rows": ['), each(",", '{"row_id": "', "id", '", "label": "', "raw", '"}'), F.lit("]}\n```")),
        F.concat(F.lit("["), each(",", '["', "id", '", "', "raw", '"]'), F.lit("]")),
        F.concat("text", F.lit("\n```csv\nn,Label,row_id\n"), each("\n", '1,"', "raw", '",', "id"), F.lit("\n```\n"), "text"),
        F.concat("text", F.lit("\n"), each("\n", "id", ": ", "raw")),
        F.concat(F.lit("| id | is |\n|---|---|\n"), each("\n", "| ", "id", " | ", "raw", " |"), F.lit("\n"), "text"),
    ]
    return c.select("conv_id", "turn", F.element_at(F.array(*shapes), ((F.col("conv_id") + F.col("turn")) % 6 + 1).cast("int")).alias("content"))


def _lift(spark, d):
    o = _predicted(spark, d).withColumn("variant", F.when(F.col("o_orderkey") % 2 == 0, "price").otherwise("price_sentiment"))
    acc = o.groupBy("o_orderpriority", "variant").agg(F.avg((F.col("gold") == F.col("pred")).cast("double")).alias("accuracy"))
    return acc


def _walk(spark, d):
    edges = table(spark, d, "nation").select(F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("parent"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("child")).union(table(spark, d, "region").select(F.lit("root"), F.concat(F.lit("r"), F.col("r_regionkey").cast("string"))))
    return W.frontier_walk(edges.withColumn("kind", F.lit("sitemap")), ["root"])[0].withColumnRenamed("steps", "depth")


SITE = "https://x.example/"


def _site(spark, d):
    """A site's sitemaps by order dates: years in a chain, their months, which list pages and lead back to the root."""
    day = F.to_date("o_orderdate")
    o = table(spark, d, "orders").select(day.alias("day"), F.col("o_orderkey").cast("string").alias("id"))
    year, month = (lambda c: F.concat(F.lit(SITE + "y"), F.year(c).cast("string"), F.lit(".xml"))), F.concat(F.lit(SITE + "sitemap."), F.date_format("day", "yyyyMM"), F.lit(".xml"))
    page = F.concat(F.lit(SITE), F.date_format("day", "yyyy/MM/dd"), F.lit("/"), "id")
    parts = [("sitemap", year(F.col("day")), year(F.add_months("day", 12))), ("sitemap", year(F.col("day")), month), ("url", month, page), ("url", F.lit(SITE + "root.xml"), page), ("sitemap", F.lit(SITE + "root.xml"), F.lit(SITE + "y1995.xml")), ("sitemap", F.lit(SITE + "y1999.xml"), F.lit(SITE + "root.xml"))]
    out = None
    for kind, parent, child in parts:
        part = o.select(parent.alias("parent"), child.alias("child"), F.lit(kind).alias("kind"))
        out = part if out is None else out.union(part)
    return out.distinct()


def _crawled(spark, d):
    return W.frontier_walk(_site(spark, d), [SITE + "root.xml"], bad="199903\\.xml$", since=datetime.date(1998, 6, 15), allow="^https://", block=("7$",))[1]


QUERIES = {
    "exclude_exact_anti": lambda s, d: K.exclude_exact(_dated(s, d), _held(s, d)).select("doc_id", "date"),
    "exclude_loose_anti": lambda s, d: K.exclude_loose(_dated(s, d), _held(s, d), "doc_id").select("doc_id", "date"),
    "already_matched_semi": lambda s, d: _held(s, d).join(_dated(s, d), ["date", "text"], "left_semi").select("held_id", "date"),
    "company_alias_match": lambda s, d: _matched(s, d).select("p_partkey", "ticker", "matched_aliases", "match_in_title", "match_in_body", "match_in_text"),
    "company_summary": lambda s, d: K.company_summary(_matched(s, d), SPECS),
    "even_quota": lambda s, d: K.even_quota(table(s, d, "documents").groupBy("source").agg(F.count("*").alias("size")), "source", "size", 333),
    "month_balanced_sample_counts": lambda s, d: _month_sample(s, d).groupBy("month").agg(F.count("*").alias("n")),
    "month_balanced_sample": _month_sample,
    "sentiment_month_sample_counts": _sentiment_month,
    "year_samples": _year_samples,
    "split_80_10_10": lambda s, d: K.exact_split(table(s, d, "documents").select("doc_id"), K.hashed(7, "doc_id")),
    "train_set_prep": _train_set,
    "confusion_matrix": lambda s, d: X.confusion(_predicted(s, d), "gold", "pred", LABELS),
    "confusion_matrix_norm": lambda s, d: rounded(X.normalised(X.confusion(_predicted(s, d), "gold", "pred", LABELS), LABELS)),
    "classification_report": lambda s, d: rounded(X.by_class(_predicted(s, d), "gold", "pred", LABELS).drop("hit")),
    "macro_weighted_f1": lambda s, d: rounded(X.summary(X.by_class(_predicted(s, d), "gold", "pred", LABELS))),
    "provider_merge": lambda s, d: C.merge_providers(_replies(s, d), PROVIDERS),
    "provider_coverage": lambda s, d: C.merge_providers(_replies(s, d), PROVIDERS).agg(*[F.count_if(F.col(f"{p}_label") != "").alias(p) for p in PROVIDERS]),
    "consensus_label": _consensus,
    "consensus_of_five": _five_consensus,
    "provider_conflicts": lambda s, d: C.conflicts(_five(s, d), "pos"),
    "recall_by_model": lambda s, d: rounded(_recalls(s, d)),
    "prompt_batches": lambda s, d: C.batches(table(s, d, "conversations").withColumn("ord", F.col("conv_id") * 100000 + F.col("turn")), "role", "ord", "text").select("role", "batch", "n_rows", F.md5("prompt").alias("prompt_md5")),
    "reply_parse": lambda s, d: C.parse_replies(_reply_texts(s, d), "content", "conv_id", "turn"),
    "sentiment_lift": lambda s, d: rounded(X.lift(_lift(s, d), ["o_orderpriority"], "variant", "accuracy", "price", "price_sentiment")),
    "metric_pivot": lambda s, d: rounded(_lift(s, d).groupBy("o_orderpriority").pivot("variant", ["price", "price_sentiment"]).agg(F.max("accuracy"))),
    "recall_grid": lambda s, d: rounded(X.by_class(_predicted(s, d), "gold", "pred", LABELS).groupBy().pivot("label", LABELS).agg(F.max("recall"))),
    "sitemap_walk": _walk,
    "frontier_links": _crawled,
}

_DATED = "dated AS (SELECT doc_id, date, body AS text FROM articles), held AS (SELECT doc_id AS held_id, date, CASE doc_id % 10 WHEN 0 THEN text WHEN 5 THEN substr(text, 1, 150) ELSE substr(text, 1, 100) END AS text FROM dated WHERE doc_id % 10 IN (0, 5, 7))"
_EXACT = f"{_ARTICLES}, {_DATED}, lft AS (SELECT * FROM dated c WHERE NOT EXISTS (SELECT 1 FROM held h WHERE h.date = c.date AND h.text = c.text))"
_NEAR = "(starts_with(c.text, h.text) OR starts_with(h.text, c.text) OR (length(c.text) >= 160 AND length(h.text) >= 160 AND substr(c.text, 1, 160) = substr(h.text, 1, 160)))"
_PARTS = "p AS (SELECT p_partkey, p_name AS title, p_type || ' ' || p_name AS body, DATE '2024-01-01' + CAST(p_partkey % 365 AS INT) AS date, p_brand AS source FROM part), t AS (SELECT *, title || '. ' || body AS text FROM p)"


def _alias_sql() -> str:
    parts = []
    for s in SPECS:
        field = lambda f, s=s: "list_filter([" + ", ".join(f"CASE WHEN regexp_matches({f}, '(?i)" + (rf"(^|[^A-Za-z0-9]){a}([^A-Za-z0-9]|$)" if " " not in a else a.replace(" ", r"\s+")) + f"') THEN '{a}' END" for a in s.aliases) + "], lambda x: x IS NOT NULL)"
        parts.append(f"SELECT p_partkey, date, source, '{s.ticker}' AS ticker, {field('title')} AS a, {field('body')} AS b, {field('text')} AS c FROM t")
    return f"{_PARTS}, hits AS ({' UNION ALL '.join(parts)}), mt AS (SELECT * FROM hits WHERE len(a) + len(b) + len(c) > 0)"


_MONTHS = f"{_ARTICLES}, am AS (SELECT doc_id, strftime(date, '%Y-%m') AS month FROM articles), mq AS (SELECT month, count(*) AS quota FROM (SELECT month, row_number() OVER (PARTITION BY month) AS r FROM am ORDER BY r, month LIMIT 100) GROUP BY month)"
_PRED = "pr AS (SELECT o_orderkey, o_orderpriority, CASE o_orderstatus WHEN 'F' THEN 'negative' WHEN 'O' THEN 'neutral' ELSE 'positive' END AS gold, CASE WHEN o_totalprice < 150000 THEN 'negative' WHEN o_totalprice < 300000 THEN 'neutral' ELSE 'positive' END AS pred FROM orders)"
_CM = f"{_PRED}, cm AS (SELECT gold, sum((pred = 'negative')::BIGINT)::BIGINT AS negative, sum((pred = 'neutral')::BIGINT)::BIGINT AS neutral, sum((pred = 'positive')::BIGINT)::BIGINT AS positive FROM pr GROUP BY gold)"
_CLASSES = f"{_PRED}, lb AS (SELECT unnest(['negative', 'neutral', 'positive']) AS label), k AS (SELECT label, (SELECT count(*) FROM pr WHERE gold = label) AS g, (SELECT count(*) FROM pr WHERE pred = label) AS p, (SELECT count(*) FROM pr WHERE gold = label AND pred = label) AS hit FROM lb), q AS (SELECT label, g, hit, coalesce(hit / nullif(p, 0), 0) AS precision, coalesce(hit / nullif(g, 0), 0) AS recall FROM k), cl AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM q)"
_REPLY = "rp AS (SELECT event_id, printf('row_%05d', event_id % 400) AS row_id, ['one', 'two', 'three'][user_id % 3 + 1] AS provider, ['pos', 'neg', 'neut'][event_id % 7 % 3 + 1] AS label FROM events), mg AS (SELECT row_id, " + ", ".join(f"coalesce(arg_max(label, event_id) FILTER (provider = '{p}'), '') AS {p}_label" for p in PROVIDERS) + " FROM rp GROUP BY row_id)"
_FIVE = "e5 AS (SELECT event_id, event_id % 300 AS k, ['one', 'two', 'three', 'four', 'five'][user_id % 5 + 1] AS provider FROM events), r5 AS (SELECT printf('row_%05d', k) AS row_id, provider, CASE WHEN k % 10 = 0 AND event_id % 7 = 0 THEN 'neg' WHEN event_id % 41 = 0 THEN '' ELSE ['pos', 'neg', 'neut'][k % 3 + 1] END AS label, event_id FROM e5)"
_ACC = f"{_PRED}, ac AS (SELECT o_orderpriority, CASE WHEN o_orderkey % 2 = 0 THEN 'price' ELSE 'price_sentiment' END AS variant, avg((gold = pred)::INT) AS accuracy FROM pr GROUP BY ALL)"



def _dealt(sizes: str, group: str, n: str, outer: str) -> str:
    """SQL: quotas by rounds: the ``n`` first of a key's rows, taken from its groups in turn."""
    return f"SELECT {outer}, {group}, count(*) AS quota FROM (SELECT *, row_number() OVER (PARTITION BY {outer} ORDER BY r, {group}) AS k FROM (SELECT *, unnest(range(1, size + 1)) AS r FROM {sizes})) WHERE k <= {n} GROUP BY {outer}, {group}"


def _year_sample(strategy: str, bucket: str) -> str:
    return f"""SELECT * FROM (WITH o AS (SELECT doc_id, CAST(DATE '2023-01-01' + CAST(doc_id * 37 % 731 AS INT) AS DATE) AS date, CASE WHEN toxic = 1 THEN 'neutral' WHEN quality = 1 THEN 'positive' WHEN quality = 0 THEN 'negative' ELSE '' END AS b FROM documents LEFT JOIN labels USING (doc_id)),
t AS (SELECT doc_id, year(date) AS y, strftime(date, '%Y-%m') AS m, {bucket} AS b, CASE year(date) WHEN 2023 THEN {TARGETS[2023]} WHEN 2024 THEN {TARGETS[2024]} END AS asked FROM o WHERE year(date) IN (2023, 2024)),
s1 AS (SELECT y, b, count(*) AS size, any_value(asked) AS asked FROM t WHERE b <> '' GROUP BY y, b), q1 AS ({_dealt('s1', 'b', 'asked', 'y')}),
s2 AS (SELECT y, b, m, count(*) AS size, any_value(quota) AS n FROM t JOIN q1 USING (y, b) GROUP BY y, b, m), q2 AS ({_dealt('s2', 'm', 'n', 'y, b')}),
p AS (SELECT * FROM (SELECT t.*, row_number() OVER (PARTITION BY y, b, m ORDER BY md5('42|' || doc_id)) AS k FROM t WHERE b <> '') JOIN q2 USING (y, b, m) WHERE k <= quota),
r AS (SELECT t.* FROM t WHERE doc_id NOT IN (SELECT doc_id FROM p)),
s3 AS (SELECT y, m, count(*) AS size, any_value(asked) - (SELECT count(*) FROM p WHERE p.y = r.y) AS n FROM r GROUP BY y, m), q3 AS ({_dealt('s3', 'm', 'n', 'y')}),
a AS (SELECT * FROM (SELECT r.*, row_number() OVER (PARTITION BY y, m ORDER BY md5('819|' || doc_id)) AS k FROM r) JOIN q3 USING (y, m) WHERE k <= quota)
SELECT doc_id, '{strategy}' AS sample_strategy, CAST(y AS INT) AS sample_target_year, m AS sample_month, b AS sample_sentiment_bucket FROM (SELECT doc_id, y, m, b FROM p UNION ALL SELECT doc_id, y, m, b FROM a))"""


ORACLES = {
    "year_samples": " UNION ALL ".join(_year_sample(*x) for x in ((K.BY_MONTH, "''"), (K.UNLABELLED, "''"), (K.BY_LABEL, "b"))),
    "exclude_exact_anti": f"WITH {_EXACT} SELECT doc_id, date FROM lft",
    "exclude_loose_anti": f"WITH {_EXACT}, rest AS (SELECT * FROM held h WHERE length(text) >= 120 AND NOT EXISTS (SELECT 1 FROM dated c WHERE h.date = c.date AND h.text = c.text)), o AS (SELECT min(c.doc_id) AS doc_id FROM lft c JOIN rest h ON c.date = h.date AND length(c.text) >= 120 AND {_NEAR} GROUP BY held_id) SELECT doc_id, date FROM lft WHERE doc_id NOT IN (SELECT doc_id FROM o)",
    "already_matched_semi": f"WITH {_ARTICLES}, {_DATED} SELECT held_id, date FROM held h WHERE EXISTS (SELECT 1 FROM dated c WHERE c.date = h.date AND c.text = h.text)",
    "company_alias_match": f"WITH {_alias_sql()} SELECT p_partkey, ticker, (SELECT string_agg(x, '; ' ORDER BY i) FROM (SELECT x, min(i) AS i FROM (SELECT unnest(a || b || c) AS x, generate_subscripts(a || b || c, 1) AS i) GROUP BY x)) AS matched_aliases, len(a) > 0 AS match_in_title, len(b) > 0 AS match_in_body, len(c) > 0 AS match_in_text FROM mt",
    "company_summary": f"WITH {_alias_sql()}, sp AS (SELECT unnest([{', '.join(repr(s.ticker) for s in SPECS)}]) AS ticker, unnest([{', '.join(repr(s.name) for s in SPECS)}]) AS company_name) SELECT ticker, company_name, count(p_partkey) AS rows, min(date) AS min_date, max(date) AS max_date, count(DISTINCT source) AS n_sources FROM sp LEFT JOIN mt USING (ticker) GROUP BY ticker, company_name",
    "even_quota": "SELECT source, count(*) AS quota FROM (SELECT source, row_number() OVER (PARTITION BY source) AS r FROM documents ORDER BY r, source LIMIT 333) GROUP BY source",
    "month_balanced_sample_counts": f"WITH {_MONTHS} SELECT month, quota AS n FROM mq",
    "month_balanced_sample": f"WITH {_MONTHS} SELECT doc_id, month FROM (SELECT doc_id, month, row_number() OVER (PARTITION BY month ORDER BY md5('42|' || doc_id)) AS r FROM am) JOIN mq USING (month) WHERE r <= quota",
    "sentiment_month_sample_counts": "WITH e AS (SELECT CAST(ts AS DATE) AS day, CASE WHEN event_type = 'error' THEN 'negative' WHEN event_type IN ('click', 'purchase') THEN 'positive' ELSE 'neutral' END AS label FROM events), lq AS (SELECT label, count(*) AS q FROM (SELECT label, row_number() OVER (PARTITION BY label) AS r FROM e ORDER BY r, label LIMIT 100) GROUP BY label), n AS (SELECT label, day, row_number() OVER (PARTITION BY label, day) AS r FROM e), k AS (SELECT label, day, row_number() OVER (PARTITION BY label ORDER BY r, day) AS i FROM n) SELECT label, day, count(*) AS quota FROM k JOIN lq USING (label) WHERE i <= q GROUP BY ALL",
    "split_80_10_10": "WITH o AS (SELECT doc_id, row_number() OVER (ORDER BY md5('7|' || doc_id)) - 1 AS pos, count(*) OVER () AS n FROM documents) SELECT doc_id, CASE WHEN pos < floor(n * 0.8) THEN 'train' WHEN pos < floor(n * 0.9) THEN 'validation' ELSE 'test' END AS split FROM o",
    "train_set_prep": f"WITH {_ARTICLES}, a AS (SELECT doc_id, trim(title) AS text, CASE WHEN toxic = 1 THEN 1 WHEN quality = 1 THEN 2 ELSE 0 END::INT AS label_id FROM articles JOIN labels USING (doc_id) WHERE trim(title) <> '') SELECT min(doc_id) AS doc_id, text, arg_min(label_id, doc_id) AS label_id FROM a GROUP BY text",
    "confusion_matrix": f"WITH {_CM} SELECT * FROM cm",
    "confusion_matrix_norm": f"WITH {_CM} SELECT gold, round(negative / (negative + neutral + positive), 6) AS negative, round(neutral / (negative + neutral + positive), 6) AS neutral, round(positive / (negative + neutral + positive), 6) AS positive FROM cm",
    "classification_report": f"WITH {_CLASSES} SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, g AS support FROM cl",
    "macro_weighted_f1": f"WITH {_CLASSES} SELECT round(sum(hit) / sum(g), 6) AS accuracy, " + ", ".join(f"round(avg({c}), 6) AS {c}_macro, round(sum({c} * g) / sum(g), 6) AS {c}_weighted" for c in ("precision", "recall", "f1")) + " FROM cl",
    "provider_merge": f"WITH {_REPLY} SELECT * FROM mg",
    "provider_coverage": f"WITH {_REPLY} SELECT " + ", ".join(f"count(*) FILTER ({p}_label <> '') AS {p}" for p in PROVIDERS) + " FROM mg",
    "consensus_label": f"WITH {_REPLY} SELECT row_id, CASE WHEN one_label = '' OR two_label = '' OR three_label = '' THEN '' WHEN one_label = two_label AND two_label = three_label THEN one_label ELSE 'mixed' END AS consensus FROM mg",
    "consensus_of_five": f"WITH {_FIVE}, m5 AS (SELECT row_id, " + ", ".join(f"coalesce(arg_max(label, event_id) FILTER (provider = '{p}'), '') AS {p}_label" for p in FIVE) + " FROM r5 WHERE label <> '' GROUP BY row_id) SELECT *, CASE WHEN '' IN (" + ", ".join(f"{p}_label" for p in FIVE) + ") THEN '' WHEN " + " AND ".join(f"one_label = {p}_label" for p in FIVE[1:]) + " THEN one_label ELSE 'mixed' END AS consensus FROM m5",
    "provider_conflicts": f"WITH {_FIVE} SELECT provider, row_id, count(DISTINCT label) AS n_labels, arg_max(label, event_id) AS kept_label FROM r5 WHERE label <> '' GROUP BY provider, row_id HAVING count(DISTINCT label) > 1",
    "recall_by_model": f"WITH {_PRED}, b AS (SELECT 'priced' AS model, gold, pred AS told FROM pr UNION ALL SELECT 'constant', gold, 'neutral' FROM pr) SELECT model, " + ", ".join(f"coalesce(round(avg((told = gold)::INT) FILTER (gold = '{x}'), 6), 0) AS {x}" for x in LABELS) + " FROM b GROUP BY model",
    "prompt_batches": "WITH n AS (SELECT role, text, row_number() OVER (PARTITION BY role ORDER BY conv_id * 100000 + turn) - 1 AS pos FROM conversations) SELECT role, CAST(floor(pos / 20) + 1 AS BIGINT) AS batch, count(*) AS n_rows, md5(string_agg(printf('row_%05d', pos + 1) || ',' || regexp_replace(text, '[,\\s]+', ' ', 'g'), chr(10) ORDER BY pos)) AS prompt_md5 FROM n GROUP BY role, batch",
    "reply_parse": "SELECT conv_id, turn, printf('row_%05d', conv_id * 10 + i) AS row_id, ['pos', 'neg', 'neg', 'neut', 'pos', 'neut'][(conv_id + turn + i) % 6 + 1] AS label FROM (SELECT conv_id, turn, unnest(range(0, conv_id % 3 + 1)) AS i FROM conversations WHERE role = 'assistant')",
    "sentiment_lift": f"WITH {_ACC} SELECT o_orderpriority, round(max(accuracy) FILTER (variant = 'price_sentiment') - max(accuracy) FILTER (variant = 'price'), 6) AS lift FROM ac GROUP BY o_orderpriority",
    "metric_pivot": f"WITH {_ACC} SELECT o_orderpriority, round(max(accuracy) FILTER (variant = 'price'), 6) AS price, round(max(accuracy) FILTER (variant = 'price_sentiment'), 6) AS price_sentiment FROM ac GROUP BY o_orderpriority",
    "recall_grid": f"WITH {_CLASSES} SELECT " + ", ".join(f"round(max(recall) FILTER (label = '{x}'), 6) AS {x}" for x in LABELS) + " FROM cl",
    "frontier_links": f"""WITH RECURSIVE o AS (SELECT CAST(o_orderdate AS DATE) AS day, o_orderkey FROM orders), ys AS (SELECT DISTINCT year(day) AS y FROM o),
w AS (SELECT 1995 AS y, 1 AS steps UNION ALL SELECT y + 1, steps + 1 FROM w WHERE y IN (SELECT y FROM ys)),
m AS (SELECT DISTINCT strftime(day, '%Y%m') AS m, steps + 1 AS steps FROM o JOIN w ON w.y = year(day) WHERE strftime(day, '%Y%m') >= '199806' AND strftime(day, '%Y%m') <> '199903')
SELECT '{SITE}' || strftime(day, '%Y/%m/%d') || '/' || o_orderkey AS link, CAST(steps AS INT) AS steps FROM o JOIN m ON m = strftime(day, '%Y%m') WHERE day >= DATE '1998-06-15' AND o_orderkey % 10 <> 7""",
    "sitemap_walk": "WITH RECURSIVE e AS (SELECT 'r' || n_regionkey AS parent, 'n' || n_nationkey AS child FROM nation UNION ALL SELECT 'root', 'r' || r_regionkey FROM region), w AS (SELECT 'root' AS node, 0 AS depth UNION ALL SELECT child, depth + 1 FROM w JOIN e ON parent = node WHERE depth < 10) SELECT node, min(depth) AS depth FROM w GROUP BY node",
}
