"""Queries on texts, labels, dates and web pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import labels as L
from ..functions import text as T
from ..operators import web as W
from .tables import table


def articles(spark: SparkSession, d: str) -> DataFrame:
    """Documents as articles: title before the first full stop, a date by id, url by id from the pages."""
    docs = table(spark, d, "documents")
    return docs.select("doc_id", F.col("source"), F.col("lang").alias("category"), F.trim(F.substring_index("text", ".", 1)).alias("title"), F.col("text").alias("body"), F.date_add(F.lit("2023-01-01").cast("date"), (F.col("doc_id") % 1096).cast("int")).alias("date"))


def _docs(column, name):
    return lambda s, d: table(s, d, "documents").select("doc_id", column().alias(name))


def _pages(*columns):
    return lambda s, d: table(s, d, "pages").select("page_id", *[c().alias(n) for n, c in columns])


_LABELS = ["Positive outlook", "neg", " Bearish ", "mixed", "-1", "1", "n/a", "It is not negative, neutral", "POS", "a {\"label\": \"pos\"}", '{"label":"neg"}', "bullish run", "neutral/positive", ""]


def _labelled(spark, d):
    choices = F.array(*[F.lit(x) for x in _LABELS])
    return table(spark, d, "events").select("event_id", F.element_at(choices, (F.col("event_id") % len(_LABELS) + 1).cast("int")).alias("raw"))


def _normalised(fn):
    return lambda s, d: _labelled(s, d).select("event_id", fn("raw").alias("label"))


def _dated(spark, d):
    day = F.to_date("o_orderdate")
    shown = F.element_at(F.array(F.date_format(day, "yyyy-MM-dd"), F.date_format(day, "dd/MM/yyyy"), F.date_format(day, "dd/MM/yy"), F.date_format(day, "M/d/yyyy"), F.lit("soon")), (F.col("o_orderkey") % 5 + 1).cast("int"))
    return table(spark, d, "orders").select("o_orderkey", shown.alias("raw"))


#: Forms of an order's date (as Spark and SQL expressions of day), and the day that each means.
def _forms(day):
    f = lambda p: F.date_format(day, p)
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    week = text(F.extract(F.lit("YEAROFWEEK"), day).cast("string"), "-W", F.lpad(F.weekofyear(day).cast("string"), 2, "0"), "-", (F.weekday(day) + 1).cast("string"))
    return [
        f("yyyyMMdd"), text(f("yyyy-MM-dd"), "T23:10:05.5+08:00"), week, f("yyyy-DDD"), f("d MMMM yyyy"), f("MMM d, yyyy"), text(f("EEE, dd MMM yyyy"), " 10:20:30 GMT"), text(f("EEEE, MMMM d"), "th, ", f("yyyy"), " at 9:05 PM"),
        f("dd-MMM-yy"), f("MM.dd.yyyy"), f("MMMM yyyy"), f("yyyy"), text(f("yyyy-MM"), "-32"), text("on ", f("yyyy-MM-dd")), f("d/M/yyyy"), f("yyyy MMM dd"),
    ]


def _mixed(spark, d):
    forms = _forms(F.to_date("o_orderdate"))
    raw = F.element_at(F.array(*forms), (F.col("o_orderkey") % len(forms) + 1).cast("int"))
    return table(spark, d, "orders").select("o_orderkey", D.normalised(raw).alias("day"))


def _probed(spark, d):
    """Pages with tags that tell a date, in every way, and with some that don't."""
    when = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 300).cast("int"))
    iso, words = F.concat(F.date_format(when, "yyyy-MM-dd"), F.lit("T08:00:00Z")), F.date_format(when, "d MMM yyyy")
    tags = [
        ('<meta property="article:published_time" content="', iso, '">'), ("<META content='", words, "' name='pubdate'/>"), ('<meta name=date content="soon"><meta itemprop="datePublished" content="', iso, '">'), ('<p><time class="x" datetime="', iso, '">'),
        ('<meta name="article:published_time" content="', words, '">'), ('<meta property="og:published_time" content="', iso, '"><meta property="article:published_time" content="">'), ('<meta name="publish-date" content="', words, '">'), ('<meta name="dates" content="', words, '">'), ("<time>", words, "</time>"),
        ('<time datetime="2020-02-02"></time><meta name="date" content="', iso, '">'),
    ]
    told = F.element_at(F.array(*[F.concat(F.lit(a), b, F.lit(c)) for a, b, c in tags]), (F.col("page_id") % len(tags) + 1).cast("int"))
    return W.published_date(table(spark, d, "pages").select("page_id", F.concat(told, F.coalesce("html", F.lit(""))).alias("html"))).select("page_id", "published")


def _epochs(spark, d):
    e = table(spark, d, "events")
    seconds = F.unix_timestamp(F.col("ts").cast("timestamp"))
    raw = F.when(F.col("event_id") % 3 == 0, seconds.cast("string")).when(F.col("event_id") % 3 == 1, (seconds * 1000).cast("string")).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return e.select("event_id", F.date_format(D.moment(raw), "yyyy-MM-dd HH:mm:ss").alias("moment"))


def _mojibake(spark, d):
    seeded = F.concat("text", F.when(F.col("doc_id") % 3 == 0, F.lit("cafÃ© itâ€™s Â£")).otherwise(F.lit("")))
    return table(spark, d, "documents").select("doc_id", seeded.alias("text"))


def _quoted(spark, d):
    seeded = F.concat("text", F.when(F.col("doc_id") % 3 == 0, F.lit("cafÃ© â€œxâ€\x9d itâ€™s Â£")).otherwise(F.lit("")))
    return table(spark, d, "documents").select("doc_id", seeded.alias("text"))


def _boiler(spark, d):
    parts = F.when(F.col("doc_id") % 2 == 0, F.lit("Follow us on social media. Read also this. Copyright 2024 X. ")).otherwise(F.lit("All rights reserved. Terms of service apply here. "))
    return table(spark, d, "documents").select("doc_id", F.concat(parts, "text").alias("text"))


def _datelined(spark, d):
    heads = F.array(*[F.lit(x) for x in ("KUALA LUMPUR: ", "home | KUALA LUMPUR (Jan 31): ", "TOKYO (Reuters) - ", "ALOR SETAR, Jan 1 — ", "Plain. ")])
    return table(spark, d, "documents").select("doc_id", F.concat(F.element_at(heads, (F.col("doc_id") % 5 + 1).cast("int")), F.coalesce("text", F.lit(""))).alias("text"))


def _links(spark, d):
    pages = table(spark, d, "pages")
    found = pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('(?i)<a[^>]*href="([^"#]*)'), F.lit(1))).alias("href"))
    return found.where(F.rlike("href", F.lit("^/[A-Za-z]")) & ~F.rlike("href", F.lit("(?i)the"))).groupBy("page_id").agg(F.count("*").alias("n_links"), F.min("href").alias("first_href"))


def _sentences(spark, d):
    return T.distinct_sentences(table(spark, d, "documents").select("doc_id", F.col("text").alias("body")), "body")


def _text_sources(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", F.lit("documents").alias("origin"), "source")
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text", F.lit("benchmark").alias("origin"))
    return docs.unionByName(items, allowMissingColumns=True)


def _fingerprints(spark, d):
    a = articles(spark, d).withColumn("fp", T.fingerprint("title", "body"))
    return T.first_of(a, "fp", "doc_id").select("doc_id", "fp")


def _url_rows(spark, d):
    return table(spark, d, "pages").select("page_id", T.canonical_url("url").alias("url"))


def _url_first(spark, d):
    rows = _url_rows(spark, d).withColumn("key", F.regexp_replace("url", "[0-9]+.*$", ""))
    return T.first_of(rows, "key", "page_id").select("page_id", "key")


def _cleaned(spark, d):
    a = articles(spark, d).where((F.col("date") >= "2023-06-01") & (F.length("title") > 0) & (F.length("body") >= 80))
    return a.select("doc_id", "date", F.length("body").cast("bigint").alias("body_chars"), F.length(F.trim(F.concat("title", F.lit(". "), "body"))).cast("bigint").alias("text_chars"))


def _validation(spark, d):
    a = articles(spark, d)
    status = F.when(F.length("title") == 0, "fail").when(F.length("body") < 200, "warn").otherwise("pass")
    return a.groupBy(status.alias("status")).agg(F.count("*").alias("n"))


def _titles(spark, d):
    p = table(spark, d, "pages")
    title = F.coalesce(F.nullif(F.regexp_extract("html", "(?s)<h1[^>]*>(.*?)</h1>", 1), F.lit("")), F.regexp_extract("html", "(?s)<title[^>]*>(.*?)</title>", 1))
    day = F.coalesce(*[F.nullif(F.regexp_extract("html", p, 1), F.lit("")) for p in ('(?i)<meta[^>]*property="article:published_time"[^>]*content="([^"]*)"', '(?i)<time[^>]*datetime="([^"]*)"')])
    return p.select("page_id", title.alias("title"), day.alias("published"))


QUERIES = {
    "clean_whitespace": _docs(lambda: T.collapse("text"), "text"),
    "mojibake_score": lambda s, d: _mojibake(s, d).select("doc_id", T.mojibake_score("text").alias("score")),
    "mojibake_repair": lambda s, d: T.repair(_mojibake(s, d), "text"),
    "clean_text": lambda s, d: T.clean(_mojibake(s, d), "text"),
    "clean_mojibake_columns": lambda s, d: T.clean_mojibake(_mojibake(s, d).withColumn("head", F.substring_index("text", ".", 1)), ["text", "head"]),
    "literal_replacements": lambda s, d: _quoted(s, d).select("doc_id", T.replaced("text").alias("text")),
    "strip_tags": _pages(("text", lambda: T.strip_tags("html"))),
    "boilerplate_strip": lambda s, d: _boiler(s, d).select("doc_id", T.without_boilerplate("text").alias("text")),
    "dateline_strip": lambda s, d: T.strip_dateline(_datelined(s, d), "text"),
    "canonical_url": _url_rows,
    "url_host": _pages(("host", lambda: T.host("url"))),
    "slugify": lambda s, d: table(s, d, "part").select("p_partkey", T.slug(F.concat_ws(" ", "p_name", "p_brand", "p_type")).alias("slug")),
    "sentence_dedupe": _sentences,
    "match_text": _docs(lambda: T.match_text("text"), "text"),
    "text_fingerprint_dedupe": _fingerprints,
    "url_dedupe_keep_first": _url_first,
    "corpus_clean_filter": _cleaned,
    "year_split_counts": lambda s, d: articles(s, d).groupBy(F.year("date").cast("bigint").alias("year")).agg(F.count("*").alias("n"), F.count_distinct("source").alias("n_sources")),
    "month_buckets": lambda s, d: articles(s, d).groupBy(F.date_format("date", "yyyy-MM").alias("month")).agg(F.count("*").alias("n")),
    "mixed_dates": _mixed,
    "published_dates": _probed,
    "multi_format_dates": lambda s, d: _dated(s, d).select("o_orderkey", D.parsed("raw").alias("day")),
    "epoch_parse": _epochs,
    "url_dates": lambda s, d: table(s, d, "pages").select("page_id", D.url_date(F.concat("url", F.lit("/2024/"), F.lpad((F.col("page_id") % 14).cast("string"), 2, "0"), F.lit("/15/x"))).alias("day")),
    "tumbling_windows_90d": lambda s, d: D.tumbling(table(s, d, "orders").select(F.to_date("o_orderdate").alias("day")), "day", 90),
    "label_norm_corpus": _normalised(L.corpus),
    "label_norm_gold": _normalised(L.gold),
    "label_norm_generated": _normalised(L.generated),
    "label_norm_chat": _normalised(L.chat),
    "label_training_ids": lambda s, d: _labelled(s, d).where(F.col("raw").isin("-1", "1")).select("event_id", L.training("raw").alias("label_id")),
    "label_to_score": lambda s, d: _labelled(s, d).select("event_id", L.score(L.gold("raw")).alias("score")),
    "prob_score": lambda s, d: table(s, d, "events").select("event_id", (F.col("value") / 100).alias("p"), F.when(F.col("event_id") % 4 > 0, 0.25).alias("q")).select("event_id", F.round(L.probability_score("p", "q"), 6).alias("score")),
    "html_links": _links,
    "html_title_date": _titles,
    "union_by_name": lambda s, d: _text_sources(s, d).groupBy("origin").agg(F.count("*").alias("n"), F.count("source").alias("with_source")),
    "union_distinct": lambda s, d: table(s, d, "documents").select("text").union(table(s, d, "benchmark").select("text")).distinct().agg(F.count("*").alias("n")),
    "validation_status": _validation,
    "kaggle_category_filter": lambda s, d: articles(s, d).where(F.rlike("source", F.lit(r"(?i)src1|src\s*2")) & F.rlike("category", F.lit("(?i)^(en|fr)$")) & (F.col("date") >= "2024-01-01")).select("doc_id", "source", "category", "date"),
    "top_newest_urls": lambda s, d: table(s, d, "pages").select("page_id", "url").orderBy(F.desc("url"), "page_id").limit(25),
    "article_text_concat": lambda s, d: articles(s, d).select("doc_id", F.md5(T.collapse(F.concat_ws(" ", "title", "body"))).alias("text_md5")),
}

_WS = r"[\s\x1c-\x1f\x{00a0}\x{0085}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x0b]+"


def _collapse(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), '{_WS}', ' ', 'g'))"


def _quote(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _nested(x: str, pairs) -> str:
    for a, b in pairs:
        x = f"replace({x}, {_quote(a)}, {_quote(b)})"
    return x


_SEEDED = "(SELECT doc_id, text || CASE WHEN doc_id % 3 = 0 THEN 'cafÃ© itâ€™s Â£' ELSE '' END AS text FROM documents)"
_QUOTED = "(SELECT doc_id, text || CASE WHEN doc_id % 3 = 0 THEN 'cafÃ© â€œxâ€\x9d itâ€™s Â£' ELSE '' END AS text FROM documents)"
_ARTICLES = "articles AS (SELECT doc_id, source, lang AS category, trim(split_part(text, '.', 1)) AS title, text AS body, DATE '2023-01-01' + CAST(doc_id % 1096 AS INT) AS date FROM documents)"
_RAW = f"(SELECT event_id, [{', '.join(_quote(x) for x in _LABELS)}][event_id % {len(_LABELS)} + 1] AS raw FROM events)"
_TITLED = "title || ' ' || body"
_LOW = "lower(trim(regexp_replace(raw, '\\s+', ' ', 'g')))"
_BOILED = "(SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'Follow us on social media. Read also this. Copyright 2024 X. ' ELSE 'All rights reserved. Terms of service apply here. ' END || text AS text FROM documents)"


def _boiled() -> str:
    x = "text"
    for p in T.BOILERPLATE:
        x = f"regexp_replace({x}, {_quote('(?i)' + p)}, ' ', 'g')"
    return x


def _words(x: str, *choices) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({x}, '\\b(?:{w})\\b') THEN '{label}'" for w, label in choices) + " END"


_GOLD = f"coalesce(map {{{', '.join(f'{_quote(k)}: {_quote(v)}' for k, v in L.GOLD.items())}}}[{_LOW}], {_words(_LOW, ('negative|neg|bearish', 'negative'), ('neutral|neut|mixed', 'neutral'), ('positive|pos|bullish', 'positive'))}, '')"


def _chat(t: str) -> str:
    return f"CASE WHEN {t} IN ('pos', 'neg', 'neut') THEN {t} ELSE coalesce({_words(t, ('pos', 'pos'), ('neg', 'neg'), ('neut', 'neut'))}, CASE WHEN regexp_matches({t}, 'positive|bullish') THEN 'pos' WHEN regexp_matches({t}, 'negative|bearish') THEN 'neg' WHEN regexp_matches({t}, 'neutral|mixed') THEN 'neut' END) END"


_URL = r"'^([a-zA-Z][a-zA-Z0-9+.-]*)://([^/?]+)([^?]*)\??(.*)$'"
_CANON = f"""(SELECT page_id, CASE WHEN s = '' THEN whole ELSE lower(s) || '://' || lower(h) || regexp_replace(regexp_replace(p, '/+', '/', 'g'), '/$', '') || CASE WHEN q <> '' THEN '?' || q ELSE '' END END AS url
FROM (SELECT page_id, whole, regexp_extract(whole, {_URL}, 1) AS s, regexp_extract(whole, {_URL}, 2) AS h, regexp_extract(whole, {_URL}, 3) AS p,
array_to_string(list_transform(list_filter(string_split(regexp_extract(whole, {_URL}, 4), '&'), lambda x: x <> '' AND lower(split_part(x, '=', 1)) NOT IN ('{"', '".join(T.TRACKING)}')), lambda x: split_part(x, '=', 1) || '=' || replace(regexp_replace(x, '^[^=]*=?', ''), '%20', '+')), '&') AS q
FROM (SELECT page_id, split_part(trim(coalesce(url, '')), '#', 1) AS whole FROM pages)))"""

# A text in other letters than ASCII can't be read again as a whole, so its damaged ending stays; else the ending was known.
_MENDED = "(SELECT doc_id, text || CASE WHEN doc_id % 3 <> 0 THEN '' WHEN regexp_matches(text, '[^\\x00-\\x7F]') THEN 'cafÃ© itâ€™s Â£' ELSE 'café it’s £' END AS text FROM documents)"
_PLAIN = _nested("text", T.REPLACEMENTS)
ORACLES = {
    "mojibake_repair": f"SELECT doc_id, text FROM {_MENDED}",
    "clean_text": f"""SELECT doc_id, {_collapse(f"regexp_replace({_PLAIN}, '<[^>]+>', ' ', 'g')")} AS text FROM {_MENDED}""",
    "clean_mojibake_columns": f"WITH h AS (SELECT doc_id, text, split_part(text, '.', 1) AS head FROM {_MENDED}) SELECT doc_id, {_collapse(_PLAIN)} AS text, {_collapse(_nested('head', T.REPLACEMENTS))} AS head FROM h",
    "mixed_dates": "SELECT o_orderkey, CAST(CASE o_orderkey % 16 WHEN 10 THEN date_trunc('month', o_orderdate) WHEN 11 THEN date_trunc('year', o_orderdate) WHEN 12 THEN NULL WHEN 13 THEN NULL ELSE o_orderdate END AS DATE) AS day FROM orders",
    "published_dates": "SELECT page_id, CASE WHEN page_id % 10 NOT IN (7, 8) THEN CAST(DATE '2024-01-01' + CAST(page_id % 300 AS INT) AS DATE) END AS published FROM pages",
    "clean_whitespace": f"SELECT doc_id, {_collapse('text')} AS text FROM documents",
    "mojibake_score": f"SELECT doc_id, CAST({' + '.join(f'(length(text) - length(replace(text, {_quote(m)}, {_quote(str())}))) / {len(m)}' for m in T.MARKERS)} AS BIGINT) AS score FROM {_SEEDED}",
    "literal_replacements": f"SELECT doc_id, {_nested('text', T.REPLACEMENTS)} AS text FROM {_QUOTED}",
    "strip_tags": "SELECT page_id, regexp_replace(html, '<[^>]+>', ' ', 'g') AS text FROM pages",
    "boilerplate_strip": f"SELECT doc_id, {_collapse(_boiled())} AS text FROM {_BOILED}",
    "dateline_strip": "SELECT doc_id, trim(CASE WHEN doc_id % 5 = 4 THEN 'Plain. ' ELSE '' END || coalesce(text, '')) AS text FROM documents",
    "canonical_url": f"SELECT page_id, url FROM {_CANON}",
    "url_host": "SELECT page_id, regexp_replace(lower(regexp_extract(coalesce(url, ''), '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1)), '^www\\.', '') AS host FROM pages",
    "slugify": "SELECT p_partkey, trim(regexp_replace(lower(p_name || ' ' || p_brand || ' ' || p_type), '[^a-z0-9]+', '_', 'g'), '_') AS slug FROM part",
    "sentence_dedupe": f"""WITH t AS (SELECT row_number() OVER () AS r, doc_id, {_collapse('text')} AS x FROM documents), p AS (SELECT r, unnest(string_split(regexp_replace(x, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))) AS s, generate_subscripts(string_split(regexp_replace(x, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), 1) AS i FROM t),
f AS (SELECT r, arg_min(s, i) AS s, min(i) AS i FROM p WHERE s <> '' GROUP BY r, lower(s)), b AS (SELECT r, string_agg(s, ' ' ORDER BY i) AS b FROM f GROUP BY r) SELECT doc_id, CASE WHEN lower(x) = 'related' OR starts_with(lower(x), 'related ') THEN '' ELSE coalesce(b, '') END AS body FROM t LEFT JOIN b USING (r)""",
    "match_text": f"SELECT doc_id, {_collapse('lower(' + _nested('text', T.MATCH_REPLACEMENTS) + ')')} AS text FROM documents",
    "text_fingerprint_dedupe": f"WITH {_ARTICLES} SELECT min(doc_id) AS doc_id, sha1(lower(title) || chr(10) || lower(body)) AS fp FROM articles GROUP BY 2",
    "url_dedupe_keep_first": f"SELECT min(page_id) AS page_id, regexp_replace(url, '[0-9]+.*$', '') AS key FROM {_CANON} GROUP BY 2",
    "corpus_clean_filter": f"WITH {_ARTICLES} SELECT doc_id, date, length(body) AS body_chars, length(trim(title || '. ' || body)) AS text_chars FROM articles WHERE date >= DATE '2023-06-01' AND length(title) > 0 AND length(body) >= 80",
    "year_split_counts": f"WITH {_ARTICLES} SELECT year(date) AS year, count(*) AS n, count(DISTINCT source) AS n_sources FROM articles GROUP BY 1",
    "month_buckets": f"WITH {_ARTICLES} SELECT strftime(date, '%Y-%m') AS month, count(*) AS n FROM articles GROUP BY 1",
    "multi_format_dates": "WITH r AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%d/%m/%Y') WHEN 2 THEN strftime(o_orderdate, '%d/%m/%y') WHEN 3 THEN strftime(o_orderdate, '%-m/%-d/%Y') ELSE 'soon' END AS raw FROM orders) SELECT o_orderkey, CAST(coalesce(try_strptime(raw, '%Y-%m-%d'), CASE WHEN regexp_matches(raw, '/\\d{4}$') THEN try_strptime(raw, '%d/%m/%Y') END, CASE WHEN regexp_matches(raw, '/\\d{2}$') THEN try_strptime(left(raw, length(raw) - 2) || '20' || right(raw, 2), '%d/%m/%Y') END, CASE WHEN regexp_matches(raw, '/\\d{4}$') THEN try_strptime(raw, '%m/%d/%Y') END) AS DATE) AS day FROM r",
    "epoch_parse": "SELECT event_id, strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS moment FROM events",
    "url_dates": "SELECT page_id, CAST(try_strptime('2024-' || lpad(CAST(page_id % 14 AS VARCHAR), 2, '0') || '-15', '%Y-%m-%d') AS DATE) AS day FROM pages",
    "tumbling_windows_90d": "WITH o AS (SELECT CAST(o_orderdate AS DATE) AS day FROM orders), e AS (SELECT min(day) AS f, max(day) AS l FROM o), w AS (SELECT CAST(unnest(generate_series(f, l, INTERVAL 90 DAY)) AS DATE) AS window_start, l FROM e) SELECT window_start, least(CAST(window_start + 89 AS DATE), l) AS window_end, (SELECT count(*) FROM o WHERE day >= window_start AND day < window_start + 90) AS n_rows FROM w",
    "label_norm_corpus": f"SELECT event_id, coalesce({_words(_LOW, ('negative|neg', 'negative'), ('neutral|neu', 'neutral'), ('positive|pos', 'positive'))}, '') AS label FROM {_RAW}",
    "label_norm_gold": f"SELECT event_id, {_GOLD} AS label FROM {_RAW}",
    "label_norm_generated": f"SELECT event_id, CASE WHEN contains(lower(raw), 'positive') THEN 'positive' WHEN contains(lower(raw), 'negative') THEN 'negative' ELSE 'neutral' END AS label FROM {_RAW}",
    "label_norm_chat": f"SELECT event_id, coalesce(CASE WHEN regexp_matches({_LOW}, '^\\{{.*\\}}$') THEN {_chat('json_extract_string(' + _LOW + ', ' + _quote('$.label') + ')')} END, {_chat(_LOW)}, '') AS label FROM {_RAW}",
    "label_training_ids": f"SELECT event_id, CASE raw WHEN '-1' THEN 0 ELSE 2 END::INT AS label_id FROM {_RAW} WHERE raw IN ('-1', '1')",
    "label_to_score": f"SELECT event_id, CASE label WHEN 'positive' THEN 1.0 WHEN 'negative' THEN -1.0 ELSE 0.0 END::DOUBLE AS score FROM (SELECT event_id, {_GOLD} AS label FROM {_RAW})",
    "prob_score": "SELECT event_id, round(value / 100 - CASE WHEN event_id % 4 > 0 THEN 0.25 ELSE 0 END, 6) AS score FROM events",
    "html_links": "SELECT page_id, count(*) AS n_links, min(h) AS first_href FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?i)<a[^>]*href=\"([^\"#]*)', 1)) AS h FROM pages) WHERE regexp_matches(h, '^/[A-Za-z]') AND NOT regexp_matches(h, '(?i)the') GROUP BY page_id",
    "html_title_date": "SELECT page_id, coalesce(nullif(regexp_extract(html, '(?s)<h1[^>]*>(.*?)</h1>', 1), ''), regexp_extract(html, '(?s)<title[^>]*>(.*?)</title>', 1)) AS title, coalesce(nullif(regexp_extract(html, '(?i)<meta[^>]*property=\"article:published_time\"[^>]*content=\"([^\"]*)\"', 1), ''), nullif(regexp_extract(html, '(?i)<time[^>]*datetime=\"([^\"]*)\"', 1), '')) AS published FROM pages",
    "union_by_name": "SELECT origin, count(*) AS n, count(source) AS with_source FROM (SELECT 'documents' AS origin, source FROM documents UNION ALL SELECT 'benchmark', NULL FROM benchmark) GROUP BY origin",
    "union_distinct": "SELECT count(*) AS n FROM (SELECT text FROM documents UNION SELECT text FROM benchmark)",
    "validation_status": f"WITH {_ARTICLES} SELECT CASE WHEN length(title) = 0 THEN 'fail' WHEN length(body) < 200 THEN 'warn' ELSE 'pass' END AS status, count(*) AS n FROM articles GROUP BY 1",
    "kaggle_category_filter": f"WITH {_ARTICLES} SELECT doc_id, source, category, date FROM articles WHERE regexp_matches(source, '(?i)src1|src\\s*2') AND regexp_matches(category, '(?i)^(en|fr)$') AND date >= DATE '2024-01-01'",
    "top_newest_urls": "SELECT page_id, url FROM pages ORDER BY url DESC, page_id LIMIT 25",
    "article_text_concat": f"WITH {_ARTICLES} SELECT doc_id, md5({_collapse(_TITLED)}) AS text_md5 FROM articles",
}
