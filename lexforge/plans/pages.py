"""Registered queries over pages: their matter and their rows of "key: value"."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexforge.functions import html as H
from lexforge.functions import text as T
from lexforge.session import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _decoded(t: str) -> str:
    for name, sign in H.REFERENCES:
        t = f"replace({t}, '{name}', chr({ord(sign)}))"
    return t


def _lines(html: str, by: str) -> str:
    return rf"array_to_string(list_filter(list_transform(regexp_split_to_array(regexp_replace({html}, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]*>'), lambda t: regexp_replace({_decoded('t')}, '^\s+|\s+$', '', 'g')), lambda t: t != ''), {by})"


def _inner(element: str) -> str:
    return f"regexp_extract(coalesce(html, ''), '{H.inner_pattern(element)}', 1)"


_BODY = "coalesce(" + ", ".join(f"nullif({_inner(e)}, '')" for e in H.CONTENT) + ", '')"


@query(f"""with r as (select page_id, html, {_lines(_BODY, 'chr(10)')} b, {_lines(_inner('h1'), "' '")} h, {_lines(_inner('title'), "' '")} t from pages)
select page_id, left(case when h != '' then h else t end, 200) title, left(b, 15000) as content, contains(lower(html), 'captcha') captcha, len(list_distinct(regexp_extract_all(html, 'href="([^"]*)"', 1))) n_links from r where length(b) > 200""")
def scan_html_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title and content of every page with over 200 characters of it."""
    html = F.col("html")
    rows = table(spark, sf_dir, "pages").select("page_id", "html", H.case(html).alias("c")).where("c is not null")
    return rows.select("page_id", "c.title", "c.content", F.contains(F.lower(html), F.lit("captcha")).alias("captcha"), F.size(T.html_links(html)).cast("bigint").alias("n_links"))


@query(rf"""with e as (select page_id, unnest(regexp_extract_all(html, '(?is)<(?:li|p|h1)(?:\s[^>]*)?>([^<]*)', 1)) t from (select page_id, regexp_replace(coalesce(html, ''), '</?(b|br|a|i)(\s[^>]*)?>', '', 'g') html from pages)),
k as (select page_id, lower(trim(split_part(d, ':', 1))) k from (select page_id, {_decoded('t')} d from e) where contains(d, ':'))
select p.page_id, count(distinct k.k) n, coalesce(string_agg(distinct k.k, '|' order by k.k), '') keys from pages p left join k using (page_id) group by 1""")
def scan_html_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of "key: value" of every page as a map: how many, and their keys."""
    meta = table(spark, sf_dir, "pages").select("page_id", H.meta(F.col("html")).alias("m"))
    return meta.select("page_id", F.size("m").cast("bigint").alias("n"), F.array_join(F.array_sort(F.map_keys("m")), "|").alias("keys"))
