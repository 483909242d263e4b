"""Line de-duplication by site-relative frequency.

A line that more than ``ratio`` of a host's pages contain, and at least ``min_pages`` of them (three: a page and its one copy are no evidence), is boilerplate there and is
dropped from the host's pages. A page counts a line once. Lines are compared whole, by a 64-bit hash; lines of whitespace only
are never boilerplate.

Only counts are shuffled: (host, line) with partial sums, and pages by host. A host has at most (lines of a page / ratio)
boilerplate lines; the table of all hosts is broadcast if it has up to MAX_BROADCAST of them, and otherwise joined by host
and a salt from the text, so that a hot host is spread.

Nulls: a null text has no lines and stays null; null hosts are one host. Repeated rows are pages of their own. An empty table
gives an empty result. Other columns are kept as they are; their names may not begin with two underscores.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hedgerow.llm.common import cut

RATIO = 0.08
MIN_PAGES = 3
MAX_BROADCAST = 100_000
SALTS = 64


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _told(line: Column) -> Column:
    """What a line is compared by; null if it is blank."""
    return F.when(line.rlike(r"[^\x20\x09-\x0D]"), F.xxhash64(line))


def boilerplate(docs: DataFrame, host_col: str, text_col: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(__host, __line, pages, share) of every boilerplate line."""
    host = F.coalesce(F.col(host_col).cast("string"), F.lit("\0"))
    rows = docs.select(host.alias("__host"), F.array_distinct(F.transform(_lines(F.col(text_col)), _told)).alias("__told"))
    totals = rows.groupBy("__host").agg(F.count("*").alias("__total"))
    counts = rows.select("__host", F.explode("__told").alias("__line")).where(F.col("__line").isNotNull()).groupBy("__host", "__line").agg(F.count("*").alias("pages"))
    found = counts.where(F.col("pages") >= min_pages).join(totals, "__host")
    return found.where(F.col("pages") > ratio * F.col("__total")).select("__host", "__line", "pages", (F.col("pages") / F.col("__total")).alias("share"))


def drop_boilerplate(docs: DataFrame, host_col: str = "source", text_col: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """``docs`` with the boilerplate lines taken out of the text, and __n_lines and __n_dropped."""
    found = cut(boilerplate(docs, host_col, text_col, ratio, min_pages).select("__host", "__line"), "boilerplate")
    by_host = found.groupBy("__host").agg(F.collect_set("__line").alias("__drop"))
    rows = docs.withColumn("__host", F.coalesce(F.col(host_col).cast("string"), F.lit("\0")))
    if found.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST:
        joined = rows.join(F.broadcast(by_host), "__host", "left")
    else:
        salted = by_host.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.withColumn("__salt", F.pmod(F.xxhash64(F.col(text_col)), F.lit(SALTS)).cast("int")).join(salted, ["__host", "__salt"], "left").drop("__salt")
    lines = _lines(F.col(text_col))
    joined = joined.withColumn("__lines", lines)
    kept = F.when(F.col("__drop").isNull(), F.col("__lines")).otherwise(F.filter("__lines", lambda x: ~F.coalesce(F.array_contains("__drop", _told(x)), F.lit(False))))
    joined = joined.withColumn("__kept", kept)
    sizes = {"__n_lines": F.size("__lines").cast("long"), "__n_dropped": (F.size("__lines") - F.size("__kept")).cast("long")}
    text = F.when(F.col(text_col).isNotNull(), F.array_join("__kept", "\n"))
    return joined.withColumns(sizes).withColumn(text_col, text).select(*[f"`{c}`" for c in docs.columns], *sizes)


def judge(docs: DataFrame, host_col: str = "source", text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, n_lines, n_dropped and the MD5 of the remaining text, for every row of ``docs``."""
    out = drop_boilerplate(docs.select(id_col, host_col, text_col), host_col, text_col)
    return out.select(id_col, F.col("__n_lines").alias("n_lines"), F.col("__n_dropped").alias("n_dropped"), F.md5(F.coalesce(F.col(text_col), F.lit(""))).alias("text_md5"))


ORACLE_SQL = f"""
with pages as (select row_number() over () as r, doc_id, coalesce(source, chr(0)) as host, string_split(coalesce(text, ''), chr(10)) as lines from documents),
parts as (select r, host, unnest(lines) as line, generate_subscripts(lines, 1) as pos from pages),
solid as (select * from parts where regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
counts as (select host, line, count(distinct r) as n from solid group by host, line),
totals as (select host, count(*) as total from pages group by host),
boiler as (select host, line from counts join totals using (host) where n >= {MIN_PAGES} and n > {RATIO} * total),
kept as (select r, list(line order by pos) as lines from parts p where not exists (select 1 from boiler b where b.host = p.host and b.line = p.line) group by r)
select doc_id, len(p.lines)::bigint as n_lines, (len(p.lines) - coalesce(len(k.lines), 0))::bigint as n_dropped,
  md5(coalesce(array_to_string(k.lines, chr(10)), '')) as text_md5
from pages p left join kept k using (r)
"""
