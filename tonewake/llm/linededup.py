"""Site-relative line frequency, in DataFrame functions only.

Lines of a page that stand on more than a given share of its host's pages are boilerplate and go.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .state import cut

#: What ends a line in HTML, what is no text at all, and the common entities.
UNSEEN = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>"
BREAKS = r"(?i)</?(?:p|div|br|li|ul|ol|h[1-6]|tr|td|th|table|nav|header|footer|article|section|title|head|body|html|main|aside|form|option|pre|blockquote|dl|dt|dd|hr)\b[^>]*>"
TAGS = r"<[^>]*>"
ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")]
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)"
#: A line on more than this share of a host's pages goes, on hosts of so many pages or more.
RATIO = 0.1
MIN_PAGES = 10
#: Boilerplate lines (8 bytes each) that may be broadcast; beyond, pages and lines meet in a salted join.
BROADCAST_MARKS = 1 << 20
SALTS = 32


def host(url: Column) -> Column:
    """The host in lower case, null without one."""
    return F.nullif(F.lower(F.regexp_extract(url, HOST, 1)), F.lit(""))


def lines(html: Column) -> Column:
    """The page's text lines: trimmed, not empty, in order."""
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.coalesce(html, F.lit("")), UNSEEN, " "), BREAKS, "\n"), TAGS, "")
    for name, char in ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(char))
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x, F.lit(" \t\r"))), lambda x: x != "")


def dedup_lines(pages: DataFrame, carry: list[str], ratio: float = RATIO, min_pages: int = MIN_PAGES, broadcast_marks: int = BROADCAST_MARKS, repeats: int = 1) -> DataFrame:
    """Columns carry of pages with host, n_lines, n_dropped and kept_lines; inputs named like an output are replaced.

    A line is boilerplate on a host with min_pages pages or more where pages with it >= repeats and > ratio * pages; at the
    ratio itself it stays.  min_pages=1, repeats=2 judges small hosts too.  A page counts a line once; repeated rows are pages of their own.  Pages without a host keep all lines, as
    no site tells how common these are; a null html has none.  Lines are told apart by 64-bit hashes.
    """
    carry = [c for c in carry if c not in ("host", "n_lines", "n_dropped", "kept_lines")]
    split = pages.select(*carry, host(F.col("url").cast("string")).alias("host"), lines(F.col("html").cast("string")).alias("__lines"))
    marks = F.transform("__lines", lambda x: F.xxhash64(x))
    totals = pages.select(host(F.col("url").cast("string")).alias("host")).where("host is not null").groupBy("host").agg(F.count("*").alias("pages")).where(F.col("pages") >= min_pages)
    counts = split.where("host is not null").select("host", F.explode(F.array_distinct(marks)).alias("mark")).groupBy("host", "mark").agg(F.count("*").alias("n"))
    common = counts.where((F.col("n") >= repeats) & (F.col("n") > min_pages * ratio)).join(totals, "host").where(F.col("n") > ratio * F.col("pages"))
    sets = cut(common.groupBy("host").agg(F.collect_set("mark").alias("__common")), "boilerplate")  # at most lines a page / ratio for a host
    if (sets.agg(F.sum(F.size("__common"))).first()[0] or 0) <= broadcast_marks:
        joined = split.join(F.broadcast(sets), "host", "left")
    else:  # a host with many pages is dealt out over SALTS tasks; pages without a host stay where they are
        salted = split.where("host is not null").withColumn("__salt", F.pmod(F.xxhash64("__lines"), F.lit(SALTS)))
        copies = sets.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        joined = salted.join(copies, ["host", "__salt"], "left").unionByName(split.where("host is null"), allowMissingColumns=True)
    # what of the host's boilerplate the page has, first: then each line meets only that
    gone = F.array_intersect(marks, F.coalesce("__common", F.array().cast("array<bigint>")))
    placed = joined.withColumn("__gone", gone)
    kept = F.filter("__lines", lambda x: ~F.array_contains("__gone", F.xxhash64(x)))
    return placed.select(*[F.col(c) for c in carry], "host", F.size("__lines").cast("long").alias("n_lines"), kept.alias("kept_lines")).withColumn("n_dropped", F.col("n_lines") - F.size("kept_lines"))
