"""Site-relative line deduplication, in DataFrame and SQL functions only.

Pages are grouped by host. A line's ratio is the number of the host's pages that contain it over the number of the
host's pages. Lines above the ratio, on a least number of pages, are boilerplate of that host and are dropped from its
pages. Lines are counted under two 64-bit hashes with partial sums, so a host or a line on a third of all pages is one
row per task. What a host drops is one short array: no host has more than (lines of a page) / ratio such lines. Tables
with a row for each host are broadcast while few; beyond that every host's pages are dealt over several tasks.

Defined results: a page's lines are the trimmed, non-empty texts between block-level tags and line breaks, without
scripts, styles and comments; a null html has no lines; pages with a null or malformed url share the host ''; repeated
rows count as pages of their own; a ratio equal to the limit is kept; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from decidra.llm._common import drop, join_by_key, stage

HIDDEN = r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->"
BLOCK_TAG = r"(?i)</?(?:html|head|body|title|meta|link|p|br|div|ul|ol|li|h[1-6]|table|tr|td|th|nav|header|footer|main|article|section|aside|pre|blockquote|form|hr)\b[^>]*>"
ANY_TAG = r"<[^>]*>"
HOST = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/@?#]*@)?([^/:?#]+)"


def host_of(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, HOST, 1), F.lit("")))


def lines_of(html: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.coalesce(html, F.lit("")), HIDDEN, " "), BLOCK_TAG, "\n"), ANY_TAG, "")
    return F.filter(F.transform(F.split(bare, "\n"), lambda line: F.trim(line)), lambda line: line != "")


def _key(line: Column) -> Column:
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit("second"), line).alias("b"))  # the second begins in another state


def drop_boilerplate(pages: DataFrame, ratio: float = 0.2, min_pages: int = 3, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, host, n_lines, n_dropped and the kept lines as clean_text, one row for each page."""
    split = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), lines_of(F.col(html_col)).alias("lines"))
    rows, _ = stage(split, "page-lines")
    totals, totals_at = stage(rows.groupBy("host").agg(F.count("*").alias("pages")), "host-pages")
    seen = rows.select("host", F.explode(F.array_distinct(F.transform("lines", _key))).alias("line"))
    counts = seen.groupBy("host", "line").agg(F.count("*").alias("n")).filter(F.col("n") >= min_pages)
    over = join_by_key(counts, totals, "host", ["line"]).filter(F.col("n") > F.lit(float(ratio)) * F.col("pages"))
    dropped, _ = stage(over.groupBy("host").agg(F.collect_list("line").alias("dropped")), "host-boilerplate")
    drop(rows.sparkSession, totals_at)
    judged = join_by_key(rows, dropped, "host", ["page_id", "lines"], "left").withColumn("kept", F.when(F.col("dropped").isNull(), F.col("lines")).otherwise(F.filter("lines", lambda line: ~F.array_contains(F.col("dropped"), _key(line)))))
    return judged.select("page_id", "host", F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size("kept")).cast("long").alias("n_dropped"), F.array_join("kept", "\n").alias("clean_text"))
