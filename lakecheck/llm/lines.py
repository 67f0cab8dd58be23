"""Boilerplate lines: dropped by the share of a site's pages that contain them.

Each page counts a line once. Counts are combined within the map tasks before they move, so a line of every page
costs one row per task. Copies of a page can be counted as one: a text that many rows of a site hold is then no
boilerplate by its copies alone. Only the boilerplate lines of a site, at most its mean number of lines per page divided by
the ratio, go back to the pages; the site's list is repeated ``salts`` times and pages carry a salt from id and text, so that a site
with a third of all pages is spread over that many keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakecheck.llm.text import WHITE, text_or_empty


def line_key(line: Column) -> Column:
    """64-bit digest of a line without white space around it; NULL for a blank line.

    A line is dropped wrongly only if its digest equals that of a boilerplate line of its own site.
    """
    bare = F.regexp_replace(line, f"^{WHITE}+|{WHITE}+$", "")
    return F.when(bare != "", F.xxhash64(bare))


def boilerplate(docs: DataFrame, host: str, text: str, ratio: float, min_pages: int, copies_once: bool = False) -> DataFrame:
    """``host, keys``: per site the digests of lines on more than ``ratio`` of its pages and on ``min_pages`` at least.

    With ``copies_once`` all pages of a site with the same lines, blank ones left out, are one page.
    """
    pages = docs.select(F.col(host).alias("host"), F.transform(F.split(text_or_empty(text), "\n"), line_key).alias("keys"))
    if copies_once:
        pages = pages.withColumn("keys", F.filter("keys", lambda key: key.isNotNull())).distinct()
    totals = pages.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    counts = (
        pages.select("host", F.explode(F.array_distinct("keys")).alias("key"))
        .where(F.col("key").isNotNull())
        .groupBy("host", "key")
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") >= min_pages)
    )
    often = counts.alias("c").join(totals.alias("t"), F.col("c.host").eqNullSafe(F.col("t.host"))).where(F.col("n") > ratio * F.col("pages"))
    return often.groupBy(F.col("c.host").alias("host")).agg(F.sort_array(F.collect_list("key")).alias("keys"))


def drop_boilerplate(
    docs: DataFrame,
    host: str = "source",
    text: str = "text",
    id_column: str = "doc_id",
    ratio: float = 0.05,
    min_pages: int = 5,
    salts: int = 64,
    copies_once: bool = False,
) -> DataFrame:
    """``docs`` with the same columns and rows, boilerplate lines taken out of ``text``, and ``removed_lines`` added.

    Lines end at line feeds and are compared without white space around them; blank lines stay. A NULL text stays
    NULL with 0 lines removed, an empty one empty; a text of boilerplate alone becomes empty, its row stays. Pages
    without a host (NULL) form one site. Repeated rows count as pages of their own; with ``copies_once`` all pages of
    a site with the same lines count as one, in the lines and in the pages that ``ratio`` is taken of. A column
    ``removed_lines`` of the input is replaced, all others pass through.
    """
    listed = boilerplate(docs, host, text, ratio, min_pages, copies_once).select(
        F.col("host").alias("_host"), F.col("keys").alias("_keys"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_at")
    )
    names = [c for c in docs.columns if c != "removed_lines"]
    packed = docs.select(
        F.struct(*names).alias("_page"), F.col(host).alias("_site"), F.split(F.col(text), "\n").alias("_lines"), F.pmod(F.xxhash64(id_column, text), F.lit(salts)).cast("int").alias("_salt")
    )
    joined = packed.join(listed, F.col("_site").eqNullSafe(F.col("_host")) & (F.col("_salt") == F.col("_at")), "left")
    kept = F.filter("_lines", lambda line: ~F.coalesce(F.array_contains("_keys", line_key(line)), F.lit(False)))
    out = joined.withColumn("_kept", F.when(F.col("_keys").isNotNull(), kept).otherwise(F.col("_lines")))
    return out.select(
        *(F.array_join("_kept", "\n").alias(c) if c == text else F.col(f"_page.{c}") for c in names),
        F.coalesce(F.size("_lines") - F.size("_kept"), F.lit(0)).cast("long").alias("removed_lines"),
    )
