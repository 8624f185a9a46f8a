"""Site-relative line deduplication, with DataFrame functions only.

A line is boilerplate of a host if the part of the host's pages that contain it
exceeds a ratio. Every page counts a line once; pages are counted before they
are shuffled, and only hashes of lines travel, never texts. What is boilerplate
goes back to the pages as one array a host; a host has at most as many such lines
as its pages have on average, divided by the ratio.

Lines are told apart by 64-bit hashes within a host: of n different lines, one
is mistaken for one of the host's b boilerplate lines with probability
n b / 2 ** 64, for a billion lines and a thousand of these 5e-8.

Defined cases
-------------
null or empty text  stays as it is
lines without words are never counted and never dropped
null hosts          are one host
pages all of boilerplate lose every line with a word; what to do with the empty
                    text is the caller's decision
lines on fewer than ``AT_LEAST`` pages are no repetition of the site, however few
                    pages it has: two pages may just be copies of each other
repeated rows       are pages of their own
empty table         no rows
other columns       are passed through
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roomlake.storage import Workspace

RATIO = 0.1
#: Pages on which a line is no chance any more.
AT_LEAST = 3


def url_host(url: Column) -> Column:
    """The host of a URL in lower case, without user and port; null for what has none."""
    return F.nullif(F.lower(F.regexp_extract(url, r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1)), F.lit(""))


def split_lines(text: Column) -> Column:
    return F.split(text, "\n")


def has_word(line: Column) -> Column:
    return line.rlike(r"[^\x20\x09-\x0D]")


def boilerplate(pages: DataFrame, *, host: Column, text: str = "text", ratio: float = RATIO, at_least: int = AT_LEAST) -> DataFrame:
    """host, line_hash, pages, host_pages of every line that more than ``ratio`` of its host's pages contain."""
    hashes = F.array_distinct(F.transform(F.filter(split_lines(F.col(text)), has_word), lambda line: F.xxhash64(line)))
    # a marker line stands for the page itself, so that one pass counts lines and pages
    seen = pages.select(host.alias("host"), F.explode(F.concat(F.array(F.lit(None).cast("long")), F.coalesce(hashes, F.array().cast("array<bigint>")))).alias("line_hash"))
    counts = seen.groupBy("host", "line_hash").agg(F.count("*").alias("pages")).where((F.col("pages") >= at_least) | F.col("line_hash").isNull())
    totals = counts.where("line_hash is null").select(F.col("host").alias("of"), F.col("pages").alias("host_pages"))
    frequent = counts.where("line_hash is not null").join(totals, F.col("host").eqNullSafe(F.col("of")))
    return frequent.where(F.col("pages") > ratio * F.col("host_pages")).select("host", "line_hash", "pages", "host_pages")


def drop_boilerplate(pages: DataFrame, space: Workspace, *, host: Column, text: str = "text", ratio: float = RATIO, at_least: int = AT_LEAST) -> DataFrame:
    """``pages`` with boilerplate lines taken out of ``text``, and n_lines, n_dropped (int)."""
    found = boilerplate(pages, host=host, text=text, ratio=ratio, at_least=at_least)
    table = space.save(found.groupBy(F.col("host").alias("_host")).agg(F.collect_set("line_hash").alias("_bad")), "boilerplate")
    return apply_boilerplate(pages, table, host=host, text=text)


def apply_boilerplate(pages: DataFrame, table: DataFrame, *, host: Column, text: str = "text") -> DataFrame:
    """``table``: _host, _bad (array of hashes). Spark broadcasts it while it is below its threshold."""
    lines = split_lines(F.col(f"_row.`{text}`"))
    joined = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("_row"), host.alias("_of")).join(table, F.col("_of").eqNullSafe(F.col("_host")), "left")
    # first the few hashes that the page and its host share, by a hash set; then its lines against these
    own = F.transform(lines, lambda line: F.xxhash64(line))
    shared = joined.withColumn("_shared", F.when(F.col("_bad").isNotNull(), F.array_intersect(own, F.col("_bad"))))
    touched = F.coalesce(F.size("_shared") > 0, F.lit(False))
    kept = F.filter(lines, lambda line: ~(has_word(line) & F.array_contains(F.col("_shared"), F.xxhash64(line))))
    out = shared.withColumn("_kept", F.when(touched, kept))
    n_lines = F.coalesce(F.size(lines), F.lit(0))
    n_lines = F.when(F.col(f"_row.`{text}`").isNull(), F.lit(0)).otherwise(n_lines)
    columns = [F.coalesce(F.array_join("_kept", "\n"), F.col(f"_row.`{c}`")).alias(c) if c == text else F.col(f"_row.`{c}`").alias(c) for c in pages.columns]
    return out.select(*columns, n_lines.alias("n_lines"), F.when(F.col("_kept").isNotNull(), n_lines - F.size("_kept")).otherwise(F.lit(0)).alias("n_dropped"))
