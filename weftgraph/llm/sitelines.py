"""Lines repeated within one site's documents.

Per (site, line) the number of the site's rows with the line is compared with its frequency on
other sites by the log-likelihood ratio; the Benjamini-Hochberg rule keeps the false discovery
rate. Sites on which a line is itself excessive are left out of its background, since a notice that
two sites share is a notice on both. Lines are compared without regard to letter case, white
space and the digits of numbers.

Rows with a null text or without a host are left out; blank lines are never cases; a line that
stands twice in a row counts once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from weftgraph.runtime import cut, host, load, spread

#: Least rows of the site with the line, and least share of the site's rows.
LEAST_ROWS, LEAST_SHARE = 8, 0.2
#: False discovery rate.
FDR = 0.05
#: What is added to the outside, so that a line that all sites repeat, or a single site's, has a background.
PRIOR_HITS, PRIOR_ROWS = 0.5, 50
#: Width and number of the bins of -ln p in which the step-up rule ranks; the table of bins is all that one task sees.
BIN, BINS = 0.05, 20_000

_DIGITS = r"\p{Nd}+"
_SPACE = r"[\s \u0085  -     　]+"


def line_keys(lines: Column) -> Column:
    """For each line 64 bits that equal lines share; null for blank lines."""
    plain = F.transform(lines, lambda x: F.regexp_replace(F.regexp_replace(F.lower(x), _DIGITS, "0"), _SPACE, ""))
    return F.transform(plain, lambda x: F.when(x != "", F.xxhash64(x)))


def site_lines(content: DataFrame) -> DataFrame:
    """item_id, site, and the keys of the text's lines in order, of the rows that take part; written once."""
    return cut(
        spread(content.where((F.col("content_type") == "webpage") & F.col("raw_content").isNotNull()))
        .select("item_id", host(F.coalesce("source_url", "url")).alias("site"), line_keys(F.split("raw_content", "\n")).alias("keys"))
        .where(F.col("site").isNotNull())
    )


def _g2(k: Column, n: Column, k0: Column, n0: Column) -> Column:
    """Log-likelihood ratio of k of n against k0 of n0."""
    p = (k + k0) / (n + n0)

    def term(observed: Column, expected: Column) -> Column:
        return F.when(observed > 0, observed * F.log(observed / F.greatest(expected, F.lit(1e-12)))).otherwise(0.0)

    return 2 * (term(k, n * p) + term(n - k, n * (1 - p)) + term(k0, n0 * p) + term(n0 - k0, n0 * (1 - p)))


def tested_lines(rows: DataFrame, least_rows: int = LEAST_ROWS, least_share: float = LEAST_SHARE) -> DataFrame:
    """(site, key, k, n, g2, bin, large) of every line of every site: its excess over the other sites, ranked in bins of -ln p.

    ``large`` tells whether the excess has the wanted size. Sites on which a line is large leave its background.
    """
    keys = F.array_distinct(F.filter("keys", lambda x: x.isNotNull()))
    counts = rows.select("site", F.explode(keys).alias("key")).groupBy("site", "key").agg(F.count("*").alias("k"))
    sizes = rows.groupBy("site").agg(F.count("*").alias("n"))
    total = sizes.agg(F.sum("n").alias("all_rows"))
    known = counts.join(sizes, "site").withColumn("large", (F.col("k") >= least_rows) & (F.col("k") >= least_share * F.col("n")))
    # one site only has most lines: sums by key combine before their shuffle
    outside = known.groupBy("key").agg(
        F.sum(F.when(~F.col("large"), F.col("k")).otherwise(0)).alias("k0"), F.sum(F.when(F.col("large"), F.col("n")).otherwise(0)).alias("n_large")
    )
    own = F.when(F.col("large"), F.lit(0))  # a line that is not large on this site is part of its own background's sums
    return (
        known.join(outside, "key")
        .join(F.broadcast(total))  # one row
        .withColumn("k0", F.col("k0") - F.coalesce(own, F.col("k")))
        .withColumn("n0", F.greatest(F.col("all_rows") - F.col("n_large") - F.coalesce(own, F.col("n")), F.col("k0")))
        .withColumn("g2", _g2(F.col("k"), F.col("n"), F.col("k0") + PRIOR_HITS, F.col("n0") + PRIOR_ROWS))
        .withColumn("more", F.col("k") * (F.col("n0") + PRIOR_ROWS) > (F.col("k0") + PRIOR_HITS) * F.col("n"))
        # the tail of chi-square with one degree of freedom is at most exp(-g/2) / sqrt(pi g / 2)
        .withColumn("strength", F.when(F.col("more"), F.greatest(F.lit(0.0), F.col("g2") / 2 + 0.5 * F.log(F.greatest(F.col("g2"), F.lit(1e-9)) * 1.5707963))).otherwise(0.0))
        .withColumn("bin", F.least(F.floor(F.col("strength") / BIN), F.lit(BINS)).cast("int"))
        .select("site", "key", "k", "n", "g2", "bin", "large")
    )


def least_bin(tested: DataFrame, fdr: float = FDR) -> DataFrame:
    """The least bin that the Benjamini-Hochberg rule keeps among all tests, in one row; null if it keeps none."""
    ranked = tested.groupBy("bin").agg(F.count("*").alias("in_bin"))
    upto = W.orderBy(F.desc("bin")).rowsBetween(W.unboundedPreceding, 0)  # over at most BINS rows
    steps = ranked.select("bin", F.sum("in_bin").over(upto).alias("rank"), F.sum("in_bin").over(W.partitionBy()).alias("tests"))
    return steps.where(F.exp(-F.col("bin") * BIN) <= fdr * F.col("rank") / F.col("tests")).agg(F.min("bin").alias("least_bin"))


def excess_lines(rows: DataFrame, least_rows: int = LEAST_ROWS, least_share: float = LEAST_SHARE, fdr: float = FDR) -> DataFrame:
    """(site, key, k, n, g2) of the lines whose excess within the site is significant among all lines of all sites, and large."""
    tested = cut(tested_lines(rows, least_rows, least_share))
    return tested.where("large").join(F.broadcast(least_bin(tested, fdr))).where("bin >= least_bin").select("site", "key", "k", "n", "g2")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line numbers of the lines that a site repeats excessively."""
    rows = site_lines(load(spark, sf_dir, "content_item", "item_id", "url", "raw_content", "content_type", "source_url"))
    lines = rows.select("item_id", "site", F.posexplode("keys").alias("line_no", "key")).where(F.col("key").isNotNull())
    return lines.join(excess_lines(rows).select("site", "key"), ["site", "key"], "left_semi").select("item_id", "line_no")


def p3_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of every row that takes part without its site's repeated lines; null when no line is left.

    Only the numbers of the removed lines are gathered and joined; the texts are split and filtered in place.
    """
    content = load(spark, sf_dir, "content_item", "item_id", "url", "raw_content", "content_type", "source_url")
    rows = site_lines(content)
    lines = rows.select("item_id", "site", F.posexplode("keys").alias("line_no", "key")).where(F.col("key").isNotNull())
    gone = (
        lines.join(excess_lines(rows).select("site", "key"), ["site", "key"], "left_semi").groupBy("item_id").agg(F.collect_list("line_no").alias("gone"))  # of one text's lines
    )
    texts = content.where((F.col("content_type") == "webpage") & F.col("raw_content").isNotNull() & host(F.coalesce("source_url", "url")).isNotNull())
    split = F.split("raw_content", "\n")
    kept = F.filter(split, lambda x, i: ~F.array_contains("gone", i))
    text = F.when(F.col("gone").isNull(), F.col("raw_content")).when(F.size(kept) > 0, F.array_join(kept, "\n"))
    return texts.select("item_id", "raw_content").join(gone, "item_id", "left").select("item_id", text.alias("text"))


def p3_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many lines are tested, significant, large, and both, by site."""
    tested = cut(tested_lines(site_lines(load(spark, sf_dir, "content_item", "item_id", "url", "raw_content", "content_type", "source_url"))))
    marked = tested.join(F.broadcast(least_bin(tested))).withColumn("significant", F.coalesce(F.col("bin") >= F.col("least_bin"), F.lit(False)))
    return marked.groupBy("site").agg(
        F.count("*").alias("n_tests"), F.count_if("significant").alias("n_significant"), F.count_if("large").alias("n_large"), F.count_if(F.col("significant") & F.col("large")).alias("n_found")
    )


P3_FOUND_SQL = r"""
WITH r AS (
  SELECT item_id, regexp_replace(regexp_replace(lower(regexp_extract(regexp_replace(trim(coalesce(source_url, url)), '^[A-Za-z][A-Za-z0-9+.\-]*:(//)?|^//', ''), '^([^/?#\\]*)', 1)), ':\d*$', ''), '^www\.', '') AS site,
         string_split(raw_content, chr(10)) AS lines
  FROM content_item WHERE content_type = 'webpage' AND raw_content IS NOT NULL),
l AS (SELECT item_id, site, unnest(lines) AS line, unnest(range(len(lines))) AS line_no FROM r WHERE site <> ''),
k AS (SELECT item_id, site, line_no, regexp_replace(regexp_replace(lower(line), '\p{Nd}+', '0', 'g'), '[\s\x{b}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', '', 'g') AS key FROM l),
n AS (SELECT site, count(*) AS n FROM r WHERE site <> '' GROUP BY site),
c AS (SELECT k.site, key, count(DISTINCT item_id) AS k, any_value(n.n) AS n FROM k JOIN n ON k.site = n.site WHERE key <> '' GROUP BY k.site, key)
SELECT k.item_id, CAST(k.line_no AS INT) AS line_no FROM k JOIN c ON k.site = c.site AND k.key = c.key WHERE c.k >= 8 AND c.k >= 0.2 * c.n
"""
