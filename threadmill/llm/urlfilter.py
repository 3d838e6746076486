"""Operator 2: URL filter by rules on host suffixes and path prefixes.

A URL is expanded into expressions: each suffix of its host that starts at a
label, with each prefix of its path that has the length of some rule's path.
The expressions meet the rules by an equi-join on the first 32 bits of their
SHA-256, full digests confirm the hit, and the longest rule (characters of host
and path; then the longer host) decides. Expressions are made once for each
distinct pair of host and path, so a host with a third of all pages costs
little; the verdicts then go back to the pages by an equi-join that Spark may
split. The rules are never broadcast by hand: Spark measures them at run time.

Defined results: a null URL or one without ``://`` has an empty host and path,
fits no rule and gets the default verdict, as any other URL without a fitting
rule. Only A-Z of the host are lower-cased. An empty label (``a..b``) is a label
as any other. Repeated pages give one row each, a null id stays null. Rules with a null
part are ignored; of equal rules one is taken, a block before an allow. Columns
of the input other than the id and the URL are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Host, path and verdict of the rules that the query uses.
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_suffixes(host: Column, most: Column) -> Column:
    """The last 1, 2, ... up to ``most`` labels of the host."""
    labels = F.split(host, r"\.", -1)
    return F.when(host == "", F.array().cast("array<string>")).otherwise(
        F.transform(
            F.sequence(F.lit(1), F.least(F.size(labels), most)),
            lambda n: F.array_join(F.slice(labels, F.size(labels) - n + 1, n), "."),
        )
    )


def filter_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """Judge every page. ``rules`` has columns host, path and verdict (allow or block)."""
    known = (
        rules.select(F.translate("host", UPPER, LOWER).alias("r_host"), F.col("path").alias("r_path"), F.col("verdict").alias("r_verdict"))
        .where("r_host is not null and r_path is not null and r_verdict is not null and r_host <> ''")
        .groupBy("r_host", "r_path").agg(F.max("r_verdict").alias("r_verdict"))  # block sorts after allow
        .withColumn("r_digest", F.sha2(F.concat("r_host", "r_path"), 256))
    )
    # lengths of rule paths and the longest rule host: a few numbers, whatever the count of rules
    shape = known.agg(
        F.array_sort(F.collect_set(F.length("r_path"))).alias("lengths"),
        F.max(F.size(F.split("r_host", r"\.", -1))).alias("labels"),
    ).first()
    lengths, labels = shape["lengths"], shape["labels"] or 0

    read = pages.select(F.col(id_col).alias("page_id"), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"))
    distinct = read.select("host", "path").distinct()
    prefixes = F.array_distinct(
        F.transform(
            F.filter(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"), lambda n: n <= F.length("path")),
            lambda n: F.substring(F.col("path"), F.lit(1), n),
        )
    )
    expressions = (
        distinct.withColumn("e_host", F.explode(host_suffixes(F.col("host"), F.lit(labels))))
        .withColumn("e_path", F.explode(prefixes))
        .withColumn("e_digest", F.sha2(F.concat("e_host", "e_path"), 256))
    )
    short = lambda c: F.conv(F.substring(c, 1, 8), 16, 10).cast("long")
    hits = (
        expressions.withColumn("short", short("e_digest"))
        .join(known.withColumn("short", short("r_digest")), "short")
        .where("e_digest = r_digest and e_host = r_host and e_path = r_path")
    )
    best = hits.groupBy("host", "path").agg(
        F.max(F.struct(F.length(F.concat("r_host", "r_path")).alias("n"), F.length("r_host").alias("h"), "r_host", "r_path", "r_verdict")).alias("best")
    )
    return read.join(best, ["host", "path"], "left").select(
        "page_id",
        "host",
        "path",
        F.concat("best.r_host", "best.r_path").alias("rule"),
        F.coalesce("best.r_verdict", F.lit(default)).alias("verdict"),
    )
