"""URL filter lists by hashed expressions.

A URL is expanded into expressions: each suffix of its host with each directory its path goes
through. A rule has one such expression: its host with the directory its path begins in. Both
sides meet in an equi-join on the first bytes of the expression's digest; the full digest, and the
rest of the rule's path, are confirmed after it. Of the rules that fit, the longest wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cleanlake.llm.shared import lower_ascii, table, written

#: Hexadecimal digits of a digest that the join looks at: 32 bits.
PREFIX = 8


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host in lower case and path, both empty without a ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return lower_ascii(host), path


def _directory(path: Column) -> Column:
    return F.regexp_extract(path, r"(?s)^.*/", 0)


def _digest(host: Column, directory: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), directory), 256)


def judge_urls(
    pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow"
) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` and ``verdict`` (replacing such columns).

    ``rules``: (host, path, verdict), a path beginning with ``/``. A rule fits its host and all
    subdomains if the path starts with the rule's. The longest rule that fits wins, host and path
    together; of equally long ones that with the longer host, and ``block`` before
    ``allow``. Where none fits, ``rule`` is null and the verdict ``default``. A null url or
    one without ``://`` has an empty host and path, which no rule fits; nor does a rule fit an
    url without a path. Every row is kept, repeated ones too. No rules or no pages are fine.

    Distinct (host, path) pairs are judged, so copies of a url cost one row. An url
    is expanded only as deep as the deepest rule goes, which bounds the expressions of any url.
    """
    host, path = host_and_path(F.col(url_col))
    pages = pages.drop(*({"host", "path", "rule", "verdict"} & set(pages.columns)))
    pages = pages.withColumns({"host": host, "path": path})

    rules = rules.select(
        lower_ascii(F.col("host")).alias("r_host"), F.col("path").alias("r_path"), "verdict"
    ).where("r_host is not null and r_path is not null")
    rules = rules.groupBy("r_host", "r_path").agg(F.max("verdict").alias("verdict"))
    rules = rules.withColumn("r_digest", _digest(F.col("r_host"), _directory(F.col("r_path"))))
    rules = rules.withColumn("short", F.substring("r_digest", 1, PREFIX))
    deepest = rules.agg(
        F.max(F.size(F.split("r_host", r"\."))).alias("labels"),
        F.max(F.size(F.split("r_path", "/"))).alias("steps"),
    ).first()
    labels, steps = deepest["labels"] or 1, (deepest["steps"] or 2) - 1

    pairs = pages.select("host", "path").where("path like '/%'").distinct()
    parts, segments = F.col("_parts"), F.col("_segments")
    suffixes = F.transform(
        F.sequence(F.greatest(F.size(parts) - (labels - 1), F.lit(1)), F.size(parts)),
        lambda i: F.array_join(F.slice(parts, i, labels), "."),
    )
    directories = F.transform(
        F.sequence(F.lit(1), F.least(F.size(segments) - 1, F.lit(steps))),
        lambda i: F.concat(F.array_join(F.slice(segments, 1, i), "/"), F.lit("/")),
    )
    pairs = pairs.withColumns(
        {"_parts": F.split("host", r"\."), "_segments": F.split("path", "/")}
    )
    told = pairs.select("host", "path", F.explode(suffixes).alias("_suffix"), directories.alias("_d"))
    told = told.select("host", "path", "_suffix", F.explode("_d").alias("_directory"))
    told = told.withColumn("digest", _digest(F.col("_suffix"), F.col("_directory")))
    told = told.withColumn("short", F.substring("digest", 1, PREFIX))
    fits = told.join(rules, "short").where(
        "digest = r_digest and _suffix = r_host and startswith(path, r_path)"
    )
    best = fits.groupBy("host", "path").agg(
        F.max(
            F.struct(
                (F.length("r_host") + F.length("r_path")).alias("size"),
                F.length("r_host").alias("host_size"),
                F.col("verdict"),
                F.concat("r_host", "r_path").alias("rule"),
            )
        ).alias("best")
    )
    best = written(best.select("host", "path", "best.rule", "best.verdict"), "url-verdicts")
    out = pages.join(best, ["host", "path"], "left")
    return out.withColumn("verdict", F.coalesce("verdict", F.lit(default)))


RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge_urls(pages, rules).select("page_id", "host", "path", "rule", "verdict")


SQL = r"""
with parts as (
    select page_id,
           case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end
               as rest
    from pages
), split as (
    select page_id,
           translate(regexp_extract(rest, '^[^/?#]*'),
                     'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
           regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path
    from parts
), rules(r_host, r_path, verdict) as (
    values ('com', '/', 'allow'), ('example.com', '/en/', 'block'),
           ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), fits as (
    select page_id, r_host || r_path as rule, verdict,
           row_number() over (partition by page_id
                              order by length(r_host || r_path) desc, length(r_host) desc) as rank
    from split join rules
      on (host = r_host or ends_with(host, '.' || r_host)) and starts_with(path, r_path)
)
select s.page_id, s.host, s.path, f.rule, coalesce(f.verdict, 'allow') as verdict
from split s left join fits f on s.page_id = f.page_id and f.rank = 1
"""
