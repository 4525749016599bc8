"""URL filter lists: many pattern rules, of which each URL meets only a few."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Up to this many rules are broadcast; more are joined by a shuffle.
BROADCAST_RULES = 50_000
#: The token of rules that hold no literal token; every URL has it.
ANY_TOKEN = ""


@dataclass(frozen=True)
class Rule:
    """``pattern`` is host/path; the path is a prefix, in which ``*`` stands for any characters. verdict: allow or block."""

    pattern: str
    verdict: str

    @property
    def host(self) -> str:
        return self.pattern.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.pattern.partition("/")[2]

    def regex(self) -> str:
        """For a text of host, line feed and path."""
        host = r"(?:[^\n]*\.)?" + _quoted(self.host) if self.host else r"[^\n]*"
        return rf"(?s)\A{host}\n" + ".*".join(_quoted(p) for p in self.path.split("*"))

    def tokens(self) -> set[str]:
        """Tokens that every URL has which the rule fits: only those with both ends fixed by the pattern."""
        host = [f"h:{t}" for t in re.findall("[a-z0-9]+", self.host)]
        edges = [m for part in self.path.split("*") for m in re.findall(r"(?<=[^A-Za-z0-9])[A-Za-z0-9]+(?=[^A-Za-z0-9])", part)]
        return {*host, *(f"p:{t}" for t in edges)}


def _quoted(text: str) -> str:
    return re.sub(r"([^A-Za-z0-9])", r"\\\1", text)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lowered) and path of a URL; both empty for null or without ``://``."""
    rest = F.coalesce(F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)\A.*?://(.*)\z", 1)), F.lit(""))
    host = F.regexp_extract(rest, r"(?s)\A([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)\A[^/?#]*([^?#]*)", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(host, upper, upper.lower()), path


def _url_tokens(host: Column, path: Column) -> Column:
    def marked(text: Column, kind: str, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all(text, F.lit(pattern), 0), lambda t: F.concat(F.lit(kind), t))

    return F.array_distinct(
        F.concat(marked(host, "h:", "[a-z0-9]+"), marked(path, "p:", "[A-Za-z0-9]+"), F.array(F.lit(ANY_TOKEN)))
    )


def _indexed(spark: SparkSession, urls: DataFrame, rules: list[Rule]) -> DataFrame:
    """(token, rule, regex, verdict): each rule under that of its tokens which the fewest URLs have."""
    wanted = spark.createDataFrame(
        [(i, t) for i, r in enumerate(rules) for t in sorted(r.tokens() or {ANY_TOKEN})], "at int, token string"
    )
    counts = urls.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    best = (
        wanted.join(counts, "token", "left")
        .groupBy("at")
        .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token"))["token"].alias("token"))
    )
    listed = spark.createDataFrame(
        [(i, r.pattern, r.regex(), r.verdict) for i, r in enumerate(rules)], "at int, rule string, regex string, rule_verdict string"
    )
    return listed.join(best, "at").select("token", "rule", "regex", "rule_verdict")


def filter_urls(
    pages: DataFrame, rules: list[Rule], default: str = "allow", id_column: str = "page_id", url_column: str = "url"
) -> DataFrame:
    """(id, host, path, rule, verdict) of each row of ``pages``: the longest rule that fits, or ``default`` without one.

    Rules are looked up by token, and only the rules found run their expressions. The longest pattern wins, of equally
    long ones the smallest text. A null URL, or one without ``://``, has an empty host and path, which no rule with a host
    fits. Repeated rows and ids each keep a row; other columns are ignored. No rules: every verdict is the default.
    """
    spark = pages.sparkSession
    host, path = host_and_path(F.col(url_column))
    urls = pages.select(F.col(id_column), host.alias("host"), path.alias("path")).withColumn(
        "tokens", _url_tokens(F.col("host"), F.col("path"))
    )
    none = F.lit(None).cast("string")
    if not rules:
        return urls.select(id_column, "host", "path", none.alias("rule"), F.lit(default).alias("verdict"))
    index = _indexed(spark, urls, rules)
    # Equal URLs are judged once, and a page meets its judgement by host and path.
    sites = urls.groupBy("host", "path").agg(F.first("tokens").alias("tokens"))
    looked = sites.select("host", "path", F.explode("tokens").alias("token"))
    found = (
        looked.join(F.broadcast(index) if len(rules) <= BROADCAST_RULES else index, "token")
        .where(F.expr("concat(host, '\n', path) rlike regex"))
        .groupBy("host", "path")
        .agg(
            F.min_by(
                F.struct("rule", "rule_verdict"), F.struct(-F.length("rule"), "rule")
            ).alias("hit")
        )
    )
    return urls.join(found, ["host", "path"], "left").select(
        id_column, "host", "path", F.col("hit.rule").alias("rule"), F.coalesce("hit.rule_verdict", F.lit(default)).alias("verdict")
    )
