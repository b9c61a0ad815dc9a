"""URL filters: pattern rules indexed by their rarest literal token.

Each rule has a host and a path (``*`` stands for any characters). Its literal tokens are
the runs of letters and digits that any matching url must hold as whole tokens. The token
that the fewest urls hold is the rule's key; the tokens of a url fetch the rules with those
keys, and only these candidates run their regular expression. DataFrame functions only.

Results by case: a null url or one without ``://`` has empty host and path; no rule: rule
null and the default verdict; of several rules the longest wins, then ``block`` before
``allow``, then the first in text order; repeated urls and page ids are judged row by row;
rules with a null host and path are left out; other columns of the input are kept as they
are, those named like a result column are replaced."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
BROADCAST_RULES = 50_000  # an index of so many rules is a few MB; larger ones are joined by shuffle, with salted keys
SALTS = 16
TOKEN = "[A-Za-z0-9]+"
NAMES = ("host", "path", "rule", "verdict")


def lower_az(text: Column) -> Column:
    """Lower-case A to Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (after the first ``://`` up to ``/``, ``?`` or ``#``) and path (then up to ``?`` or ``#``)."""
    shape = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    return lower_az(F.coalesce(F.regexp_extract(url, shape, 1), F.lit(""))), F.coalesce(F.regexp_extract(url, shape, 2), F.lit(""))


def rule_table(spark, rules=RULES) -> DataFrame:
    """Rules as a table of host, path and verdict."""
    return spark.createDataFrame(list(rules), "host string, path string, verdict string")


def prepared(rules: DataFrame) -> DataFrame:
    """Rules with their regular expression and literal tokens."""
    rules = rules.filter(F.col("host").isNotNull() | F.col("path").isNotNull()).select(
        lower_az(F.coalesce("host", F.lit(""))).alias("r_host"), F.coalesce("path", F.lit("")).alias("r_path"), F.coalesce("verdict", F.lit("block")).alias("r_verdict"))
    literal = F.regexp_replace("r_path", r"([\\.\[\]{}()+?^$|])", r"\\$1")
    pattern = F.concat(  # on host, '#' (which neither host nor path can hold) and path
        F.when(F.col("r_host") == "", "^[^#]*#").otherwise(F.concat(F.lit("^(?:[^#]*\\.)?"), F.regexp_replace("r_host", r"([\\.\[\]{}()*+?^$|])", r"\\$1"), F.lit("#"))),
        F.regexp_replace(literal, r"\*", ".*"))
    # a token at the end of a path, or beside a wildcard, need not be whole in the url
    whole = F.regexp_replace(F.regexp_replace("r_path", f"{TOKEN}$", ""), r"[A-Za-z0-9]*\*+[A-Za-z0-9]*", "*")
    return rules.select(
        F.concat("r_host", "r_path").alias("rule"), "r_verdict", F.concat(F.lit("(?s)"), pattern).alias("pattern"),
        F.array_distinct(F.concat(F.expr(f"regexp_extract_all(r_host, '{TOKEN}', 0)"), F.regexp_extract_all(whole, F.lit(TOKEN), F.lit(0)))).alias("tokens")).distinct()


def url_tokens(host: str = "host", path: str = "path") -> Column:
    """Distinct tokens of a url and the empty token, which all urls hold."""
    both = F.concat_ws(" ", host, path)
    return F.array_distinct(F.concat(F.array(F.lit("")), F.regexp_extract_all(both, F.lit(TOKEN), F.lit(0))))


def rule_index(rules: DataFrame, urls: DataFrame) -> DataFrame:
    """One row per rule: its rarest token, counted over all urls (which hold host and path), and the rule."""
    wanted = prepared(rules)
    tokens = wanted.select(F.explode("tokens").alias("token")).distinct()
    held = urls.select(F.explode(url_tokens()).alias("token")).join(F.broadcast(tokens) if tokens.count() <= BROADCAST_RULES else tokens, "token", "left_semi")
    counts = held.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    rarest = (wanted.select("rule", "r_verdict", "pattern", F.explode_outer("tokens").alias("token")).join(counts, "token", "left")
              .groupBy("rule", "r_verdict", "pattern").agg(F.min(F.struct(F.coalesce("n", F.lit(0)), F.coalesce("token", F.lit("")).alias("token"))).alias("best")))
    return rarest.select(F.col("best.token").alias("key"), "rule", "r_verdict", "pattern")


def apply_rules(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """Every row of ``pages`` with host, path, rule and verdict. Select the columns that are
    needed first: they pass one shuffle, keyed by row, in which no key is hot."""
    host, path = host_and_path(F.col(url))
    kept = [c for c in pages.columns if c.lower() not in NAMES]
    rows = pages.select(*[pages[c] for c in kept], host.alias("host"), path.alias("path"))
    index = rule_index(rules, rows)
    rows = rows.select(F.struct(*kept).alias("_kept"), "host", "path", F.monotonically_increasing_id().alias("_row"))
    probes = rows.select("*", F.explode(url_tokens()).alias("_token"))
    hit = (F.col("_token") == F.col("key")) & F.expr("regexp_like(concat(host, '#', path), pattern)")
    if index.count() <= BROADCAST_RULES:
        found = probes.join(F.broadcast(index), hit, "left")
    else:  # each rule stands once for every salt, a hot token is dealt over the salts
        salted = index.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_key_salt"))
        found = probes.withColumn("_salt", F.pmod("_row", F.lit(SALTS)).cast("int")).join(salted, hit & (F.col("_salt") == F.col("_key_salt")), "left")
    rank = F.when(F.col("rule").isNotNull(), F.struct(-F.length("rule"), F.when(F.col("r_verdict") == "block", 0).otherwise(1), "rule", "r_verdict"))
    best = found.groupBy("_row").agg(F.min(rank).alias("best"), F.first("_kept").alias("_kept"), F.first("host").alias("host"), F.first("path").alias("path"))
    return best.select(*[F.col("_kept")[c].alias(c) for c in kept], "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.r_verdict", F.lit(default)).alias("verdict"))


def op2_url_filters(spark, sf_dir):
    """Verdict of every page."""
    from tollbook.llm.common import table

    return apply_rules(table(spark, sf_dir, "pages").select("page_id", "url"), rule_table(spark)).select("page_id", "host", "path", "rule", "verdict")


OP2_SQL = """
WITH rules(h, p, verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
parsed AS (
  SELECT page_id, row_number() OVER () AS row_id,
         coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 2, 's'), '') AS path
  FROM pages)
SELECT page_id, host, path, h || p AS rule, coalesce(verdict, 'allow') AS verdict
FROM parsed LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY length(h || p) DESC) = 1
"""
