"""URL rules: host-suffix and path-prefix expressions, joined on short hash prefixes and confirmed by full digests.

Each distinct (host, path) is expanded to the hosts that end it at a dot, and to path prefixes, of such numbers of labels and
lengths as rules have together; so a host of very many labels costs no more than another. An expression is `host` + `path`; its SHA-256 digest is joined with the rules' on the first four bytes,
then compared in full. Of the rules that fit, the longest wins; ties go to the longer host, then the smaller text. All of
it is DataFrame operations.

Defined cases: a null url and one without `://` have an empty host and path and fit no rule; a null page_id is kept;
equal rows each get a row; a url that no rule fits gets the default verdict; an empty rule table leaves all urls to the
default; columns named like an added one are replaced, all others are carried along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower

#: Rules of which at most so many bytes are broadcast; more are joined by a shuffle, in which a common expression is dealt over SALTS.
BROADCAST_BYTES, SALTS = 16_000_000, 8
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_and_path(url: Column) -> tuple[Column, Column]:
    url = F.coalesce(url, F.lit(""))
    return ascii_lower(F.regexp_extract(url, _PARTS, 1)), F.regexp_extract(url, _PARTS, 2)


def labels(host: Column) -> Column:
    return F.length(host) - F.length(F.translate(host, ".", "")) + 1


def _rules(rules: DataFrame) -> DataFrame:
    """Distinct rules with their digests; if a rule is given with two verdicts, `block` wins over `allow`."""
    rules = rules.where("host is not null and path is not null").groupBy(ascii_lower(F.col("host")).alias("rule_host"), F.col("path").alias("rule_path")).agg(F.max("verdict").alias("rule_verdict"))
    rule = F.concat("rule_host", "rule_path")
    return rules.select(rule.alias("rule"), labels(F.col("rule_host")).alias("labels"), F.length("rule_host").alias("host_length"), F.length("rule_path").alias("path_length"), "rule_verdict", F.sha2(rule, 256).alias("digest"))


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """Adds host, path, rule and verdict to rows with a url; rules: host, path and verdict."""
    ready = _rules(rules)
    # A row per shape, and few at that: rules are short and share their numbers of labels and lengths of paths.
    facts = ready.agg(F.collect_set(F.struct("labels", "path_length")).alias("shapes"), F.sum(F.length("rule") + 120).alias("bytes")).first()
    shapes = F.array(*[F.struct(F.lit(int(k)).alias("k"), F.lit(int(n)).alias("n")) for k, n in sorted(facts["shapes"])]).cast("array<struct<k: int, n: int>>")
    host, path = host_and_path(F.col("url"))
    parsed = pages.drop("host", "path", "rule", "verdict").withColumn("host", host).withColumn("path", path)
    distinct = parsed.where("host <> ''").select("host", "path").distinct().withColumn("labels", labels(F.col("host")))
    fitting = F.filter(shapes, lambda x: (x["k"] <= F.col("labels")) & (x["n"] <= F.length("path")))
    expressions = distinct.select("host", "path", F.explode(fitting).alias("x"))
    suffix = F.expr("substring_index(host, '.', -x.k)")
    expressions = expressions.select("host", "path", F.length(suffix).alias("h"), F.sha2(F.concat(suffix, F.expr("substring(path, 1, x.n)")), 256).alias("full")).withColumn("short", F.substring("full", 1, 8))
    keyed = ready.drop("labels").withColumn("short", F.substring("digest", 1, 8))
    on = ["short"]
    if (facts["bytes"] or 0) <= BROADCAST_BYTES:
        keyed = F.broadcast(keyed)
    else:
        on = ["short", "salt"]
        expressions = expressions.withColumn("salt", F.pmod(F.xxhash64("host", "path"), F.lit(SALTS)).cast("int"))
        keyed = keyed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    hits = expressions.join(keyed, on).where((F.col("full") == F.col("digest")) & (F.col("h") == F.col("host_length")))
    rank = F.struct(F.length("rule").alias("n"), F.col("host_length"))
    best = hits.groupBy("host", "path").agg(F.max_by(F.struct("rule", "rule_verdict"), rank).alias("_weft_best"))
    judged = parsed.join(best, ["host", "path"], "left")
    columns = [c for c in parsed.columns if c not in ("host", "path")]
    return judged.select(*columns, "host", "path", F.col("_weft_best.rule").alias("rule"), F.coalesce("_weft_best.rule_verdict", F.lit(default)).alias("verdict"))
