"""URL filtering by host-suffix and path-prefix rules, in DataFrame functions only.

Each URL becomes the expressions (host suffix + path prefix) that a rule could have: those of as many labels and as many path characters
as some rule has. Expressions and rules meet on the first 8 hex digits of their SHA-256, then the whole digests are compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainflow.llm.common import LOWER, UPPER

PREFIX_DIGITS = 8
#: Rules (under 200 bytes each) up to which they are broadcast; beyond, both sides are shuffled by digest prefix.
BROADCAST_RULES = 100_000
#: Parts that the pages of one host and path are dealt out to.
PARTS = 256


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """For each row of pages (page_id, url): page_id, host, path, rule, verdict.

    rules: rule (``host/path``, the host in any case) and action (``allow`` or ``block``); one without rule or action is no rule. A rule fits its host and all subdomains, if the path starts
    with the rule's. The longest fitting rule decides; of the same rule with both actions, block does. Where none fits, rule is null and
    verdict is ``default``. Null URLs and those without ``://`` have an empty host and path, which no rule fits. Repeated rows stay; other
    columns are ignored; no rules or no pages are fine.

    The verdict depends on host and path, so each different pair is judged once and joined back: a host or URL that a third
    of all pages share is a few rows in the rule join, and is dealt out to parts for the join back.
    """
    cut = F.instr("rule", "/")
    rule_host = F.translate(F.when(cut > 0, F.substring_index("rule", "/", 1)).otherwise(F.col("rule")), UPPER, LOWER)
    rule_path = F.when(cut > 0, F.substring(F.col("rule"), cut, F.length("rule"))).otherwise(F.lit(""))
    ready = rules.filter("rule IS NOT NULL AND action IS NOT NULL").select(F.concat(rule_host, rule_path).alias("rule"), "action", F.size(F.split(rule_host, r"\.")).alias("labels"), F.length(rule_path).alias("chars"))
    shapes = ready.select("labels", "chars").distinct().orderBy("labels", "chars").collect()  # as many as rule shapes, whatever the rules' number
    part = F.pmod(F.xxhash64("page_id"), F.lit(PARTS)).alias("part")
    pages = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), part)
    if not shapes:
        return pages.drop("part").select("*", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    keyed = ready.groupBy("rule").agg(F.max("action").alias("action")).select("*", F.sha2("rule", 256).alias("digest")).withColumn("prefix", F.substring("digest", 1, PREFIX_DIGITS))
    keyed = F.broadcast(keyed) if ready.count() <= BROADCAST_RULES else keyed
    labels = F.split("host", r"\.")
    # One array of all shapes, gone through in the row: the plan doesn't grow with their number.
    every = F.array(*(F.struct(F.lit(s.labels).alias("labels"), F.lit(s.chars).alias("chars")) for s in shapes))
    suffix = lambda n: F.array_join(F.slice("labels", -n, n), ".")
    expressions = F.transform(every, lambda s: F.when((F.size("labels") >= s["labels"]) & (F.length("path") >= s["chars"]), F.concat(suffix(s["labels"]), F.left("path", s["chars"]))))
    pairs = pages.groupBy("host", "path").agg(F.collect_set("part").alias("parts"))
    different = pairs.withColumn("labels", labels).select("host", "path", F.explode(F.array_distinct(F.array_compact(expressions))).alias("expression"))
    different = different.select("host", "path", F.sha2("expression", 256).alias("found"))
    fits = different.join(keyed, F.substring("found", 1, PREFIX_DIGITS) == F.col("prefix")).filter("found = digest")
    best = fits.groupBy("host", "path").agg(F.max(F.struct(F.length("rule").alias("size"), "rule", "action")).alias("best"))
    dealt = best.join(pairs, ["host", "path"]).select("host", "path", "best", F.explode("parts").alias("part"))
    out = pages.join(dealt, ["host", "path", "part"], "left")
    return out.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.action", F.lit(default)).alias("verdict"))
