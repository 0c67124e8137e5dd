"""URL filters: a sort-merge range join of URLs with nested host and path rules.

A rule (host, path) fits a URL whose host is the rule's host or one of its subdomains and
whose path starts with the rule's path; of several the longest wins (host and path together,
then the longer host). Under one canonical key (the host's labels reversed) the paths that
start with a rule's path are an interval, and such intervals are nested or apart. A sorted
sweep over interval starts, URLs and interval ends therefore needs a stack only: its height is
a running sum, and the rule on top is the last one that was opened at the present height.

Built-in functions only. The rules are never broadcast by hint; hosts with very many URLs are
swept in several lanes, each with its own copy of that host's rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import ascii_lower

# URLs of one rule host that one lane sweeps, or as many as the host has rules.
LANE = 50_000


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path of a URL; both empty without ``://`` or for null."""
    start = F.instr(url, "://")
    rest = F.when(start > 0, F.substr(url, start + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(ascii_lower(host), F.lit("")), F.coalesce(path, F.lit(""))


def _canonical(labels: Column) -> Column:
    return F.array_join(F.reverse(labels), ".")


def apply_rules(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """Add ``host``, ``path``, ``rule`` (its text, else null) and ``verdict`` to every row.

    ``rules`` has the columns ``verdict``, ``host`` and ``path``. Rules without host or verdict
    are left out, a null path is the empty one, and of equal rules with different verdicts
    block wins. Columns of ``pages`` with the names of results are replaced; every row stays,
    null and repeated ones too. URLs that no rule fits get ``default``.
    """
    rules = (
        rules.where("host IS NOT NULL AND verdict IS NOT NULL")
        .select(
            ascii_lower(F.col("host")).alias("rule_host"),
            F.coalesce(F.col("path"), F.lit("")).alias("rule_path"),
            "verdict",
        )
        .groupBy("rule_host", "rule_path")
        .agg(F.max("verdict").alias("verdict"))  # "block" is above "allow"
        .withColumn("site", _canonical(F.split("rule_host", r"\.")))
    )
    limits = rules.agg(
        F.max(F.size(F.split("rule_host", r"\."))).alias("labels"), F.max(F.char_length("rule_path")).alias("chars")
    ).first()
    depth, reach = limits["labels"] or 0, limits["chars"] or 0

    host, path = host_and_path(F.col(url))
    pages = pages.drop("host", "path", "rule", "verdict").withColumns({"host": host, "path": path})
    pages = pages.withColumn("__near", F.left("path", F.lit(reach)))
    # No rule looks at more of a path than its first `reach` characters.
    places = pages.groupBy("host", "__near").agg(F.lit(1).alias("one")).select("host", "__near")
    labels = F.split("host", r"\.")
    probes = places.select(
        "host",
        "__near",
        F.explode(
            F.transform(F.sequence(F.lit(1), F.least(F.size(labels), F.lit(max(depth, 1)))), lambda i: _canonical(F.slice(labels, -i, i)))
        ).alias("site"),
    )
    sites = rules.groupBy("site").agg(F.count("*").alias("rules"))
    probes = probes.join(sites, "site")
    lanes = probes.groupBy("site").agg(
        F.ceil(F.count("*") / F.greatest(F.max("rules"), F.lit(LANE))).cast("int").alias("lanes")
    )
    probes = probes.join(lanes, "site").withColumn("lane", F.pmod(F.xxhash64("host", "__near"), F.col("lanes")).cast("int"))
    ruled = rules.join(lanes, "site").withColumn("lane", F.explode(F.sequence(F.lit(0), F.col("lanes") - 1)))

    opened = F.struct("rule_host", "rule_path", "verdict")
    nothing = F.lit(None).cast(rules.select(opened.alias("x")).schema["x"].dataType)
    key = F.encode(F.col("rule_path"), "utf-8")
    no_text = F.lit(None).cast("string")
    events = (
        ruled.select("site", "lane", key.alias("key"), F.lit(0).alias("kind"), F.lit(1).alias("step"), opened.alias("open"), no_text.alias("host"), no_text.alias("__near"))
        .unionByName(
            # 0xFF is in no UTF-8 text, so this comes after all that starts with the path.
            ruled.select("site", "lane", F.concat(key, F.lit(b"\xff")).alias("key"), F.lit(2).alias("kind"), F.lit(-1).alias("step"), nothing.alias("open"), no_text.alias("host"), no_text.alias("__near"))
        )
        .unionByName(
            probes.select("site", "lane", F.encode(F.col("__near"), "utf-8").alias("key"), F.lit(1).alias("kind"), F.lit(0).alias("step"), nothing.alias("open"), "host", "__near")
        )
    )
    sweep = Window.partitionBy("site", "lane").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    level = Window.partitionBy("site", "lane", "height").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    found = (
        events.withColumn("height", F.sum("step").over(sweep))
        .where("kind < 2")
        .withColumn("top", F.last("open", ignorenulls=True).over(level))
        .where("kind = 1 AND height > 0")
    )
    length = F.char_length("top.rule_host") + F.char_length("top.rule_path")
    best = found.groupBy("host", "__near").agg(
        F.max_by("top", F.struct(length, F.char_length("top.rule_host"))).alias("best")
    )
    return pages.join(best, ["host", "__near"], "left").select(
        *[f"`{c}`" for c in pages.columns if c not in ("host", "path", "__near")],
        "host",
        "path",
        F.concat("best.rule_host", "best.rule_path").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
    )
