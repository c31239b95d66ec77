"""URL filtering by rules and by a tree of path templates, in DataFrame functions alone.

Per host, paths form a tree of segments. Digit runs become ``#``; where a
node has more than ``FAN_OUT`` different children they become one wildcard.
Leaves of the tree that differ in one segment alone, at any level, are
siblings. A leaf is merged with its siblings where two tests of proportions
find no difference from the others together: its share of the urls of its
branch (so branches must be built alike, be they labelled or not), and, if
both sides have labels, its share of blocked ones. A template is rejected if,
with what it is merged with, it has at least ``LABELS`` labels, these are at
least ``SEEN`` of its urls, and the smoothed share of blocked ones reaches
``PURITY``. Labels are the verdicts of the rules that fit a url, plus any
that are given; merging carries them to urls that no rule fits.

Everything after the first aggregation works on distinct templates, which
digits and wildcards keep few; a host with a third of all urls costs no
task more than its templates.

Defined cases: a null url, or one without ``://``, has an empty host and
path and no template, and is allowed. Very long urls stay whole. Of rules
of equal length the first in alphabetical order wins. Repeated rows are
judged each. Empty input gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import string
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import written

#: Fixed values: (host, path, verdict) of the rules.
RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]
#: Children of a node that is no wildcard at most, least labels, least share of labelled urls, least purity,
#: weight of the prior in it, and standard deviations beyond which proportions differ.
FAN_OUT, LABELS, SEEN, PURITY, WEIGHT, DIFFERENT = 20, 3, 0.2, 0.8, 2.0, 1.96


def split_url(urls: DataFrame, column: str = "url") -> DataFrame:
    """urls with host and path."""
    url = F.col(column)
    after = F.when(F.locate("://", url) > 0, F.expr(f"substring(`{column}`, locate('://', `{column}`) + 3)")).otherwise(F.lit(""))
    host = F.regexp_extract(F.col("rest"), r"^[^/?#]*", 0)
    path = F.regexp_extract(F.expr("substring(rest, char_length(raw_host) + 1)"), r"^[^?#]*", 0)
    return (
        urls.withColumn("rest", F.coalesce(after, F.lit("")))
        .withColumn("raw_host", host)
        .withColumn("path", path)
        .withColumn("host", F.translate("raw_host", string.ascii_uppercase, string.ascii_lowercase))
        .drop("rest", "raw_host")
    )


def _by_rules(rules: list[tuple[str, str, str]], give) -> Column:
    """give(rule) of the longest rule that fits host and path, else null."""
    fits = [
        F.when(
            ((F.col("host") == h) | F.col("host").endswith(f".{h}")) & F.col("path").startswith(p), F.lit(give((h, p, v)))
        )
        for h, p, v in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[0] + r[1]))
    ]
    return F.coalesce(*fits, F.lit(None).cast("string"))


def _shape() -> Column:
    """The generalised path: its segments, joined by single slashes."""
    parts = F.filter(F.split("path", "/", -1), lambda s: s != "")
    return F.array_join(F.transform(parts, lambda s: F.regexp_replace(s, "[0-9]+", "#")), "/")


def _generalise(tree: DataFrame) -> DataFrame:
    """tree (host, shape, ...) with its template: the segments of shape, with wildcards below wide nodes.

    Nothing below a node of at most FAN_OUT paths is wide, so these paths
    stay as they are. In other nodes a round passes all segments that the
    paths share and decides the level after them.
    """
    nothing, node, given, done = F.array().cast("array<string>"), ["host", "template"], tree.columns, []
    segments = F.when(F.col("shape") == "", nothing).otherwise(F.split("shape", "/", -1))
    todo = tree.withColumn("template", nothing).withColumn("rest", segments)
    while True:
        held = todo.groupBy(*node).agg(F.count("*").alias("paths"), F.min("rest").alias("low"), F.max("rest").alias("high")).where(F.col("paths") > FAN_OUT)
        differ = F.array_position(F.zip_with("low", "high", lambda a, b: a.eqNullSafe(b)), F.lit(False))
        held = held.select(*node, F.when(differ == 0, F.size("low")).otherwise(differ - 1).cast("int").alias("shared"))
        size = F.size("rest")
        passed = F.coalesce("shared", size)
        rows = todo.join(held, node, "left").select(
            *given, F.concat("template", F.slice("rest", F.lit(1), passed)).alias("template"), F.get("rest", passed).alias("next"),
            F.slice("rest", passed + 2, size).alias("rest"),
        )
        rows = written(rows, "level")
        done.append(rows.where("next IS NULL").select(*given, "template"))
        more = rows.where("next IS NOT NULL")
        if more.isEmpty():
            return reduce(DataFrame.unionByName, done)
        wide = more.groupBy(*node, "next").agg(F.lit(1).alias("one")).groupBy(*node).count().where(F.col("count") > FAN_OUT)
        wide = wide.select(*node, F.lit("*").alias("star"))
        todo = more.join(wide, node, "left").select(*given, F.concat("template", F.array(F.coalesce("star", "next"))).alias("template"), "rest")


def _alike(part: Column, of: Column, all_parts: Column, all_of: Column) -> Column:
    """Whether the proportion part / of differs from that of the rest, two-sided; true where either has no cases."""
    rest, rest_of, share = all_parts - part, all_of - of, all_parts / all_of
    gap = F.abs(part / of - rest / rest_of)
    return (of == 0) | (rest_of == 0) | (gap <= DIFFERENT * F.sqrt(share * (1 - share) * (1 / of + 1 / rest_of)) + 1e-9)


COUNTS = ("n", "n_labelled", "n_blocked")


def _merge(leaves: DataFrame) -> DataFrame:
    """host, leaf, more_n, more_n_labelled, more_n_blocked: what the siblings merged with a leaf add to it.

    Siblings of different levels differ, so nothing is added twice; a node
    has FAN_OUT children at most, so a leaf has few.
    """
    upto, below = F.slice("template", F.lit(1), F.col("d")), F.slice("template", F.col("d") + 2, F.size("template"))
    key = lambda *parts: F.sha2(F.array_join(F.concat(*parts), "/"), 256)
    places = leaves.select("host", "leaf", *COUNTS, "template", F.posexplode("template").alias("d", "own")).select(
        "host", "leaf", *COUNTS, key(upto, F.array(F.lit("")), below).alias("pool"), key(upto, F.array("own")).alias("branch")
    )
    branches = places.groupBy("host", "branch").agg(F.sum("n").alias("branch_n"))
    places = written(places.join(branches, ["host", "branch"]).drop("branch"), "siblings")
    pool = ["host", "pool"]
    pools = places.groupBy(*pool).agg(F.count("*").alias("leaves"), *(F.sum(c).alias(f"pool_{c}") for c in (*COUNTS, "branch_n")))
    built_alike = _alike(F.col("n"), F.col("branch_n"), F.col("pool_n"), F.col("pool_branch_n"))
    judged_alike = _alike(F.col("n_blocked"), F.col("n_labelled"), F.col("pool_n_blocked"), F.col("pool_n_labelled"))
    told = pools.where("leaves > 1 AND pool_n_labelled > 0")
    merged = written(places.join(told, pool).where(built_alike & judged_alike).select(*places.columns), "merged")
    pooled = merged.groupBy(*pool).agg(F.count("*").alias("branches"), *(F.sum(c).alias(f"all_{c}") for c in COUNTS))
    added = (F.sum(F.col(f"all_{c}") - F.col(c)).alias(f"more_{c}") for c in COUNTS)
    return merged.join(pooled.where("branches > 1"), pool).groupBy("host", "leaf").agg(*added)


def templates(labelled: DataFrame) -> DataFrame:
    """host, shape (generalised path), template, merged, n, n_labelled, n_blocked, purity, rejected.

    labelled: host, path and label (block, allow or null).
    """
    tree = written(
        labelled.where("host <> ''")
        .select("host", _shape().alias("shape"), "label")
        .groupBy("host", "shape")
        .agg(
            F.count("*").alias("n"),
            F.count("label").alias("n_labelled"),
            F.count(F.when(F.col("label") == "block", 1)).alias("n_blocked"),
        ),
        "shapes",
    )
    whole = tree.agg(F.sum("n_labelled").alias("all_labelled"), F.sum("n_blocked").alias("all_blocked")).first()
    prior = ((whole["all_blocked"] or 0) + 1) / ((whole["all_labelled"] or 0) + 2)
    tree = _generalise(tree).withColumn("leaf", F.sha2(F.array_join("template", "/"), 256))
    leaves = tree.groupBy("host", "leaf").agg(F.first("template").alias("template"), *(F.sum(c).alias(c) for c in COUNTS))
    leaves = written(leaves, "leaves")
    n, labelled, blocked = (F.col(c) + F.coalesce(f"more_{c}", F.lit(0)) for c in COUNTS)
    purity = (blocked + WEIGHT * prior) / (labelled + WEIGHT)
    judged = leaves.join(_merge(leaves), ["host", "leaf"], "left").select(
        "host", "leaf", F.col("more_n").isNotNull().alias("merged"), *COUNTS, purity.alias("purity"),
        ((labelled >= LABELS) & (labelled >= SEEN * n) & (purity >= PURITY)).alias("rejected"),
    )
    return tree.select("host", "shape", "template", "leaf").join(judged, ["host", "leaf"]).drop("leaf")


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, labels: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict of every row of page_id, url.

    labels: further labels (page_id, label: block or allow) for urls that no rule fits.
    """
    rows = split_url(pages.select("page_id", "url")).select("page_id", "host", "path")
    rows = rows.withColumn("rule", _by_rules(rules, lambda r: r[0] + r[1])).withColumn("label", _by_rules(rules, lambda r: r[2]))
    known = rows
    if labels is not None:
        more = labels.groupBy("page_id").agg(F.max("label").alias("given"))
        known = rows.join(more, "page_id", "left").withColumn("label", F.coalesce("label", "given"))
    rejected = templates(known.select("host", "path", "label")).where("rejected").select("host", "shape", F.lit("block").alias("method"))
    return rows.withColumn("shape", _shape()).join(rejected, ["host", "shape"], "left").select(
        "page_id", "host", "path", "rule", F.coalesce("label", "method", F.lit("allow")).alias("verdict")
    )
