"""URL filters by a path-template tree.  DataFrame functions only.

Rules
    ``(verdict, "host/path")`` pairs.  A rule fits its host and all subdomains if
    the url's path starts with the rule's; of several the longest wins.  The rules
    are a parameter, compiled into one expression.

Template tree, for urls that no rule fits
    1. Lexical: digits of a path segment become ``#``.
    2. Per host, from the root down, a segment becomes the wildcard ``*`` if it is
       variable (its node has more than ``FANOUT`` children and it holds less than
       a ``FANOUT``-th of the node's pages) or if it is statistically like its
       siblings: its count of blocked labelled pages is within ``Z`` standard
       deviations of what the node's own rate would give.
       Branches that became wildcards are merged, and the next level starts from
       the merged node.
    3. A template's purity is its share of allowed labelled pages, smoothed by the
       host's, which is smoothed by that of all pages.  Below ``PURITY`` it is
       rejected.
    Labelled pages are those that a rule decides.

    The tree is as deep as the paths.  An only child is always like its node, so
    segments that all pages of a node share become wildcards at once: there is a
    round for each branching on the way down, not for each segment.

    Pages are counted by distinct (host, segments) first; all rounds work on these
    counts, whose sums are partial aggregates, so a hot host or path is never
    gathered in one task.

Edge cases
    * null url, or one without ``://``: host and path are empty, judged as one
      template of the empty host;
    * empty segments (``//``) do not count; a path that ends within the tree is a
      child of its own, without a segment;
    * very long urls and deep paths are read whole;
    * repeated rows keep their own result rows, null ids are kept;
    * no labelled page at all: every purity is one half, which is allowed;
    * extra columns are ignored, an empty table gives an empty result.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, functions as F

from ledgerloom.llm.common import removed, written

RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
FANOUT = 8
Z = 2.0
PRIOR = 2.0
PURITY = 0.5


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty if it has no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase), path


def _fits(rule: str) -> Column:
    host, _, path = rule.partition("/")
    return ((F.col("host") == host) | F.endswith("host", F.lit(f".{host}"))) & F.startswith("path", F.lit(f"/{path}"))


def _rule_columns(rules: tuple[tuple[str, str], ...]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, null if none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, rule in sorted(rules, key=lambda r: len(r[1])):
        name, verdict = F.when(_fits(rule), rule).otherwise(name), F.when(_fits(rule), said).otherwise(verdict)
    return name, verdict


def _shapes() -> Column:
    """The path's segments with digits folded."""
    parts = F.filter(F.split("path", "/", -1), lambda s: s != "")
    return F.transform(parts, lambda s: F.regexp_replace(s, "[0-9]+", "#"))


_SUMS = ("pages", "allowed", "blocked")


def _rest() -> Column:
    """The segments that a row's node has not read."""
    return F.slice("shapes", F.size("general") + 1, F.size("shapes"))


def _shared(low: Column, high: Column) -> Column:
    """How many leading segments the smallest and the largest of some arrays, hence all of them, share."""
    same = F.array_position(F.zip_with(low, high, lambda a, b: a.eqNullSafe(b)), F.lit(False))
    return F.when(low == high, F.size(low)).otherwise(same.cast("int") - 1)


def _branch(counts: DataFrame) -> DataFrame:
    """``counts (host, shapes, general, ...)`` one branching further down, with ``closed``: nothing is left to read."""
    node = ["host", "general"]
    rows = counts.withColumn("shape", F.coalesce(F.get("shapes", F.size("general")), F.lit("")))
    after = F.slice(_rest(), F.lit(2), F.size("shapes"))
    children = rows.groupBy(*node, "shape").agg(*[F.sum(c).alias(c) for c in _SUMS], F.min(after).alias("low"), F.max(after).alias("high"))
    nodes = children.groupBy(*node).agg(F.count("*").alias("kids"), *[F.sum(c).alias(f"node_{c}") for c in _SUMS])
    labelled = F.col("allowed") + F.col("blocked")
    rate = (F.col("node_blocked") + 1.0) / (F.col("node_allowed") + F.col("node_blocked") + 2.0)
    variable = (F.col("kids") > FANOUT) & (F.col("pages") * FANOUT < F.col("node_pages"))
    alike = F.abs(F.col("blocked") - labelled * rate) <= Z * F.sqrt(labelled * rate * (1.0 - rate))
    name = F.when(F.col("shape") == "", "").when(variable | alike, "*").otherwise(F.col("shape"))
    named = children.join(nodes, node).select(*node, "shape", name.alias("name"), "low", "high")
    # What the merged child's pages share below it.
    merged = named.groupBy(*node, "name").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    merged = merged.select(*node, "name", _shared(F.col("low"), F.col("high")).alias("shared"), ((F.col("name") == "") | (F.col("low") == F.col("high"))).alias("closed"))
    steps = named.select(*node, "shape", "name").join(merged, [*node, "name"])
    said = F.when(F.col("name") == "", F.array().cast("array<string>")).otherwise(F.concat(F.array("name"), F.array_repeat(F.lit("*"), F.col("shared"))))
    # A round reads the one before several times: written, the plan stays as long as one round.
    return written(rows.join(steps, [*node, "shape"]).select("host", "shapes", F.concat("general", said).alias("general"), *_SUMS, "closed"), "url-counts")


def templates(counts: DataFrame) -> DataFrame:
    """``counts (host, shapes, pages, allowed, blocked)`` with ``general``, the generalised segments."""
    left = written(counts.withColumn("general", F.array().cast("array<string>")), "url-counts")
    done = None
    while not left.isEmpty():
        step = _branch(left)
        removed(left)
        closed = step.where("closed").drop("closed")
        done = closed if done is None else done.unionByName(closed)
        left = written(step.where("not closed").drop("closed"), "url-counts")
    return left if done is None else done


def judge(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``page_id, host, path, rule, verdict, template`` for every row of ``pages``."""
    host, path = host_and_path(F.col(url_col).cast("string"))
    urls = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    name, verdict = _rule_columns(rules)
    urls = urls.select("page_id", "host", "path", name.alias("rule"), verdict.alias("said"), _shapes().alias("shapes"))
    counts = templates(urls.groupBy("host", "shapes").agg(
        F.count("*").alias("pages"), F.count_if(F.col("said") == "allow").alias("allowed"), F.count_if(F.col("said") == "block").alias("blocked")))
    found = counts.groupBy("host", "general").agg(F.sum("allowed").alias("allowed"), F.sum("blocked").alias("blocked"))
    hosts = found.groupBy("host").agg(F.sum("allowed").alias("host_allowed"), F.sum("blocked").alias("host_blocked"))
    total = hosts.agg(F.coalesce(F.sum("host_allowed"), F.lit(0)).alias("a"), F.coalesce(F.sum("host_blocked"), F.lit(0)).alias("b"))
    base = total.select(((F.col("a") + 1.0) / (F.col("a") + F.col("b") + 2.0)).alias("base"))
    smooth = lambda a, b, prior: (F.col(a) + PRIOR * prior) / (F.col(a) + F.col(b) + PRIOR)
    hosts = hosts.crossJoin(F.broadcast(base)).select("host", smooth("host_allowed", "host_blocked", F.col("base")).alias("host_purity"))  # base: one row
    judged = found.join(hosts, "host").select("host", "general", smooth("allowed", "blocked", F.col("host_purity")).alias("purity"))
    judged = counts.join(judged, ["host", "general"]).select("host", "shapes", "purity", F.array_join(F.concat(F.array("host"), "general"), "/").alias("template"))
    method = F.when(F.col("purity") >= PURITY, "allow").otherwise("block")
    return urls.join(judged, ["host", "shapes"], "left").select(
        "page_id", "host", "path", "rule", F.coalesce("said", method).alias("verdict"), "template")
