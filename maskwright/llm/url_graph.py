"""Operator 9, URL filter: rules, and trust and distrust spread over the link graph of hosts.

Rules name a host (with its subdomains) and the start of a path; the longest that fits decides. Pages that no rule fits
are decided by their host: personalised PageRank spreads trust from the hosts whose pages the rules mostly allow along
links, and distrust from those they mostly block against the direction of links, to hosts that link to them, until the
ranks no longer change. A host is
blocked when its distrust exceeds its trust and a least share of what one seed starts with; all others are allowed.

Links are absolute and protocol-relative ``href`` targets of ``a`` elements, counted per (host, host) before anything is shuffled; the
iteration runs on that table. The bounded list of rules is compiled into one expression.

Edge cases: a url that is null or has no ``://`` has an empty host and path and is allowed unless a rule fits; null html
has no links; repeated rows are judged each; a host linking to itself is no edge; without edges only seeds have ranks;
other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.llm.support import materialize, table

#: (host, path prefix, verdict)
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
DAMPING = 0.85
#: Steps of a spread that is not asked to converge.
ITERATIONS = 12
#: Least distrust of a blocked host, as a share of a blocked seed's start.
LEAST_SHARE = 0.05
#: A spread ends when all ranks together can rise by no more than this: a thousandth of the least distrust of a blocked host.
TOLERANCE = LEAST_SHARE * (1 - DAMPING) / 1000
#: Blocked hosts that are broadcast; with more, they are joined by a shuffle.
MAX_BROADCAST_HOSTS = 200_000

_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_HREF = r"""(?i)<a\s(?:[^>]*?[\s"'])?href\s*=\s*["']?\s*((?:https?:)?//[^/?#\s"'<>]+)"""
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule, null where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, start, kind in sorted(rules, key=lambda r: len(r[0]) + len(r[1])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        rule, verdict = F.when(fits, name + start).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, n): links between different hosts."""
    targets = F.transform(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(_HREF), F.lit(1)), lambda t: F.translate(F.substring_index(t, "//", -1), _UPPER, _LOWER))
    rows = pages.select(F.col("host").alias("src"), F.explode(targets).alias("dst")).filter("src <> '' and src <> dst")
    return rows.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def spread(edges: DataFrame, seeds: DataFrame, name: str, damping: float = DAMPING, iterations: int = ITERATIONS, tolerance: float | None = None) -> DataFrame:
    """Personalised PageRank: (host, rank) over ``edges(src, dst, n)`` from ``seeds(host, weight)``; what reaches a host without links is lost.

    With a tolerance, ``iterations`` are followed by more until no rank is further from its limit than that. Ranks only
    rise, and each step adds at most ``damping`` times what the step before added, so the sum of all ranks tells how much
    can still come to any host; many small shares that meet again in one host are in it too.
    """
    ranks = seeds.select("host", ((1 - damping) * F.col("weight")).alias("rank"))
    if edges.isEmpty():
        return ranks
    total = edges.groupBy("src").agg(F.sum("n").alias("all"))
    steps = materialize(edges.join(total, "src").select("src", "dst", (F.col("n") / F.col("all")).alias("p")), f"{name}-steps")
    start, k, before = ranks, 0, None
    while True:
        moved = steps.join(ranks.withColumnRenamed("host", "src"), "src").select(F.col("dst").alias("host"), (damping * F.col("p") * F.col("rank")).alias("rank"))
        ranks = moved.unionByName(start).groupBy("host").agg(F.sum("rank").alias("rank"))
        k += 1
        if k % 4 == 0:
            ranks = materialize(ranks, f"{name}-{k}")
        if tolerance is None:
            if k >= iterations:
                return ranks
        elif k % 4 == 0:
            mass = ranks.agg(F.coalesce(F.sum("rank"), F.lit(0.0))).first()[0]
            if k >= iterations and before is not None and (mass - before) * damping / (1 - damping) <= tolerance:
                return ranks
            before = mass


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict."""
    parts = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.col("html").alias("html"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    parts = parts.withColumn("rule", rule).withColumn("ruled", verdict)
    share = parts.filter("host <> ''").groupBy("host").agg(F.avg(F.when(F.col("ruled") == "allow", 1.0).otherwise(0.0)).alias("allowed"), F.avg(F.when(F.col("ruled") == "block", 1.0).otherwise(0.0)).alias("blocked"))
    share = materialize(share, "hosts")
    edges = materialize(host_edges(parts), "edges")
    trust = spread(edges, share.filter("allowed > 0.5").select("host", F.lit(1.0).alias("weight")), "trust", tolerance=TOLERANCE)
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n")
    distrust = spread(back, share.filter("blocked > 0.5").select("host", F.lit(1.0).alias("weight")), "distrust", tolerance=TOLERANCE)
    scored = trust.select("host", F.col("rank").alias("trust")).join(distrust.select("host", F.col("rank").alias("distrust")), "host", "full").fillna(0.0, ["trust", "distrust"])
    bad = materialize(scored.filter((F.col("distrust") > F.col("trust")) & (F.col("distrust") >= LEAST_SHARE * (1 - DAMPING))).select("host", F.lit(True).alias("bad")), "bad")
    if bad.count() <= MAX_BROADCAST_HOSTS:
        bad = F.broadcast(bad)
    out = parts.drop("html").join(bad, "host", "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(F.coalesce("bad", F.lit(False)), "block").otherwise("allow")).alias("verdict"))


def op9_url_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op9_url_graph": op9_url_graph}


def _oracle() -> str:
    """The rules, and both spreads as sums over steps of a recursive query: 60 steps leave less than 0.85^60 of the mass."""
    rules = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
    href = _HREF.replace("'", "''")
    spread_ = """{n}_seed AS (SELECT host FROM share WHERE {col} > 0.5),
{n}_step AS (SELECT {a} AS src, {b} AS dst, n / sum(n) OVER (PARTITION BY {a}) AS p FROM edges),
{n}_walk AS (SELECT host, %s AS rank, 0 AS k FROM {n}_seed UNION ALL SELECT dst, sum(%s * p * rank), k + 1 FROM {n}_walk JOIN {n}_step ON src = host WHERE k < 60 GROUP BY dst, k),
{n} AS (SELECT host, sum(rank) AS rank FROM {n}_walk GROUP BY host)""" % (1 - DAMPING, DAMPING)
    return f"""
WITH RECURSIVE parts AS (SELECT row_number() OVER () AS r, page_id, translate(coalesce(regexp_extract(url, '{_URL}', 1), ''), '{_UPPER}', '{_LOWER}') AS host, coalesce(regexp_extract(url, '{_URL}', 2), '') AS path, html FROM pages),
fits AS (SELECT r, h || p AS rule, v, row_number() OVER (PARTITION BY r ORDER BY length(h) + length(p) DESC) AS k FROM parts, (VALUES {rules}) t(h, p, v) WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)),
judged AS (SELECT parts.*, rule, v AS ruled FROM parts LEFT JOIN fits ON fits.r = parts.r AND k = 1),
share AS (SELECT host, avg(CASE WHEN ruled = 'allow' THEN 1.0 ELSE 0.0 END) AS allowed, avg(CASE WHEN ruled = 'block' THEN 1.0 ELSE 0.0 END) AS blocked FROM judged WHERE host <> '' GROUP BY host),
targets AS (SELECT host AS src, translate(split_part(t, '//', 2), '{_UPPER}', '{_LOWER}') AS dst FROM (SELECT host, unnest(regexp_extract_all(coalesce(html, ''), '{href}', 1)) AS t FROM judged)),
edges AS (SELECT src, dst, count(*) AS n FROM targets WHERE src <> '' AND src <> dst GROUP BY src, dst),
{spread_.format(n="trust", col="allowed", a="src", b="dst")},
{spread_.format(n="distrust", col="blocked", a="dst", b="src")},
bad AS (SELECT d.host FROM distrust d LEFT JOIN trust t USING (host) WHERE d.rank > coalesce(t.rank, 0) AND d.rank >= {LEAST_SHARE * (1 - DAMPING)})
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN host IN (SELECT host FROM bad) THEN 'block' ELSE 'allow' END) AS verdict FROM judged
"""


ORACLES = {"op9_url_graph": _oracle()}
