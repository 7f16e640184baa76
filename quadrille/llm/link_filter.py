"""URL filters: rules first, then trust and distrust propagated over the links between hosts.

Personalised PageRank starts from hosts with allowed pages and follows links forwards; distrust starts from hosts
with blocked pages and follows links backwards (who links to bad hosts is suspect). Both vectors are in units of
ruled pages, so a host is blocked where its distrust exceeds its trust.

Edge cases: a null url, or one without `://`, has empty host and path, fits no rule and is allowed; pages without
html have no links; repeated pages count as often as they occur; ties between trust and distrust allow; an empty
table gives an empty result. Links are taken with a scheme or as `//host/...`; others stay on their host. Columns of the
input other than page_id, url and html are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = r"""(?i)href\s*=\s*["']?((?:[a-z][a-z0-9+.-]*:)?//[^"'\s>]+)"""
#: Rules of the registered query: host (with all subdomains) and the start of the path.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))


def host_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    return F.coalesce(F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    return F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest fitting rule as struct(action, rule), or null."""
    fits = F.lit(None).cast("struct<action:string,rule:string>")
    for action, rule in sorted(rules, key=lambda r: len(r[1])):
        at, start = rule.split("/", 1)
        own = (host == at) | host.endswith("." + at)
        fits = F.when(own & path.startswith("/" + start), F.struct(F.lit(action).alias("action"), F.lit(rule).alias("rule"))).otherwise(fits)
    return fits


def host_links(pages: DataFrame) -> DataFrame:
    """Distinct links between different hosts with the share of the source's links: src, dst, share."""
    pairs = (
        pages.select(host_of(F.col("url")).alias("src"), F.explode(F.regexp_extract_all("html", F.lit(LINK), F.lit(1))).alias("link"))
        .select("src", host_of(F.when(F.col("link").startswith("//"), F.concat(F.lit("http:"), "link")).otherwise(F.col("link"))).alias("dst"))
        .where("src <> dst AND src <> '' AND dst <> ''")
        .groupBy("src", "dst").agg(F.count("*").alias("n"))
    )
    return pairs


def propagate(seeds: DataFrame, links: DataFrame, damping: float = 0.85, tolerance: float = 1e-6, every: int = 4, most_rounds: int = 400) -> DataFrame:
    """host, trust, distrust from seeds (host, kind, mass) and links (src, dst, n).

    Each round sends on what the last one added: a join on the sending host and a sum per receiving host (pre-aggregated
    before the shuffle; a hub with very many links is split by the adaptive skew join). It ends when all that later
    rounds could still add is below `tolerance` of the seeds' mass. A host without links keeps its mass to itself.
    """
    def shares(source: str, target: str, kind: str) -> DataFrame:
        total = links.groupBy(source).agg(F.sum("n").alias("all"))
        return links.join(total, source).select(F.lit(kind).alias("kind"), F.col(source).alias("host"), F.col(target).alias("to"), (F.col("n") / F.col("all")).alias("share"))

    edges = written(shares("src", "dst", "trust").unionByName(shares("dst", "src", "distrust")), "links")
    whole = seeds.agg(F.sum("mass")).first()[0] or 0.0
    added = seeds.select("host", "kind", (F.col("mass") * (1 - damping)).alias("mass"), F.lit(0).alias("round"))
    steps = [added]
    for first in range(1, most_rounds + 1, every):
        several = []
        for k in range(first, first + every):
            sent = added.join(edges, ["kind", "host"]).groupBy(F.col("to").alias("host"), "kind").agg((F.sum(F.col("mass") * F.col("share")) * damping).alias("mass"))
            added = sent.withColumn("round", F.lit(k))
            several.append(added)
        steps.append(written(reduce(DataFrame.unionByName, several), "rank"))
        added = steps[-1].where(F.col("round") == first + every - 1)
        left = added.agg(F.sum("mass")).first()[0] or 0.0
        if left * damping / (1 - damping) <= tolerance * whole:
            break
    else:
        raise RuntimeError(f"more than {most_rounds} rounds for a tolerance of {tolerance}")
    mass = reduce(DataFrame.unionByName, steps)
    return mass.groupBy("host").agg(*[F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("mass"))), F.lit(0.0)).alias(kind) for kind in ("trust", "distrust")])


def filter_urls(pages: DataFrame, rules=RULES, damping: float = 0.85, tolerance: float = 1e-6) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust for every page."""
    url = F.col("url")
    judged = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"))
    judged = judged.withColumn("fit", longest_rule(F.col("host"), F.col("path"), rules))
    seeds = written(
        judged.where("fit IS NOT NULL").groupBy("host", F.when(F.col("fit.action") == "allow", "trust").otherwise("distrust").alias("kind")).agg(F.count("*").cast("double").alias("mass")), "seeds"
    )
    scores = propagate(seeds, host_links(pages), damping, tolerance)
    trust, distrust = (F.round(F.coalesce(c, F.lit(0.0)), 9) for c in ("trust", "distrust"))
    return judged.join(scores, "host", "left").select(
        "page_id", "host", "path", F.col("fit.rule").alias("rule"),
        F.coalesce(F.col("fit.action"), F.when(distrust > trust, "block").otherwise("allow")).alias("verdict"),
        trust.alias("trust"), distrust.alias("distrust"),
    )


def op5_link_graph(spark, sf_dir) -> DataFrame:
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "host", "path", "rule", "verdict")


def op5_sql(rules=RULES, damping: float = 0.85, rounds: int = 12) -> str:
    """The same in DuckDB SQL, with the rounds written out one by one."""
    rest = "substr({0}, instr({0}, '://') + 3)"
    host = lambda c: f"CASE WHEN instr({c}, '://') > 0 THEN translate(regexp_extract({rest.format(c)}, '^[^/?#]*', 0), '{UPPER}', '{LOWER}') ELSE '' END"
    path = f"CASE WHEN instr(url, '://') > 0 THEN regexp_extract({rest.format('url')}, '^[^/?#]*([^?#]*)', 1) ELSE '' END"
    whens = {"action": "", "rule": ""}
    for action, rule in sorted(rules, key=lambda r: -len(r[1])):
        at, start = rule.split("/", 1)
        fits = f"WHEN (host = '{at}' OR ends_with(host, '.{at}')) AND starts_with(path, '/{start}') THEN "
        whens["action"] += fits + f"'{action}' "
        whens["rule"] += fits + f"'{rule}' "
    link = LINK.replace("'", "''")
    sql = f"""WITH p AS (SELECT page_id, html, {host('url')} AS host, {path} AS path FROM pages),
j AS (SELECT *, CASE {whens['action']} ELSE NULL END AS action, CASE {whens['rule']} ELSE NULL END AS rule FROM p),
seed AS (SELECT host, CASE action WHEN 'allow' THEN 'trust' ELSE 'distrust' END AS kind, count(*) * {1 - damping!r} AS mass FROM j WHERE action IS NOT NULL GROUP BY ALL),
u AS (SELECT host AS src, unnest(regexp_extract_all(html, '{link}', 1)) AS url FROM p),
h AS (SELECT src, CASE WHEN starts_with(url, '//') THEN 'http:' || url ELSE url END AS url FROM u),
l AS (SELECT src, {host('url')} AS dst FROM h),
n AS (SELECT src, dst, count(*) AS n FROM l WHERE src <> dst AND src <> '' AND dst <> '' GROUP BY ALL),
e AS (SELECT 'trust' AS kind, src AS host, dst AS tgt, n / sum(n) OVER (PARTITION BY src) AS share FROM n
      UNION ALL SELECT 'distrust', dst, src, n / sum(n) OVER (PARTITION BY dst) FROM n),
m0 AS (SELECT * FROM seed)"""
    for k in range(1, rounds + 1):
        sql += f""",
m{k} AS (SELECT host, kind, sum(mass) AS mass FROM (SELECT * FROM seed UNION ALL
      SELECT e.tgt, kind, m.mass * e.share * {damping!r} FROM m{k - 1} m JOIN e USING (kind, host)) GROUP BY ALL)"""
    return sql + f""",
s AS (SELECT host, coalesce(sum(mass) FILTER (kind = 'trust'), 0) AS trust, coalesce(sum(mass) FILTER (kind = 'distrust'), 0) AS distrust FROM m{rounds} GROUP BY host)
SELECT page_id, j.host, path, rule, coalesce(action, CASE WHEN round(coalesce(distrust, 0), 9) > round(coalesce(trust, 0), 9) THEN 'block' ELSE 'allow' END) AS verdict
FROM j LEFT JOIN s ON j.host = s.host"""
