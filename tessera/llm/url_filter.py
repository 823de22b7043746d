"""URL filter: explicit host/path rules, else the verdict of a path-template tree.

The tree is grown level by level on the distinct path shapes of each host, as DataFrames. Runs of
digits in a segment become ``*`` at once; a node with more than ``max_children`` distinct children
generalises them into one ``*`` child; below ``max_depth`` levels the rest of a path is ``**``.
Branches of a host that differ only in their first segment form a family. A branch whose share of
bad labels doesn't differ from the rest of its family (two-proportion z below ``z``), or that has
no labels, merges into the family. A template's rate of bad labels is smoothed towards its host's,
and that towards the overall rate; purity is one less that rate, and templates below ``purity`` are
blocked. Only counts are grouped; hot hosts are spread over tasks by adaptive skew joins.

Defined cases: null urls and those without ``://`` have empty host and path; upper case is folded
for A-Z in hosts only; a host that no label covers gets the overall rate; without any labels all
templates are allowed; repeated rows are judged alike; extra columns stay out of the result.
Rules are few (held in the plan): of those that fit, the longest wins.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lookup, materialise, release

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DEPTH, CHILDREN, Z, PRIOR, PURITY = 6, 8, 1.96, 20.0, 0.5


def host_and_path(url: Column) -> tuple[Column, Column]:
    u = F.coalesce(url, F.lit(""))
    at = F.instr(u, "://")
    rest = F.when(at > 0, F.substr(u, at + 3)).otherwise("")
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_columns(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, its verdict) of the longest fitting rule; null if none fits. Rules: (verdict, host/path)."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, r in sorted(rules, key=lambda x: len(x[1])):
        domain, _, tail = r.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith("/" + tail)
        rule, verdict = F.when(fits, F.lit(r)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def _key(*columns: str) -> Column:
    return F.concat_ws("\n", *columns)


def templates(rows: DataFrame, max_depth: int = DEPTH, max_children: int = CHILDREN, z: float = Z, prior: float = PRIOR) -> DataFrame:
    """The tree of rows (host, shape, bad): one row per distinct host and shape: key, template, purity.

    ``bad`` is 1 or 0 for labelled rows, else null.
    """
    shapes = rows.groupBy("host", "shape").agg(F.count("bad").alias("lab"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    cut = F.filter(F.split("shape", "/"), lambda s: s != "")
    t = materialise(shapes.select("host", "shape", "lab", "bad", cut.alias("segs"), F.lit("").alias("tmpl")), "shapes")
    for d in range(max_depth):
        whole = t
        t = t.withColumns({"seg": F.get("segs", F.lit(d)), "parent": _key("host", "tmpl")})
        wide = t.where("seg is not null").groupBy("parent", "seg").agg(F.lit(1)).groupBy("parent").agg(F.count("*").alias("kids")).where(F.col("kids") > max_children)
        t = lookup(t, wide, "parent", "left")
        step = F.when(F.col("seg").isNull(), F.col("tmpl")).otherwise(F.concat("tmpl", F.lit("/"), F.when(F.col("kids").isNull(), F.col("seg")).otherwise("*")))
        last, t = whole, materialise(t.select("host", "shape", "lab", "bad", "segs", step.alias("tmpl")), "tree")
        release(last)
    deep = F.when(F.size("segs") > max_depth, F.concat("tmpl", F.lit("/**"))).otherwise(F.col("tmpl"))
    t = t.select("host", "shape", "lab", "bad", deep.alias("tmpl"))
    t = materialise(t.withColumns({"branch": _key("host", "tmpl"), "family": _key("host", F.regexp_replace("tmpl", r"^/[^/]*", "/+"))}), "branches")

    total = t.agg(F.coalesce(F.sum("lab"), F.lit(0)).alias("lab"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")).first()
    overall = (float(total["bad"]) + 1.0) / (float(total["lab"]) + 2.0)

    def rate(bad: Column, lab: Column, towards: Column) -> Column:
        return (bad.cast("double") + F.lit(prior) * towards) / (lab.cast("double") + F.lit(prior))

    branches = t.groupBy("branch", "family").agg(F.sum("lab").alias("bl"), F.sum("bad").alias("bb"))
    families = branches.groupBy("family").agg(F.sum("bl").alias("fl"), F.sum("bb").alias("fb"))
    b = lookup(branches, families, "family")
    rest_l, pool = F.col("fl") - F.col("bl"), F.try_divide(F.col("fb").cast("double"), F.col("fl").cast("double"))
    spread = F.sqrt(pool * (F.lit(1.0) - pool) * (F.try_divide(F.lit(1.0), F.col("bl").cast("double")) + F.try_divide(F.lit(1.0), rest_l.cast("double"))))
    gap = F.abs(F.try_divide(F.col("bb").cast("double"), F.col("bl").cast("double")) - F.try_divide((F.col("fb") - F.col("bb")).cast("double"), rest_l.cast("double")))
    own = F.coalesce(gap > F.lit(z) * spread, F.lit(False))
    b = materialise(b.select("branch", "bl", "bb", F.when(own, F.col("branch")).otherwise(F.col("family")).alias("node")), "merged")
    nodes = b.groupBy("node").agg(F.sum("bl").alias("nl"), F.sum("bb").alias("nb")).withColumn("host", F.substring_index("node", "\n", 1))
    hosts = nodes.groupBy("host").agg(F.sum("nl").alias("hl"), F.sum("nb").alias("hb"))
    n = lookup(nodes, hosts, "host")
    purity = F.lit(1.0) - rate(F.col("nb"), F.col("nl"), rate(F.col("hb"), F.col("hl"), F.lit(overall)))
    n = n.select("node", F.substring_index("node", "\n", -1).alias("template"), purity.alias("purity"))
    judged = lookup(b.select("branch", "node"), n, "node").select("branch", "template", "purity")
    return lookup(t.select("branch", _key("host", "shape").alias("key")), judged, "branch").select("key", "template", "purity")


def judge(pages: DataFrame, rules: list[tuple[str, str]], url_col: str = "url", id_col: str = "page_id", bad_col: str | None = None, purity: float = PURITY, **tree) -> DataFrame:
    """id, host, path, rule, verdict, template, purity of every row; ``bad_col``: 1, 0 or null."""
    host, path = host_and_path(F.col(f"`{url_col}`"))
    bad = F.col(f"`{bad_col}`").cast("bigint") if bad_col else F.lit(None).cast("bigint")
    p = pages.select(F.col(f"`{id_col}`").alias("id"), host.alias("host"), path.alias("path"), bad.alias("bad"))
    p = materialise(p.withColumn("shape", F.regexp_replace("path", "[0-9]+", "*")), "pages")
    t = templates(p.select("host", "shape", "bad"), **tree)
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    out = lookup(p.withColumn("key", _key("host", "shape")), t, "key")
    own = F.when(F.col("purity") < purity, "block").otherwise("allow")
    return out.select(F.col("id").alias(id_col), "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "template", F.round("purity", 6).alias("purity"))


RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def query(spark, sf_dir: str) -> DataFrame:
    """Labels are those of documents (quality 0 is bad); a page shows the document its url numbers."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").groupBy("doc_id").agg(F.max(1 - F.col("quality")).alias("bad"))
    _, path = host_and_path(F.col("url"))
    number = F.regexp_extract(path, "([0-9]{1,18})", 1).try_cast("bigint")
    known = lookup(pages.withColumn("doc_id", number), labels, "doc_id", "left").select("page_id", "url", "bad")
    return judge(known, RULES, bad_col="bad")


def _sql() -> str:
    """The same computation for DuckDB."""
    key = "{0} || chr(10) || {1}".format
    fits = [
        f"((host = '{d}' OR ends_with(host, '.{d}')) AND starts_with(path, '/{p}'))"
        for d, _, p in (r.partition("/") for _, r in RULES)
    ]
    order = sorted(range(len(RULES)), key=lambda i: -len(RULES[i][1]))
    rule = "CASE " + " ".join(f"WHEN {fits[i]} THEN '{RULES[i][1]}'" for i in order) + " END"
    verdict = "CASE " + " ".join(f"WHEN {fits[i]} THEN '{RULES[i][0]}'" for i in order) + " END"
    levels = reduce(
        lambda s, d: s
        + f"""k{d} AS (SELECT host, tmpl, count(DISTINCT segs[{d + 1}]) AS kids FROM t{d} WHERE len(segs) > {d} GROUP BY ALL),
t{d + 1} AS (SELECT t.host, t.shape, t.lab, t.bad, t.segs, CASE WHEN len(segs) <= {d} THEN t.tmpl
  ELSE t.tmpl || '/' || CASE WHEN coalesce(k.kids, 0) > {CHILDREN} THEN '*' ELSE segs[{d + 1}] END END AS tmpl
  FROM t{d} t LEFT JOIN k{d} k ON t.host = k.host AND t.tmpl = k.tmpl),
""",
        range(DEPTH),
        "",
    )
    return f"""
WITH l AS (SELECT doc_id, max(1 - quality) AS bad FROM labels GROUP BY doc_id),
u AS (SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
p AS (SELECT page_id, host, path, regexp_replace(path, '[0-9]+', '*', 'g') AS shape, l.bad
  FROM h LEFT JOIN l ON l.doc_id = try_cast(nullif(regexp_extract(path, '([0-9]{{1,18}})', 1), '') AS BIGINT)),
t0 AS (SELECT host, shape, count(bad) AS lab, coalesce(sum(bad), 0) AS bad, list_filter(string_split(shape, '/'), lambda s: s <> '') AS segs, '' AS tmpl
  FROM p GROUP BY host, shape),
{levels}
t AS (SELECT host, shape, lab, bad, {key('host', 'm')} AS branch, {key('host', "regexp_replace(m, '^/[^/]*', '/+')")} AS family
  FROM (SELECT *, CASE WHEN len(segs) > {DEPTH} THEN tmpl || '/**' ELSE tmpl END AS m FROM t{DEPTH})),
o AS (SELECT (coalesce(sum(bad), 0) + 1)::DOUBLE / (coalesce(sum(lab), 0) + 2)::DOUBLE AS r FROM t),
b0 AS (SELECT branch, family, sum(lab)::DOUBLE AS bl, sum(bad)::DOUBLE AS bb FROM t GROUP BY ALL),
b1 AS (SELECT *, sum(bl) OVER (PARTITION BY family) AS fl, sum(bb) OVER (PARTITION BY family) AS fb FROM b0),
b AS (SELECT branch, bl, bb, CASE WHEN bl > 0 AND fl - bl > 0
    AND abs(bb / nullif(bl, 0) - (fb - bb) / nullif(fl - bl, 0)) > {Z} * sqrt(fb / nullif(fl, 0) * (1.0::DOUBLE - fb / nullif(fl, 0)) * (1.0::DOUBLE / nullif(bl, 0) + 1.0::DOUBLE / nullif(fl - bl, 0)))
    THEN branch ELSE family END AS node FROM b1),
n AS (SELECT node, split_part(node, chr(10), 1) AS host, sum(bl) AS nl, sum(bb) AS nb FROM b GROUP BY node),
nn AS (SELECT *, sum(nl) OVER (PARTITION BY host) AS hl, sum(nb) OVER (PARTITION BY host) AS hb FROM n),
q AS (SELECT node, split_part(node, chr(10), 2) AS template,
  1.0::DOUBLE - (nb + {PRIOR}::DOUBLE * ((hb + {PRIOR}::DOUBLE * r) / (hl + {PRIOR}::DOUBLE))) / (nl + {PRIOR}::DOUBLE) AS purity FROM nn, o)
SELECT p.page_id, p.host, p.path, {rule} AS rule,
  coalesce({verdict}, CASE WHEN purity < {PURITY} THEN 'block' ELSE 'allow' END) AS verdict, template, round(purity, 6) AS purity
FROM p JOIN t USING (host, shape) JOIN b USING (branch) JOIN q USING (node)
""".replace("fb / nullif(fl, 0)", "(fb / nullif(fl, 0))")


SQL = _sql()
