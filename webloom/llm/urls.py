"""URL filters: explicit rules first, then a path-template tree per host judged by smoothed labelled purity. Native only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.llm.common import ascii_lower, join_counted, materialize

#: (action, host, path): a rule fits its host and all subdomains, under paths that start with its own.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))

#: Levels of the tree; the segments below the last level, each generalised like any other, are one child together.
DEPTH = 4
#: A branching node with more different children than this, each met less than CROWD times on average, is a variable.
CHILDREN, CROWD = 8, 3.0
#: Siblings whose share of good labels (without labels: of variable children) lies within this many standard errors of their parent's are merged.
Z = 1.96
#: Pseudo-counts: a template leans on its host, a host on NEUTRAL. A template below PURITY is rejected; two bad labels of its own (or three of its host) and no good one do that.
PRIOR, NEUTRAL, PURITY = 4.0, 0.5, 0.3
WILD, STAR = "*", "%2A"


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without it."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def url_path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as ``host`` + ``path``, or null."""
    out = F.lit(None).cast("string")
    for _, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1:])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        out = F.when(fits, F.lit(h + p)).otherwise(out)
    return out


def action_of(rule: Column, rules=RULES) -> Column:
    """What the rule says, or null."""
    out = F.lit(None).cast("string")
    for a, h, p in rules:
        out = F.when(rule == h + p, F.lit(a)).otherwise(out)
    return out


def _general(segment: Column) -> Column:
    """Segments that are variables by their form: numbers, with or without an ending, and long hex ids. A segment that is the wildcard's sign is written otherwise."""
    variable = segment.rlike(r"^[0-9]+(\.[A-Za-z0-9]+)?$") | segment.rlike(r"^[0-9a-fA-F-]{16,}$")
    return F.when(variable, F.lit(WILD)).when(segment == WILD, F.lit(STAR)).otherwise(segment)


def _segments(path: Column) -> Column:
    parts = F.transform(F.filter(F.split(path, "/"), lambda s: s != ""), _general)
    tail = F.when(F.size(parts) > DEPTH, F.array(F.array_join(F.slice(parts, F.lit(DEPTH + 1), F.greatest(F.size(parts) - DEPTH, F.lit(0))), "/")))
    return F.concat(F.slice(parts, 1, DEPTH), F.coalesce(tail, F.array().cast("array<string>")))


def _near(part: str, whole: str) -> Column:
    """A child's ``part`` of its ``whole`` lies within Z standard errors of what its parent's share would give."""
    p = F.try_divide(F.col(f"all_{part}").cast("double"), F.col(f"all_{whole}").cast("double"))
    return F.abs(F.col(part) - F.col(whole) * p) <= Z * F.sqrt(F.col(whole) * p * (1 - p))


def templates(pages: DataFrame) -> DataFrame:
    """``(host, shape, n, template, good, labelled, purity)`` for every distinct path shape of every host, written.

    ``pages(host, path, q)``, q 1 for good, 0 for bad, null for unknown, are first summed to path shapes, so that a
    host with a third of all pages is as small as its variety. The tree is then walked from the root: at
    each depth the children of a node are one row each; children of a variable node (many children, few pages
    each) and siblings that are alike go to the wildcard branch, and the next depth counts below the merged branches. Labelled
    siblings are alike if their labels don't differ from their parent's. A child without labels is like its siblings, and
    shares their labels, if the share of its pages that go on with a variable segment doesn't differ from its parent's; where no child has
    any labels, all are alike. Sums are all partial; a node with many children is a hot key of joins only, which AQE splits.
    """
    shapes = pages.select("host", _segments(F.col("path")).alias("shape"), "q").groupBy("host", "shape")
    shapes = shapes.agg(F.count("*").alias("n"), F.count("q").alias("labelled"), F.sum(F.when(F.col("q") > 0, 1).otherwise(0)).alias("good"))
    level = materialize(shapes.withColumn("template", F.lit("")), "urls-shapes")
    for d in range(1, DEPTH + 2):
        seg = F.try_element_at("shape", F.lit(d))
        there = level.withColumn("seg", seg)
        goes_on = F.when(F.try_element_at("shape", F.lit(d + 1)) == WILD, F.col("n")).otherwise(0)
        child = there.where(F.col("seg").isNotNull()).groupBy("host", "template", "seg").agg(F.sum("n").alias("n"), F.sum("labelled").alias("labelled"), F.sum("good").alias("good"), F.sum(goes_on).alias("wild"))
        node = child.groupBy("host", "template").agg(F.count("*").alias("kids"), F.count_if(F.col("labelled") > 0).alias("told"), *[F.sum(c).alias(f"all_{c}") for c in ("n", "labelled", "good", "wild")])
        variable = (F.col("kids") > CHILDREN) & (F.col("all_n") / F.col("kids") < CROWD)
        alike = F.when(F.col("told") == 0, True).when(F.col("labelled") > 0, _near("good", "labelled")).otherwise(_near("wild", "n"))
        kept = child.join(node, ["host", "template"]).where(~(variable | ((F.col("kids") > 1) & alike))).select("host", "template", "seg", F.lit(True).alias("own"))
        branch = F.when(F.col("seg").isNull(), F.col("template")).otherwise(F.concat("template", F.lit("/"), F.when(F.col("own"), F.col("seg")).otherwise(F.lit(WILD))))
        level = materialize(there.join(kept, ["host", "template", "seg"], "left").withColumn("template", branch).drop("seg", "own"), "urls-level")
    hosts = level.groupBy("host").agg(F.sum("good").alias("hg"), F.sum("labelled").alias("hl"))
    hosts = hosts.select("host", ((F.col("hg") + F.lit(PRIOR * NEUTRAL)) / (F.col("hl") + PRIOR)).alias("lean"))
    leaves = level.groupBy("host", "template").agg(F.sum("good").alias("tg"), F.sum("labelled").alias("tl")).join(hosts, "host")
    leaves = leaves.select("host", "template", "tg", "tl", ((F.col("tg") + PRIOR * F.col("lean")) / (F.col("tl") + PRIOR)).alias("purity"))
    out = level.select("host", "shape", "n", "template").join(leaves, ["host", "template"])
    return materialize(out.select("host", "shape", "n", "template", F.col("tg").alias("good"), F.col("tl").alias("labelled"), "purity"), "urls-templates")


def judge(pages: DataFrame, rules=RULES, labels: DataFrame | None = None) -> DataFrame:
    """``(page_id, host, path, rule, verdict, template, purity)``, one row for each row of ``pages``.

    A page that a rule fits is labelled by it: block 0, allow 1; ``labels(page_id, quality)``, if given, label the other pages
    (the least of several). Rules win over templates; a template is blocked if its purity is below
    PURITY, its own labels and those of its host counted. Null urls and urls without
    ``://`` have an empty host and path and share one template; repeated rows are judged alike;
    hosts without labelled pages all pass; an empty table gives no row; other columns are ignored.

    A shape with a large share of all pages (see :func:`join_counted`) meets its template by a broadcast, so the
    shuffled join has no hot key.
    """
    rows = pages.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    rows = rows.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    action = action_of(F.col("rule"), rules)
    told = rows.withColumn("q", F.when(action == "allow", 1).when(action == "block", 0))
    if labels is not None:
        one = labels.where(F.col("page_id").isNotNull()).groupBy("page_id").agg((F.min("quality") > 0).cast("int").alias("given"))
        told = told.join(one, "page_id", "left").withColumn("q", F.coalesce("q", "given"))
    known = templates(told.select("host", "path", "q"))
    out = join_counted(rows.withColumn("shape", _segments(F.col("path"))), known, ["host", "shape"])
    learned = F.when(F.col("purity") < PURITY, F.lit("block")).otherwise(F.lit("allow"))
    return out.select("page_id", "host", "path", "rule", F.coalesce(action, learned).alias("verdict"), "template", F.round("purity", 9).alias("purity"))


def _sql_segments(path: str) -> str:
    gen = f"CASE WHEN regexp_matches(s, '^[0-9]+(\\.[A-Za-z0-9]+)?$') OR regexp_matches(s, '^[0-9a-fA-F-]{{16,}}$') THEN '{WILD}' WHEN s = '{WILD}' THEN '{STAR}' ELSE s END"
    parts = f"list_transform(list_filter(string_split({path}, '/'), lambda s: s <> ''), lambda s: {gen})"
    return f"list_concat(list_slice({parts}, 1, {DEPTH}), CASE WHEN len({parts}) > {DEPTH} THEN [array_to_string(list_slice({parts}, {DEPTH + 1}, len({parts})), '/')] ELSE [] END)"


def oracle_sql(rules=RULES) -> str:
    """The same in DuckDB's SQL."""
    rule, action = "NULL", "NULL"
    for a, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1:])):
        rule = f"CASE WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h}{p}' ELSE {rule} END"
        action = f"CASE WHEN rule = '{h}{p}' THEN '{a}' ELSE {action} END"
    ctes = [
        "p AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages)",
        f"r AS (SELECT *, {rule} AS rule FROM p)",
        f"k AS (SELECT *, {action} AS said, {_sql_segments('path')} AS shape FROM r)",
        "l0 AS (SELECT host, shape, count(*)::BIGINT AS n, count(said)::BIGINT AS labelled, coalesce(sum(CASE WHEN said = 'allow' THEN 1 ELSE 0 END), 0)::BIGINT AS good, '' AS template FROM k GROUP BY 1, 2)",
    ]
    for d in range(1, DEPTH + 2):
        ctes += [
            f"c{d} AS (SELECT host, template, shape[{d}] AS seg, sum(n)::DOUBLE AS n, sum(labelled)::DOUBLE AS labelled, sum(good)::DOUBLE AS good, sum(CASE WHEN shape[{d + 1}] = '{WILD}' THEN n ELSE 0 END)::DOUBLE AS wild FROM l{d - 1} WHERE shape[{d}] IS NOT NULL GROUP BY 1, 2, 3)",
            f"n{d} AS (SELECT host, template, count(*) AS kids, count(*) FILTER (labelled > 0) AS told, sum(n) AS an, sum(labelled) AS al, sum(good) AS ag, sum(wild) AS aw FROM c{d} GROUP BY 1, 2)",
            f"o{d} AS (SELECT c.host, c.template, c.seg FROM c{d} c JOIN n{d} p ON c.host = p.host AND c.template = p.template WHERE NOT (kids > {CHILDREN} AND an / kids < {CROWD}) AND (kids = 1 OR told > 0 AND CASE WHEN labelled > 0 THEN abs(good - labelled * (ag / al)) > {Z} * sqrt(labelled * (ag / al) * (1 - ag / al)) ELSE abs(wild - n * (aw / an)) > {Z} * sqrt(n * (aw / an) * (1 - aw / an)) END))",
            f"l{d} AS (SELECT l.host, l.shape, l.n, l.labelled, l.good, CASE WHEN l.shape[{d}] IS NULL THEN l.template ELSE l.template || '/' || CASE WHEN o.seg IS NOT NULL THEN o.seg ELSE '{WILD}' END END AS template FROM l{d - 1} l LEFT JOIN o{d} o ON l.host = o.host AND l.template = o.template AND l.shape[{d}] = o.seg)",
        ]
    last = f"l{DEPTH + 1}"
    ctes += [
        f"h AS (SELECT host, (sum(good) + {PRIOR * NEUTRAL})::DOUBLE / (sum(labelled) + {PRIOR}) AS lean FROM {last} GROUP BY 1)",
        f"t AS (SELECT x.host, template, sum(labelled) AS tl, (sum(good) + {PRIOR} * max(lean)) / (sum(labelled) + {PRIOR}) AS purity FROM {last} x JOIN h ON x.host = h.host GROUP BY 1, 2)",
        f"j AS (SELECT k.page_id, k.host, k.path, k.rule, k.said, x.template, t.tl, t.purity FROM k JOIN {last} x ON k.host = x.host AND k.shape = x.shape JOIN t ON t.host = x.host AND t.template = x.template)",
    ]
    return "WITH " + ",\n".join(ctes) + f"\nSELECT page_id, host, path, rule, coalesce(said, CASE WHEN purity < {PURITY} THEN 'block' ELSE 'allow' END) AS verdict, template, round(purity, 9) AS purity FROM j"
