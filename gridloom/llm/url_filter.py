"""URL rules, and path templates judged by labelled purity; DataFrame functions only.

Rules name a host and the begin of a path, and hold for the host and all below it; the longest rule that fits decides.
The other URLs are judged by the template of their path. Per host, a tree of path segments is built level by level:
numbers, dates and hashes become wildcards by their shape, and so do the children of a node that are rare there.

A template's purity is the share of bad URLs among its labelled ones, smoothed along the tree: the host's share leans towards the
share of all (of which no more than PRIOR counts, so one hot host condemns no other), each node's towards its parent's. So a
branch with labels of its own is judged by them, and one without by its nearest labelled ancestor on the same host. Sibling
branches whose labelled share does not differ statistically from that of all siblings are merged: they are judged by the labels
of all of them. A template is rejected if its purity is REJECT or more.
The URLs that a rule decides are the labelled ones, unless other labels are given.

All counting is on aggregates by host and generalised path, which combine before the shuffle; a frequent host or path is
one row for each task. What goes back to the URLs is one row a path.

Defined results: a NULL URL, or one without `://`, has an empty host and path, no rule, and is allowed as there is
nothing against it. Repeated rows get equal verdicts; two rules of one length that fit: the longer host decides, then
block. An empty table gives an empty result. Other columns are ignored.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written
from .frames import pick, table

RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
LEVELS = 4                  # path segments that a template tells apart, unless told otherwise; URLs that differ only behind them are judged together
KEEP = 0.02                 # share of its parent from which a segment stays literal
SIMILAR = 1.96              # standard errors within which a branch is like its siblings
SMOOTH, REJECT = 5.0, 0.8   # weight of the parent's share, and the smoothed bad share that rejects
PRIOR = 0.5                 # the share of all counts no higher than this

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parsed(urls: DataFrame) -> DataFrame:
    """`urls` with host and path."""
    at = F.locate("://", "url")
    rest = F.when(at > 0, F.expr("substring(url, locate('://', url) + 3)")).otherwise("")
    out = urls.withColumn("__rest", F.coalesce(rest, F.lit(""))).withColumn("__host", F.regexp_extract("__rest", r"^[^/?#]*", 0))
    out = out.withColumn("path", F.regexp_extract(F.expr("substring(__rest, length(__host) + 1)"), r"^[^?#]*", 0))
    return out.withColumn("host", F.translate("__host", _UPPER, _LOWER)).drop("__rest", "__host")


def rule_of(rules) -> tuple[Column, Column]:
    """The rule that decides, as host and path, and what it says; NULL without one."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r[0] != "block"))
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, host, path in reversed(ordered):
        fits = ((F.col("host") == host) | F.endswith(F.col("host"), F.lit("." + host))) & F.startswith(F.col("path"), F.lit(path))
        name, verdict = F.when(fits, host + path).otherwise(name), F.when(fits, says).otherwise(verdict)
    return name, verdict


def shaped(levels: int = LEVELS) -> Column:
    """The first segments of `path`, with numbers, dates and hashes as wildcards of their shape, and {rest} for what follows."""
    parts = F.filter(F.split("path", "/"), lambda s: s != "")
    shape = lambda s: F.regexp_replace(F.regexp_replace(s, r"^[0-9a-fA-F-]{16,}", "{hash}"), r"[0-9]+", "{n}")                    # noqa: E731
    head = F.transform(F.slice(parts, 1, levels), shape)
    return F.when(F.size(parts) > levels, F.concat(head, F.array(F.lit("{rest}")))).otherwise(head)


def templates(paths: DataFrame, levels: int = LEVELS) -> DataFrame:
    """(host, segments, template) from (host, segments, n, labelled, bad): rare children of a node become wildcards, level by level."""
    out = paths.withColumn("template", F.lit(""))
    for level in range(1, levels + 1):
        out = out.withColumn("s", F.coalesce(F.get("segments", F.lit(level - 1)), F.lit("")))
        children = out.groupBy("host", "template", "s").agg(F.sum("n").alias("n"))
        total = children.groupBy("host", "template").agg(F.sum("n").alias("total"))
        frequent = children.join(total, ["host", "template"]).where(F.col("n") >= KEEP * F.col("total")).select("host", "template", "s", F.lit(True).alias("kept"))
        step = F.when(F.col("s") == "", F.lit("")).when(F.col("kept"), F.concat(F.lit("/"), "s")).otherwise("/*")
        out = written(out.join(frequent, ["host", "template", "s"], "left").withColumn("template", F.concat("template", step)).drop("s", "kept"))
    return out


def merged(tree: DataFrame) -> DataFrame:
    """(host, template, branch, labelled, bad): a row for each template, with the labels of all siblings where it is like them.

    Siblings share the host and what follows the first segment; `branch` names those that are merged alike."""
    tail = F.regexp_replace("template", r"^/[^/]*", "")
    leaves = tree.groupBy("host", "template").agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad")).withColumn("tail", tail)
    pooled = leaves.groupBy("host", "tail").agg(F.sum("labelled").alias("all_labelled"), F.sum("bad").alias("all_bad"))
    p = F.try_divide("all_bad", "all_labelled")
    error = F.sqrt(F.try_divide(p * (1 - p), F.col("labelled")))
    like = (F.col("labelled") > 0) & (F.abs(F.try_divide("bad", "labelled") - p) <= SIMILAR * error)
    like = F.coalesce(like, F.lit(False))
    either = lambda pool, own: F.when(like, F.col(pool)).otherwise(F.col(own)).alias(own)                      # noqa: E731
    return leaves.join(pooled, ["host", "tail"]).select("host", "template", F.when(like, F.concat(F.lit("/{similar}"), "tail")).otherwise(F.col("template")).alias("branch"),
                                                        either("all_labelled", "labelled"), either("all_bad", "bad"))


def purities(tree: DataFrame, prior: float) -> DataFrame:
    """(host, template, branch, purity): shares smoothed from the host down to the template."""
    leaves = written(merged(tree))
    parts = F.split("template", "/")
    above = tree.groupBy("host", "template").agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"))
    above = above.select("host", "template", "labelled", "bad", F.posexplode(F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda k: F.array_join(F.slice(parts, 1, k), "/"))).alias("depth", "node"))
    nodes = above.groupBy("host", "node").agg(F.sum("labelled").alias("node_labelled"), F.sum("bad").alias("node_bad"))
    chain = above.select("host", "template", "depth", "node").join(nodes, ["host", "node"]).groupBy("host", "template") \
        .agg(F.sort_array(F.collect_list(F.struct("depth", "node_labelled", "node_bad"))).alias("chain"))               # a row for each segment
    smooth = lambda share, labelled, bad: (bad + SMOOTH * share) / (labelled + SMOOTH)                          # noqa: E731
    parent = F.aggregate("chain", F.lit(prior), lambda share, n: smooth(share, n["node_labelled"], n["node_bad"]))
    return leaves.join(chain, ["host", "template"]).select("host", "template", "branch", smooth(parent, F.col("labelled"), F.col("bad")).alias("purity"))


def judge(pages: DataFrame, rules=RULES, labels: DataFrame | None = None, levels: int = LEVELS) -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity. `labels`: (page_id, bad boolean), else what the rules say."""
    name, says = rule_of(rules)
    urls = parsed(pick(pages, page_id="page_id:bigint", url="url:string")).withColumn("rule", name).withColumn("says", says).withColumn("segments", shaped(levels))
    bad = F.col("says") == "block"
    if labels is not None:
        urls = urls.join(pick(labels, page_id="page_id:bigint", __bad="bad:boolean").groupBy("page_id").agg(F.max("__bad").alias("__bad")), "page_id", "left")
        bad = F.col("__bad")
    urls = written(urls.withColumn("bad", bad).drop("url"))
    paths = urls.groupBy("host", "segments").agg(F.count("*").alias("n"), F.count("bad").alias("labelled"), F.sum(F.coalesce(F.col("bad").cast("long"), F.lit(0))).alias("bad"))
    tree = templates(written(paths), levels)
    share = tree.agg(F.try_divide(F.sum("bad"), F.sum("labelled")).alias("share")).first()["share"] or 0.0               # one number
    judged = tree.select("host", "segments", "template").join(purities(tree, min(share, PRIOR)), ["host", "template"]).drop("template")
    out = urls.join(written(judged), ["host", "segments"], "left")
    verdict = F.coalesce("says", F.when((F.col("purity") >= REJECT) & (F.col("host") != ""), "block").otherwise("allow"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.col("branch").alias("template"), "purity")


def op6_url_filter(spark, folder: str) -> DataFrame:
    return judge(table(spark, folder, "pages"))


def op6_sql(rules=RULES) -> str:
    """The same in SQL."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r[0] != "block"))
    case = lambda value: "CASE " + " ".join(f"WHEN (host = '{h}' OR host LIKE '%.{h}') AND starts_with(path, '{p}') THEN '{value(s, h, p)}'" for s, h, p in ordered) + " END"
    levels = ",\n".join(f"""c{k} AS (SELECT *, coalesce(segs[{k}], '') AS s FROM t{k - 1}),
k{k} AS (SELECT host, template, s, true AS kept FROM (SELECT host, template, s, sum(n) AS n FROM c{k} GROUP BY ALL) QUALIFY n >= {KEEP} * sum(n) OVER (PARTITION BY host, template)),
t{k} AS (SELECT host, segs, n, labelled, bad, template || CASE WHEN s = '' THEN '' WHEN kept THEN '/' || s ELSE '/*' END AS template FROM c{k} LEFT JOIN k{k} USING (host, template, s))"""
                        for k in range(1, LEVELS + 1))
    nodes = ",\n".join(f"""n{k} AS (SELECT * EXCLUDE (up), CASE WHEN len(segments) > {k + 1} THEN (sum(bad) OVER w + {SMOOTH} * up) / (sum(labelled) OVER w + {SMOOTH}) ELSE up END AS up
    FROM n{k - 1} WINDOW w AS (PARTITION BY host, array_to_string(segments[1:{k + 1}], '/')))""" for k in range(1, LEVELS))
    return f"""WITH r AS (SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, regexp_extract(coalesce(rest, ''), '^[^/?#]*') AS raw, coalesce(rest, '') AS rest FROM r),
p AS (SELECT page_id, translate(raw, '{_UPPER}', '{_LOWER}') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
s AS (SELECT *, {case(lambda s, h, p: h + p)} AS rule, {case(lambda s, h, p: s)} AS says, list_filter(string_split(path, '/'), lambda x: x <> '') AS parts FROM p),
g AS (SELECT *, list_transform(parts[1:{LEVELS}], lambda x: regexp_replace(regexp_replace(x, '^[0-9a-fA-F-]{{16,}}', '{{hash}}'), '[0-9]+', '{{n}}', 'g'))
             || CASE WHEN len(parts) > {LEVELS} THEN ['{{rest}}'] ELSE [] END AS segs FROM s),
t0 AS (SELECT host, segs, count(*) AS n, count(says) AS labelled, count(*) FILTER (says = 'block') AS bad, '' AS template FROM g GROUP BY host, segs),
{levels},
leaf AS (SELECT host, template, sum(labelled)::DOUBLE AS labelled, sum(bad)::DOUBLE AS bad, regexp_replace(template, '^/[^/]*', '') AS tail, string_split(template, '/') AS segments
         FROM t{LEVELS} GROUP BY host, template),
pool AS (SELECT *, sum(labelled) OVER (PARTITION BY host, tail) AS all_labelled, sum(bad) OVER (PARTITION BY host, tail) AS all_bad FROM leaf),
like_ AS (SELECT *, labelled > 0 AND coalesce(abs(bad / nullif(labelled, 0) - all_bad / nullif(all_labelled, 0))
                    <= {SIMILAR} * sqrt(all_bad / nullif(all_labelled, 0) * (1 - all_bad / nullif(all_labelled, 0)) / nullif(labelled, 0)), FALSE) AS alike FROM pool),
share AS (SELECT least(coalesce(sum(bad) / nullif(sum(labelled), 0), 0), {PRIOR}) AS share FROM leaf),
n0 AS (SELECT *, (sum(bad) OVER (PARTITION BY host) + {SMOOTH} * (SELECT share FROM share)) / (sum(labelled) OVER (PARTITION BY host) + {SMOOTH}) AS up FROM like_),
{nodes},
judged AS (SELECT host, template, CASE WHEN alike THEN '/{{similar}}' || tail ELSE template END AS branch,
             (CASE WHEN alike THEN all_bad ELSE bad END + {SMOOTH} * up) / (CASE WHEN alike THEN all_labelled ELSE labelled END + {SMOOTH}) AS purity FROM n{LEVELS - 1})
SELECT page_id, host, path, rule, coalesce(says, CASE WHEN purity >= {REJECT} AND host <> '' THEN 'block' ELSE 'allow' END) AS verdict, branch AS template, purity
FROM g JOIN t{LEVELS} USING (host, segs) JOIN judged USING (host, template)"""
