"""URL filters: a tree of path templates for each host.

Segments that are numbers, dates, hexadecimal or otherwise mixed with digits become typed wildcards at
once. Then, level by level from the root, a place's remaining branches become the wildcard ``*`` if they
are many and none is large, and branches that are statistically similar, by a two-proportion test of
their labelled shares against their siblings, become the group ``~``. Each leaf is a template; it is rejected
if its labelled purity, smoothed towards the host's and the whole table's share, reaches ``REJECT``.

Labels are the verdicts of explicit rules (host suffix and path prefix, the longest wins); urls without
a rule get the verdict of their template. All steps are aggregates over templates, so a host with a
third of all rows is one group of partial sums, never one task's rows.

Null urls and urls without ``://`` have an empty host and path. Repeated pages count as often as they are
there. Empty tables give no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.llm.common import Scratch

MANY, LARGE = 12, 0.2  # branches of a place that make a wildcard: more than MANY, none with a LARGE share
SIMILAR = 1.96  # standard errors
WEIGHT, REJECT = 4.0, 0.8

# Fixed values: (verdict, host, path) of the explicit rules.
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)


def host_of(url: Column) -> Column:
    host = F.regexp_extract(url, r"^(?s).*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s).*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as a struct (rule, verdict), or null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, name, start in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r[1], r[2])):
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(start))
        out = F.when(fits, F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def shapes(path: Column) -> Column:
    """The path's segments, variable ones as typed wildcards."""
    parts = F.filter(F.split(path, "/"), lambda s: s != "")

    def shape(s: Column) -> Column:
        stem, ending = F.regexp_extract(s, r"^(.*?)(\.[A-Za-z]{1,5})?$", 1), F.regexp_extract(s, r"(\.[A-Za-z]{1,5})$", 1)
        kind = (
            F.when(stem.rlike(r"^\d{4}-\d{1,2}(-\d{1,2})?$"), F.lit("<date>"))
            .when(stem.rlike(r"^\d+$"), F.lit("<number>"))
            .when(stem.rlike(r"^[0-9a-fA-F-]{8,}$"), F.lit("<hex>"))
            .when(stem.rlike(r"\d"), F.lit("<mixed>"))
            .otherwise(stem)
        )
        return F.concat(kind, ending)

    return F.transform(parts, shape)


def generalise(counts: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows (host, segs, n, known, bad) with ``template``: the segments after generalising and merging.

    Levels go on as long as paths that share a place have further segments. Paths that have ended are in no later place, and
    a path alone at its place keeps its own segments, so both are done. Each level's tree is written, so that the next
    level's aggregates and joins read it instead of its history.
    """
    tree = scratch.write(counts.withColumn("template", F.array().cast("array<string>")))
    done, level, columns = [], 0, ["host", "segs", "n", "known", "bad", "template"]
    while True:
        level += 1
        alone = tree.groupBy("host", "template").agg((F.count("*") == 1).alias("alone"))
        tree = tree.join(alone, ["host", "template"])
        ended = F.col("alone") | (F.size("segs") < level - 1)
        rest = F.slice("segs", level, F.greatest(F.size("segs") - level + 1, F.lit(0)))
        done.append(tree.where(ended).withColumn("template", F.concat("template", rest)).select(*columns))
        tree = tree.where(~ended).select(*columns)
        if not tree.agg(F.max(F.size("segs") >= level)).first()[0]:  # the rest ends here
            return reduce(DataFrame.unionByName, [*done, tree])
        seg = F.coalesce(F.get("segs", F.lit(level - 1)), F.lit(""))
        tree = tree.withColumn("seg", seg)
        place = ["host", "template"]
        branch = tree.groupBy(*place, "seg").agg(F.sum("n").alias("n"), F.sum("known").alias("known"), F.sum("bad").alias("bad"))
        whole = branch.groupBy(*place).agg(
            F.count_if(F.col("seg") != "").alias("branches"),
            F.max(F.when(F.col("seg") != "", F.col("n"))).alias("largest"),
            F.sum("n").alias("all_n"),
            F.sum("known").alias("all_known"),
            F.sum("bad").alias("all_bad"),
        )
        share = F.col("all_bad") / F.col("all_known")
        error = F.sqrt(share * (1 - share) / F.col("known"))
        literal = (F.col("seg") != "") & ~F.col("seg").rlike("^<")
        similar = (F.col("known") > 0) & (F.abs(F.col("bad") / F.col("known") - share) <= SIMILAR * error + 1e-12)
        name = (
            F.when(literal & (F.col("branches") > MANY) & (F.col("largest") < LARGE * F.col("all_n")), "*")
            .when(literal & similar & (F.col("branches") > 1), "~")
            .otherwise(F.col("seg"))
        )
        named = branch.join(whole, place).select(*place, "seg", name.alias("name"))
        tree = tree.join(named, [*place, "seg"]).withColumn(
            "template", F.when(F.col("name") == "", F.col("template")).otherwise(F.array_append("template", F.col("name")))
        )
        tree = scratch.write(tree.select(*columns))


def url_verdicts(pages: DataFrame, rules=RULES) -> DataFrame:
    """A row for each page: (page_id, host, path, rule, verdict, template, purity)."""
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    base = pages.select("page_id", host.alias("host"), path.alias("path"))
    base = base.withColumn("fit", rule_of(F.col("host"), F.col("path"), rules)).withColumn("segs", shapes(F.col("path")))
    known, bad = F.col("fit").isNotNull(), F.col("fit.verdict") == "block"
    counts = base.groupBy("host", "segs").agg(F.count("*").alias("n"), F.count_if(known).alias("known"), F.count_if(known & bad).alias("bad"))
    scratch = Scratch(pages.sparkSession, "urls")
    tree = generalise(counts, scratch)
    leaf = tree.groupBy("host", "template").agg(F.sum("known").alias("known"), F.sum("bad").alias("bad"))
    own = leaf.groupBy("host").agg(F.sum("known").alias("host_known"), F.sum("bad").alias("host_bad"))
    total = own.agg(F.sum("host_known").alias("all_known"), F.sum("host_bad").alias("all_bad"))
    prior = (F.col("all_bad") + 1) / (F.col("all_known") + 2)
    towards = (F.col("host_bad") + WEIGHT * prior) / (F.col("host_known") + WEIGHT)
    purity = (F.col("bad") + WEIGHT * towards) / (F.col("known") + WEIGHT)
    # the total is a single row
    leaf = leaf.join(own, "host").crossJoin(F.broadcast(total)).select("host", "template", purity.alias("purity"))
    # written, so that where it is too large to be broadcast the join below can split a host's commonest shape
    found = scratch.write(tree.select("host", "segs", "template").join(leaf, ["host", "template"]))
    return base.join(found, ["host", "segs"]).select(
        "page_id",
        "host",
        "path",
        F.col("fit.rule").alias("rule"),
        F.coalesce(F.col("fit.verdict"), F.when(F.col("purity") >= REJECT, "block").otherwise("allow")).alias("verdict"),
        F.concat(F.lit("/"), F.array_join("template", "/")).alias("template"),
        "purity",
    )


def op8_url_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = url_verdicts(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return found.select("page_id", "host", "path", "rule", "verdict", "template", F.round("purity", 6).alias("purity"))


ORACLE_OP8 = r"""WITH RECURSIVE u AS (SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
rules(v, h, p) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
f AS (SELECT *, (SELECT max_by({'rule': h || p, 'verdict': v}, length(h || p)) FROM rules WHERE (host = h OR suffix(host, '.' || h)) AND starts_with(path, p)) AS fit FROM u),
parts AS (SELECT *, list_transform(list_filter(string_split(path, '/'), lambda x: x <> ''),
  lambda x: {'stem': regexp_extract(x, '^(.*?)(\.[A-Za-z]{1,5})?$', 1), 'ending': regexp_extract(x, '(\.[A-Za-z]{1,5})$', 1)}) AS cut FROM f),
base AS (SELECT page_id, host, path, fit, list_transform(cut, lambda x: CASE WHEN regexp_matches(x.stem, '^\d{4}-\d{1,2}(-\d{1,2})?$') THEN '<date>' WHEN regexp_matches(x.stem, '^\d+$') THEN '<number>'
  WHEN regexp_matches(x.stem, '^[0-9a-fA-F-]{8,}$') THEN '<hex>' WHEN regexp_matches(x.stem, '\d') THEN '<mixed>' ELSE x.stem END || x.ending) AS segs FROM parts),
counts AS (SELECT host, segs, count(*) AS n, count(fit.verdict) AS known, count(*) FILTER (WHERE fit.verdict = 'block') AS bad FROM base GROUP BY ALL),
tree(host, segs, n, known, bad, template, level, ended) AS (
  SELECT host, segs, n, known, bad, []::VARCHAR[], 1, false FROM counts
  UNION ALL
  SELECT host, segs, n, known, bad, CASE WHEN ends THEN list_concat(template, segs[level:]) WHEN name = '' THEN template ELSE list_append(template, name) END, level + 1, ends FROM (
    SELECT *, CASE WHEN literal AND branches > 12 AND largest < 0.2::DOUBLE * all_n THEN '*' WHEN literal AND branches > 1 AND alike THEN '~' ELSE seg END AS name FROM (
      SELECT *, seg <> '' AND NOT starts_with(seg, '<') AS literal, max(CASE WHEN seg <> '' THEN own_n END) OVER (PARTITION BY host, template, ends) AS largest,
        CASE WHEN own_known > 0 THEN abs(own_bad / own_known - all_bad / all_known) <= 1.96::DOUBLE * sqrt(all_bad / all_known * (1 - all_bad / all_known) / own_known) + 1e-12 ELSE false END AS alike FROM (
        SELECT *, count(DISTINCT nullif(seg, '')) OVER (PARTITION BY host, template, ends) AS branches, sum(n) OVER (PARTITION BY host, template, ends) AS all_n,
          sum(known) OVER (PARTITION BY host, template, ends) AS all_known, sum(bad) OVER (PARTITION BY host, template, ends) AS all_bad, sum(n) OVER (PARTITION BY host, template, ends, seg) AS own_n,
          sum(known) OVER (PARTITION BY host, template, ends, seg) AS own_known, sum(bad) OVER (PARTITION BY host, template, ends, seg) AS own_bad FROM (
          SELECT *, coalesce(segs[level], '') AS seg, count(*) OVER (PARTITION BY host, template) = 1 OR len(segs) < level - 1 AS ends FROM tree WHERE NOT ended))))),
done AS (SELECT * FROM tree WHERE ended),
leaf AS (SELECT host, template, sum(known) AS known, sum(bad) AS bad FROM done GROUP BY ALL),
own AS (SELECT host, sum(known) AS known, sum(bad) AS bad FROM leaf GROUP BY ALL),
prior AS (SELECT (sum(bad) + 1) / (sum(known) + 2) AS share FROM own),
scored AS (SELECT leaf.host, leaf.template, (leaf.bad + 4::DOUBLE * ((own.bad + 4::DOUBLE * prior.share) / (own.known + 4::DOUBLE))) / (leaf.known + 4::DOUBLE) AS purity FROM leaf JOIN own USING (host), prior)
SELECT page_id, base.host, path, fit.rule AS rule, coalesce(fit.verdict, CASE WHEN purity >= 0.8::DOUBLE THEN 'block' ELSE 'allow' END) AS verdict,
  '/' || coalesce(array_to_string(done.template, '/'), '') AS template, round(purity, 6) AS purity
FROM base JOIN done ON base.host = done.host AND base.segs = done.segs JOIN scored ON scored.host = done.host AND scored.template = done.template"""
