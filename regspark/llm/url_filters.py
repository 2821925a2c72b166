"""URL filters by a path-template tree; DataFrame functions only.

Every path is split into segments.  Numbers (with or without an extension) and long
hexadecimal segments become wildcards by their form; a literal segment becomes a wildcard if
its place in the tree (same host, same segments before it) has at least ``MIN_VALUES``
different values and these are at least ``VARIABLE_SHARE`` of the pages there.  Templates of a
host that differ in one literal segment are branches of one node: they are merged if at least
two of them have labelled pages and a chi-square test finds their mixes of blocked and allowed
pages alike; branches without labelled pages go with them.  Labels come from the rules.  A page
without a rule is blocked if its template, or what that was merged into, has labelled pages
whose blocked share, smoothed by the share over all labelled pages, is at least ``PURITY``;
otherwise it is allowed.

Hot hosts: everything is counted per distinct (host, path) first and summed with partial
aggregation; pages meet their verdict in an equi-join that Spark can split.

Defined cases: a null url or one without ``://`` has empty host and path, fits no rule and is
allowed; a path without a leading ``/`` is empty; repeated rows are judged alike; an empty
table gives an empty result.  Only ``page_id`` and ``url`` are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Host and path prefix, verdict; the longest fitting rule wins.
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
MIN_VALUES = 16
VARIABLE_SHARE = 0.5
SMOOTHING = 4.0
PURITY = 0.9
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"://([^/?#]*)", 1)
    return F.translate(host, UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list) -> Column:
    """struct(rule, verdict) of the longest fitting rule, else null."""
    best = []
    for r_host, r_path, verdict in sorted(rules, key=lambda r: -len(r[0] + r[1])):
        fits = ((host == r_host) | F.endswith(host, F.lit("." + r_host))) & F.startswith(path, F.lit(r_path))
        best.append(F.when(fits, F.struct(F.lit(r_host + r_path).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.coalesce(*best)


def form_wildcards(segment: Column) -> Column:
    numbers = F.regexp_replace(segment, r"^[0-9]+(\.[A-Za-z0-9]+)?\z", "*$1")
    return F.regexp_replace(numbers, r"^[0-9a-fA-F-]{16,}\z", "*")


def templates(paths: DataFrame) -> DataFrame:
    """``paths`` (one row per host and path, ``n`` pages) with its ``template``."""
    segments = F.transform(F.split(F.substring("path", 2, 1 << 30), "/", -1), form_wildcards)
    places = (paths.select("host", "path", "n", segments.alias("segments"))
              .select("host", "path", "n", "segments", F.posexplode("segments").alias("i", "segment"))
              .withColumn("above", F.array_join(F.slice("segments", F.lit(1), F.col("i")), "/")).drop("segments"))
    variable = (places.where(F.col("segment") != "*")
                .groupBy("host", "i", "above", "segment").agg(F.sum("n").alias("n"))
                .groupBy("host", "i", "above").agg(F.count("*").alias("n_values"), F.sum("n").alias("n_pages"))
                .where((F.col("n_values") >= MIN_VALUES) & (F.col("n_values") >= VARIABLE_SHARE * F.col("n_pages")))
                .select("host", "i", "above", F.lit(True).alias("variable")))
    got = places.join(variable, ["host", "i", "above"], "left")
    part = F.when(F.col("variable"), F.lit("*")).otherwise(F.col("segment"))
    whole = got.groupBy("host", "path").agg(F.array_sort(F.collect_list(F.struct("i", part.alias("part")))).alias("parts"))
    return whole.select("host", "path", F.concat(F.lit("/"), F.array_join("parts.part", "/")).alias("template"))


def merged(stats: DataFrame) -> DataFrame:
    """(host, template) -> ``branch``: the template, with one literal a wildcard if that merge
    passes the test; of several such merges the one with most pages (then the first)."""
    literal = F.split(F.substring("template", 2, 1 << 30), "/", -1)
    options = (stats.select("*", literal.alias("parts"))
               .select("*", F.posexplode("parts").alias("i", "part")).where("part <> '*'")
               .withColumn("branch", F.concat(
                   F.lit("/"), F.array_join(F.transform("parts", lambda p, k: F.when(k == F.col("i"), F.lit("*"))
                                                        .otherwise(p)), "/"))))
    kinds = ["blocked", "allowed"]
    labelled = F.col("blocked") + F.col("allowed")
    sums = options.groupBy("host", "branch", "i").agg(
        F.count(F.when(labelled > 0, 1)).alias("m"), F.sum("n").alias("n_pages"), F.sum(labelled).alias("n_labelled"),
        *[F.sum(k).alias(k) for k in kinds],
        *[F.sum(F.when(labelled > 0, F.col(k) * F.col(k) / labelled)).alias(f"{k}_sq") for k in kinds])
    # chi-square of a (labelled members x kinds) table; a kind that does not occur gives no freedom
    chi = sum((F.when(F.col(k) > 0, F.col(f"{k}_sq") * F.col("n_labelled") / F.col(k)).otherwise(F.lit(0.0)) for k in kinds),
              F.lit(0.0)) - F.col("n_labelled")
    freedom = (F.col("m") - 1) * (sum(((F.col(k) > 0).cast("int") for k in kinds), F.lit(0)) - 1)
    alike = sums.where("m > 1").where(chi <= freedom + 2 * F.sqrt(2 * freedom) + 1e-6).select("host", "branch", "i", "n_pages")
    best = W.partitionBy("host", "template").orderBy(F.desc("n_pages"), "i")
    chosen = (options.select("host", "template", "branch", "i").join(alike, ["host", "branch", "i"])
              .withColumn("r", F.row_number().over(best)).where("r = 1").select("host", "template", "branch"))
    return (stats.join(chosen, ["host", "template"], "left")
            .withColumn("branch", F.coalesce("branch", "template")))


def judge_urls(pages: DataFrame, rules: list = RULES) -> DataFrame:
    """page_id, host, path, rule and verdict of every page."""
    cut = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    ruled = cut.withColumn("fit", rule_of(F.col("host"), F.col("path"), rules))
    label = F.col("fit.verdict")
    paths = (ruled.groupBy("host", "path", label.alias("label")).agg(F.count("*").alias("n")))
    stats = (paths.join(templates(paths.where("path <> ''").select("host", "path", "n")), ["host", "path"]))
    count = lambda test: F.sum(F.when(test, F.col("n")).otherwise(0))
    by_template = stats.groupBy("host", "template").agg(
        F.sum("n").alias("n"), count(F.col("label") == "block").alias("blocked"),
        count(F.col("label") == "allow").alias("allowed"))
    tree = merged(by_template)
    share = paths.agg(F.sum(F.when(F.col("label") == "block", F.col("n")).otherwise(0)).alias("b"),
                      F.sum(F.when(F.col("label").isNotNull(), F.col("n")).otherwise(0)).alias("l")).first()
    prior = share["b"] / share["l"] if share["l"] else 0.0
    pure = (tree.groupBy("host", "branch").agg(F.sum("blocked").alias("b"), F.sum(F.col("blocked") + F.col("allowed")).alias("l"))
            .where(F.col("l") > 0).where((F.col("b") + SMOOTHING * prior) / (F.col("l") + SMOOTHING) >= PURITY).select("host", "branch"))
    blocked = (stats.where("label is null").select("host", "path", "template")
               .join(tree.select("host", "template", "branch"), ["host", "template"])
               .join(pure, ["host", "branch"], "left_semi").select("host", "path", F.lit("block").alias("by_template")))
    return (ruled.join(blocked, ["host", "path"], "left")
            .select("page_id", "host", "path", F.col("fit.rule").alias("rule"),
                    F.coalesce(label, F.col("by_template"), F.lit("allow")).alias("verdict")))


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page."""
    return judge_urls(spark.read.parquet(f"{sf_dir.rstrip('/')}/pages.parquet").select("page_id", "url"))


OP7_SQL = r"""
WITH cut AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1),
                            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM pages),
ruled AS (
  SELECT *, CASE
    WHEN ('.' || host) LIKE '%.www.example.com' AND path LIKE '/en/%' THEN 'www.example.com/en/'
    WHEN ('.' || host) LIKE '%.example.com' AND path LIKE '/en/%' THEN 'example.com/en/'
    WHEN ('.' || host) LIKE '%.net' AND path LIKE '/es/%' THEN 'net/es/'
    WHEN ('.' || host) LIKE '%.net' AND path LIKE '/fr/%' THEN 'net/fr/'
    WHEN ('.' || host) LIKE '%.com' AND path LIKE '/%' THEN 'com/' END AS rule FROM cut),
labelled AS (
  SELECT *, CASE WHEN rule IS NULL THEN NULL WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow'
                 ELSE 'block' END AS label FROM ruled),
paths AS (SELECT host, path, label, count(*) AS n FROM labelled GROUP BY ALL),
segs AS (
  SELECT host, path, n, list_transform(str_split(substr(path, 2), '/'),
    lambda s: regexp_replace(regexp_replace(s, '^[0-9]+(\.[A-Za-z0-9]+)?$', '*\1'), '^[0-9a-fA-F-]{16,}$', '*')) AS segments
  FROM paths WHERE path <> ''),
nums AS (SELECT host, path, n, segments, unnest(range(1, len(segments) + 1)) AS i FROM segs),
places AS (SELECT host, path, n, i, segments[i] AS segment,
                  array_to_string(segments[1:i - 1], '/') AS above FROM nums),
variable AS (
  SELECT host, i, above FROM (
    SELECT host, i, above, segment, sum(n) AS n FROM places WHERE segment <> '*' GROUP BY ALL)
  GROUP BY ALL HAVING count(*) >= 16 AND count(*) >= 0.5 * sum(n)),
tmpl AS (
  SELECT p.host, p.path, '/' || string_agg(CASE WHEN v.host IS NULL THEN p.segment ELSE '*' END, '/' ORDER BY p.i) AS template
  FROM places p LEFT JOIN variable v ON p.host = v.host AND p.i = v.i AND p.above = v.above GROUP BY p.host, p.path),
stats AS (SELECT p.*, t.template FROM paths p JOIN tmpl t ON p.host = t.host AND p.path = t.path),
bt AS (
  SELECT host, template, sum(n) AS n, sum(CASE WHEN label = 'block' THEN n ELSE 0 END) AS blocked,
         sum(CASE WHEN label = 'allow' THEN n ELSE 0 END) AS allowed FROM stats GROUP BY ALL),
lit AS (SELECT *, str_split(substr(template, 2), '/') AS parts FROM bt),
opt0 AS (SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM lit),
opt AS (
  SELECT *, '/' || array_to_string(list_concat(list_concat(parts[1:i - 1], ['*']), parts[i + 1:]), '/') AS branch
  FROM opt0 WHERE parts[i] <> '*'),
sums AS (
  SELECT host, branch, i, count(*) FILTER (blocked + allowed > 0) AS m, sum(n) AS n_pages, sum(blocked)::DOUBLE AS b,
         sum(allowed)::DOUBLE AS a, sum(blocked + allowed)::DOUBLE AS l,
         sum(blocked * blocked / (blocked + allowed)::DOUBLE) FILTER (blocked + allowed > 0) AS bq,
         sum(allowed * allowed / (blocked + allowed)::DOUBLE) FILTER (blocked + allowed > 0) AS aq FROM opt GROUP BY ALL),
tested AS (
  SELECT *, (CASE WHEN b > 0 THEN bq * l / b ELSE 0 END) + (CASE WHEN a > 0 THEN aq * l / a ELSE 0 END) - l AS chi,
         (m - 1) * ((b > 0)::INT + (a > 0)::INT - 1) AS freedom FROM sums WHERE m > 1),
chosen AS (
  SELECT host, template, branch FROM (
    SELECT o.host, o.template, o.branch, row_number() OVER (PARTITION BY o.host, o.template ORDER BY t.n_pages DESC, o.i) AS r
    FROM opt o JOIN tested t ON o.host = t.host AND o.branch = t.branch AND o.i = t.i
    WHERE t.chi <= t.freedom + 2 * sqrt(2 * t.freedom) + 1e-6) WHERE r = 1),
tree AS (SELECT bt.*, coalesce(c.branch, bt.template) AS branch
         FROM bt LEFT JOIN chosen c ON bt.host = c.host AND bt.template = c.template),
prior AS (SELECT coalesce(sum(CASE WHEN label = 'block' THEN n END)::DOUBLE / nullif(sum(CASE WHEN label IS NOT NULL THEN n END), 0), 0) AS p FROM paths),
pure AS (SELECT host, branch FROM tree GROUP BY ALL
         HAVING sum(blocked + allowed) > 0 AND (sum(blocked) + 4.0 * (SELECT p FROM prior)) / (sum(blocked + allowed) + 4.0) >= 0.9),
bad AS (SELECT s.host, s.path FROM stats s JOIN tree t ON s.host = t.host AND s.template = t.template
        JOIN pure p ON p.host = t.host AND p.branch = t.branch WHERE s.label IS NULL)
SELECT l.page_id, l.host, l.path, l.rule,
       CASE WHEN l.label IS NOT NULL THEN l.label WHEN b.host IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict
FROM labelled l LEFT JOIN bad b ON l.host = b.host AND l.path = b.path
"""
