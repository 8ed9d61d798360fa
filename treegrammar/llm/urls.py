"""URL filters: an explicit rule list, and a path-template tree that judges the rest, with DataFrame functions only.

Urls are first reduced to shapes (host and path with every run of digits masked) and counted.  Each host's tree is built from the host
down, a level of path segments at a time.  Under a node a segment is

- variable, if it holds digits, or occurs once where segments are mostly different ones (at least SPREAD_LEAST, and half as many as the
  node's urls): it becomes a wildcard (with its file ending).  The lone word of a small host is thus a word, as it is on a large one;
- rare, if it holds less than KEEP_SHARE of the node's urls: it becomes one of three wildcards, of segments without labels, with mostly
  blocking and with mostly allowing labels, so that a rare branch is not judged by others' labels;
- kept otherwise.  The end of a path is a segment of its own.

Then sibling branches are compared and similar ones merge into one node: in the order of their block rates, neighbours merge unless
a test of two proportions (Z standard errors) tells their block rates, or their shares of labelled urls or of urls that end there, apart; branches with and
without labels never merge.  The next level hangs below the merged nodes.  Urls that a rule judges are the labelled ones.  From the
host down a node's block rate is smoothed towards its parent's.  A template is rejected if its last node holds labels and its smoothed
purity reaches the threshold; a branch without labels is allowed.

A path has LEVELS levels; what is deeper counts as one segment.  Between levels the shapes stand in a written table.  Joins on a node, which a busy
host can fill, are salted; the siblings of a node are few (1 / KEEP_SHARE, and wildcards by file ending).

Defined results: a null url, or one without ``://``, has an empty host and path, fits no rule and is judged
under the empty host (allowed, as nothing there is labelled); repeated rows are judged each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from treegrammar.llm.common import ascii_lower, cut, forget, read

#: (verdict, host, path), longest match wins.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
KEEP_SHARE, LEVELS = 0.02, 5
SPREAD_LEAST, SPREAD_SHARE = 8, 0.5  # different segments of a node, and their share of its urls, from which lone ones are variable
#: Block rate and weight of what stands above a host, standard errors within which branches are alike, purity of a rejected template.
PRIOR, STRENGTH, Z, THRESHOLD = 0.2, 4.0, 2.0, 0.6
SALTS = 32
#: Expressions that Spark and DuckDB read alike, over a segment's n (urls), all_n and kinds (urls and segments of its node), m (labels), b (blocking ones), seg and ending.
_NAME = f"""CASE WHEN seg = '$' THEN 's$' WHEN instr(seg, '#') > 0 OR n = 1 AND kinds >= {SPREAD_LEAST} AND kinds >= {SPREAD_SHARE} * all_n THEN concat('v', ending)
  WHEN n < {KEEP_SHARE} * all_n THEN concat(CASE WHEN m = 0 THEN 'r' WHEN 2 * b >= m THEN 'b' ELSE 'a' END, ending) ELSE concat('s', seg) END"""
_SHOWN = "CASE WHEN name = 's$' THEN '' WHEN substr(name, 1, 1) = 's' THEN substr(name, 2) ELSE concat('*', substr(name, 2)) END"


def _apart(x: str, n: str) -> str:
    """Do the proportions x / n of a branch and its neighbour (p_x of p_n) differ?"""
    r = f"((p_{x} + {x}) * 1.0e0 / (p_{n} + {n}))"
    d = f"({x} * 1.0e0 / {n} - p_{x} * 1.0e0 / p_{n})"
    return f"{d} * {d} > {Z * Z} * {r} * (1.0e0 - {r}) * (1.0e0 / {n} + 1.0e0 / p_{n})"


_NEW = f"CASE WHEN p_n IS NULL OR (m = 0) <> (p_m = 0) THEN 1 WHEN m > 0 AND {_apart('b', 'm')} THEN 1 WHEN {_apart('m', 'n')} THEN 1 WHEN {_apart('leaves', 'n')} THEN 1 ELSE 0 END"
_PURITY = f"CASE WHEN m = 0 THEN purity ELSE (b + {STRENGTH}e0 * purity) / (m + {STRENGTH}e0) END"


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, its verdict) of the longest rule that fits, nulls if none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, kind).otherwise(verdict)
    return name, verdict


def judged(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES) -> DataFrame:
    """(page_id, host, path, shape, rule, rule_verdict) of every row."""
    url = F.col(url_col).cast("string")
    rows = pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return rows.withColumns({"shape": F.regexp_replace("path", "[0-9]+", "#"), "rule": name, "rule_verdict": verdict})


def salted(big: DataFrame, small: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """Their join on keys; rows of big with one key are dealt by the columns by. Both sides grow with the input: neither is broadcast."""
    big = big.withColumn("salt", F.pmod(F.xxhash64(*by), F.lit(SALTS)))
    small = small.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return big.join(small.hint("merge"), [*keys, "salt"]).drop("salt")


def grown(at: DataFrame, level: int) -> DataFrame:
    """The shapes a level further down: (host, shape, segs, n, m, b, node, purity, own: labels of the node, shown)."""
    last = F.array_join(F.slice("segs", level + 1, 1 << 30), "/") if level == LEVELS - 1 else F.col("segs")[level]
    done, open_ = at.where(F.size("segs") <= level), at.where(F.size("segs") > level).withColumn("seg", last)
    leaf = F.when(F.size("segs") <= level + 2, F.col("n")).otherwise(0)
    child = open_.groupBy("node", "seg").agg(F.sum("n").alias("n"), F.sum("m").alias("m"), F.sum("b").alias("b"), F.sum(leaf).alias("leaves"), F.max("purity").alias("purity"))
    child = salted(child, child.groupBy("node").agg(F.sum("n").alias("all_n"), F.count("*").alias("kinds")), ["node"], ["seg"])
    child = child.withColumn("ending", F.regexp_extract("seg", "[.][A-Za-z#]{1,5}$", 0)).withColumn("name", F.expr(_NAME))
    sib = child.groupBy("node", "name").agg(*(F.sum(c).alias(c) for c in ("n", "m", "b", "leaves")), F.max("purity").alias("purity"))
    order = Window.partitionBy("node").orderBy(F.expr("CASE WHEN m = 0 THEN 1 ELSE 0 END"), F.expr("CASE WHEN m = 0 THEN 0.0e0 ELSE b * 1.0e0 / m END"), F.expr("m * 1.0e0 / n"), F.expr("leaves * 1.0e0 / n"), "name")
    sib = sib.withColumns({f"p_{c}": F.lag(c).over(order) for c in ("n", "m", "b", "leaves")}).withColumn("branch", F.sum(F.expr(_NEW)).over(order))
    one = sib.groupBy("node", "branch").agg(F.sum("m").alias("m"), F.sum("b").alias("b"), F.max("purity").alias("purity"), F.array_join(F.array_sort(F.collect_list("name")), "|").alias("names"), F.array_join(F.array_sort(F.collect_set(F.expr(_SHOWN))), "|").alias("part"))
    one = one.select("node", "branch", F.md5(F.concat("node", F.lit("/"), "names")).alias("below"), F.expr(_PURITY).alias("p"), F.col("m").alias("labels"), "part")
    branches = sib.select("node", "name", "branch").join(one, ["node", "branch"]).drop("branch")
    way = salted(child.select("node", "seg", "name"), branches, ["node", "name"], ["seg"])
    moved = open_.join(way, ["node", "seg"]).select("host", "shape", "segs", "n", "m", "b", F.col("below").alias("node"), F.col("p").alias("purity"), F.col("labels").alias("own"), F.concat("shown", F.lit("/"), "part").alias("shown"))
    return done.select(moved.columns).union(moved)


def verdicts(rows: DataFrame) -> DataFrame:
    """(host, shape, template, purity, blocked): the tree's verdict on every shape of rows (host, shape, rule_verdict)."""
    spark = rows.sparkSession
    one = rows.groupBy("host", "shape").agg(F.count("*").alias("n"), F.count("rule_verdict").alias("m"), F.count_if(F.col("rule_verdict") == "block").alias("b"))
    segs = F.expr("concat(filter(split(shape, '/'), s -> s <> ''), array('$'))")
    at = cut(spark, one.select("host", "shape", segs.alias("segs"), "n", "m", "b", F.md5(F.concat(F.lit("host "), "host")).alias("node"), F.lit(PRIOR).alias("purity"), F.lit(0).cast("long").alias("own"), F.lit("").alias("shown")), "shapes")
    # the host itself is the first node
    host = at.groupBy("node").agg(F.sum("m").alias("m"), F.sum("b").alias("b")).select("node", F.expr(_PURITY.replace("purity", f"{PRIOR}e0")).alias("p"))
    rooted = cut(spark, salted(at.drop("purity"), host, ["node"], ["shape"]).withColumnRenamed("p", "purity").select(at.columns), "shapes")
    forget(at)
    at = rooted
    for level in range(min(LEVELS, at.agg(F.coalesce(F.max(F.size("segs")), F.lit(0))).first()[0])):
        below = cut(spark, grown(at, level), "shapes")
        forget(at)
        at = below
    return at.select("host", "shape", F.col("shown").alias("template"), "purity", ((F.col("own") > 0) & (F.col("purity") >= THRESHOLD)).alias("blocked"))


def filter_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, template, purity) of every row."""
    rows = judged(pages, id_col, url_col, rules)
    rows = salted(rows, verdicts(rows), ["host", "shape"], ["page_id", "path"])
    verdict = F.coalesce("rule_verdict", F.when(F.col("blocked"), "block").otherwise("allow"))
    return rows.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "template", "purity")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(read(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict", "template")


_RULE = "CASE " + " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN {{{k}}}" for k, (_, h, p) in enumerate(sorted(RULES, key=lambda r: -len(r[1] + r[2])))) + " END"
_BY_LENGTH = sorted(RULES, key=lambda r: -len(r[1] + r[2]))


def _level(k: int) -> str:
    """CTEs of one level of the tree, from at{k} to at{k + 1}."""
    seg = "array_to_string(segs[%d:], '/')" % (k + 1) if k == LEVELS - 1 else f"segs[{k + 1}]"
    return f"""
open{k} AS MATERIALIZED (SELECT *, {seg} AS seg FROM at{k} WHERE len(segs) > {k}),
child{k} AS MATERIALIZED (
  SELECT *, {_NAME} AS name FROM (
    SELECT node, seg, sum(n)::BIGINT AS n, sum(m)::BIGINT AS m, sum(b)::BIGINT AS b, sum(CASE WHEN len(segs) <= {k + 2} THEN n ELSE 0 END)::BIGINT AS leaves, max(purity) AS purity,
           regexp_extract(seg, '[.][A-Za-z#]{{1,5}}$', 0) AS ending FROM open{k} GROUP BY node, seg)
  JOIN (SELECT node, sum(n)::BIGINT AS all_n, count(DISTINCT seg) AS kinds FROM open{k} GROUP BY node) USING (node)),
sib{k} AS MATERIALIZED (
  SELECT *, sum({_NEW}) OVER (PARTITION BY node ORDER BY unlabelled, rate, known, leaf_rate, name ROWS UNBOUNDED PRECEDING) AS branch FROM (
    SELECT *, lag(n) OVER w AS p_n, lag(m) OVER w AS p_m, lag(b) OVER w AS p_b, lag(leaves) OVER w AS p_leaves FROM (
      SELECT *, CASE WHEN m = 0 THEN 1 ELSE 0 END AS unlabelled, CASE WHEN m = 0 THEN 0.0e0 ELSE b * 1.0e0 / m END AS rate, m * 1.0e0 / n AS known, leaves * 1.0e0 / n AS leaf_rate FROM (
        SELECT node, name, sum(n)::BIGINT AS n, sum(m)::BIGINT AS m, sum(b)::BIGINT AS b, sum(leaves)::BIGINT AS leaves, max(purity) AS purity FROM child{k} GROUP BY node, name))
    WINDOW w AS (PARTITION BY node ORDER BY unlabelled, rate, known, leaf_rate, name))),
one{k} AS MATERIALIZED (
  SELECT node, branch, md5(node || '/' || names) AS below, {_PURITY} AS p, m AS labels, part FROM (
    SELECT node, branch, sum(m)::BIGINT AS m, sum(b)::BIGINT AS b, max(purity) AS purity, string_agg(name, '|' ORDER BY name) AS names, array_to_string(list_sort(list_distinct(list({_SHOWN}))), '|') AS part
    FROM sib{k} GROUP BY node, branch)),
at{k + 1} AS MATERIALIZED (
  SELECT host, shape, segs, n, m, b, below AS node, p AS purity, labels AS own, shown || '/' || part AS shown
  FROM open{k} JOIN child{k} AS c USING (node, seg) JOIN sib{k} AS s USING (node, name) JOIN one{k} USING (node, branch)
  UNION ALL SELECT host, shape, segs, n, m, b, node, purity, own, shown FROM at{k} WHERE len(segs) <= {k})""".replace("SELECT host, shape, segs, n, m, b, below", f"SELECT open{k}.host, open{k}.shape, open{k}.segs, open{k}.n, open{k}.m, open{k}.b, below")


ORACLE = f"""
WITH rows AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
ruled AS MATERIALIZED (
  SELECT *, regexp_replace(path, '[0-9]+', '#', 'g') AS shape,
         {_RULE.format(*(f"'{h}{p}'" for _, h, p in _BY_LENGTH))} AS rule,
         {_RULE.format(*(f"'{k}'" for k, _, _ in _BY_LENGTH))} AS rule_verdict
  FROM rows),
shapes AS (
  SELECT host, shape, count(*) AS n, count(rule_verdict) AS m, count(*) FILTER (rule_verdict = 'block') AS b,
         list_append(list_filter(string_split(shape, '/'), lambda s: s <> ''), '$') AS segs, md5('host ' || host) AS node
  FROM ruled GROUP BY host, shape),
at0 AS MATERIALIZED (
  SELECT s.host, s.shape, s.segs, s.n, s.m, s.b, s.node, h.p AS purity, 0::BIGINT AS own, '' AS shown
  FROM shapes s JOIN (SELECT host, {_PURITY.replace("purity", f"{PRIOR}e0")} AS p FROM (SELECT host, sum(m)::BIGINT AS m, sum(b)::BIGINT AS b FROM shapes GROUP BY host)) h ON h.host = s.host),
{",".join(map(_level, range(LEVELS)))}
SELECT page_id, r.host, r.path, r.rule, coalesce(r.rule_verdict, CASE WHEN t.own > 0 AND t.purity >= {THRESHOLD} THEN 'block' ELSE 'allow' END) AS verdict, t.shown AS template
FROM ruled r JOIN at{LEVELS} t ON t.host = r.host AND t.shape = r.shape
"""
