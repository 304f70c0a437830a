"""URL filters by a path-template tree with labelled purity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Scratch

#: (verdict, host and path) of the fixed rules.
RULES = (
    ("block", "com/en/"),
    ("allow", "example.com/en/7"),
    ("allow", "net/de/"),
    ("block", "example.net/de/8"),
    ("block", "org/es/"),
)
DEPTH, WIDE, PRIOR, CUT, Z = 3, 16, 4.0, 0.5, 1.96
LEVELS = [f"t{k}" for k in range(1, DEPTH + 1)]


def parts(urls: DataFrame, url_col: str) -> DataFrame:
    """Adds host and path: host after the first ://, path from there up to ? or #; both empty without ://."""
    u = F.col(url_col)
    rest = F.when(F.instr(u, "://") > 0, F.expr(f"substring(`{url_col}`, instr(`{url_col}`, '://') + 3)")).otherwise("")
    rest = F.regexp_extract(rest, r"(?s)^([^?#]*)", 1)
    host = F.regexp_extract(rest, r"(?s)^([^/]*)", 1)
    ascii_lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return urls.withColumn("host", ascii_lower).withColumn("path", F.substr(rest, F.length(host) + 1))


def rule_of(rules) -> F.Column:
    """The longest rule that fits, a struct of rule and verdict; null if none fits."""
    fits = [F.when(_fits(r), F.struct(F.lit(len(r)).alias("n"), F.lit(r).alias("rule"), F.lit(v).alias("verdict"))) for v, r in rules]
    return F.array_max(F.array(*fits)) if fits else F.lit(None).cast("struct<n:int,rule:string,verdict:string>")


def _fits(rule: str) -> F.Column:
    host, path = rule[: rule.index("/")], rule[rule.index("/") :]
    return ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)


def _shapes(path: F.Column) -> F.Column:
    """The path's segments with runs of digits as N."""
    return F.filter(F.split(F.regexp_replace(path, "[0-9]+", "N"), "/"), lambda s: s != "")


def _alike() -> F.Column:
    """Whether a node's labelled rate (b of l) does not differ from that of it and its siblings (ba of la) by Z standard errors."""
    rate = F.col("ba") / F.col("la")
    near = F.abs(F.col("b") / F.col("l") - rate) <= Z * F.sqrt(rate * (1 - rate) / F.col("l"))
    return F.when((F.col("l") == 0) | (F.col("la") == 0), True).otherwise(near)


def templates(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """(host, shapes, labelled, bad) -> the same with template, the generalised one of each, and its purity.

    Top down, a node with more than WIDE children merges the variable ones into one wildcard: those with fewer labels than the prior's
    PRIOR pages, and those whose labelled rate does not differ from that of all siblings by Z standard errors. Labelled children that
    differ stay. Bottom up, all siblings that do not differ merge. Levels go on until no two paths share a longer one. Below DEPTH levels
    a run of segments that all paths of a node share is one level, so levels follow branchings and not the length of paths. The purity is
    the rate of bad labels, smoothed by PRIOR pages at the global rate. Each level is written, so the next one does not compute it
    twice. A template has DEPTH levels at least; of the deeper ones, closing wildcards are left out.
    """
    tree, g = scratch.keep(pages.withColumn("rest", F.col("shapes")), "shapes"), []
    while True:
        above, own = ["host", *g], f"g{len(g) + 1}"
        g.append(own)
        if len(g) > DEPTH:
            # what the first and the last path in order share, all share
            ends = tree.groupBy(*above).agg(F.min("rest").alias("lo"), F.max("rest").alias("hi"))
            parted = F.array_position(F.zip_with("lo", "hi", lambda a, b: a.eqNullSafe(b)), False)
            run = F.when(parted > 0, parted - 1).otherwise(F.size("lo")).cast("int")
            tree = tree.join(ends.select(*above, F.greatest(run, F.lit(1)).alias("run")), above)
        else:
            tree = tree.withColumn("run", F.lit(1))
        tree = tree.withColumn(own, F.array_join(F.slice("rest", F.lit(1), F.col("run")), "/")).withColumn("rest", F.slice("rest", F.col("run") + 1, F.greatest(F.size("rest"), F.lit(1)))).drop("run")
        node = tree.groupBy(*above, own).agg(F.sum("labelled").alias("l"), F.sum("bad").alias("b"))
        whole = node.groupBy(*above).agg(F.count("*").alias("width"), F.sum("l").alias("la"), F.sum("b").alias("ba")).where(F.col("width") > WIDE)
        wild = node.join(whole, above).where((F.col("l") < PRIOR) | _alike()).select(*above, own, F.lit("*").alias("m"))
        tree = scratch.keep(tree.join(wild, [*above, own], "left").withColumn(own, F.coalesce("m", own)).drop("m"), f"wide-{len(g)}")
        # paths of one template so far go on only if one of them has more segments; a path alone has no siblings below
        shared = tree.groupBy("host", *g).agg(F.count("*").alias("paths"), F.max(F.size("rest")).alias("longest"))
        if len(g) >= DEPTH and shared.where((F.col("paths") > 1) & (F.col("longest") > 0)).isEmpty():
            break
    for k in range(len(g), 0, -1):
        above = ["host", *g[: k - 1]]
        node = tree.groupBy(*above, f"g{k}").agg(F.sum("labelled").alias("l"), F.sum("bad").alias("b"))
        whole = node.groupBy(*above).agg(F.sum("l").alias("la"), F.sum("b").alias("ba"))
        merged = node.join(whole, above).select(*above, f"g{k}", F.when(_alike(), "*").otherwise(F.col(f"g{k}")).alias("m"))
        tree = tree.join(merged, [*above, f"g{k}"]).withColumn(f"g{k}", F.col("m")).drop("m")
        tree = scratch.keep(tree, f"merged-{k}")
    groups = ["host", *g]
    base = tree.agg((F.sum("bad") / F.greatest(F.sum("labelled"), F.lit(1))).alias("base"))
    purity = tree.groupBy(*groups).agg(F.sum("labelled").alias("l"), F.sum("bad").alias("b")).join(F.broadcast(base))  # one row
    purity = purity.select(*groups, ((F.col("b") + PRIOR * F.coalesce("base", F.lit(0.0))) / (F.col("l") + PRIOR)).alias("purity"))
    deeper = [F.regexp_replace(F.concat(*[F.concat(F.lit("/"), x) for x in g[DEPTH:]]), r"(/\*)+$", "")] if len(g) > DEPTH else []
    return tree.join(purity, groups).withColumn("template", F.concat(F.concat_ws("/", "host", *g[:DEPTH]), *deeper))


def filter_urls(pages: DataFrame, labels: DataFrame, *, id_col: str = "page_id", url_col: str = "url", rules=RULES) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, template, purity.

    The longest fitting rule decides; else the page's template: block where the smoothed rate of bad labels (quality 0 or toxic 1
    of the document with the page's id) reaches CUT. Pages are aggregated to (host, shapes of the path) before the tree is built, so a
    host with a third of all pages is a few rows there. Built-in functions only.

    A null url, or one without ://, has an empty host and path. Repeated pages count each. Labels that repeat for an id count once,
    bad if one of them is bad. A null id has no label. Without labels every purity is 0. Other columns are ignored.
    """
    p = parts(pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url")), "url").drop("url")
    p = p.withColumn("shapes", _shapes(F.col("path")))
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("page_id")).agg(F.max(F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0)).alias("is_bad"))
    counted = p.join(marks, "page_id", "left").groupBy("host", "shapes").agg(F.count("is_bad").alias("labelled"), F.coalesce(F.sum("is_bad"), F.lit(0)).alias("bad"))
    tree = templates(counted, Scratch(pages.sparkSession, "urls")).select("host", "shapes", "template", "purity")
    out = p.join(tree, ["host", "shapes"]).withColumn("r", rule_of(rules))
    return out.select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.coalesce("r.verdict", F.when(F.col("purity") >= CUT, "block").otherwise("allow")).alias("verdict"), "template", "purity")


def oracle() -> str:
    """The same rows for DuckDB, where no node has more than WIDE children and no path more than DEPTH segments."""
    cases = sorted(RULES, key=lambda r: -len(r[1]))
    fit = lambda r: f"((host = '{r[: r.index('/')]}' or ends_with(host, '.{r[: r.index('/')]}')) and starts_with(path, '{r[r.index('/') :]}'))"
    g = [f"g{k}" for k in range(1, DEPTH + 1)]
    ts = ", ".join(LEVELS)
    sql = f"""
with cut as (select page_id, case when instr(url, '://') > 0 then regexp_extract(substr(url, instr(url, '://') + 3), '(?s)^([^?#]*)', 1) else '' end as rest from pages),
hosted as (select page_id, rest, regexp_extract(rest, '(?s)^([^/]*)', 1) as h from cut),
p0 as (select page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, substr(rest, length(h) + 1) as path from hosted),
p1 as (select *, list_filter(string_split(regexp_replace(path, '[0-9]+', 'N', 'g'), '/'), lambda s: s <> '') as shapes from p0),
p as (select page_id, host, path, {", ".join(f"coalesce(shapes[{k}], '') as t{k}" for k in range(1, DEPTH))}, coalesce(array_to_string(shapes[{DEPTH}:], '/'), '') as t{DEPTH} from p1),
marks as (select doc_id, max(case when quality = 0 or toxic = 1 then 1 else 0 end) as is_bad from labels group by 1),
tree0 as (select host, {ts}, {", ".join(f"{t} as {x}" for t, x in zip(LEVELS, g, strict=True))}, count(is_bad) as labelled, coalesce(sum(is_bad), 0) as bad from p left join marks on doc_id = page_id group by host, {ts})"""
    n = 0
    for k in range(1, DEPTH + 1):
        above = ", ".join(["host", *g[: k - 1]])
        sql += f",\ntree{n + 1} as (select t.* replace (case when width > {WIDE} then '*' else g{k} end as g{k}) from (select t.*, w.width from tree{n} t join (select {above}, count(distinct g{k}) as width from tree{n} group by {above}) w using ({above})) t)".replace("select t.* replace", "select * exclude (width) replace")
        n += 1
    for k in range(DEPTH, 0, -1):
        above = ", ".join(["host", *g[: k - 1]])
        sql += f""",
node{k} as (select {above}, g{k}, sum(labelled) as l, sum(bad) as b from tree{n} group by {above}, g{k}),
whole{k} as (select {above}, sum(l) as la, sum(b) as ba from node{k} group by {above}),
merged{k} as (select {above}, g{k}, case when l = 0 or la = 0 then '*' when abs(b / l - ba / la) <= {Z} * sqrt((ba / la) * (1 - ba / la) / l) then '*' else g{k} end as m from node{k} join whole{k} using ({above})),
tree{n + 1} as (select * exclude (m) replace (m as g{k}) from tree{n} join merged{k} using ({above}, g{k}))"""
        n += 1
    gs = ", ".join(["host", *g])
    return (
        sql
        + f""",
base as (select sum(bad) / greatest(sum(labelled), 1) as base from tree{n}),
pure as (select {gs}, (sum(bad) + {PRIOR}::double * coalesce((select base from base), 0)) / (sum(labelled) + {PRIOR}::double) as purity from tree{n} group by {gs})
select page_id, host, path, case {" ".join(f"when {fit(r)} then '{r}'" for _, r in cases)} end as rule,
  case {" ".join(f"when {fit(r)} then '{v}'" for v, r in cases)} when purity >= {CUT} then 'block' else 'allow' end as verdict,
  host || '/' || {" || '/' || ".join(g)} as template, purity
from p join tree{n} using (host, {ts}) join pure using ({gs})"""
    )
