"""Line dedup by distinct-site spread: lines that many sites share are boilerplate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Scratch, free_name

MIN_SITES = 8
LG_K = 12
#: A line that makes up more than one in FREQUENT of all rows is joined by broadcast; there are fewer than FREQUENT of those.
FREQUENT = 2000


def _with_lines(rows: DataFrame, lines: DataFrame, frequent: DataFrame) -> DataFrame:
    """`rows` joined with `lines`, one row per h: no rows of a frequent line are shuffled to a single task."""
    frequent = F.broadcast(frequent)
    few = rows.join(F.broadcast(lines.join(frequent, "h", "left_semi")), "h")
    return few.unionByName(rows.join(frequent, "h", "left_anti").join(lines.join(frequent, "h", "left_anti"), "h"))


def drop_site_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """`docs` with boilerplate lines taken out of the text, and the columns n_lines and n_removed.

    A line (trimmed of spaces, not blank) is boilerplate if at least `min_sites` distinct sites have it. Its first occurrence, by
    doc_id and place, stays; every other one goes. HyperLogLog sketches of the sites are merged per line hash; where the estimate
    is within three standard errors of the threshold, or half a site, the distinct sites are counted exactly. Only lines that occur
    `min_sites` times can qualify, so only those are sketched; very frequent ones are joined without a shuffle of their rows. Built-in functions only.

    A null text stays null with 0 lines; a null site counts as one site of its own; a null doc_id orders first. Repeated rows
    with one doc_id keep or lose the same lines. Other columns pass through; n_lines and n_removed replace columns so named.
    """
    scratch = Scratch(docs.sparkSession, "lines")
    of_lines, gone_lines = free_name("d__of_lines", docs.columns), free_name("gone__lines", docs.columns)
    rows = docs.select(F.col(id_col).alias("d"), F.coalesce(F.col(site_col).cast("string"), F.lit("")).alias("site"), F.posexplode(F.split(F.col(text_col), "\n")).alias("pos", "line"))
    rows = rows.where("trim(line) <> ''").select("d", "site", "pos", F.xxhash64(F.trim("line")).alias("h"))
    rows = scratch.keep(rows, "rows")
    often = scratch.keep(rows.groupBy("h").agg(F.count("*").alias("k")).where(F.col("k") >= min_sites), "often")
    frequent = often.where(F.col("k") * FREQUENT > rows.count()).select("h")
    seen = scratch.keep(_with_lines(rows, often.select("h"), frequent), "seen")

    spread = seen.groupBy("h").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", LG_K)).alias("sites"), F.min(F.struct("d", "pos")).alias("first"))
    spread = scratch.keep(spread, "spread")
    margin = max(0.5, 3 * 1.04 / 2 ** (LG_K / 2) * min_sites)
    near = spread.where(F.abs(F.col("sites") - min_sites) <= margin).select("h", "first")
    exact = _with_lines(seen, near.select("h"), frequent).groupBy("h", "site").agg(F.lit(1).alias("one"))
    exact = exact.groupBy("h").agg(F.count("*").alias("sites")).where(F.col("sites") >= min_sites)
    boilerplate = spread.where(F.col("sites") > min_sites + margin).select("h", "first").unionByName(near.join(exact.select("h"), "h", "left_semi"))
    boilerplate = scratch.keep(boilerplate, "boilerplate")

    found = _with_lines(seen, boilerplate, frequent)
    gone = found.where(~(F.col("d").eqNullSafe(F.col("first.d")) & (F.col("pos") == F.col("first.pos"))))
    gone = gone.groupBy(F.col("d").alias(of_lines)).agg(F.collect_set(F.xxhash64("pos", "h")).alias(gone_lines))

    text = F.col(text_col)
    marked = docs.join(gone, docs[id_col].eqNullSafe(gone[of_lines]), "left").drop(of_lines)
    lines = F.split(text, "\n")
    left = F.filter(lines, lambda line, i: ~F.array_contains(gone_lines, F.xxhash64(i, F.xxhash64(F.trim(line)))))
    marked = marked.withColumn("n_lines", F.when(text.isNull(), 0).otherwise(F.size(lines)).cast("long"))
    kept = F.when(F.col(gone_lines).isNull(), lines).otherwise(left)
    marked = marked.withColumn("n_removed", F.when(text.isNull() | F.col(gone_lines).isNull(), F.lit(0)).otherwise(F.size(lines) - F.size(kept)).cast("long"))
    return marked.withColumn(text_col, F.when(F.col(gone_lines).isNull(), text).otherwise(F.array_join(kept, "\n"))).drop(gone_lines)


def oracle(min_sites: int = MIN_SITES) -> str:
    """The same rows by exact counts, for DuckDB."""
    return f"""
with rows_ as (
  select doc_id, coalesce(source, '') as site, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as pos
  from documents),
shared as (
  select trim(line) as t, min((doc_id, pos)) as first_ from rows_ where trim(line) <> '' group by 1 having count(distinct site) >= {min_sites}),
marked as (
  select r.doc_id, r.pos, r.line, s.t is not null and (r.doc_id, r.pos) <> s.first_ as gone from rows_ r left join shared s on trim(r.line) = s.t)
select d.doc_id, coalesce(count(m.pos), 0) as n_lines, coalesce(sum(m.gone::int), 0)::bigint as n_removed,
  coalesce(string_agg(m.line, chr(10) order by m.pos) filter (not m.gone), '') as text
from documents d left join marked m on m.doc_id = d.doc_id group by d.doc_id"""
