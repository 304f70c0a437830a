"""License scans: MinHash bands over overlapping windows retrieve templates, exact shingle containment verifies them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .license_texts import TEXTS
from .store import Scratch

#: Words of a shingle; bands of one MinHash each; share of a template that has to be there.
SIZE, BANDS, LEAST = 5, 3, 0.8
#: Shingles of the longest window; shorter templates have windows of a lesser power of two.
WINDOW = 16
#: Rows of 24 bytes, a template's key each, and bytes of templates' shingles that are sent to every executor; beyond, they meet by a shuffle.
BROADCAST_KEYS, BROADCAST_BYTES = 1_000_000, 32 << 20


def template_table(spark: SparkSession, texts=TEXTS) -> DataFrame:
    return spark.createDataFrame(list(texts), "template string, text string")


def _words(text: F.Column) -> F.Column:
    """Hashes of the lower-cased runs of letters and digits."""
    plain = F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))
    return F.when(plain == "", F.array().cast("array<bigint>")).otherwise(F.transform(F.split(plain, " "), lambda w: F.xxhash64(w)))


def _rolled(last: str, step: int, value: str) -> str:
    """SQL of an array of `value` at i = 0, step, ... up to `last`; empty if that is negative."""
    return f"if({last} < 0, cast(array() as array<bigint>), transform(sequence(0, greatest({last}, 0), {step}), i -> {value}))"


def _shingles(size: int) -> str:
    """SQL of the hashes of each `size` words in a row; none in shorter texts."""
    return _rolled(f"size(w) - {size}", 1, f"xxhash64({', '.join(f'w[i + {k}]' for k in range(size))})")


def _settled(rows: DataFrame, *names: str) -> DataFrame:
    """The same columns, computed once a row: the optimiser doesn't copy expressions through a generator, where a lambda would evaluate them for each element."""
    return rows.select(F.inline(F.array(F.struct(*names))))


def window_of(shingles: int) -> int:
    """The largest power of two whose windows, one at every half window, lie inside so many shingles at least once."""
    w = 1
    while w < WINDOW and 3 * w - 1 <= shingles:
        w *= 2
    return w


def _bands(window: int) -> int:
    """A template of up to four shingles has to be there whole, so its windows are equal or not met."""
    return 1 if window < 4 else BANDS


def _minima(rows: DataFrame, windows: set[int], step: int, *keep: str) -> tuple[DataFrame, list[tuple[str, int, int]]]:
    """(keep, s5) -> the least seeded hash of each window and band, an array each; and of each array its name, window and step.

    Windows of 4, 8 and 16 begin at every half window (or every place, with `step` 1); each length takes its minima from the half as long one.
    """
    deepest = max(windows, default=1)
    made: list[tuple] = []
    if 2 in windows:
        made.append(("m2_0", 2, 1, f"least(s{SIZE}[i], s{SIZE}[i + 1])"))
    if deepest >= 4:
        made += [(f"m4_{b}", 4, 2 if step else 1, f"least({', '.join(f's{SIZE}[i + {k}]' if b == 0 else f'xxhash64(s{SIZE}[i + {k}], {1000 + b})' for k in range(4))})") for b in range(BANDS)]
    if made:
        rows = _settled(rows.select(*keep, *[F.expr(_rolled(f"size(s{SIZE}) - {w}", by, v)).alias(n) for n, w, by, v in made]), *keep, *[n for n, *_ in made])
    arrays = [(n, w, by) for n, w, by, _ in made]
    for window in (8, 16):
        if deepest < window:
            break
        # places in the list of half as long windows: their step is half of this one's, their length twice their step
        half, by = window // 2, window // 2 if step else 1
        jump, apart = (2, 2) if step else (1, half)
        made = [(f"m{window}_{b}", f"least(m{half}_{b}[i], m{half}_{b}[i + {apart}])", f"m{half}_{b}") for b in range(BANDS)]
        have = [n for n, *_ in arrays]
        rows = _settled(rows.select(*keep, *have, *[F.expr(_rolled(f"size({of}) - {apart + 1}", jump, v)).alias(n) for n, v, of in made]), *keep, *have, *[n for n, *_ in made])
        arrays += [(n, window, by) for n, *_ in made]
    return rows, [(n, w, by) for n, w, by in arrays if w in windows and int(n.split("_")[1]) < _bands(w)]


def scan_licenses(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", templates: DataFrame | None = None, least: float = LEAST, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """One row per document and template found: doc_id, template, containment, first_word.

    `templates` (template, text) are whole notices; the default ones are TEXTS. A text is cut into overlapping windows of W shingles
    of five words, one at every half window; a template has a window at every shingle. W is 16, or for short templates the largest
    power of two whose windows surely lie inside them, so an unedited notice holds a window that equals one of the template: it
    collides with certainty, whatever stands around it. Where a word was edited, a window and the template's share 11 of 21 shingles, so
    BANDS = 3 bands of one seeded MinHash collide with probability 0.89, and two such windows with 0.99; a long notice has many more. A template of less
    than five words is one shingle of all its words, and its window that shingle. Keys of all lengths are one table; what meets by
    chance is found out by the comparison.

    At each collision, the share of the template's shingles in the stretch of its length on both sides is computed exactly; the best of
    at least `least` is returned with the first window that led to it. A hit carries that stretch alone, so texts of many notices stay
    linear. Template keys hold no shingles; they are broadcast up to `broadcast_keys` of them, and the shingles, once a template, up to
    BROADCAST_BYTES. Beyond, a window is shuffled as its place and key alone, and what it met goes back to its text. Built-in functions only.

    A null or wordless text has no row, nor has a null or wordless template; a null doc_id is reported as null; repeated rows are
    reported once; templates that repeat a name count each. Other columns are ignored.
    """
    spark = docs.sparkSession
    given = (templates if templates is not None else template_table(spark)).select("template", "text").where("text is not null")
    named = given.select("template", "text", F.size(_words(F.col("text"))).alias("words")).where("words > 0")
    classes = sorted({(min(SIZE, r.words), window_of(r.words - min(SIZE, r.words) + 1)) for r in named.select("words").distinct().collect()})
    if not classes:
        return docs.select(F.col(id_col).alias("doc_id"), F.lit("").alias("template"), F.lit(0.0).alias("containment"), F.lit(0).alias("first_word")).where("false")
    sizes = sorted({n for n, _ in classes})
    of_windows = {w for n, w in classes if n == SIZE and w > 1}
    shingles = [f"s{n}" for n in sizes]

    def prepared(rows: DataFrame, step: int, *keep: str) -> tuple[DataFrame, list[tuple[str, str, int, int]]]:
        """The rows with shingles, and arrays of keys: (name, shingles, window, step)."""
        rows = _settled(rows.select(*keep, _words(F.col("text")).alias("w")), *keep, "w")
        rows = _settled(rows.select(*keep, *[F.expr(_shingles(n)).alias(f"s{n}") for n in sizes]), *keep, *shingles)
        rows, arrays = _minima(rows, of_windows, step, *keep, *shingles)
        return rows, [(f"s{n}", f"s{n}", 1, 1) for n, w in classes if w == 1] + [(name, f"s{SIZE}", w, by) for name, w, by in arrays]

    scratch = Scratch(spark, "licenses")
    known, arrays = prepared(named, 0, "template", "words")
    known = scratch.keep(known.withColumn("no", F.monotonically_increasing_id()), "templates")
    tables, owns = [], []
    for name, whole, window, _ in arrays:
        n = F.size(whole)
        fits = (F.least(F.col("words"), F.lit(SIZE)) == int(whole[1:])) & (n >= (1 if window == 1 else 3 * window // 2 - 1)) & (F.lit(True) if window == WINDOW else n < max(2, 3 * window - 1))
        tables.append(known.where(fits).select("no", F.lit(int(whole[1:])).alias("size"), F.size(F.array_distinct(whole)).alias("n_own"), F.explode(name).alias("key")))
    for k in sizes:
        owns.append(known.where(F.least(F.col("words"), F.lit(SIZE)) == k).select("no", "template", F.array_distinct(f"s{k}").alias("own")))
    keys, own = tables[0], owns[0]
    for t in tables[1:]:
        keys = keys.unionByName(t)
    for t in owns[1:]:
        own = own.unionByName(t)
    keys, own = scratch.keep(keys.distinct(), "keys"), scratch.keep(own, "own")
    few = keys.count() <= broadcast_keys
    if (own.agg(F.sum(8 * F.size("own") + F.octet_length("template") + 64)).first()[0] or 0) <= BROADCAST_BYTES:
        own = F.broadcast(own)

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where("text is not null")
    rows, at = (rows, []) if few else (scratch.keep(rows.withColumn("at", F.monotonically_increasing_id()), "rows"), ["at"])
    rows, arrays = prepared(rows, 1, "doc_id", *at)
    ends = [" + ".join(f"size({name})" for name, *_ in arrays[: k + 1]) for k in range(len(arrays))]
    rows = _settled(rows.select("doc_id", *at, *shingles, F.concat(*[name for name, *_ in arrays]).alias("keys"), F.array(*[F.expr(e) for e in ends]).alias("ends")), "doc_id", *at, *shingles, "keys", "ends")
    if few:
        met = rows.select("doc_id", *shingles, "ends", F.posexplode("keys").alias("pos", "key")).join(F.broadcast(keys), "key")
    else:
        met = rows.select("at", F.posexplode("keys").alias("pos", "key")).join(keys, "key").join(rows.select("at", "doc_id", *shingles, "ends"), "at")
    steps = [f"when pos < ends[{k}] then (pos - {f'ends[{k - 1}]' if k else 0}) * {by}" for k, (_, _, _, by) in enumerate(arrays)]
    met = met.withColumn("i", F.expr(f"case {' '.join(steps)} end"))
    whole = "case size " + " ".join(f"when {n} then s{n}" for n in sizes) + " end"
    around = F.expr(f"slice({whole}, greatest(i + 1 - n_own, 1), 2 * n_own + {WINDOW})")
    met = met.select("doc_id", "no", "i", around.alias("around")).join(own, "no")
    found = met.select("doc_id", "template", "i", (F.size(F.array_intersect("own", "around")) / F.size("own")).cast("double").alias("containment"))
    found = found.where(F.col("containment") >= least)
    return found.groupBy("doc_id", "template").agg(F.max("containment").alias("containment"), F.min("i").alias("first_word"))
