"""Fields from parsed lines, without a model: `Label: value` lines and the best row of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.labels import once, slug
from ..functions.values import infer_type

# Labels that introduce prose.
PROSE_LABELS = ("description", "notes", "note", "comments", "comment", "terms", "remarks")
# Fixed pattern of a labelled line, and the marks of which it has one.
MARKS = (":", "–", "—")
LABELLED = r"^\s*([A-Za-z][A-Za-z0-9 /&._'()-]{1,40}?)\s*[:–—]\s*(\S.*?)\s*$"
# What a document's text calls it, and the kind that means.
KINDS = {"purchase order": "purchase order", "bank statement": "bank statement", "statement of account": "bank statement", "opening balance": "bank statement", "credit note": "credit note", "tax invoice": "invoice", "invoice": "invoice", "receipt": "receipt", "quotation": "quotation"}
LABELLED_CONFIDENCE, TABLE_CONFIDENCE, LONGEST, TABLE_ROWS, HEADING = 0.55, 0.5, 160, 5, 200
SEPARATOR, SPLIT = " | ", r" \| "


def text_lines(docs: DataFrame, id_col: str, text_col: str, most: int = 20_000) -> DataFrame:
    """(document_id, page_index, line_no, text): lines keep their number, blank ones go."""
    rows = docs.select(F.col(id_col).alias("document_id"), F.posexplode(F.slice(F.split(text_col, "\r?\n"), 1, most)).alias("p", "text"))
    return rows.where(F.trim("text") != "").select("document_id", F.floor(F.col("p") / 48).cast("int").alias("page_index"), (F.col("p") + 1).alias("line_no"), "text")


def labelled_fields(lines: DataFrame) -> DataFrame:
    """Lines without a mark of a label aren't matched. A filter would be pushed below the columns it reads and match a line again for each of them, so what a line says is a list of one struct or none, and each of its parts is computed once."""
    kind = "struct<label:string,value_text:string,key:string,value_type:string>"

    def said(label: Column, value: Column) -> Column:
        wordy = (F.size(F.split(value, r"\s+")) > 8) & ~value.rlike("[0-9]")
        ok = (label != "") & (F.length(value) <= LONGEST) & ~F.lower(label).isin(*PROSE_LABELS) & ~wordy
        return F.when(ok, F.struct(label.alias("label"), value.alias("value_text"), slug(label).alias("key"), infer_type(value).alias("value_type")))

    parts = F.array(F.regexp_extract("text", LABELLED, 1), F.regexp_extract("text", LABELLED, 2))
    marked = F.exists(F.array(*[F.lit(m) for m in MARKS]), lambda m: F.contains("text", m))
    found = F.when(marked, once(parts, lambda p: once(F.trim(p[0]), lambda label: said(label, p[1])))).cast(kind)
    rows = lines.select("document_id", "page_index", "line_no", "text", F.inline(F.array_compact(F.array(found))))
    return rows.where("key is not null").select("document_id", "page_index", "line_no", "key", "label", "value_text", "value_type", F.lit(LABELLED_CONFIDENCE).alias("confidence"), F.substring("text", 1, 300).alias("quote"))


def table_fields(lines: DataFrame) -> DataFrame:
    """On pages whose lines are mostly rows: the first is the header, the fullest of the next few its values. Pages are counted first, so that only the rows of such pages are shuffled and sorted."""
    key = ["document_id", "page_index"]
    is_row = F.contains("text", F.lit(SEPARATOR))
    tables = lines.groupBy(*key).agg(F.count("*").alias("n"), F.count_if(is_row).alias("n_rows")).where(F.col("n_rows") >= F.greatest(F.lit(2), F.floor(F.col("n") / 2)))
    rows = lines.where(is_row).join(tables.select(*[F.col(k).alias(f"t_{k}") for k in key]), F.col("document_id").eqNullSafe(F.col("t_document_id")) & F.col("page_index").eqNullSafe(F.col("t_page_index")), "left_semi")
    rows = rows.withColumn("place", F.row_number().over(W.partitionBy(*key).orderBy("line_no"))).where(F.col("place") <= TABLE_ROWS + 1)
    rows = rows.withColumn("cells", F.transform(F.split("text", SPLIT), lambda c: F.trim(c)))
    full = F.size(F.filter("cells", lambda c: c != ""))
    best = F.when(F.col("place") > 1, F.struct(F.col("cells"), F.col("text"), F.col("line_no")))
    tables = rows.groupBy("document_id", "page_index").agg(F.max_by("cells", -F.col("place")).alias("header"), F.max_by(best, F.when(F.col("place") > 1, F.struct(full, -F.col("place")))).alias("row"))
    cells = tables.where("row is not null").select("document_id", "page_index", F.col("row.line_no").alias("line_no"), F.substring("row.text", 1, 300).alias("quote"), F.inline(F.arrays_zip(F.col("header").alias("label"), F.col("row.cells").alias("value_text"))))
    made = F.when(F.col("label").isNotNull() & (F.col("value_text") != ""), F.struct(slug(F.col("label")).alias("key"), infer_type(F.col("value_text")).alias("value_type")))
    cells = cells.select("*", F.inline(F.array_compact(F.array(made)))).where("key is not null")
    return cells.select("document_id", "page_index", "line_no", "key", "label", "value_text", "value_type", F.lit(TABLE_CONFIDENCE).alias("confidence"), "quote")


def extract(lines: DataFrame) -> DataFrame:
    """Both; of a page the table's fields come first, and of a document the first of a key stays."""
    rows = table_fields(lines).withColumn("late", F.lit(0)).unionByName(labelled_fields(lines).withColumn("late", F.lit(1)))
    first = F.row_number().over(W.partitionBy("document_id", "key").orderBy("page_index", "late", "line_no", "label"))
    return rows.withColumn("r", first).where("r = 1").drop("r", "late")


def document_kind(text: Column) -> Column:
    """The kind whose markers are found most, all of them together; one in the heading counts ten more. Ties go to the kind that KINDS names first; `document` without any."""
    low = F.lower(F.coalesce(text, F.lit("")))
    count = lambda s, m: F.size(F.split(s, m)) - 1
    scores = []
    for k, kind in enumerate(dict.fromkeys(KINDS.values())):
        n = sum((count(low, m) + 10 * count(F.substring(low, 1, HEADING), m) for m, v in KINDS.items() if v == kind), F.lit(0))
        scores.append(F.struct(n.alias("n"), F.lit(-k).alias("o"), F.lit(kind).alias("kind")))
    best = F.array_max(F.array(*scores))
    return F.when(best["n"] > 0, best["kind"]).otherwise("document")
