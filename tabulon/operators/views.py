"""What screens and prompts read: rows of one workspace with their document, values by record, page blocks, orders of tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.exprs import NOT_STATED, label_of, numeric_of
from ..functions.vectors import overlaps_vertically

MOST_CHARACTERS = 120_000
CUT_NOTE = "[Later pages of this document are not shown.]"


def in_workspace(rows: DataFrame, workspace_id: str) -> DataFrame:
    """The only way into a shared table: a filter that prunes partitions where the table is partitioned by workspace."""
    return rows.where(F.col("workspace_id") == workspace_id)


def wire_status(status: Column) -> Column:
    return F.when(status == "awaiting_schema", "extracting").otherwise(status)


def with_document(rows: DataFrame, documents: DataFrame) -> DataFrame:
    """Passages or records with their document's name; those of a document that is gone are left out."""
    return rows.join(documents.select("document_id", "filename"), "document_id")


def one_passage(chunks: DataFrame, documents: DataFrame, workspace_id: str, document_id: object, ordinal: int) -> DataFrame:
    """A cited passage with its document's name, if it is of that workspace; the filters reach the scan, so a stored table is pruned."""
    found = in_workspace(chunks, workspace_id).where((F.col("document_id") == F.lit(document_id)) & (F.col("ordinal") == ordinal))
    return with_document(found, in_workspace(documents, workspace_id).where(F.col("document_id") == F.lit(document_id)))


def record_values(records: DataFrame, field_values: DataFrame) -> DataFrame:
    """Each record with its values as a map by field (a record's fields are unique and few); an empty map without any."""
    shown = F.struct("field_key", label_of(F.col("v"), F.col("value_type")).alias("shown"))
    of = field_values.groupBy("record_id").agg(F.map_from_entries(F.collect_list(shown)).alias("shown"))
    none = F.create_map().cast("map<string,string>")
    return records.join(of, "record_id", "left").withColumn("shown", F.coalesce("shown", none))


def vector_space(chunks: DataFrame) -> DataFrame:
    """The embedding model that most of a workspace's passages have; of equals the first by name."""
    n = chunks.where("embedding_model is not null").groupBy("workspace_id", "embedding_model").agg(F.count("*").alias("n"))
    return n.groupBy("workspace_id").agg(F.min_by("embedding_model", F.struct(-F.col("n"), "embedding_model")).alias("embedding_model"))


def page_blocks(pages: DataFrame, most: int = MOST_CHARACTERS) -> DataFrame:
    """(document_id, prompt, pages): numbered blocks of a document's pages, whole pages only, up to `most` characters; the first always.

    pages: document_id, page_index, text, locator, ocr_applied. The lengths are added up before any text is gathered.
    """
    body = F.regexp_replace(F.coalesce("text", F.lit("")), r"^\s+|\s+$", "")
    place = F.coalesce(F.concat(F.lit(" ("), F.nullif(F.col("locator"), F.lit("")), F.lit(")")), F.lit(""))
    scan = F.when(F.col("ocr_applied"), " [text recognised from a scan]").otherwise("")
    head = F.concat(F.lit("=== PAGE "), F.col("page_index").cast("string"), place, scan, F.lit(" ===\n"))
    block = F.concat(head, F.when(body == "", "[no readable text on this page]").otherwise(body))
    order = W.partitionBy("document_id").orderBy("page_index")
    rows = pages.select("document_id", "page_index", block.alias("block")).withColumn("used", F.sum(F.length("block")).over(order.rowsBetween(W.unboundedPreceding, 0))).withColumn("k", F.row_number().over(order))
    fits = (F.col("used") <= most) | (F.col("k") == 1)
    taken = F.array_sort(F.collect_list(F.when(fits, F.struct("page_index", "block"))))
    out = rows.groupBy("document_id").agg(taken.alias("t"), F.count("*").alias("n"))
    text = F.array_join(F.col("t.block"), "\n\n")
    return out.select("document_id", F.when(F.size("t") < F.col("n"), F.concat_ws("\n\n", text, F.lit(CUT_NOTE))).otherwise(text).alias("prompt"), F.size("t").alias("pages"))


def table_order(v: Column, kind: Column, descending: bool = False) -> list[Column]:
    """Sort keys of a column: numbers and amounts by size, everything else by its text, absent values last both ways."""
    shown = label_of(v, kind)
    number = F.when(kind.isin("number", "currency"), numeric_of(v, kind))
    text = F.when(~kind.isin("number", "currency") & (shown != NOT_STATED), shown)
    return [(c.desc_nulls_last() if descending else c.asc_nulls_last()) for c in (number, text)]


def locator_of(lines: Column, box: Column) -> Column:
    """The locator of the first line that has one and lies beside the box."""
    return F.get(F.filter(lines, lambda line: line["locator"].isNotNull() & overlaps_vertically(line["box"], box, 1.0)), F.lit(0))["locator"]


def workspace_names(documents: DataFrame) -> DataFrame:
    """(workspace_id, name): after the first word that all its file names share, else the number and kind of its files. documents: workspace_id, filename."""
    base = F.substring_index(F.trim("filename"), "/", -1)
    dot = F.length(base) - F.instr(F.reverse(base), ".")  # characters before the last dot
    suffixed = (F.instr(F.reverse(base), ".") > 1) & (dot > 0)
    stem = F.when(suffixed, F.substr(base, F.lit(1), dot)).otherwise(base)
    kind = F.when(suffixed, F.upper(F.substr(base, dot + 2)))
    first = F.when(stem != "", F.split(F.regexp_replace(stem, "_", "-"), "-")[0])
    of = documents.where("trim(filename) <> ''").groupBy("workspace_id").agg(F.count("*").alias("n"), F.min(first).alias("least"), F.max(first).alias("most"), F.min(kind).alias("kind"), F.max(kind).alias("last_kind"))
    shared = F.when((F.col("least") == F.col("most")) & (F.col("least") != ""), F.concat(F.initcap("least"), F.lit(" documents")))
    one = F.when(F.col("kind") == F.col("last_kind"), F.concat_ws(" ", F.col("n").cast("string"), "kind", F.lit("documents")))
    every = documents.select("workspace_id").distinct().join(of, "workspace_id", "left")
    name = F.when(F.col("n").isNull(), "New collection").otherwise(F.coalesce(shared, one, F.concat(F.col("n").cast("string"), F.lit(" mixed business documents"))))
    return every.select("workspace_id", name.alias("name"))
