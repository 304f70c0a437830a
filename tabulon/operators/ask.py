"""Questions to checked queries, by the words that they share with a workspace's fields; and questions worth asking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import fold_for_similarity

# What in a question asks for a figure, and what asks for gaps.
FIGURE_HINTS = ("total", "sum", "how much", "how many", "count", "average", "avg", "most", "largest", "highest", "lowest", "per ", " by ", "breakdown", "spend")
GAP_HINTS = ("missing", "without", "no ", "lack", "absent")
# What in a field's key names a party, and questions of last resort.
PARTY_WORDS = ("vendor", "supplier", "party", "name")
PLAIN_QUESTIONS = ("What do these documents have in common?", "Which document has the largest amount?", "What dates do these documents cover?")
#: Words that choose an aggregate or a date bucket where questions are read for them.
AGGREGATE_WORDS = {"avg": ("average", "avg", "mean"), "max": ("highest", "largest", "biggest", "maximum"), "min": ("lowest", "smallest", "minimum")}
BUCKET_WORDS = {"month": ("month", "monthly"), "quarter": ("quarter", "quarterly"), "year": ("year", "yearly", "annual")}
MOST_CATEGORIES, LEAST_COVERAGE = 12, 0.3
FILTERS = "array<struct<field:string,op:string,value:string>>"


def _holds(text: Column, hints: tuple[str, ...]) -> Column:
    return F.exists(F.array(*[F.lit(h) for h in hints]), lambda h: F.contains(text, h))


def _words(text: Column) -> Column:
    return F.array_remove(F.split(fold_for_similarity(text), " "), "")


def _first(rows: Column, *tests) -> Column:
    """The first row for which the first test holds that holds for any."""
    return F.coalesce(*[F.get(F.filter(rows, t), F.lit(0)) for t in tests])


def total_phrase(label: Column) -> Column:
    low = F.lower(label)
    return F.when(low.startswith("total"), low).otherwise(F.concat(F.lit("total "), low))


def _article(word: Column) -> Column:
    return F.when(F.lower(F.substring(word, 1, 1)).isin("a", "e", "i", "o", "u"), "an").otherwise("a")


def schemas(fields: DataFrame) -> DataFrame:
    """(workspace_id, schema): the fields of a workspace in their order, with the words of their labels; a schema has some dozen."""
    row = F.struct("position", "key", "label", "type", "currency_default", _words(F.col("label")).alias("words"))
    return fields.groupBy("workspace_id").agg(F.array_sort(F.collect_list(row)).alias("schema"))


def plan_questions(questions: DataFrame, fields: DataFrame, *, slots: bool = False) -> DataFrame:
    """A row per question: workspace_id, question_id, answerable, kind, title, unit_hint and the columns of a query (see plans.shared), null where it asks for no figure.

    questions: workspace_id, question_id, question, and, if known, passages (how many were found; none means it can't be answered).
    A field is mentioned if its label and the question share a word, filler aside. The measure is the first mentioned currency field,
    else the first mentioned number, else the first currency field; the group is the first mentioned text, enumerated or date
    field. Where the question asks for gaps, records without the first mentioned field are counted; without a measure,
    records; else the measure is summed. With `slots` the question's words also choose average, highest or lowest, and the bucket of a date.

    Questions are joined with their workspace's schema, a row, so no question is compared with another workspace's fields. A text is
    read once for each workspace that asks it, however often.
    A null question mentions nothing. A question of a workspace without fields is answerable and asks for no figure.
    """
    found = F.coalesce(F.col("passages") > 0, F.lit(True)) if "passages" in questions.columns else F.lit(True)
    text = F.lower(F.coalesce("question", F.lit("")))
    every = questions.select("workspace_id", "question_id", text.alias("text"), found.alias("answerable"))
    rows = every.select("workspace_id", "text", "answerable").distinct().join(schemas(fields), "workspace_id", "left")
    rows = rows.withColumn("schema", F.coalesce("schema", F.array().cast(dict(schemas(fields).dtypes)["schema"]))).withColumn("asked", _words(F.col("text")))
    rows = rows.withColumn("named", F.filter("schema", lambda f: F.arrays_overlap(f["words"], "asked")))
    money, number = (lambda f: f["type"] == "currency"), (lambda f: f["type"].isin("currency", "number"))
    measure = F.coalesce(_first(F.col("named"), money, number), _first(F.col("schema"), money))
    group = _first(F.col("named"), lambda f: f["type"].isin("string", "enum", "date"))
    gap = F.when(_holds(F.col("text"), GAP_HINTS), F.get("named", F.lit(0)))
    figure = F.col("answerable") & (F.size("schema") > 0) & _holds(F.col("text"), FIGURE_HINTS)
    rows = rows.select("workspace_id", "text", "answerable", "asked", figure.alias("figure"), measure.alias("m"), group.alias("g"), gap.alias("gap"))

    m, g, missing = F.col("m"), F.col("g"), F.col("gap").isNotNull()
    chosen, bucket = F.lit("sum"), F.lit(None).cast("string")
    if slots:
        has = lambda words: F.arrays_overlap("asked", F.array(*[F.lit(w) for w in words]))
        for name, words in AGGREGATE_WORDS.items():
            chosen = F.when(has(words), name).otherwise(chosen)
        for name, words in BUCKET_WORDS.items():
            bucket = F.when(has(words), name).otherwise(bucket)
        bucket = F.when(g["type"] == "date", bucket)
    heading = F.when(chosen == "sum", F.when(F.lower(m["label"]).startswith("total"), m["label"]).otherwise(F.concat(F.lit("Total "), m["label"])))
    heading = heading.otherwise(F.concat(F.when(chosen == "avg", "Average ").when(chosen == "max", "Highest ").otherwise("Lowest "), m["label"]))
    spoken = F.when(chosen == "sum", m["label"]).otherwise(heading)
    by = F.concat(F.lit(" by "), g["label"])
    title = F.when(missing, F.concat(F.lit("Documents with no "), F.col("gap.label"))).when(m.isNull(), F.concat(F.lit("Documents"), F.coalesce(by, F.lit("")))).otherwise(F.coalesce(F.concat(spoken, by), heading))
    count = missing | m.isNull()
    only = lambda c: F.when(F.col("figure"), c)
    filters = F.when(missing, F.array(F.struct(F.col("gap.key").alias("field"), F.lit("missing").alias("op"), F.lit(None).cast("string").alias("value")))).otherwise(F.array().cast(FILTERS))
    planned = rows.select(
        F.col("workspace_id").alias("of"), F.col("text").alias("said"), F.col("answerable").alias("found"),
        only(F.when(missing | g.isNull(), "metric").when(bucket.isNotNull(), "line").otherwise("bar")).alias("kind"), only(title).alias("title"), only(F.when(~count, m["currency_default"])).alias("unit_hint"),
        only(F.when(count, "count").otherwise(chosen)).alias("aggregate"), only(F.when(~count, m["key"])).alias("measure_field"), only(F.when(~missing, g["key"])).alias("group_by"), only(F.when(~missing, bucket)).alias("date_bucket"),
        only(filters).cast(FILTERS).alias("filters"), only(F.lit("value_desc")).alias("sort"), only(F.lit(20)).alias("limit"))
    same = F.col("workspace_id").eqNullSafe(F.col("of")) & (F.col("text") == F.col("said")) & (F.col("answerable") == F.col("found"))
    return every.join(planned, same).drop("text", "of", "said", "found")


SPEC = ("aggregate", "measure_field", "group_by", "date_bucket", "filters", "sort", "limit")


def with_spec_id(plans: DataFrame) -> DataFrame:
    """Plans with query_id, equal for equal queries of a workspace, so each is evaluated once however many questions ask it."""
    return plans.withColumn("query_id", F.when(F.col("aggregate").isNotNull(), F.sha2(F.to_json(F.struct(*SPEC)), 256)))


def distinct_queries(plans: DataFrame) -> DataFrame:
    return plans.where("query_id is not null").select("workspace_id", "query_id", *SPEC).dropDuplicates(["workspace_id", "query_id"])


def suggest_questions(fields: DataFrame, stats: DataFrame) -> DataFrame:
    """(workspace_id, place, question): three questions for each workspace with fields, one of which splits a measure by a category where the data allow that.

    stats: a row per field, of operators.profile by workspace, with label and type. The split is of the currency field that most records
    have, by the text field with 2 to 12 labels that most records have, and comes first unless another question has one.
    """
    schema = schemas(fields)
    rows = schema.select("workspace_id", "schema", _first(F.col("schema"), lambda f: f["type"] == "currency").alias("money"), F.filter("schema", lambda f: f["type"] == "string").alias("texts"))
    party = _first(F.col("texts"), lambda f: _holds(f["key"], PARTY_WORDS), lambda f: f["key"].isNotNull())
    rows = rows.withColumn("party", party).withColumn("other", _first(F.col("texts"), lambda f: f["key"] != F.col("party.key")))
    money, party, other = F.col("money.label"), F.lower("party.label"), F.lower("other.label")
    whole = F.concat(F.lit("What is the "), total_phrase(money), F.coalesce(F.concat(F.lit(" by "), party), F.lit("")), F.lit("?"))
    gap = F.concat(F.lit("Which documents are missing "), _article(other), F.lit(" "), other, F.lit("?"))
    often = F.concat(F.lit("Which "), party, F.lit(" appears most often?"))
    first = F.filter(F.array(whole, gap, often), lambda q: q.isNotNull())
    # each place that is left takes the plain question of that place
    filled = F.slice(F.concat(first, F.slice(F.array(*[F.lit(q) for q in PLAIN_QUESTIONS]), F.size(first) + 1, F.lit(3))), 1, 3)

    enough = stats.where(F.col("coverage") >= LEAST_COVERAGE)
    rank = lambda c: F.max_by(F.struct("label", "field_key"), F.struct("coverage", -F.col("position"))).alias(c)
    measure = enough.where("type = 'currency' and numeric_sum is not null").groupBy("workspace_id").agg(rank("measure"))
    category = enough.where(F.col("type").isin("string", "enum") & F.col("distinct").between(2, MOST_CATEGORIES)).groupBy("workspace_id").agg(rank("category"))
    split = measure.join(category, "workspace_id").select("workspace_id", F.concat(F.lit("What is the "), total_phrase(F.col("measure.label")), F.lit(" by "), F.lower("category.label"), F.lit("?")).alias("split"))
    rows = rows.select("workspace_id", filled.alias("questions")).join(split, "workspace_id", "left")
    splits = F.exists("questions", lambda q: q.rlike(r"(?i)\bby\s+[a-z]"))
    rows = rows.select("workspace_id", F.when(splits | F.col("split").isNull(), F.col("questions")).otherwise(F.slice(F.concat(F.array("split"), "questions"), 1, 3)).alias("questions"))
    return rows.select("workspace_id", F.posexplode("questions").alias("place", "question")).withColumn("place", F.col("place") + 1)
