"""JSON documents checked field by field: every fault is a row that names its path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed: the lists of a report context.
LISTS = ("baseline_rows", "lineage_rows", "measurability", "audit_entries", "federated_sites", "error_trend", "prevalence_rows", "target_rows", "watchlist_rows", "external_benchmark_rows")
NUMBERS = ("TINYINT", "SMALLINT", "INT", "BIGINT", "FLOAT", "DOUBLE", "DECIMAL")


def parsed(texts: DataFrame) -> DataFrame:
    """file and v: the value of each text (file, value); null where it is no JSON."""
    return texts.select("file", F.try_parse_json("value").alias("v"))


def kind(v: Column) -> Column:
    """OBJECT, ARRAY, STRING, BOOLEAN, VOID or the name of a number's type."""
    return F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)


def is_number(v: Column) -> Column:
    return F.coalesce(kind(v).isin(*NUMBERS), F.lit(False))


def exploded(rows: DataFrame, column: str, *keep: str) -> DataFrame:
    """pos, key and value of the members of an object or the items of an array, with the columns ``keep``; others give no rows."""
    held = rows.select(*keep, F.col(column).alias("_v"))
    return held.lateralJoin(rows.sparkSession.tvf.variant_explode(F.col("_v").outer())).select(*keep, "pos", "key", "value")


def _error(rows: DataFrame, path: Column | str, reason: Column | str) -> DataFrame:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    return rows.select("file", lit(path).alias("path"), lit(reason).alias("reason")).where("reason IS NOT NULL")


def _item(name: Column, pos: Column) -> Column:
    return F.concat(F.lit("$."), name, F.lit("["), pos.cast("string"), F.lit("]"))


def _count(v: Column, *names: str) -> Column:
    """The first of the members that is there and not null."""
    return F.coalesce(*[F.when(kind(F.try_variant_get(v, f"$.{n}", "variant")) != "VOID", F.try_variant_get(v, f"$.{n}", "variant")) for n in names])


def _bad_count(v: Column) -> Column:
    """Whether a count is there that is no whole number from 0 on; whole numbers may be written as text."""
    text = F.when(kind(v).isin("STRING", *NUMBERS), v.cast("string"))
    return v.isNotNull() & ~F.coalesce(text.rlike(r"^\s*\+?[0-9]+\s*$") | (is_number(v) & text.rlike(r"^[0-9]+\.0*$")), F.lit(False))


def context_errors(texts: DataFrame, schema_name: str) -> DataFrame:
    """file, path and reason of every fault of report contexts (file, value); a document without faults has no row.

    A context is an object whose ``schema`` is ``schema_name`` and whose known fields are lists: of
    numbers from 0 to 100 (error_trend) or of objects. Counts of prevalence rows are whole
    and not negative, resistant ones not above tested ones; a target row names its target
    or gene; ``validation`` holds lists, ``reference_method`` is text.
    """
    docs = parsed(texts)
    v = F.col("v")
    top = F.when(v.isNull(), "not JSON").when(kind(v) != "OBJECT", "not an object")
    errors = _error(docs, "$", top)
    objects = docs.where(v.isNotNull() & (kind(v) == "OBJECT"))
    said = F.when(kind(F.try_variant_get(v, "$.schema", "variant")) == "STRING", F.try_variant_get(v, "$.schema", "string"))
    errors = errors.unionByName(_error(objects, "$.schema", F.when(~F.coalesce(said == schema_name, F.lit(False)), "not the schema")))

    fields = exploded(objects, "v", "file").where("key <> 'schema'")
    path, value = F.concat(F.lit("$."), F.col("key")), F.col("value")
    wrong = (
        F.when(F.col("key").isin(*LISTS), F.when(kind(value) != "ARRAY", "not a list")).when(F.col("key") == "validation", F.when(kind(value) != "OBJECT", "not an object"))
        .when(F.col("key") == "reference_method", F.when(kind(value) != "STRING", "not text")).otherwise("unknown field")
    )
    errors = errors.unionByName(_error(fields, path, wrong))

    lists = fields.where(F.col("key").isin(*LISTS) & (kind(value) == "ARRAY")).select("file", F.col("key").alias("list"), "value")
    items = exploded(lists, "value", "file", "list")
    number = F.try_variant_get(value, "$", "double")
    of_item = F.when(F.col("list") == "error_trend", F.when(~is_number(value), "not a number").when(~number.between(0, 100), "not between 0 and 100")).otherwise(F.when(kind(value) != "OBJECT", "not an object"))
    errors = errors.unionByName(_error(items, _item(F.col("list"), F.col("pos")), of_item))

    rows = items.where(kind(value) == "OBJECT")
    total, resistant = _count(value, "total", "n_tested"), _count(value, "resistant", "n_resistant")
    above = resistant.cast("string").try_cast("double") > total.cast("string").try_cast("double")
    counts = F.array_compact(F.array(F.when(_bad_count(total), "tested count"), F.when(_bad_count(resistant), "resistant count"), F.when(~_bad_count(total) & ~_bad_count(resistant) & above, "resistant above tested")))
    prevalence = rows.where("list = 'prevalence_rows'").select("file", "list", "pos", F.explode(counts).alias("said"))
    errors = errors.unionByName(_error(prevalence, _item(F.col("list"), F.col("pos")), F.col("said")))
    filled = lambda name: F.coalesce(~kind(F.try_variant_get(value, f"$.{name}", "variant")).isin("VOID") & ~F.try_variant_get(value, f"$.{name}", "string").isin("", "false", "0"), F.lit(False))
    target = rows.where("list = 'target_rows'")
    errors = errors.unionByName(_error(target, _item(F.col("list"), F.col("pos")), F.when(~filled("target") & ~filled("gene"), "no target or gene")))

    inner = exploded(fields.where((F.col("key") == "validation") & (kind(value) == "OBJECT")).select("file", "value"), "value", "file")
    of_inner = F.when(~F.col("key").isin("outcomes", "timeline"), "unknown field").when(kind(value) != "ARRAY", "not a list")
    return errors.unionByName(_error(inner, F.concat(F.lit("$.validation."), F.col("key")), of_inner))


def typed_rows(texts: DataFrame, fields: dict[str, str], required: tuple[str, ...], id_field: str) -> tuple[DataFrame, DataFrame]:
    """(rows, errors) of texts (file, value) that hold a JSON list of objects.

    ``fields`` gives each known field its type: string, double, bigint or boolean. A
    document with a fault gives no rows, as nothing of it may be trusted; its errors name
    every fault with its path: not JSON, not a list, an item that is no object, an unknown
    field, a value of another type (null is none), a missing required field, and an id
    that comes again in the document. An empty list has neither rows nor errors.
    """
    docs = parsed(texts)
    v = F.col("v")
    errors = _error(docs, "$", F.when(v.isNull(), "not JSON").when(kind(v) != "ARRAY", "not a list"))
    items = exploded(docs.where(v.isNotNull() & (kind(v) == "ARRAY")), "v", "file").select("file", "pos", F.col("value").alias("item"))
    path = F.concat(F.lit("$["), F.col("pos").cast("string"), F.lit("]"))
    item = F.col("item")
    errors = errors.unionByName(_error(items, path, F.when(kind(item) != "OBJECT", "not an object")))
    objects = items.where(kind(item) == "OBJECT")
    members = exploded(objects.select("file", F.col("pos").alias("at"), "item"), "item", "file", "at")
    value = F.col("value")
    fits = {"string": kind(value) == "STRING", "double": is_number(value), "bigint": kind(value).isin("TINYINT", "SMALLINT", "INT", "BIGINT"), "boolean": kind(value) == "BOOLEAN"}
    wrong = F.lit(None).cast("string")
    for name, type_ in fields.items():
        wrong = F.when(F.col("key") == name, F.when((kind(value) != "VOID") & ~fits[type_], f"not {type_}")).otherwise(wrong)
    said = F.when(~F.col("key").isin(*fields), "unknown field").otherwise(wrong)
    inside = F.concat(F.lit("$["), F.col("at").cast("string"), F.lit("]."), F.col("key"))
    errors = errors.unionByName(_error(members, inside, said))
    absent = F.filter(F.array(*[F.lit(r) for r in required]), lambda r: F.lit(False)) if not required else F.array_compact(F.array(*[
        F.when(F.coalesce(kind(F.try_variant_get(item, f"$.{r}", "variant")) == "VOID", F.lit(True)), F.lit(r)) for r in required
    ]))
    missing = objects.select("file", "pos", F.explode(absent).alias("name"))
    errors = errors.unionByName(_error(missing, F.concat(path, F.lit("."), F.col("name")), "missing"))
    id_ = F.try_variant_get(item, f"$.{id_field}", "string")
    again = objects.where(id_.isNotNull()).groupBy("file", id_.alias("_id")).agg(F.count("*").alias("n")).where("n > 1")
    errors = errors.unionByName(_error(again, F.concat(F.lit(f"$[*].{id_field}="), F.col("_id")), "repeated"))
    good = objects.join(errors.select("file").distinct().hint("merge"), "file", "left_anti")
    return good.select("file", "pos", *[F.try_variant_get(item, f"$.{n}", t).alias(n) for n, t in fields.items()]), errors
