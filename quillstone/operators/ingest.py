"""Flattening of nested, dynamically keyed records into the tables of a snapshot.

A record is one JSON text; its dynamic part is read as a variant, so no schema is inferred and unknown keys are kept.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text

#: Columns of items and their types.
ITEMS = {
    "id": "long", "documentKey": "string", "globalId": "string", "itemType": "long", "typeKey": "string", "typeName": "string", "project": "long", "name": "string",
    "description": "string", "status": "string", "statusName": "string", "priority": "string", "priorityName": "string", "sequence": "string", "globalSortOrder": "long",
    "parentItem": "long", "parentProject": "long", "createdDate": "string", "modifiedDate": "string", "lastActivityDate": "string", "createdBy": "long", "modifiedBy": "long",
    "stepsText": "string",
}
SCHEMA_VERSION = "7"
#: Arrays within an array whose elements are still joined as text.
NESTED = 6


def scalar(record: Column, path: str, kind: str) -> Column:
    """The value at a path, or the first element if it is boxed in an array; null if absent or of another type."""
    return F.coalesce(F.try_variant_get(record, f"$.{path}[0]", kind), F.try_variant_get(record, f"$.{path}", kind))


def field_text(value: Column, depth: int = NESTED) -> Column:
    """A variant as text: strings as they are, True/False, numbers, arrays joined by ';' without nulls, objects as JSON.

    Arrays in arrays are joined alike, up to ``depth`` of them within another; what is nested deeper is JSON.
    """
    kind = F.schema_of_variant(value)
    plain = F.try_variant_get(value, "$", "string")
    out = (
        F.when(value.isNull() | (kind == "VOID"), F.lit(None).cast("string"))
        .when(kind == "BOOLEAN", F.when(F.try_variant_get(value, "$", "boolean"), "True").otherwise("False"))
        .when(kind == "STRING", plain)
    )
    if depth:
        parts = F.transform(F.try_variant_get(value, "$", "array<variant>"), lambda x: field_text(x, depth - 1))
        out = out.when(kind.startswith("ARRAY"), F.array_join(F.filter(parts, lambda p: p.isNotNull()), ";"))
    return out.when(kind.startswith("OBJECT") | kind.startswith("ARRAY"), F.to_json(value)).otherwise(plain)


def records(raw: DataFrame, column: str = "record") -> DataFrame:
    """The JSON texts as variants, in column r; texts that aren't JSON are left out."""
    return raw.withColumn("r", F.try_parse_json(F.col(column))).where("r IS NOT NULL")


def ids(raw: DataFrame) -> DataFrame:
    """The different identifiers of raw records."""
    return records(raw).select(scalar(F.col("r"), "id", "long").alias("id")).where("id IS NOT NULL").distinct()


def since(rows: DataFrame, mark: str | Column, column: str = "modifiedDate") -> DataFrame:
    """The rows at or after a mark: the delta is inclusive.  An empty mark keeps all."""
    return rows if isinstance(mark, str) and not mark else rows.where(F.col(column) >= mark)


def latest(raw: DataFrame, arrival: str | None = None, tie: str = "record") -> DataFrame:
    """One record an identifier: the last seen, by the arrival column if there is one, else by modification date; of equal
    ones that with the largest ``tie``."""
    rows = records(raw).withColumn("id", scalar(F.col("r"), "id", "long")).where("id IS NOT NULL")
    newest = F.desc(arrival) if arrival else F.desc_nulls_last(F.try_variant_get(F.col("r"), "$.modifiedDate", "string"))
    by = Window.partitionBy("id").orderBy(newest, F.desc(tie))
    return rows.withColumn("n", F.row_number().over(by)).where("n = 1").drop("n")


def last_seen(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """Of each key the row with the largest values of ``order`` (nulls are smallest).  Rows are compared before they are
    shuffled, so a key may have any share of them."""
    kept = F.max_by(F.struct(*(c for c in rows.columns if c != key)), F.struct(*order)).alias("kept")
    return rows.groupBy(key).agg(kept).select(key, "kept.*").select(*rows.columns)


def items(rows: DataFrame, types: DataFrame | None = None, picks: DataFrame | None = None) -> DataFrame:
    """The 23 columns of items.  types: id, typeKey, display; picks: id, name; both are small dimensions."""
    r = F.col("r")

    def get(path: str, kind: str = "string") -> Column:
        return F.try_variant_get(r, f"$.{path}", kind)

    def boxed_text(name: str) -> Column:
        return field_text(F.try_variant_get(r, f"$.fields.{name}", "variant"))

    # elements of a wrong kind in the steps are null structs and say nothing
    steps = F.transform(
        F.try_variant_get(r, "$.fields.testCaseSteps", "array<variant>"),
        lambda s: F.struct(*(F.try_variant_get(s, f"$.{k}", "string").alias(k) for k in ("action", "expectedResult", "notes"))),
    )
    out = rows.select(
        scalar(r, "id", "long").alias("id"), get("documentKey").alias("documentKey"), get("globalId").alias("globalId"), scalar(r, "itemType", "long").alias("itemType"),
        scalar(r, "project", "long").alias("project"), get("fields.name").alias("name"), text.strip_html(get("fields.description")).alias("description"),
        boxed_text("status").alias("status"), boxed_text("priority").alias("priority"), get("location.sequence").alias("sequence"), get("location.globalSortOrder", "long").alias("globalSortOrder"),
        get("location.parent.item", "long").alias("parentItem"), get("location.parent.project", "long").alias("parentProject"), get("createdDate").alias("createdDate"),
        get("modifiedDate").alias("modifiedDate"), get("lastActivityDate").alias("lastActivityDate"), scalar(r, "createdBy", "long").alias("createdBy"),
        scalar(r, "modifiedBy", "long").alias("modifiedBy"), text.steps_text(steps).alias("stepsText"),
    )
    out = lookup(out, types, "itemType", {"typeKey": "typeKey", "display": "typeName"}) if types is not None else out.withColumns({"typeKey": F.lit(None).cast("string"), "typeName": F.lit(None).cast("string")})
    for name in ("status", "priority"):
        label = f"{name}Name"
        if picks is None:
            out = out.withColumn(label, F.lit(None).cast("string"))
        else:
            # only the first of several options gets its label
            first = F.try_to_number(F.split(F.col(name), ";")[0], F.lit("999999999999999999")).cast("long")
            out = lookup(out.withColumn("option", first), picks, "option", {"name": label}).drop("option")
    return out.select(*(F.col(c).cast(t).alias(c) for c, t in ITEMS.items()))


def lookup(rows: DataFrame, dim: DataFrame, key: str, names: dict[str, str]) -> DataFrame:
    """Left join with a dimension (id and others) under new names; Spark broadcasts it below its own size limit."""
    small = dim.select(F.col("id").cast("long").alias(key), *(F.col(a).alias(b) for a, b in names.items())).dropDuplicates([key])
    return rows.join(small, key, "left")


def key_values(rows: DataFrame) -> DataFrame:
    """itemId, key and value of every dynamic field but the description; null values stay."""
    exploded = rows.select(scalar(F.col("r"), "id", "long").alias("itemId"), F.try_variant_get("r", "$.fields", "variant").alias("f")).where("f IS NOT NULL")
    spark = rows.sparkSession
    return spark.sql("SELECT itemId, v.key AS key, v.value AS v FROM {rows}, LATERAL variant_explode(f) AS v WHERE v.key <> 'description'", rows=exploded).select("itemId", "key", field_text(F.col("v")).alias("value"))


def option_ids(flat: DataFrame) -> DataFrame:
    """Different numbers in status and priority."""
    both = flat.select(F.explode(F.array("status", "priority")).alias("o")).select(F.explode(F.split("o", ";")).alias("o"))
    return both.where(F.col("o").rlike("^[0-9]+$")).select(F.col("o").cast("long").alias("id")).distinct()


def relationships(raw: DataFrame, types: DataFrame | None = None) -> DataFrame:
    """id, fromItem, toItem, relationshipType, relTypeName and suspect (0 or 1) of edge records."""
    r = F.col("r")
    rows = records(raw).select(
        *(scalar(r, k, "long").alias(k) for k in ("id", "fromItem", "toItem", "relationshipType")), F.coalesce(F.try_variant_get(r, "$.suspect", "boolean").cast("int"), F.lit(0)).alias("suspect")
    )
    rows = rows.where("id IS NOT NULL").dropDuplicates(["id"])
    rows = lookup(rows, types, "relationshipType", {"name": "relTypeName"}) if types is not None else rows.withColumn("relTypeName", F.lit(None).cast("string"))
    return rows.select("id", "fromItem", "toItem", "relationshipType", "relTypeName", "suspect")


def newest(rows: DataFrame, column: str, empty: object, name: str, old: Column | None = None, where: Column | None = None) -> DataFrame:
    """One row: the largest value of a column (among the rows where a condition holds), ``empty`` without any, and at
    least ``old``."""
    most = F.coalesce(F.max(F.col(column) if where is None else F.when(where, F.col(column))), F.lit(empty))
    return rows.agg((F.greatest(most, old) if old is not None else most).alias(name))


def watermark(flat: DataFrame, old: Column | None = None) -> DataFrame:
    """One row: the largest modification date, '' without any."""
    return newest(flat, "modifiedDate", "", "watermark", old, F.col("modifiedDate") != "")


def counts(tables: dict[str, DataFrame]) -> DataFrame:
    """t and n: the number of rows of each table."""
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("t"), "n") for name, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def reconciliation(local: DataFrame, server: DataFrame) -> DataFrame:
    """One row of local and server (how many identifiers either has) and deleted (those that only local has)."""
    both = local.select("id").distinct().withColumn("l", F.lit(1)).join(server.select("id").distinct().withColumn("s", F.lit(1)), "id", "full")
    return both.agg(F.count("l").alias("local"), F.count("s").alias("server"), F.count_if(F.col("l").isNotNull() & F.col("s").isNull()).alias("deleted"))


def upsert(base: DataFrame, delta: DataFrame, key: str | list[str] = "id") -> DataFrame:
    """base with the rows of delta in place of those with the same key."""
    return base.join(delta, key, "left_anti").select(*base.columns).unionByName(delta.select(*base.columns))


def without(rows: DataFrame, gone: DataFrame, *keys: str) -> DataFrame:
    """rows none of whose keys stands in gone.id."""
    for key in keys:
        rows = rows.join(gone.select(F.col("id").alias(key)), key, "left_anti")
    return rows


def among(rows: DataFrame, wanted: DataFrame, key: str, few: int = 1000) -> DataFrame:
    """As ``within``; up to ``few`` keys are constants that reach the scan, so only their row groups are read."""
    keys = [r[0] for r in wanted.select("id").where("id IS NOT NULL").limit(few + 1).collect()]
    return rows.where(F.col(key).isin(*keys)) if len(keys) <= few else within(rows, wanted.select("id").distinct(), key)


def within(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """rows whose key stands in wanted.id."""
    return rows.join(wanted.select(F.col("id").alias(key)), key, "left_semi")
