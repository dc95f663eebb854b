"""Sources and sinks (s01-s17)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_json_table(spark: SparkSession, path: str, schema: str, defaults: dict | None = None, dates: tuple[str, ...] = ()) -> DataFrame:
    """s01: a JSON array of records; missing keys get defaults, date strings are parsed where they can be."""
    df = spark.read.schema(schema).json(path, multiLine=True)
    for name in dates:
        df = df.withColumn(name, F.col(name).try_cast("timestamp"))
    return df.fillna(defaults) if defaults else df


def read_keyed_records(spark: SparkSession, path: str, record: str) -> DataFrame:
    """s02: {key: [records]} files as rows of key, pos and the record's fields."""
    text = spark.read.text(path, wholetext=True)
    parsed = text.select(F.explode(F.from_json("value", f"map<string,array<struct<{record}>>>")).alias("key", "records"))
    return parsed.select("key", F.posexplode("records").alias("pos", "r")).select("key", "pos", "r.*")


def read_symbol_csv(spark: SparkSession, path: str) -> DataFrame:
    """s03: CSV files below one folder per symbol, as text rows with symbol and file name."""
    df = spark.read.csv(path, header=True).withColumn("_path", F.col("_metadata.file_path"))
    cols = [c for c in df.columns if c != "_path"]
    return df.select(F.element_at(F.split("_path", "/"), -2).alias("symbol"), F.element_at(F.split("_path", "/"), -1).alias("file_name"), F.lit("csv").alias("type"), F.concat_ws(", ", *[F.concat_ws(": ", F.lit(c), F.col(c)) for c in cols]).alias("text"))


def read_text_docs(spark: SparkSession, path: str) -> DataFrame:
    """s04."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file_name"), F.col("value").alias("text"))


def file_inventory(df: DataFrame, size: str, min_mb: float, k: int) -> DataFrame:
    """s05: the k largest of the files from a size on."""
    return df.where(F.col(size) >= min_mb * 1048576).orderBy(F.desc(size), "id").limit(k)


def coalesce_body(*cols: Column) -> Column:
    """s07: the first that isn't blank."""
    return F.coalesce(*[F.when(F.trim(c) != "", F.trim(c)) for c in cols])


def upload_reason(df: DataFrame, max_bytes: int = 50 * 1048576) -> DataFrame:
    return df.withColumn("reason", F.when(F.coalesce(F.trim("file_name"), F.lit("")) == "", "missing name").when(F.col("file_size") > max_bytes, "too large"))


def validate_uploads(df: DataFrame, max_bytes: int = 50 * 1048576) -> tuple[DataFrame, DataFrame]:
    """s08: accepted rows, and quarantined ones with the reason."""
    judged = upload_reason(df, max_bytes)
    return judged.where("reason is null").drop("reason"), judged.where("reason is not null")


def batch_status(df: DataFrame, batch: str, processed: str) -> DataFrame:
    """s09."""
    done = F.count(F.when(F.col(processed), 1))
    return df.groupBy(batch).agg(F.count("*").alias("total"), done.alias("processed"), (F.count("*") - done).alias("pending"), F.round(done * 100.0 / F.count("*"), 2).alias("completion"))


def export_backup(tables: dict[str, DataFrame], path: str, user_id: int | None = None) -> DataFrame:
    """s10: each table as JSON partitioned by user; returns the metadata (table, rows)."""
    meta = None
    for name, df in tables.items():
        rows = df if user_id is None else df.where(F.col("user_id") == user_id)
        rows.write.mode("overwrite").partitionBy("user_id").json(f"{path}/{name}")
        one = rows.sparkSession.read.json(f"{path}/{name}").agg(F.lit(name).alias("table"), F.count("*").alias("rows"))
        meta = one if meta is None else meta.unionByName(one)
    return meta


def upsert(base: DataFrame, delta: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """s11: the merged rows (delta wins), and a log of what was restored and updated."""
    cols = [c for c in base.columns if c != key]
    j = base.select(key, *[F.col(c).alias(f"b_{c}") for c in cols], F.lit(True).alias("in_b")).join(delta.select(key, *[F.col(c).alias(f"d_{c}") for c in cols], F.lit(True).alias("in_d")), key, "full")
    merged = j.select(key, *[F.when(F.col("in_d"), F.col(f"d_{c}")).otherwise(F.col(f"b_{c}")).alias(c) for c in cols])
    log = j.where("in_d").select(key, F.when(F.col("in_b"), "Updated").otherwise("Restored").alias("action"))
    return merged, log


def export_csv(df: DataFrame, path: str) -> None:
    """s12."""
    df.write.mode("overwrite").option("header", True).csv(path)


def append_events(df: DataFrame, path: str) -> None:
    """s13: events with a default session, appended."""
    df.withColumn("session_id", F.coalesce("session_id", F.lit("default"))).write.mode("append").parquet(path)


def corpus_with_fallback(primary: DataFrame, fallback: DataFrame, key: str, valid: str) -> DataFrame:
    """s14: primary rows, and fallback rows of the keys that have no valid primary row."""
    alive = primary.where(F.col(valid)).select(key).distinct()
    return primary.where(F.col(valid)).unionByName(fallback.join(alive, key, "left_anti"))


def render_docs(df: DataFrame, key: str, templates: dict[str, Column]) -> DataFrame:
    """s15: a sentence per template."""
    return df.select(key, F.explode(F.array(*[F.struct(F.lit(n).alias("kind"), c.alias("text")) for n, c in templates.items()])).alias("t")).select(key, "t.kind", "t.text")


#: Our column to the field of each target.
CRM_FIELDS = {
    "hubspot": {"name": "name", "description": "description", "confidence": "deal_confidence", "status": "hs_lead_status"},
    "salesforce": {"name": "Name", "description": "Description", "confidence": "Confidence__c", "status": "Status__c"},
    "pipedrive": {"name": "title", "description": "note", "confidence": "confidence_level", "status": "stage"},
}


def to_crm(df: DataFrame, target: str) -> DataFrame:
    """s16."""
    return df.select(*[F.col(a).alias(b) for a, b in CRM_FIELDS[target].items()], F.lit("dealspark").alias("origin"))


def from_crm(df: DataFrame, source: str) -> DataFrame:
    """s17."""
    back = df.select(*[F.col(b).alias(a) for a, b in CRM_FIELDS[source].items()], F.lit(source).alias("source"))
    return back.where("confidence is not null")


def chart_revenues(df: DataFrame) -> DataFrame:
    """e15: chart points labelled as revenue (or not at all), and the chart's own revenue as year 'current'; the first of
    each document and year stays, in the order of pages."""
    points = df.select("doc_id", "page", "confidence", F.posexplode("data_points").alias("pos", "p")).where(F.coalesce(F.lower("p.label"), F.lit("")).isin("", "revenue", "sales", "income"))
    rows = points.select("doc_id", "page", "pos", F.col("p.year").alias("yr"), F.col("p.value").alias("revenue"), "confidence", F.lit("chart").alias("source"))
    own = df.where("metrics.revenue is not null").select("doc_id", "page", F.lit(1_000_000).alias("pos"), F.lit("current").alias("yr"), F.regexp_replace("metrics.revenue", "[$,]", "").try_cast("double").alias("revenue"), "confidence", F.lit("metrics").alias("source"))
    w = Window.partitionBy("doc_id", "yr").orderBy("page", "pos")
    return rows.unionByName(own).withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn", "pos")


def parse_model_reply(df: DataFrame, raw: str, fields: str) -> DataFrame:
    """e19: the outermost object of a reply, typed; fields that are missing are null, a reply that can't be read keeps
    error and raw text."""
    body = F.regexp_extract(raw, r"(?s)(\{.*\})", 1)
    names = [f.name for f in T._parse_datatype_string(fields).fields]
    parsed = df.withColumn("_j", F.from_json(body, f"{fields}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    bad = (body == "") | F.col("_j._bad").isNotNull() | F.col("_j").isNull()
    return parsed.select(*df.columns, *[F.when(~bad, F.col(f"_j.{n}")).alias(n) for n in names], F.when(bad, "unreadable").alias("error"))
