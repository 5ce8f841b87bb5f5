"""Readers and writers: queue records, envelopes, transcripts, manifests, rejects, sinks, table bootstrap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import schemas as S
from tessera.functions.scalars import contact_label, contact_name, truthy, uuid5, workflow_id

#: What the event filter lets through.
DETAIL_TYPES = ["EnvelopeV1.transcript", "EnvelopeV1.note", "EnvelopeV1.email", "EnvelopeV1.meeting"]


def parsed(df: DataFrame, body: str = "body") -> DataFrame:
    """Every queue record as an envelope with its body, and the ``reason`` why it is none."""
    event = F.from_json(F.col(body), S.struct(S.RECORD), {"mode": "PERMISSIVE"})
    rows = df.select(F.col(body).alias("body"), event.alias("_e"), F.get_json_object(body, "$").isNull().alias("_bad"), F.get_json_object(body, "$.detail").isNull().alias("_bare"))
    reason = F.when(F.col("_bad"), "invalid JSON").when(F.col("_bare"), "missing detail")
    return rows.select("_e.detail.*", F.col("_e.detail-type").alias("detail_type"), F.col("_e.source").alias("event_source"), reason.alias("reason"), "body")


def parse_records(df: DataFrame, body: str = "body") -> tuple[DataFrame, DataFrame]:
    """(envelopes, rejects) of queue records; a reject has its body and reason."""
    rows = parsed(df, body)
    return rows.where("reason is null").drop("reason", "body"), rows.where("reason is not null").select(F.col("body").alias(body), "reason")


def checked(df: DataFrame, body: str = "body") -> DataFrame:
    """Every queue record once, parsed and validated, with its reason (null for a good one); one pass over the records,
    to be filtered after it is kept."""
    rows = parsed(df, body)
    return rows.withColumn("reason", F.coalesce("reason", invalid()))


def validate(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, rejects with reason): required fields, enumerations, and a tenant, account and interaction id."""
    marked = df.withColumn("reason", invalid())
    return marked.where(F.col("reason").isNull()).drop("reason"), marked.where(F.col("reason").isNotNull())


def invalid() -> Column:
    """Why an envelope is not valid, else null."""
    reason = F.lit(None).cast("string")
    for field in ("account_id", "tenant_id", "user_id", "interaction_type", "timestamp", "source"):
        empty = F.col(field).isNull() if field == "timestamp" else ~truthy(F.col(field))
        reason = F.when(empty, f"missing {field}").otherwise(reason)
    known = (("interaction_type", S.INTERACTION_TYPES), ("source", S.SOURCE_TYPES))
    for field, allowed in known:
        reason = F.coalesce(reason, F.when(~F.col(field).isin(allowed), f"unknown {field}"))
    return F.coalesce(reason, F.when(~F.coalesce(F.col("content.format"), F.lit("plain")).isin(S.CONTENT_FORMATS), "unknown format"), F.when(F.col("content.text").isNull(), "missing text"))


def event_filter(df: DataFrame, sources: list[str], detail_types: list[str] | None = None) -> DataFrame:
    return df.where(F.col("event_source").isin(sources) & F.col("detail_type").isin(detail_types or DETAIL_TYPES))


def to_interaction(df: DataFrame) -> DataFrame:
    """Envelope to interaction; a missing id becomes a name-based one, so a replay gives the same."""
    made = uuid5(F.concat_ws(":", F.lit("interaction"), "tenant_id", "account_id", F.coalesce("trace_id", F.lit("")), F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.sha2("content.text", 256)))
    return df.select("tenant_id", F.coalesce("interaction_id", made).alias("interaction_id"), "account_id", "interaction_type", F.col("extras.meeting_title").alias("title"), F.col("content.text").alias("content_text"), "timestamp", "source", "trace_id")


def extras(df: DataFrame) -> DataFrame:
    """Typed accessors of the extras, lists never null."""
    contacts = F.coalesce("extras.contacts", F.array().cast(S.CONTACT))
    return df.withColumns({"opportunity_id": F.col("extras.opportunity_id"), "contact_ids": F.coalesce("extras.contact_ids", F.array().cast("array<string>")), "contact_names": F.transform(contacts, contact_name), "contact_labels": F.transform(contacts, contact_label), "duration_seconds": F.col("extras.duration_seconds")})


def owner_override(items: DataFrame) -> DataFrame:
    """Items the recording user owns get that user's name."""
    mine = truthy(F.col("user_name")) & F.col("is_user_owned") & (F.col("owner") != F.col("user_name"))
    return items.withColumn("_mine", F.coalesce(mine, F.lit(False))).withColumn("owner", F.when(F.col("_mine"), F.col("user_name")).otherwise(F.col("owner"))).withColumn("owner_type", F.when(F.col("_mine"), "named").otherwise(F.col("owner_type"))).drop("_mine")


def workflows(df: DataFrame, pipelines: tuple[str, ...] = ("items", "deals")) -> DataFrame:
    """One row for each pipeline of each envelope with an interaction id; repeated deliveries collapse."""
    rows = df.where(truthy(F.col("interaction_id"))).withColumn("pipeline", F.explode(F.array(*[F.lit(p) for p in pipelines])))
    ids = F.lit(None).cast("string")
    for p in pipelines:
        ids = F.when(F.col("pipeline") == p, workflow_id(p, F.col("interaction_id"))).otherwise(ids)
    return rows.withColumn("workflow_id", ids).dropDuplicates(["workflow_id"])


def read_envelopes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(S.struct(S.ENVELOPE)).json(path)


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """One row for each transcript of a batch file, in sequence."""
    rows = spark.read.schema(S.struct(S.TRANSCRIPTS)).option("multiLine", True).json(path)
    return rows.select("tenant_id", "account_id", "account_name", F.explode("transcripts").alias("t")).select("tenant_id", "account_id", "account_name", "t.*").orderBy("account_id", "sequence")


def by_manifest(rows: DataFrame, manifest: DataFrame, key: str, order: Column) -> DataFrame:
    """The rows that a manifest names, in order."""
    return rows.join(manifest.select(key).distinct(), key, "left_semi").orderBy(order)


#: Sets the tenant of a database session before anything else runs in it.
TENANT = "SET app.tenant_id = {}"


def read_jdbc(spark: SparkSession, url: str, table: str, tenant: str | None = None, session: str = TENANT, **options: str) -> DataFrame:
    """A relational table; connection parameters that the driver does not know are removed, the tenant is set first."""
    reader = spark.read.format("jdbc").option("url", clean_url(url)).option("dbtable", table).options(**options)
    if tenant is not None:
        reader = reader.option("sessionInitStatement", session.format(quoted(tenant)))
    return reader.load()


def write_jdbc(df: DataFrame, url: str, table: str, tenants: list[str] | None = None, mode: str = "append", session: str = TENANT, **options: str) -> None:
    """Append rows to a relational table; with ``tenants``, one write for each, in a session of that tenant."""
    for tenant in tenants if tenants is not None else [None]:
        rows = df if tenant is None else df.where(F.col("tenant_id") == tenant)
        writer = rows.write.format("jdbc").option("url", clean_url(url)).option("dbtable", table).options(**options)
        if tenant is not None:
            writer = writer.option("sessionInitStatement", session.format(quoted(tenant)))
        writer.mode(mode).save()


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def clean_url(url: str, drop: tuple[str, ...] = ("channel_binding", "sslmode")) -> str:
    base, _, query = url.partition("?")
    kept = [p for p in query.split("&") if p and p.split("=")[0] not in drop]
    return base + ("?" + "&".join(kept) if kept else "")


def deal_events(results: DataFrame, enabled: bool = True) -> DataFrame:
    """One JSON event for each run that created or merged a deal and has an interaction id."""
    rows = results.where(truthy(F.col("interaction_id")) & (F.size("created") + F.size("merged") > 0) & F.lit(enabled))
    return rows.select(F.col("interaction_id").alias("key"), F.to_json(F.struct("tenant_id", "account_id", "interaction_id", "created", "merged")).alias("value"))


def bootstrap(spark: SparkSession, path: str) -> list[str]:
    """Create the empty tables that are missing; existing ones stay."""
    made = []
    jvm = spark._jvm
    for name, ddl in {**S.TABLES, **dict.fromkeys(S.EDGES, S.EDGE)}.items():
        where = jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
        if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
            spark.createDataFrame([], S.struct(ddl)).write.parquet(f"{path}/{name}")
            made.append(name)
    return made


def missing(found: list[str]) -> list[str]:
    """Expected tables that are not there."""
    return sorted({*S.TABLES, *S.EDGES} - set(found))


def rejected_duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that are not unique."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > 1)


def split_items(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new items, status updates); an item that does not say counts as new."""
    update = F.coalesce(F.col("is_status_update"), F.lit(False))
    return items.where(~update), items.where(update)


def text_envelopes(texts: DataFrame, tenant: str, account: str, user: str, kind: str = "note", source: str = "api") -> DataFrame:
    """Raw texts (text, timestamp) as envelopes of one tenant and account, without contacts or an interaction id."""
    values = {"schema_version": F.lit("1.0"), "tenant_id": F.lit(tenant), "user_id": F.lit(user), "interaction_type": F.lit(kind), "content": F.struct(F.col("text"), F.lit("plain").alias("format")), "timestamp": F.col("timestamp").cast("timestamp"), "source": F.lit(source), "account_id": F.lit(account)}
    return texts.select(*[values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in S.struct(S.ENVELOPE)])


def dispatch(envelopes: DataFrame, pipelines: dict) -> dict[str, dict]:
    """Run every pipeline (name to a function of the envelopes) on its own; a failure of one is told and does not stop
    the others. The flags any, both (all) and overall go under "summary"."""
    out: dict[str, dict] = {}
    for name, run in pipelines.items():
        try:
            out[name] = {"ok": True, "result": run(envelopes), "error": None}
        except Exception as e:  # noqa: BLE001  each pipeline fails for itself
            out[name] = {"ok": False, "result": None, "error": str(e) or type(e).__name__}
    oks = [x["ok"] for x in out.values()]
    out["summary"] = {"any": any(oks), "both": all(oks), "overall": "success" if all(oks) else "partial" if any(oks) else "failure"}
    return out


def healthy(spark: SparkSession, paths: dict[str, str]) -> dict[str, bool]:
    """Whether Spark answers and each table can be read."""
    out = {"spark": spark.range(1).count() == 1}
    for name, path in paths.items():
        try:
            spark.read.parquet(path).limit(1).count()
            out[name] = True
        except Exception:  # noqa: BLE001  whatever stands in the way, it is not healthy
            out[name] = False
    return out


#: How a step's rows are written as JSON and read again: nulls and microseconds stay.
CODEC = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


def json_row(columns: list[str]) -> Column:
    """Columns as one JSON object that keeps nulls and every type that ``typed_row`` names."""
    return F.to_json(F.struct(*[F.col(f"`{c}`") for c in columns]), CODEC | {"ignoreNullFields": "false"})


def typed_row(text: Column, ddl: str) -> Column:
    """The struct that ``json_row`` wrote."""
    return F.from_json(text, S.struct(ddl), CODEC)


def encoded(df: DataFrame, step: str) -> DataFrame:
    """The rows of a step as (step, output), output being JSON."""
    return df.select(F.lit(step).alias("step"), json_row(df.columns).alias("output"))


def decoded(steps: DataFrame, step: str, ddl: str) -> DataFrame:
    """The rows of a step as they were encoded."""
    return steps.where(F.col("step") == step).select(typed_row(F.col("output"), ddl).alias("r")).select("r.*")
