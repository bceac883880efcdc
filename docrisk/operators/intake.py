"""Document intake: manifest fields, file types, issuer templates, model requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docrisk import dims
from docrisk.functions.banks import canonical_bank
from docrisk.functions.files import repair_mime
from docrisk.functions.values import first_text

SUPPORTED = ["image", "pdf", "video", "statement"]
UPLOAD_NAMES = ["image", "file", "video"]


def first_value(df: DataFrame, name: str) -> Column:
    """A form field as scalar: the first element where it arrives as a list."""
    if name not in df.columns:
        return F.lit(None)
    return F.get(F.col(name), F.lit(0)) if isinstance(df.schema[name].dataType, T.ArrayType) else F.col(name)


def effective_type(given: Column, statement_mode: Column) -> Column:
    """statement when asked for, else the given type, else document."""
    return F.when(statement_mode == "true", "statement").otherwise(first_text(given, F.lit("document")))


def resolve_manifest(df: DataFrame, mode: str = "compat") -> DataFrame:
    """One row per request: doc_id, type, file_name, bank, mime, path, error.

    ``error`` is NULL for documents that can be screened.
    """
    present = [n for n in UPLOAD_NAMES if n in df.columns]
    upload = F.coalesce(*[first_value(df, n) for n in present])
    fields = df.select(
        "doc_id",
        upload.alias("_u"),
        effective_type(first_value(df, "type"), first_value(df, "statement_mode")).alias("type"),
        first_value(df, "file_name").alias("_name"),
        canonical_bank(first_value(df, "bank"), mode).alias("bank"),
    ).withColumn("file_name", first_text(F.col("_name"), F.col("_u.original_name"), F.lit("document")))
    error = F.when(F.col("_u").isNull(), dims.NO_UPLOAD).when(~F.col("type").isin(SUPPORTED), dims.UNSUPPORTED_TYPE)
    return fields.select(
        "doc_id",
        "type",
        "file_name",
        "bank",
        repair_mime(F.col("type"), F.col("_u.mime"), F.col("file_name")).alias("mime"),
        F.col("_u.path").alias("path"),
        error.alias("error"),
    )


def template_names(spark) -> DataFrame:
    """The fixed bank -> template file table (eight rows)."""
    return spark.createDataFrame(list(dims.BANK_TEMPLATES.items()), "bank string, reference string")


def attach_template(docs: DataFrame, templates: DataFrame) -> DataFrame:
    """Left join of the issuer template: receipts only, never statements or videos.

    ``templates`` holds at most one row per bank of the fixed table, so it is broadcast.
    """
    t = F.broadcast(templates.withColumnRenamed("bank", "_bank"))
    wanted = (docs["bank"] == t["_bank"]) & ~docs["type"].isin("video", "statement")
    return docs.join(t, wanted, "left").drop("_bank")


#: Templates of more bytes in all are joined by shuffle, dealt over this many copies each.
BROADCAST_BYTES, TEMPLATE_COPIES = 32 * 1024 * 1024, 64


def attach_template_content(docs: DataFrame, templates: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """Add ``template_content`` to the PDFs that have a ``reference``; other documents have none.

    ``templates`` has at most one row per bank (see ``read_templates``). Up to ``most`` bytes in all they are
    broadcast; larger ones are copied, and the documents of a template are dealt over its copies by doc_id.
    """
    wanted = F.when((F.col("type") == "pdf") & F.col("reference").isNotNull(), F.col("reference"))
    t = templates.select(F.col("reference").alias("_reference"), "template_content")
    size = t.agg(F.sum(F.length("template_content"))).first()[0] or 0
    if size <= most:
        return docs.withColumn("_reference", wanted).join(F.broadcast(t), "_reference", "left").drop("_reference")
    copies = t.withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(TEMPLATE_COPIES - 1).cast("bigint"))))
    spread = F.xxhash64("doc_id")
    # documents without a template have keys of their own, not one for all
    copy = F.when(wanted.isNotNull(), F.pmod(spread, F.lit(TEMPLATE_COPIES))).otherwise(spread)
    dealt = docs.withColumns({"_reference": F.coalesce(wanted, F.lit("")), "_copy": copy})
    return dealt.join(copies.hint("merge"), ["_reference", "_copy"], "left").drop("_reference", "_copy")


def _base64(content: Column) -> Column:
    """In one line: Spark breaks longer texts into lines of 76 characters."""
    return F.replace(F.base64(content), F.lit("\r\n"), F.lit(""))


_PART = "array<struct<kind: string, filename: string, data: string>>"


def model_requests(docs: DataFrame) -> DataFrame:
    """Model input per document: prompt id and content parts.

    ``docs`` has doc_id, type, mime, file_name, content, and for receipts reference and
    template_content; videos bring ``frames``, an ordered array of at most eight frame images.
    The template itself is attached to PDFs only; images merely name it. Where ``docs`` has an ``error``,
    it comes out too, and documents that have one ask nothing.
    """
    data_url = F.concat(F.lit("data:"), F.col("mime"), F.lit(";base64,"), _base64(F.col("content")))
    pdf_url = F.concat(F.lit("data:application/pdf;base64,"), _base64(F.col("content")))

    def part(kind: str, name: Column, data: Column) -> Column:
        return F.array(F.struct(F.lit(kind).alias("kind"), name.alias("filename"), data.alias("data")))

    nameless = F.lit(None).cast("string")
    image = part("input_image", nameless, data_url)
    pdf = part("input_file", F.col("file_name"), pdf_url)
    template = part(
        "input_file", F.col("reference"),
        F.concat(F.lit("data:application/pdf;base64,"), _base64(F.col("template_content"))),
    )
    none = F.array().cast(_PART)
    frames = (
        F.transform(
            F.col("frames"),
            lambda f: F.struct(
                F.lit("input_image").alias("kind"), nameless.alias("filename"),
                F.concat(F.lit("data:image/jpeg;base64,"), _base64(f)).alias("data"),
            ),
        )
        if "frames" in docs.columns
        else none
    )
    kind = F.col("type")
    parts = (
        F.when(kind == "statement", F.when(F.col("mime").contains("pdf"), pdf).otherwise(image))
        .when(kind == "image", image)
        .when(kind == "pdf", F.concat(pdf, F.when(F.length("template_content") > 0, template).otherwise(none)))
        .when(kind == "video", frames)
    )
    prompt = F.when(kind == "statement", "statement").when(kind == "video", "video").otherwise("receipt")
    asked = F.col("error").isNull() if "error" in docs.columns else F.lit(True)
    given = [F.col("error")] if "error" in docs.columns else []
    return docs.select(
        "doc_id", "type", "bank", "reference", F.when(asked, prompt).alias("prompt"), F.when(asked, parts).alias("parts"), *given
    )
