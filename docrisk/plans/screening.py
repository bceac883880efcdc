"""Document screening: resolved documents and model responses to results and rejects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docrisk import dims
from docrisk.functions.scoring import suspicious
from docrisk.functions.values import first_text, non_empty
from docrisk.operators.intake import attach_template, attach_template_content, model_requests
from docrisk.operators.responses import amount_analysis, parse_responses, receipt_fields, statement_fields
from docrisk.operators.risk import score_documents
from docrisk.sources.documents import present_templates, read_templates, with_contents

RESULT = [
    "overall_risk", "risk_label", "confidence", "summary", "categories", "checks", "balance_analysis",
    "transaction_analysis", "amount_analysis", "limitations", "score", "suspicious", "evidence",
]
_CATEGORIES = "struct<" + ", ".join(f"{c}: double" for c in dims.CATEGORY_WEIGHTS) + ">"


def _is_statement() -> Column:
    return F.col("type") == "statement"


def _engine_scored() -> Column:
    """Images and PDFs take the engine's score; videos and statements keep the model's own."""
    return F.col("type").isin("image", "pdf")


def _error() -> Column:
    invalid = (
        F.when(_is_statement(), dims.INVALID_ANSWER["statement"])
        .when(F.col("type") == "video", dims.INVALID_ANSWER["video"])
        .otherwise(dims.INVALID_ANSWER["receipt"])
    )
    unanswered = F.when(F.coalesce(F.col("output_text"), F.lit("")) == "", dims.EMPTY_ANSWER).otherwise(invalid)
    return F.coalesce(F.col("error"), F.when(F.col("response").isNull(), unanswered))


def screen_documents(documents: DataFrame, templates: DataFrame | None = None) -> DataFrame:
    """Results and error rows for resolved documents.

    ``documents`` has doc_id, type, file_name, bank, error (see ``resolve_manifest``) and
    output_text, the model's answer. Error rows have success = false and an error; everything
    else has score, label, categories and evidence. Scores and categories that the model gave stay as
    it gave them. Where ``documents`` has the sampled ``frames`` of videos, they come out as
    ``video_frames``. All types go through one pass: the answer is parsed once and nothing is exchanged.
    """
    if templates is not None:
        documents = attach_template(documents, templates.select("bank", "reference"))
    else:
        documents = documents.withColumn("reference", F.lit(None).cast("string"))
    parsed = parse_responses(documents).withColumn("_error", _error())
    receipts = receipt_fields(
        parsed.withColumn("_receipt", F.when(~_is_statement(), F.col("response"))), "_receipt", shared="response"
    )
    fields = statement_fields(
        receipts.withColumn("_statement", F.when(_is_statement(), F.col("response"))), "_statement"
    )
    scored = score_documents(fields)
    note = first_text(
        F.col("amount.evidence"),
        F.col("summary"),
        F.when(F.col("type") == "video", dims.EVIDENCE_DEFAULT["video"]).otherwise(dims.EVIDENCE_DEFAULT["receipt"]),
    )
    engine = _engine_scored()
    score = F.when(engine, F.col("overall_risk").cast("double")).otherwise(F.col("model_risk"))
    columns = {
        "score": score,
        "suspicious": suspicious(score),
        "overall_risk": F.when(engine, F.col("overall_risk").cast("double")).otherwise(F.col("model_risk")),
        "risk_label": F.when(engine, F.col("risk_label")).otherwise(F.col("model_label")),
        "categories": F.when(engine, F.col("categories").cast(_CATEGORIES)).otherwise(F.col("model_categories")),
        "checks": F.when(~_is_statement(), F.col("checks")),
        "balance_analysis": F.when(_is_statement(), F.col("balance_analysis")),
        "transaction_analysis": F.when(_is_statement(), F.col("transaction_analysis")),
        "amount_analysis": F.when(~_is_statement(), amount_analysis(F.col("response"))),
        "evidence": F.when(_is_statement(), F.col("evidence_list")).otherwise(F.array(note)),
    }
    merged = scored.withColumns(columns)
    ok = F.col("_error").isNull()
    return merged.select(
        "doc_id", "type", "file_name",
        *[F.when(ok, F.col(c)).alias(c) for c in ("bank", "reference", *RESULT)],
        *([F.when(ok & (F.col("type") == "video"), F.col("frames")).alias("video_frames")] if "frames" in documents.columns else []),
        ok.alias("success"), F.col("_error").alias("error"),
    )


def screen_requests(manifest: DataFrame, answers: DataFrame, templates: DataFrame | None = None) -> DataFrame:
    """``screen_documents`` for a resolved manifest and a table of answers (doc_id, output_text).

    A document that was sent but never answered comes out as an error row.
    """
    answered = answers.select("doc_id", non_empty(F.col("output_text")).alias("output_text"))
    return screen_documents(manifest.join(answered, "doc_id", "left"), templates)


def requests_from_files(resolved: DataFrame, spark: SparkSession, files: str, templates: str) -> DataFrame:
    """What the model is asked for each document of a resolved manifest: see ``model_requests``.

    Contents come from the files under ``files``, templates from those under ``templates``; a template that is
    missing or empty is no reference. A document without a file to read comes out with its error.
    """
    named = attach_template(resolved, present_templates(spark, templates))
    return model_requests(attach_template_content(with_contents(named, spark, files), read_templates(spark, templates)))
