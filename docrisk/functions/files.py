"""File types and MIME types."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docrisk.functions.values import is_true

_IMAGE_SUFFIXES = [".jpg", ".jpeg", ".png", ".webp"]
_VIDEO_SUFFIXES = [".mp4", ".mov", ".avi", ".mkv", ".webm"]


def _ends_with(name: Column, suffixes: list[str]) -> Column:
    return F.coalesce(name.rlike("(?:" + "|".join(s.replace(".", r"\.") for s in suffixes) + r")\z"), F.lit(False))


def document_type(mime: Column, name: Column) -> Column:
    """pdf, image or video from MIME type or file name (in this order), else NULL."""
    m, n = F.coalesce(F.lower(mime), F.lit("")), F.coalesce(F.lower(name), F.lit(""))
    return (
        F.when((m == "application/pdf") | n.endswith(".pdf"), "pdf")
        .when(m.startswith("image/") | _ends_with(n, _IMAGE_SUFFIXES), "image")
        .when(m.startswith("video/") | _ends_with(n, _VIDEO_SUFFIXES), "video")
    )


def extension(name: Column) -> Column:
    """Lower-case extension with its dot; a leading dot alone starts no extension."""
    return F.lower(F.regexp_extract(name, r"[^/]([.][^./]*)\z", 1))


def repair_mime(doc_type: Column, mime: Column, name: Column) -> Column:
    """The MIME type a document is handled with, given its type and file name.

    The steps run in order on the running value: a statement first gets an image type and is
    turned back into a PDF only when its name says .pdf.
    """
    ext = extension(name)
    image_like = doc_type.isin("image", "statement")
    pdf_like = doc_type.isin("pdf", "statement")
    by_extension = (
        F.when(ext == ".png", "image/png").when(ext == ".webp", "image/webp").otherwise("image/jpeg")
    )
    step1 = F.when(is_true(image_like) & ~is_true(mime.startswith("image/")), by_extension).otherwise(mime)
    step2 = F.when(
        is_true(pdf_like) & ~is_true(step1.contains("pdf")) & is_true(ext == ".pdf"), "application/pdf"
    ).otherwise(step1)
    return F.when(is_true(doc_type == "video") & ~is_true(step2.startswith("video/")), "video/mp4").otherwise(step2)
