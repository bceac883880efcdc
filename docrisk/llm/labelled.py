"""Learning rows: labels joined to documents, and bounded samples of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(doc_id: Column, of: int) -> Column:
    """crc32 of the id as text, modulo ``of``; null ids fall to none."""
    return F.crc32(doc_id.cast("string").cast("binary")) % of


def sampled_ids(ids: DataFrame, n: int, seed: int) -> DataFrame:
    """At most ``n`` different ``doc_id``, the same at every run."""
    return ids.distinct().orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(n)


def texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Documents of a bounded sample of ids; the ids are broadcast, since the sample's size is."""
    return docs.join(F.broadcast(ids), "doc_id")
