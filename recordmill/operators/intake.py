"""Which submitted documents are taken, and under which id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordmill.functions.text import has_text
from recordmill.schemas import DOC_TYPES, FOLDER_TYPES

# what a rejected document is told
REASON_TEXT = {
    "extension": "Only .txt files are accepted",
    "encoding": "File read error: not valid UTF-8",
    "blank": "Document is empty",
    "doc_type": "Unknown document type",
}


def valid_utf8(content: Column) -> Column:
    return F.coalesce(F.is_valid_utf8(content.cast("string")), F.lit(False))


def decode(content: Column) -> Column:
    """Text of valid UTF-8 bytes, null otherwise."""
    return F.try_validate_utf8(content.cast("string"))


def canonical_type(doc_type: Column) -> Column:
    """Folder names (plural) to document types; other values stay."""
    result = doc_type
    for folder, name in FOLDER_TYPES.items():
        result = F.when(doc_type == folder, F.lit(name)).otherwise(result)
    return result


def reject_reason(filename: Column, text: str, doc_type: Column, content: Column | None = None) -> Column:
    """First reason to reject a document, null to take it. Order: extension, encoding, blank, type.

    A null ``filename`` means the text was submitted directly. ``text`` names a column.
    """
    readable = F.lit(True) if content is None else valid_utf8(content)
    return (
        F.when(filename.isNotNull() & ~filename.endswith(".txt"), F.lit("extension"))
        .when(~readable, F.lit("encoding"))
        .when(~has_text(text), F.lit("blank"))
        .when(~F.coalesce(doc_type.isin(*DOC_TYPES), F.lit(False)), F.lit("doc_type"))
    )


def default_doc_id(doc_id: Column, doc_type: Column, text: Column, filename: Column | None = None) -> Column:
    """The given id; else the upload's name without ``.txt``; else type and content hash.

    The hash takes the place of a submission time, which collides when many
    documents arrive at once.
    """
    named = F.lit(None).cast("string") if filename is None else F.replace(filename, F.lit(".txt"), F.lit(""))
    return F.coalesce(
        F.nullif(doc_id, F.lit("")), F.nullif(named, F.lit("")),
        F.concat(F.coalesce(doc_type, F.lit("None")), F.lit("_"), F.sha2(text, 256)),
    )


def discovery_count(docs: DataFrame) -> DataFrame:
    """Documents per known type, zero for a type without any."""
    types = docs.sparkSession.range(1).select(F.explode(F.array(*[F.lit(t) for t in DOC_TYPES])).alias("doc_type"))
    counts = docs.groupBy("doc_type").agg(F.count(F.lit(1)).alias("documents"))
    return types.join(counts, "doc_type", "left").select(
        "doc_type", F.coalesce("documents", F.lit(0)).cast("bigint").alias("documents")
    )
