"""Bytes of pages to text by what HTTP, the document and the bytes themselves say of their encoding.

What is declared is read as columns from the header and from the document's first bytes. Pages that are declared as UTF-8, or declare nothing, and
are valid UTF-8 need no more than a cast; only the others go to Python, which knows all other encodings.
"""

from __future__ import annotations

import codecs
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Bytes of a document in which it declares its encoding, marks at its beginning with what they stand for (longest first), the last resort.
WINDOW = 4096
MARKS = [("FFFE0000", "utf-32-le"), ("0000FEFF", "utf-32-be"), ("EFBBBF", "utf-8-sig"), ("FFFE", "utf-16-le"), ("FEFF", "utf-16-be")]
LAST = "cp1252"
_META = r"(?is)<meta\b[^>]*?\bcharset\s*=\s*[\"']?\s*([\w.:-]+)"
_RESULT = pa.struct([("text", pa.string()), ("used", pa.string()), ("fallback_used", pa.bool_()), ("replacement_characters", pa.int64()), ("attempts", pa.list_(pa.string()))])


def declared_http(content_type: Column) -> Column:
    """The charset of a Content-Type header in lower case, without quotes; null without one."""
    c = F.lower(F.regexp_extract(content_type, r"(?i);\s*charset\s*=\s*[\"']?\s*([^\"';]+?)\s*[\"']?\s*(?:;|$)", 1))
    return F.when(c != "", c)


def declared_document(payload: Column) -> Column:
    """What the document says: a mark at its beginning before a meta element in its first ``WINDOW`` bytes; null if it says nothing."""
    start, head = F.hex(F.substring(payload, 1, 4)), F.decode(F.substring(payload, 1, WINDOW), "ISO-8859-1")
    meta = F.lower(F.regexp_extract(head, _META, 1))
    return F.coalesce(*[F.when(start.startswith(mark), name) for mark, name in MARKS], F.when(meta != "", meta))


def decode_bytes(payload: bytes, http: str | None, document: str | None) -> tuple[str, str, bool, int, list[str]]:
    """Text, encoding used, whether nothing declared could be used, replaced bytes, and what was tried in vain."""
    attempts = []
    for label, name, fallback in (("http", http, False), ("document", document, False), ("fallback", "utf-8", True)):
        if name is None:
            continue
        try:
            codec = codecs.lookup(name).name
            return payload.decode(codec), codec, fallback, 0, attempts
        except LookupError:
            attempts.append(f"{label}:{name} (unknown codec)")
        except (UnicodeError, ValueError) as e:
            attempts.append(f"{label}:{codec} ({type(e).__name__})")
    text = payload.decode(LAST, errors="replace")
    return text, LAST, True, text.count("�"), attempts


@F.arrow_udf(T.StructType([
    T.StructField("text", T.StringType()), T.StructField("used", T.StringType()), T.StructField("fallback_used", T.BooleanType()), T.StructField("replacement_characters", T.LongType()),
    T.StructField("attempts", T.ArrayType(T.StringType())),
]))
def _decoded(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    names = [f.name for f in _RESULT]
    for payload, http, document in batches:
        rows = zip(payload.to_pylist(), http.to_pylist(), document.to_pylist(), strict=True)
        yield pa.array([None if p is None else dict(zip(names, decode_bytes(p, h, d), strict=True)) for p, h, d in rows], _RESULT)


def decoded(pages: DataFrame, payload: str = "payload", content_type: str = "content_type") -> DataFrame:
    """``pages`` with ``declared_http``, ``declared_document``, ``text``, ``used``, ``fallback_used``, ``replacement_characters``, ``attempts`` and ``lossy``.

    HTTP's word is tried before the document's, strictly; then UTF-8, strictly; then the last resort, with U+FFFD for bytes it doesn't have. ``attempts`` lists what
    was tried in vain and why. A null payload gives nulls. Columns of these names are replaced.
    """
    p = pages.withColumns({"declared_http": declared_http(F.col(content_type)), "declared_document": declared_document(F.col(payload))})
    http, document, raw = F.col("declared_http"), F.col("declared_document"), F.col(payload)
    plain = F.coalesce(http, document, F.lit("utf-8")).isin("utf-8", "utf8") & F.coalesce(document != "utf-8-sig", F.lit(True)) & F.is_valid_utf8(raw.cast("string"))
    p = p.withColumn("__plain", F.coalesce(plain, F.lit(False)))
    hard = F.when(~F.col("__plain"), raw)
    p = p.withColumn("__d", _decoded(hard, http, document))
    pick = lambda easy, name: F.when(F.col("__plain"), easy).otherwise(F.col(f"__d.{name}"))
    return p.withColumns({
        "text": pick(raw.cast("string"), "text"), "used": pick(F.lit("utf-8"), "used"), "fallback_used": pick(http.isNull() & document.isNull(), "fallback_used"),
        "replacement_characters": pick(F.lit(0).cast("long"), "replacement_characters"), "attempts": pick(F.array().cast("array<string>"), "attempts"),
    }).withColumn("lossy", F.col("replacement_characters") > 0).drop("__plain", "__d")
