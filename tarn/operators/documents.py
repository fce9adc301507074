"""Index documents and dead-letter envelopes as JSON columns, and bytes of any charset to text."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fields of an index document in their order, those left out when empty, encodings tried in turn.
REQUIRED = ("url", "url_hash", "domain", "title", "content", "content_type", "language", "fetched_at", "indexed_at", "content_length", "processing_priority", "status_code", "raw_s3_key", "parsed_s3_key")
OPTIONAL = ("embedding", "keywords", "categories")
FALLBACKS = ("utf-8", "iso-8859-1", "cp1252")
MOST_RETRIES = "max_retries_exceeded"
DEFAULTS = {"content_type": "html", "language": "ja", "raw_s3_key": "", "parsed_s3_key": ""}


def iso(at: Column) -> Column:
    """A timestamp as an ISO string with its offset from UTC, without a fraction if it is zero."""
    whole = F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss")
    return F.concat(whole, F.when(F.date_format(at, "SSSSSS") == "000000", "").otherwise(F.concat(F.lit("."), F.date_format(at, "SSSSSS"))), F.lit("+00:00"))


def index_document(fields: dict[str, Column]) -> Column:
    """The JSON document of a page: all required fields, the optional ones only if they hold something."""
    cols = [F.coalesce(fields[n], F.lit(DEFAULTS[n])).alias(n) if n in DEFAULTS and n in fields else F.lit(DEFAULTS[n]).alias(n) if n not in fields else fields[n].alias(n) for n in REQUIRED]
    cols += [F.when(F.size(fields[n]) > 0, fields[n]).alias(n) for n in OPTIONAL if n in fields]
    return F.to_json(F.struct(*cols), {"ignoreNullFields": "true"})


def dead_letter(message: Column, error: Column, error_type: Column, retry_count: Column, failed_at: Column) -> Column:
    """The envelope of a message that is out of retries: itself and why it failed."""
    why = F.struct(error.alias("error"), error_type.alias("error_type"), retry_count.alias("retry_count"), iso(failed_at).alias("failed_at"), F.lit(MOST_RETRIES).alias("failure_reason"))
    return F.to_json(F.struct(message.alias("original_message"), why.alias("failure_metadata")))


def dead_letter_attributes(message_id: Column, retry_count: Column) -> Column:
    """The attributes beside the envelope."""
    return F.struct(F.lit(MOST_RETRIES).alias("FailureReason"), F.coalesce(message_id, F.lit("unknown")).alias("OriginalMessageId"), retry_count.cast("string").alias("RetryCount"))


def decode_bytes(raw: bytes | None, content_type: str | None) -> str | None:
    """Text by the charset that the content type names, else UTF-8, else Latin-1, which never fails."""
    if raw is None:
        return None
    named = re.search(r"charset=([^;]+)", (content_type or "").lower())
    for encoding in ((named[1].strip() if named else "utf-8"), *FALLBACKS):
        try:
            return raw.decode(encoding)
        except (UnicodeDecodeError, LookupError):
            continue
    return raw.decode("utf-8", errors="ignore")


def decoded_bytes(raw: Column, content_type: Column) -> Column:
    """``decode_bytes`` over a column; valid UTF-8 that names no other charset never leaves the JVM's functions."""

    @F.pandas_udf("string")
    def run(raws: pd.Series, types: pd.Series) -> pd.Series:
        return pd.Series([decode_bytes(r, t) for r, t in zip(raws, types, strict=True)], dtype=object)

    plain = F.is_valid_utf8(raw.cast("string")) & (~F.coalesce(F.lower(content_type), F.lit("")).contains("charset=") | F.coalesce(F.lower(content_type), F.lit("")).rlike(r"charset=\s*utf-8\s*(;|$)"))
    return F.when(plain, raw.cast("string")).otherwise(run(F.when(~plain, raw), content_type))


#: Characters of a title and of an error that go to an object's metadata.
MOST_TITLE, MOST_ERROR = 200, 1000


def _said(pairs: dict[str, Column]) -> Column:
    """A map of the pairs whose value is there and not empty."""
    every = F.create_map(*[x for k, v in pairs.items() for x in (F.lit(k), v.cast("string"))])
    return F.map_filter(every, lambda k, v: v.isNotNull() & (v != ""))


def raw_metadata(url: Column, domain: Column, status: Column, fetched_at: Column, error: Column) -> Column:
    """Metadata of a page's raw object; a long error is cut."""
    return _said({"source-url": url, "content-type": F.lit("text/html"), "domain": domain, "status-code": status, "fetched-at": iso(fetched_at), "crawl-error": F.substring(error, 1, MOST_ERROR)})


def parsed_metadata(url: Column, domain: Column, language: Column, title: Column, published_at: Column) -> Column:
    """Metadata of a page's parsed object; a long title is cut, a missing language is unknown."""
    return _said({"source-url": url, "content-type": F.lit("application/json"), "domain": domain, "language": F.coalesce(F.nullif(language, F.lit("")), F.lit("unknown")), "title": F.substring(title, 1, MOST_TITLE), "published-at": iso(published_at)})


def processing_event(kind: Column, url: Column, domain: Column, at: Column, details: Column) -> Column:
    """A message about a page's way through the store (body, attributes): content_stored, processing_complete or error."""
    body = F.to_json(F.struct(kind.alias("event_type"), url.alias("url"), iso(at).alias("timestamp"), details.alias("details")))
    return F.struct(body.alias("body"), F.create_map(F.lit("EventType"), kind, F.lit("Domain"), domain).alias("attributes"))
