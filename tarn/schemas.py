"""Record schemas, their constraints, and export."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

DDL = {
    "crawl_result": "url string, status_code int, fetched_at timestamp, html_s3_key string, error string",
    "parsed_content": "url string, title string, description string, body_text string, lang string, published_at timestamp, metadata map<string,string>, parsed_s3_key string",
    "url_state": "url_hash string, url string, domain string, state string, crawler_id string, acquired_at timestamp, ttl timestamp, last_crawled timestamp, retries int, error_message string, s3_key string, created_at timestamp, updated_at timestamp",
    "discovery_message": "domain string, priority int, max_urls int, discovery_depth int, requested_at timestamp, requester_id string",
    "crawl_message": "url string, domain string, priority int, retry_count int, enqueued_at timestamp, discovery_source string",
    "indexing_message": "url string, url_hash string, domain string, raw_s3_key string, parsed_s3_key string, status_code int, fetched_at timestamp, crawl_error string, title string, language string, published_at timestamp, content_length int, crawler_id string, processing_priority int, created_at timestamp",
    "processing_event": "event_type string, url string, url_hash string, data map<string,string>, timestamp timestamp, source string",
    "url_info": "url string, last_modified timestamp, change_frequency string, priority double, source_sitemap string",
    "text_chunk": "content string, chunk_index int, start_position int, end_position int, token_count int, language string, metadata map<string,string>",
    "search_hit": "id string, title string, url string, site string, lang string, snippet string, score double, published_at timestamp, popularity_score double",
}
STATES = ("pending", "in_progress", "done", "failed")


def schema(name: str) -> StructType:
    return StructType.fromDDL(DDL[name])


def constraints(name: str) -> dict[str, Column]:
    """Named conditions that a valid row of the record meets."""
    return {
        "url_state": {"state": F.col("state").isin(*STATES), "retries": F.col("retries") >= 0},
        "crawl_message": {"priority": F.col("priority").between(1, 10), "url": F.col("url").rlike("^https?://")},
        "discovery_message": {"priority": F.col("priority").between(1, 10)},
        "search_hit": {"score": F.col("score") >= 0, "popularity_score": F.coalesce(F.col("popularity_score") >= 0, F.lit(True))},
    }.get(name, {})


_TYPESCRIPT = {"string": "string", "int": "number", "bigint": "number", "double": "number", "float": "number", "boolean": "boolean", "timestamp": "string"}


def to_typescript(name: str) -> str:
    """The record as a TypeScript interface."""
    lines = [f"  {f.name}?: {_TYPESCRIPT.get(f.dataType.simpleString(), 'Record<string, string>')};" for f in schema(name)]
    return "\n".join([f"export interface {name.title().replace('_', '')} {{", *lines, "}"])
