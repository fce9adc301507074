"""The search service and the command line over tables of documents and vectors."""

from __future__ import annotations

import argparse
import json
import logging
import os
import re
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarn.functions.text import snippet
from tarn.operators import search as S
from tarn.operators.embedding import hashed
from tarn.sources.shared import shared_folder

log = logging.getLogger(__name__)
SORTS = ("_score", "published_at", "popularity_score")


@dataclass
class SearchQuery:
    """Validated parameters: 1 to 500 characters, pages from 1, sizes 1 to 100, a known order."""

    q: str
    page: int = 1
    size: int = 10
    lang: str | None = None
    site: str | None = None
    sort: str = "_score"

    def __post_init__(self) -> None:
        if not 1 <= len(self.q) <= 500 or self.page < 1 or not 1 <= self.size <= 100 or self.sort not in SORTS:
            raise ValueError(f"invalid query {self}")


@dataclass
class SearchResponse:
    """A page of hits and how many there are in all."""

    total: int
    hits: list[dict]
    page: int
    size: int


#: Columns that a sort key stands for, by what is there.
SORT_COLUMNS = {"published_at": ("published_at", "fetched_at"), "popularity_score": ("popularity_score", "processing_priority")}


@dataclass
class SearchService:
    """Hybrid search over (doc, text, lang, site[, title, keywords, sort columns]) and vectors (doc, embedding).

    The index is written once to the shared folder and read from there by
    every query; ``close`` removes it.  Without vectors search is lexical, and
    only then the orders by date and by popularity apply, newest and most
    popular first, rows without a value last; with vectors the fused order
    counts.
    """

    docs: DataFrame
    vectors: DataFrame | None = None
    index: S.KeptIndex = field(init=False)
    folder: str = field(init=False)

    def __post_init__(self) -> None:
        spark = self.docs.sparkSession
        self.folder = f"{shared_folder(spark)}/service-{uuid.uuid4().hex}"
        text = {"content": F.col("text")}
        text |= {name: F.col(name) for name in ("title", "keywords") if name in self.docs.columns}
        paths = {}
        for name, write in S.index_writers(self.docs, "doc", text).items():
            paths[name] = f"{self.folder}/{name}"
            write(paths[name])
        self.index = S.open_index(spark, paths)

    def close(self) -> None:
        """Remove the index from the shared folder."""
        spark = self.docs.sparkSession
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)

    def search(self, query: SearchQuery) -> DataFrame:
        """One page of hits (doc, score, lang, site, snippet, fragments), in order."""
        terms, fuzzy = S.query_terms(query.q)
        keep = S.build_filter({k: v for k, v in (("lang", query.lang), ("site", query.site)) if v})
        inside = self.docs.where(keep).select("doc")
        hits = S.lexical(self.index, terms, S.BOOSTS, S.CROSS_BOOSTS, fuzzy).join(inside, "doc", "left_semi")
        order = [F.desc("score"), F.col("doc")]
        if self.vectors is not None:
            probe = [float(x) for x in hashed([query.q])[0]]
            near = S.knn(self.vectors.join(inside, "doc", "left_semi"), "doc", "embedding", probe, 2 * query.size)
            hits = S.rrf(S.ranked(hits, 2 * query.size, "bm25_rank"), S.ranked(near, 2 * query.size, "vec_rank"), 2 * query.size).select("doc", F.col("rrf").alias("score"))
        elif query.sort != "_score":
            by = next((c for c in SORT_COLUMNS[query.sort] if c in self.docs.columns), None)
            if by is None:
                raise ValueError(f"no column to sort by {query.sort}")
            hits = hits.join(self.docs.select("doc", F.col(by).alias("__by")), "doc")
            order = [F.col("__by").desc_nulls_last(), *order]
        page = S.page(hits, order, query.page, query.size)
        # the place on the page survives the join
        page = page.withColumn("__place", F.row_number().over(Window.orderBy(*order)))
        found = self.docs.select("doc", "lang", "site", "text").join(F.broadcast(page), "doc")
        return found.orderBy("__place").select("doc", "score", "lang", "site", snippet(F.col("text")).alias("snippet"), S.fragments(F.col("text"), terms).alias("fragments"))

    def respond(self, query: SearchQuery) -> SearchResponse:
        """``search`` as a page of rows with the number of all hits; any error gives an empty page, and is logged."""
        try:
            rows = [r.asDict() for r in self.search(query).collect()]
            return SearchResponse(self.total(query), rows, query.page, query.size)
        except Exception:
            log.exception("search failed for %r", query.q)
            return SearchResponse(0, [], query.page, query.size)

    def total(self, query: SearchQuery) -> int:
        """Hits on all pages: of the terms, and with vectors the lists that are fused."""
        terms, fuzzy = S.query_terms(query.q)
        keep = S.build_filter({k: v for k, v in (("lang", query.lang), ("site", query.site)) if v})
        inside = self.docs.where(keep).select("doc")
        hits = S.lexical(self.index, terms, S.BOOSTS, S.CROSS_BOOSTS, fuzzy).join(inside, "doc", "left_semi").select("doc")
        if self.vectors is not None:
            near = S.knn(self.vectors.join(inside, "doc", "left_semi"), "doc", "embedding", [float(x) for x in hashed([query.q])[0]], 2 * query.size)
            hits = hits.limit(2 * query.size).union(near.select("doc")).distinct()
        return hits.count()

    def suggest(self, q: str, size: int = 10) -> list[str]:
        """Terms of titles and keywords near ``q``; of the content where there are neither."""
        if not 1 <= len(q) <= 100 or not 1 <= size <= 20:
            raise ValueError("invalid suggestion query")
        fields = [f for f in ("title", "keywords") if f in self.index.fields] or ["content"]
        terms = self.index.terms.where(F.col("field").isin(*fields))
        return [r.term for r in S.suggest(terms, q.lower(), size).collect()]

    def health(self) -> dict:
        return {"status": "green" if self.docs.limit(1).count() else "yellow"}

    def stats(self) -> dict:
        """Documents and mean length of each field, as the index knows them."""
        return {f: {"documents": n, "mean_length": mean} for f, (n, mean) in self.index.fields.items()}


def expand(value, env=os.environ):
    """``${NAME:default}`` in configuration values, at any depth."""
    if isinstance(value, dict):
        return {k: expand(v, env) for k, v in value.items()}
    if isinstance(value, list):
        return [expand(v, env) for v in value]
    if isinstance(value, str):
        return re.sub(r"\$\{(\w+)(?::([^}]*))?\}", lambda m: env.get(m[1], m[2] or ""), value)
    return value


@dataclass
class Settings:
    """Limits of crawling and indexing, checked on construction."""

    concurrency: int = 10
    per_domain: int = 2
    qps: float = 1.0
    qps_overrides: dict[str, float] = field(default_factory=dict)
    max_bytes: int = 50 * 1024 * 1024
    batch: int = 5
    chunk_size: int = 8000
    chunk_overlap: int = 200
    timeout: float = 30.0
    max_retries: int = 3
    base_backoff: float = 60.0
    max_backoff: float = 3600.0
    lease: int = 3600
    heartbeat: int = 30
    limit_rates: bool = True
    rate_store: str = "shared"
    queue: str = "queue"
    store: str = "store"
    states: str = "states"

    def problems(self) -> tuple[list[str], list[str]]:
        """(errors, warnings): numbers out of range, settings that contradict each other, places that are not named."""
        errors = [f"{n} must be positive" for n in ("concurrency", "per_domain", "qps", "max_bytes", "batch", "chunk_size", "timeout", "base_backoff") if getattr(self, n) <= 0]
        errors += [f"{n} is required" for n in ("queue", "store", "states") if not getattr(self, n)]
        errors += [f"qps of {d} must be positive" for d, q in self.qps_overrides.items() if q <= 0]
        rules = {
            "rate_store is required where rates are limited": self.limit_rates and not self.rate_store,
            "per_domain must not exceed concurrency": self.per_domain > self.concurrency,
            "chunk_overlap must be less than chunk_size": self.chunk_overlap >= self.chunk_size,
            "max_retries must not be negative": self.max_retries < 0,
            "max_backoff must not be less than base_backoff": self.max_backoff < self.base_backoff,
            "heartbeat must be less than lease": self.heartbeat >= self.lease,
        }
        return errors + [r for r, broken in rules.items() if broken], ["lease is under a minute"] if self.lease < 60 else []

    def __post_init__(self) -> None:
        errors, warnings = self.problems()
        for w in warnings:
            log.warning(w)
        if errors:
            raise ValueError("invalid settings: " + "; ".join(errors))


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="tarn")
    p.add_argument("command", choices=("list", "run", "explain", "config", "health", "stats"))
    p.add_argument("name", nargs="?")
    p.add_argument("--data", default="/root/testdata/sf0.01")
    a = p.parse_args(args)
    from tarn.plans.catalog import QUERIES

    if a.command == "list":
        print(json.dumps(sorted(QUERIES)))
        return 0
    if a.command == "config":
        print(json.dumps(asdict(Settings()), indent=2))
        return 0
    spark = SparkSession.builder.appName("tarn").getOrCreate()
    if a.command in ("health", "stats"):
        d = spark.read.parquet(f"{a.data}/documents.parquet").select(F.col("doc_id").alias("doc"), "text", "lang", F.col("source").alias("site"))
        if a.command == "health":
            print(json.dumps({"status": "green" if d.limit(1).count() else "yellow"}))
        else:
            service = SearchService(d)
            print(json.dumps(service.stats()))
            service.close()
        return 0
    df = QUERIES[a.name](spark, a.data)
    df.explain("formatted") if a.command == "explain" else df.show(truncate=80)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
