"""Search over ``documents`` and ``embeddings``."""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tarn.operators import ivf, segments
from tarn.operators import search as S
from tarn.operators import vectors as V
from tarn.plans.registry import query, table
from tarn.sources.shared import kept_tables, shared_folder

TERMS = ["the", "tion", "erthe", "und", "que"]
VECTOR = 0
TOK = "regexp_extract_all(lower(text), '([\\p{L}\\p{N}_]+)')"
POSTINGS = f"tk as (select doc_id as doc, {TOK} as t from documents), p as (select doc, term, count(*) as tf from (select doc, unnest(t) as term from tk) group by 1, 2), l as (select doc, len(t) as len from tk where len(t) > 0), f as (select count(*) as n, avg(len) as mean from l)"
IN = "(" + ", ".join(f"'{t}'" for t in TERMS) + ")"
BM25 = f"""{POSTINGS}, w as (select * from p where term in {IN}), d as (select term, count(*) as df from w group by 1),
 b as (select w.doc, sum(3.0 * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.2 * (0.25 + 0.75 * len / mean))) as score from w join d using (term) join l using (doc) cross join f group by 1)"""
COSINE = f"v as (select e.vec_id as doc, list_cosine_similarity(cast(e.embedding as double[]), cast((select embedding from embeddings where vec_id = {VECTOR}) as double[])) as score from embeddings e)"
#: Letters beyond ASCII of the tables' languages and one-byte stand-ins, for an engine whose edit distance counts bytes.
ACCENTED, PLAIN = "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿß", "ABCDEFGHIJKLMNOPQRSTUVWXYZ!#$%&;"
LEV = f"levenshtein(translate(term, '{ACCENTED}', '{PLAIN}'), asked)"
FIELDS = f"""fd as (select doc_id as doc, 'title' as field, {TOK.replace("text", "split_part(text, chr(10), 1)")} as t from documents union all
 select doc_id, 'content', {TOK} from documents union all select doc_id, 'keywords', {TOK.replace("text", "concat_ws(' ', lang, source)")} from documents),
 fp as (select doc, field, term, count(*) as tf from (select doc, field, unnest(t) as term from fd) group by 1, 2, 3), fl as (select doc, field, len(t) as len from fd where len(t) > 0),
 fs as (select field, count(*) as n, avg(len) as mean from fl group by 1), fv as (select field, term, count(*) as df from fp group by 1, 2)"""
ASKED = "(values " + ", ".join(f"('{t}')" for t in TERMS) + ") a(asked)"
EXPANDED = f"""ex as (select *, row_number() over (partition by asked, field order by d, df desc, term) as k from (select asked, field, term, df, {LEV} as d from fv, {ASKED} where substr(term, 1, 1) = substr(asked, 1, 1))
 where d <= case when length(asked) < 3 then 0 when length(asked) <= 5 then 1 else 2 end), xt as (select asked, field, term, df, 1 - d / least(length(term), length(asked)) as weight from ex where k <= 50)"""
MULTI = f"""{FIELDS}, {EXPANDED}, hit as (select fp.doc, xt.asked, fp.field, xt.term, xt.df, weight, n, tf / (tf + 1.2 * (0.25 + 0.75 * len / mean)) as part from fp join xt using (field, term) join fl on fl.doc = fp.doc and fl.field = fp.field join fs on fs.field = fp.field),
 s1 as (select doc, sum(case field when 'title' then 3.0 when 'content' then 1.0 else 2.0 end * weight * ln(1 + (n - df + 0.5) / (df + 0.5)) * part) as s from hit group by 1),
 bl as (select term, max(df) as bdf from fv where term in {IN} group by 1),
 s2 as (select doc, sum(best) as s from (select doc, term, max(case field when 'title' then 2.0 else 1.0 end * ln(1 + (greatest(n, bdf) - bdf + 0.5) / (bdf + 0.5)) * part) as best from hit join bl using (term) where asked = term group by 1, 2) group by 1),
 b as (select doc, s1.s + 0.5 * coalesce(s2.s, 0) as score from s1 left join s2 using (doc))"""
FUSED = f"""with {MULTI}, {COSINE}, x as (select doc, row_number() over (order by round(score, 9) desc, doc) as bm25_rank from b order by bm25_rank limit 20),
 y as (select doc, row_number() over (order by round(score, 9) desc, doc) as vec_rank from v where doc in (select doc_id from documents) order by vec_rank limit 20),
 z as (select coalesce(x.doc, y.doc) as doc, bm25_rank, vec_rank, 1.0 / (60 + coalesce(bm25_rank, (select max(bm25_rank) from x) + 1)) + 1.0 / (60 + coalesce(vec_rank, (select max(vec_rank) from y) + 1)) as rrf from x full outer join y on x.doc = y.doc)"""


def index(spark, sf_dir):
    return S.build_index(table(spark, sf_dir, "documents"), "doc_id", {"content": F.col("text")})


#: The index last opened by this application, by name: its places and what ``open_index`` made of them.
_opened: dict[str, tuple[tuple, object]] = {}


def _open(spark, name: str, paths: dict[str, str], how):
    mark = (spark.sparkContext.applicationId, *paths.values())
    if _opened.get(name, (None,))[0] != mark:
        _opened[name] = mark, how(spark, paths)
    return _opened[name][1]


def kept(spark, sf_dir) -> S.KeptIndex:
    """The index of title (the first line), content and keywords (language and source), written once per version of the table."""

    def build():
        fields = {"title": F.split_part("text", F.lit("\n"), F.lit(1)), "content": F.col("text"), "keywords": F.concat_ws(" ", "lang", "source")}
        return S.index_writers(table(spark, sf_dir, "documents"), "doc_id", fields)

    return _open(spark, "index", kept_tables(spark, "index", f"{sf_dir}/documents.parquet", build), S.open_index)


def kept_vectors(spark, sf_dir) -> ivf.Index:
    """The index of all vectors, written once per version of the table."""
    paths = kept_tables(spark, "vectors", f"{sf_dir}/embeddings.parquet", lambda: ivf.writers(table(spark, sf_dir, "embeddings"), "vec_id", "embedding"))
    return _open(spark, "vectors", paths, ivf.open_index)


def kept_document_vectors(spark, sf_dir) -> ivf.Index:
    """The index of the vectors that have a document."""

    def build():
        known = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"))
        return ivf.writers(table(spark, sf_dir, "embeddings").join(known, "vec_id", "left_semi"), "vec_id", "embedding")

    return _open(spark, "document-vectors", kept_tables(spark, "document-vectors", f"{sf_dir}/embeddings.parquet", build), ivf.open_index)


def probe(spark, sf_dir) -> list[float]:
    """The query's vector: one row by key, as an embedding model would return it."""
    row = table(spark, sf_dir, "embeddings").where(F.col("vec_id") == VECTOR).select("embedding").first()
    return list(row.embedding) if row else []


@query("postings", f"with {POSTINGS} select doc, term, tf from p")
def postings(spark, sf_dir):
    return index(spark, sf_dir).postings.select("doc", "term", "tf")


@query("field_stats", f"with {POSTINGS} select n, round(mean, 6) as mean_length, (select count(distinct term) from p) as n_terms from f")
def field_stats(spark, sf_dir):
    i = index(spark, sf_dir)
    terms = i.terms.agg(F.count(F.lit(1)).alias("n_terms")).withColumn("field", F.lit("content"))
    return i.fields.join(terms, "field").select("n", F.round("mean", 6).alias("mean_length"), "n_terms")


@query("term_frequencies", f"with {POSTINGS} select term, count(*) as df from p group by 1 order by df desc, term limit 100")
def term_frequencies(spark, sf_dir):
    return index(spark, sf_dir).terms.select("term", "df").orderBy(F.desc("df"), "term").limit(100)


def scores(spark, sf_dir):
    return S.lexical(kept(spark, sf_dir), TERMS, {"content": 3.0}).select("doc", F.round("score", 9).alias("score"))


def multi(spark, sf_dir):
    """The full lexical query: boosted fields, their cross-fields clause, terms within the automatic edit distance."""
    return S.lexical(kept(spark, sf_dir), TERMS, S.BOOSTS, S.CROSS_BOOSTS, fuzzy=True).select("doc", F.round("score", 9).alias("score"))


@query("bm25_multi_field", f"with {MULTI} select doc, round(score, 5) as score from b order by round(score, 9) desc, doc limit 50")
def bm25_multi_field(spark, sf_dir):
    return multi(spark, sf_dir).orderBy(F.desc("score"), "doc").limit(50).select("doc", F.round("score", 5).alias("score"))


@query("bm25_scan_scores", f"with {BM25} select doc, round(score, 6) as score from b")
def bm25_scan_scores(spark, sf_dir):
    """The same scores as ``bm25_scores`` where no index is kept: two scans of the texts."""
    found = S.bm25_scan(table(spark, sf_dir, "documents"), "doc_id", {"content": (F.col("text"), 3.0)}, TERMS)
    return found.select("doc", F.round("score", 6).alias("score"))


@query("bm25_scores", f"with {BM25} select doc, round(score, 6) as score from b")
def bm25_scores(spark, sf_dir):
    return scores(spark, sf_dir).select("doc", F.round("score", 6).alias("score"))


@query("bm25_index_scores", f"with {BM25} select doc, round(score, 6) as score from b")
def bm25_index_scores(spark, sf_dir):
    """The same scores from the inverted index."""
    return S.bm25(index(spark, sf_dir), TERMS, {"content": 3.0}).select("doc", F.round("score", 6).alias("score"))


LIVE = BM25.replace("from documents)", "from documents where lang <> 'es')", 1)


@query("segment_scores", f"with {LIVE} select doc, round(score, 6) as score from b")
def segment_scores(spark, sf_dir):
    """An index that went through changes: old texts in four batches, all replaced, a merge, one language deleted; scores as of the live documents."""
    d = table(spark, sf_dir, "documents")
    index = segments.SegmentedIndex(spark, f"{shared_folder(spark)}/segments-{uuid.uuid4().hex}")
    for k in range(4):
        index.add(d.where(F.col("doc_id") % 4 == k), "doc_id", {"content": F.concat_ws(" ", "source", "lang", F.substring("text", 1, 200))})
    index.add(d, "doc_id", {"content": F.col("text")})
    index.merge()
    index.delete(d.where("lang = 'es'"), "doc_id")
    return S.lexical(index.view(), TERMS, {"content": 3.0}).select("doc", F.round("score", 6).alias("score"))


@query(
    "segment_counts",
    "with n as (select count(*) as n, cast(sum(case when lang = 'es' then 1 else 0 end) as bigint) as es from documents) select 'first' as batch, n as indexed, cast(0 as bigint) as replaced, cast(0 as bigint) as deleted, cast(0 as bigint) as missing from n union all select 'second', n, n, 0, 0 from n union all select 'deletes', 0, 0, es, 0 from n union all select 'deletes again', 0, 0, 0, es from n",
)
def segment_counts(spark, sf_dir):
    """What every batch of changes did: items indexed, replaced, deleted, missing."""
    d = table(spark, sf_dir, "documents")
    index = segments.SegmentedIndex(spark, f"{shared_folder(spark)}/segments-{uuid.uuid4().hex}")
    gone = d.where("lang = 'es'")
    content = {"content": F.col("source")}
    done = {"first": index.add(d, "doc_id", content), "second": index.add(d, "doc_id", content), "deletes": index.delete(gone, "doc_id"), "deletes again": index.delete(gone, "doc_id")}
    return local(spark, [(k, w.indexed, w.replaced, w.deleted, w.missing) for k, w in done.items()], "batch string, indexed long, replaced long, deleted long, missing long")


@query("bm25_topk", f"with {BM25} select doc, round(score, 6) as score from b order by round(score, 9) desc, doc limit 20")
def bm25_topk(spark, sf_dir):
    return scores(spark, sf_dir).orderBy(F.desc("score"), "doc").limit(20).select("doc", F.round("score", 6).alias("score"))


@query("bm25_filtered", f"with {BM25} select doc, round(score, 6) as score from b join documents on doc = doc_id where lang = 'en' and source = 'src0' order by round(score, 9) desc, doc limit 20")
def bm25_filtered(spark, sf_dir):
    """Statistics of the whole corpus, scores of the filtered documents only."""
    keep = table(spark, sf_dir, "documents").where("lang = 'en' and source = 'src0'").select(F.col("doc_id").alias("doc"))
    return scores(spark, sf_dir).join(keep, "doc", "left_semi").orderBy(F.desc("score"), "doc").limit(20).select("doc", F.round("score", 6).alias("score"))


@query("bm25_sorted", f"with {BM25} select doc, n_chars from b join documents on doc = doc_id order by n_chars desc, doc limit 20")
def bm25_sorted(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "n_chars")
    return scores(spark, sf_dir).join(d, "doc").orderBy(F.desc("n_chars"), "doc").limit(20).select("doc", "n_chars")


BEST = f"""{FIELDS}, one as (select fp.doc, fp.field, sum(case fp.field when 'title' then 2.0 else 1.0 end * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.2 * (0.25 + 0.75 * len / mean))) as s
 from fp join fv using (field, term) join fl on fl.doc = fp.doc and fl.field = fp.field join fs on fs.field = fp.field where fp.term in {IN} group by 1, 2)"""


@query("bm25_best_fields", f"with {BEST} select doc, round(round(max(s), 9), 6) as score from one group by 1 order by round(max(s), 9) desc, doc limit 20")
def bm25_best_fields(spark, sf_dir):
    """The best of title (doubled), content and keywords instead of their sum."""
    i = kept(spark, sf_dir)
    hits = None
    for f, b in {"title": 2.0, "content": 1.0, "keywords": 1.0}.items():
        one = S.lexical(i, TERMS, {f: b})
        hits = one if hits is None else hits.unionAll(one)
    hits = hits.groupBy("doc").agg(F.round(F.max("score"), 9).alias("score"))
    return hits.orderBy(F.desc("score"), "doc").limit(20).select("doc", F.round("score", 6).alias("score"))


@query("fuzzy_terms", f"with {FIELDS}, {EXPANDED} select asked, field, term, cast(df as bigint) as df, round(weight, 9) as weight from xt")
def fuzzy_terms(spark, sf_dir):
    rows = S.wanted_terms(kept(spark, sf_dir), sorted(TERMS), fuzzy=True)
    return spark.createDataFrame(rows, "asked string, field string, term string, df long, weight double").withColumn("weight", F.round("weight", 9))


FUZZY = f"{FIELDS}, {EXPANDED}, hit as (select fp.doc, sum(weight * ln(1 + (n - xt.df + 0.5) / (xt.df + 0.5)) * tf / (tf + 1.2 * (0.25 + 0.75 * len / mean))) as s from fp join xt using (field, term) join fl on fl.doc = fp.doc and fl.field = fp.field join fs on fs.field = fp.field where fp.field = 'content' group by 1)"


@query("bm25_fuzzy", f"with {FUZZY} select doc, round(round(s, 9), 6) as score from hit order by round(s, 9) desc, doc limit 20")
def bm25_fuzzy(spark, sf_dir):
    hits = S.lexical(kept(spark, sf_dir), TERMS, {"content": 1.0}, fuzzy=True).select("doc", F.round("score", 9).alias("score"))
    return hits.orderBy(F.desc("score"), "doc").limit(20).select("doc", F.round("score", 6).alias("score"))


@query("knn_topk", f"with {COSINE} select doc, round(score, 6) as score from v order by round(score, 9) desc, doc limit 20")
def knn_topk(spark, sf_dir):
    return S.knn(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", probe(spark, sf_dir), 20).select("doc", F.round("score", 6).alias("score"))


@query("knn_filtered", f"with {COSINE} select doc, round(score, 6) as score from v join embeddings on doc = vec_id where label = 1 order by round(score, 9) desc, doc limit 20")
def knn_filtered(spark, sf_dir):
    return S.knn(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", probe(spark, sf_dir), 20, F.col("label") == 1).select("doc", F.round("score", 6).alias("score"))


@query("knn_post_filtered", f"with {COSINE}, t as (select doc, score from v order by round(score, 9) desc, doc limit 20) select doc, round(score, 6) as score from t join embeddings on doc = vec_id where label = 1")
def knn_post_filtered(spark, sf_dir):
    return S.knn(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", probe(spark, sf_dir), 20, F.col("label") == 1, "faithful").select("doc", F.round("score", 6).alias("score"))


@query("knn_lsh", f"with {COSINE}, t as (select doc from v order by round(score, 9) desc, doc limit 20) select count(*) as k, true as enough from t")
def knn_lsh(spark, sf_dir):
    """Of the 20 nearest by the tables of signs at least nine in ten are among the 20 nearest of all."""
    v, p = table(spark, sf_dir, "embeddings"), probe(spark, sf_dir)
    found = V.near(V.signatures(v, "vec_id", "embedding", len(p)), p, 20).select("doc")
    true = S.knn(v, "vec_id", "embedding", p, 20).select("doc")
    return true.join(found.select("doc", F.lit(1).alias("hit")), "doc", "left").agg(F.count(F.lit(1)).alias("k"), (F.count("hit") >= 0.9 * F.count(F.lit(1))).alias("enough"))


def local(spark, rows: list[tuple], schema: str):
    """A bounded list as a table without a job: Arrow tables become local relations."""
    kinds = to_arrow_schema(StructType.fromDDL(schema))
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(kinds)
    return spark.createDataFrame(pa.table({f.name: pa.array(c, f.type) for f, c in zip(kinds, columns, strict=True)}))


@query("knn_index", f"with {COSINE} select doc, round(score, 6) as score from v order by round(score, 9) desc, doc limit 20")
def knn_index(spark, sf_dir):
    """The exact nearest by the index: codes of the lists in question, then full vectors of a few keys."""
    found, _ = ivf.exact(kept_vectors(spark, sf_dir), probe(spark, sf_dir), 20)
    return local(spark, found, "doc long, score double").select("doc", F.round("score", 6).alias("score"))


@query("knn_index_recall", "select count(*) as probes, true as enough, true as few from (select * from embeddings order by vec_id limit 50)")
def knn_index_recall(spark, sf_dir):
    """50 probes at once by the approximate form: nine in ten true neighbours are found (``enough``), from full vectors of at most 15 % of the rows (``few``)."""
    index, v = kept_vectors(spark, sf_dir), table(spark, sf_dir, "embeddings")
    probes = np.array([r.embedding for r in v.orderBy("vec_id").limit(50).select("embedding").collect()])
    found = ivf.near_many(index, probes, 20).select("probe", "doc", F.lit(1).alias("hit"))
    true = ivf.true_neighbours(v, "embedding", probes, 20, ["vec_id"]).select("probe", F.col("vec_id").alias("doc"))
    share = ivf.REFINE * 20 / max(1, int(index.sizes.sum()))
    both = true.join(found, ["probe", "doc"], "left")
    return both.agg(F.countDistinct("probe").alias("probes"), (F.count("hit") >= 0.9 * F.count(F.lit(1))).alias("enough")).select("probes", "enough", F.lit(share <= 0.15).alias("few"))


def fused(spark, sf_dir) -> list[tuple]:
    """[(doc, bm25_rank, vec_rank, rrf)]: both lists of 20 at once, by two threads, and their fusion."""
    with ThreadPoolExecutor(2) as pool:
        lexical = pool.submit(lambda: [tuple(r) for r in multi(spark, sf_dir).orderBy(F.desc("score"), "doc").limit(20).collect()])
        vector = pool.submit(lambda: ivf.nearest(kept_document_vectors(spark, sf_dir), probe(spark, sf_dir), 20))
        return S.rrf_lists(lexical.result(), vector.result(), 20)


@query("rrf_fuse", f"{FUSED} select doc, bm25_rank, vec_rank, round(rrf, 9) as rrf from z order by rrf desc, bm25_rank nulls last, vec_rank nulls last limit 20")
def rrf_fuse(spark, sf_dir):
    return local(spark, fused(spark, sf_dir), "doc long, bm25_rank long, vec_rank long, rrf double").withColumn("rrf", F.round("rrf", 9))


@query("rrf_join", f"{FUSED} select doc, bm25_rank, vec_rank, round(rrf, 9) as rrf from z order by rrf desc, bm25_rank nulls last, vec_rank nulls last limit 20")
def rrf_join(spark, sf_dir):
    """The same fusion as a full outer join of two ranked tables."""
    lexical = S.ranked(multi(spark, sf_dir), 20, "bm25_rank")
    near = local(spark, ivf.nearest(kept_document_vectors(spark, sf_dir), probe(spark, sf_dir), 20), "doc long, score double")
    both = S.rrf(lexical, S.ranked(near.withColumn("score", F.round("score", 9)), 20, "vec_rank"), 20)
    return both.select("doc", "bm25_rank", "vec_rank", F.round("rrf", 9).alias("rrf"))


@query("hybrid_search", f"{FUSED}, t as (select * from z order by rrf desc, bm25_rank nulls last, vec_rank nulls last limit 10) select doc, round(rrf, 9) as rrf, lang, source as site, md5(case when length(text) > 300 then substr(text, 1, 300) || '...' else text end) as snippet_md5 from t join documents on doc = doc_id")
def hybrid_search(spark, sf_dir):
    """First page of the hybrid search with the hit's projection; the page's keys are constants for the scan of documents."""
    from tarn.functions.text import snippet

    first = [(doc, round(score, 9)) for doc, _, _, score in fused(spark, sf_dir)[:10]]
    d = table(spark, sf_dir, "documents")
    d = d.where(F.col("doc_id").isin(*[doc for doc, _ in first])) if first else d.limit(0)
    # the page's scores as a literal map, so that the scan of documents is the only job
    score = F.create_map(*[F.lit(x) for hit in first for x in hit])[F.col("doc_id")] if first else F.lit(None).cast("double")
    return d.select(F.col("doc_id").alias("doc"), score.alias("rrf"), "lang", F.col("source").alias("site"), F.md5(snippet(F.col("text"))).alias("snippet_md5"))


@query("search_page_2", f"{FUSED} select doc, round(rrf, 9) as rrf from (select * from z order by rrf desc, bm25_rank nulls last, vec_rank nulls last limit 20) order by rrf desc, bm25_rank nulls last, vec_rank nulls last limit 5 offset 5")
def search_page_2(spark, sf_dir):
    return local(spark, [(doc, score) for doc, _, _, score in fused(spark, sf_dir)[5:10]], "doc long, rrf double").withColumn("rrf", F.round("rrf", 9))


@query("suggest", f"with {POSTINGS}, d as (select term, count(*) as df from p group by 1) select term, cast(levenshtein(term, 'erthes') as int) as distance, df from d where substr(term, 1, 1) = 'e' and levenshtein(term, 'erthes') <= 2 order by distance, df desc, term limit 10")
def suggest(spark, sf_dir):
    terms = kept(spark, sf_dir).terms.where("letter = 'e' and field = 'content'")
    return S.suggest(terms, "erthes", 10)


@query("suggest_union", f"with {FIELDS}, d as (select term, sum(df) as df from fv where field in ('title', 'keywords') group by 1) select term, cast(levenshtein(term, 'srce1') as int) as distance, cast(df as bigint) as df from d where substr(term, 1, 1) = 's' and levenshtein(term, 'srce1') <= 2 order by distance, df desc, term limit 10")
def suggest_union(spark, sf_dir):
    """Suggestions from the titles' and the keywords' vocabulary together."""
    terms = kept(spark, sf_dir).terms.where("letter = 's' and field in ('title', 'keywords')")
    return S.suggest(terms, "srce1", 10)


@query("highlight_counts", "select doc_id, cast(len(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) - len(list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+'), lambda x: x not in ('the', 'und'))) as int) as n from documents")
def highlight_counts(spark, sf_dir):
    marked = S.highlight(F.col("text"), ["the", "und"])
    return table(spark, sf_dir, "documents").select("doc_id", F.regexp_count(marked, F.lit("<em>")).alias("n"))


@query("highlight_fragments")
def highlight_fragments(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", S.fragments(F.col("text"), ["the", "und"]).alias("fragments"))


@query("facets", "select 'lang' as facet, lang as value, count(*) as n from documents group by 2 union all select 'source', source, count(*) from documents group by 2")
def facets(spark, sf_dir):
    """Both facets from one pass over two small columns."""
    d = table(spark, sf_dir, "documents")
    pair = F.explode(F.array(F.struct(F.lit("lang").alias("facet"), F.col("lang").alias("value")), F.struct(F.lit("source").alias("facet"), F.col("source").alias("value"))))
    return d.select(pair.alias("p")).groupBy("p.facet", "p.value").agg(F.count(F.lit(1)).alias("n"))


NDCG = f"""with {BM25}, r as (select doc, row_number() over (order by round(score, 9) desc, doc) as rank from b order by rank limit 10),
 g as (select rank, coalesce(quality, 0) as gain from r left join labels on doc = doc_id), i as (select count(*) as good from labels where quality = 1)"""


@query("ndcg_at_10", f"{NDCG} select round(sum(gain / log2(rank + 1)) / (select sum(1 / log2(k + 1)) from range(1, 11) t(k)), 6) as ndcg from g")
def ndcg_at_10(spark, sf_dir):
    """Quality labels as gains of the ten best hits, against ten perfect ones."""
    top = S.ranked(scores(spark, sf_dir), 10, "rank")
    quality = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("doc"), "quality")
    ideal = sum(1 / __import__("math").log2(k + 1) for k in range(1, 11))
    return quality.join(F.broadcast(top), "doc", "right").agg(F.round(F.sum(F.coalesce("quality", F.lit(0)) / F.log2(F.col("rank") + 1)) / ideal, 6).alias("ndcg"))


@query("recall_at_10", f"{NDCG} select round(sum(gain) / (select good from i), 9) as recall from g")
def recall_at_10(spark, sf_dir):
    top = S.ranked(scores(spark, sf_dir), 10, "rank").select("doc", F.lit(1).alias("hit"))
    good = table(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("doc"))
    return good.join(F.broadcast(top), "doc", "left").agg(F.round(F.sum(F.coalesce("hit", F.lit(0))) / F.count(F.lit(1)), 9).alias("recall"))
