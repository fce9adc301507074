"""N-gram Jaccard join: exact links between texts by filters under several token orders.

Tokens are 64-bit hashes of runs of five words.  Texts with equal token sets
are one node from the start.  A pair with similarity 0.75 or more must share
a token within the first n - ceil(0.75 n) + 1 tokens of each set under *any*
order of all tokens.  Three orders are used: two rarest first by the number
of nodes that hold a token, with different tie-breaks, and one by the hash
alone.  Every pair that is ever compared shares prefix tokens under all three.

* Token frequencies: each slice of texts ships its tokens packed by bucket
  (six bytes of token and two of owner each; equal sets once per slice); a
  bucket holds a bounded number of tokens on average and reports only tokens
  of two nodes or more.  A token that very many nodes of a slice hold is hot:
  it is only named to its bucket, while its nodes go on by themselves.  Hot
  tokens come last in the rarest-first orders.
  Tokens of one node come first in both rarest-first orders and can never
  match, so a text whose prefix is filled by them is out at once.
* Candidates of a token's list: two members are worth a comparison only if
  their sizes and the token's places in both orders leave room for enough
  common tokens.  (The first common token of a link always leaves room.)
* Rather than all pairs, every list first compares its members with one pivot,
  twice; links merge into components, and lists within one component are done.
* Of lists that still mix components, pairs of different components that pass
  the filters are compared, so no link between components is lost.  Before any
  pair is made, every list is told by classes of set size, each with the most
  tokens a member has left after the list's one; a member goes on only for the
  classes in which that leaves room for a link, and meets only members that go
  on for its own class.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.llm.common import cut, lean, map_texts, slices, small_batches, written
from tarn.llm.components import components

SHINGLE = 5
#: Links hold if 100 * intersection >= PERCENT * union.
PERCENT = 75
BUCKET_TOKENS = 500_000
SLICE_BYTES = 2_000_000
#: A token of so many nodes in one slice is hot, and has this number of nodes in the orders.
HOT_NODES = 64
HOT = 1 << 40
PIVOT_ROUNDS = 2
#: Sizes of sets in one class of a list differ by less than this factor.
CLASS = 1.15
#: Up to so many ids the survivors are broadcast to the text scan; beyond, the texts are shuffled.
BROADCAST_IDS = 500_000

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def token_sets(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, starts): all texts' distinct tokens, ascending within a text; starts has one more entry."""
    number: dict[bytes, int] = {}
    fresh = count()
    ids, per = [], np.zeros(len(texts), dtype=np.int64)
    for d, t in enumerate(texts):
        words = (t or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
        per[d] = len(words)
        if words:
            ids.append(np.fromiter(map(number.setdefault, words, fresh), dtype=np.int64, count=len(words)))
    if not ids:
        return np.zeros(0, dtype=np.uint64), np.zeros(len(texts) + 1, dtype=np.int64)
    flat = np.concatenate(ids)
    digest = np.zeros(int(flat.max()) + 1, dtype=np.uint64)
    digest[np.fromiter(number.values(), dtype=np.int64, count=len(number))] = np.fromiter(
        map(xxhash.xxh64_intdigest, number), dtype=np.uint64, count=len(number)
    )
    words = digest[flat]
    doc = np.repeat(np.arange(len(texts)), per)
    first = np.cumsum(per) - per

    def mix(h: np.ndarray, v: np.ndarray) -> np.ndarray:
        h = (h ^ v) * np.uint64(0x9FB21C651E98DF25)
        return h ^ (h >> np.uint64(32))

    with np.errstate(over="ignore"):
        if len(words) >= SHINGLE:
            h = np.full(len(words) - SHINGLE + 1, SHINGLE, dtype=np.uint64)
            for k in range(SHINGLE):
                h = mix(h, words[k : len(words) - SHINGLE + 1 + k])
            whole = doc[: len(h)] == doc[SHINGLE - 1 :]
            tokens, own = h[whole], doc[: len(h)][whole]
        else:
            tokens, own = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
        short = np.flatnonzero((per > 0) & (per < SHINGLE))
        if len(short):
            extra = []
            for d in short:
                h = np.array([per[d]], dtype=np.uint64)
                for w in words[first[d] : first[d] + per[d]]:
                    h = mix(h, np.array([w], dtype=np.uint64))
                extra.append(h[0])
            tokens = np.concatenate([tokens, np.array(extra, dtype=np.uint64)])
            own = np.concatenate([own, short])
    order = np.lexsort((tokens, own))
    tokens, own = tokens[order], own[order]
    keep = np.concatenate(([True], (tokens[1:] != tokens[:-1]) | (own[1:] != own[:-1]))) if len(tokens) else np.zeros(0, dtype=bool)
    tokens, own = tokens[keep], own[keep]
    return tokens, np.searchsorted(own, np.arange(len(texts) + 1))


def nodes_of(tokens: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """One 64-bit name per token set; 0 for the empty set."""
    raw = tokens.tobytes()
    return np.fromiter(
        (xxhash.xxh3_64_intdigest(raw[8 * a : 8 * b]) if b > a else 0 for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)),
        dtype=np.uint64,
        count=len(starts) - 1,
    ).view(np.int64)


def _named(texts: list[str | None]) -> dict:
    tokens, starts = token_sets(texts)
    return {"n": np.diff(starts), "node": nodes_of(tokens, starts)}


def _with_tokens(texts: list[str | None]) -> dict:
    tokens, starts = token_sets(texts)
    lists = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(tokens.view(np.int64)))
    return {"node": nodes_of(tokens, starts), "tokens": lists}


def _six(tokens: np.ndarray) -> bytes:
    """Six bytes of each token."""
    return np.ascontiguousarray(tokens).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _eight(blob: bytes) -> np.ndarray:
    six = np.frombuffer(blob, dtype=np.uint8).reshape(-1, 6)
    out = np.zeros((len(six), 8), dtype=np.uint8)
    out[:, :6] = six
    return out.view(np.int64).ravel()


def _pack(texts: list[str | None], buckets: int) -> pa.RecordBatch | None:
    """The tokens of a slice by bucket; nodes of hot tokens in a row of their own under a negative bucket."""
    tokens, starts = token_sets(texts)
    if not len(tokens):
        return None
    node = nodes_of(tokens, starts)
    own = np.repeat(np.arange(len(node)), np.diff(starts))
    _, firsts = np.unique(node, return_index=True)
    once = np.zeros(len(node), dtype=bool)
    once[firsts] = True
    mine = once[own]
    tokens, own = tokens[mine] >> np.uint64(16), own[mine]
    bucket = (tokens % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((tokens, bucket))
    tokens, own, bucket = tokens[order], own[order], bucket[order]
    at = np.flatnonzero(np.concatenate(([True], tokens[1:] != tokens[:-1])))
    times = np.diff(np.append(at, len(tokens)))
    hot = np.repeat(times >= HOT_NODES, times)
    hot_at = at[times >= HOT_NODES]
    rows = []

    def row(key: int, which: np.ndarray, named: np.ndarray) -> None:
        docs, local = np.unique(own[which], return_inverse=True)
        rows.append((key, _six(tokens[which]), local.astype(np.uint16).tobytes(), node[docs].tobytes(), _six(tokens[named])))

    some, begins = np.unique(bucket, return_index=True)
    for k, a, b in zip(some.tolist(), begins.tolist(), np.append(begins[1:], len(bucket)).tolist(), strict=True):
        x, y = np.searchsorted(hot_at, [a, b])
        row(k, a + np.flatnonzero(~hot[a:b]), hot_at[x:y])
    if len(hot_at):
        row(-1 - int(node[own[0]] & 0xFFFFFFFFFF), np.flatnonzero(hot), hot_at[:0])
    kinds = (pa.int64(), *[pa.binary()] * 4)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["bucket", "tokens", "owners", "names", "hots"])


def _count_bucket(table: pa.Table) -> pa.Table:
    """(node, token, df) of a bucket's tokens of two nodes or more."""
    tokens, nodes = [], []
    for blob, local, names in zip(*(table.column(c).to_pylist() for c in ("tokens", "owners", "names")), strict=True):
        tokens.append(_eight(blob))
        nodes.append(np.frombuffer(names, dtype=np.int64)[np.frombuffer(local, dtype=np.uint16)])
    t, n = np.concatenate(tokens), np.concatenate(nodes)
    if table.column("bucket")[0].as_py() < 0:
        return pa.table({"node": n, "token": t, "df": np.full(len(t), HOT)})
    hot = np.unique(np.concatenate([_eight(b) for b in table.column("hots").to_pylist()]))
    order = np.argsort(t, kind="stable")
    t, n = t[order], n[order]
    several = np.isin(t, hot)
    same = t[1:] == t[:-1]
    several[1:] |= same
    several[:-1] |= same
    t, n = t[several], n[several]
    order = np.lexsort((n, t))
    t, n = t[order], n[order]
    new = np.concatenate(([True], (t[1:] != t[:-1]) | (n[1:] != n[:-1]))) if len(t) else np.zeros(0, dtype=bool)
    t, n = t[new], n[new]
    _, inverse, df = np.unique(t, return_inverse=True, return_counts=True)
    df = np.where(np.isin(t, hot), HOT, df[inverse])
    keep = df >= 2
    return pa.table({"node": n[keep], "token": t[keep], "df": df[keep]})


def shared_tokens(texts: DataFrame, buckets: int) -> DataFrame:
    """(node, token, df) of the tokens that two nodes or more hold; tokens are cut to 48 bits.

    Pairs of a hot token and a node may come twice, from two slices.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                rows = part.column("text").to_pylist()
                for k in range(0, len(rows), 60_000):
                    made = _pack(rows[k : k + 60_000], buckets)
                    if made is not None:
                        yield made

    small_batches(texts.sparkSession)
    packed = texts.select("text").mapInArrow(lean(pack), "bucket long, tokens binary, owners binary, names binary, hots binary")
    return packed.groupBy("bucket").applyInArrow(_count_bucket, "node long, token long, df long")


def _need(n: str) -> str:
    """Tokens of the prefix: n - ceil(0.75 n) + 1."""
    return f"({n} - ({PERCENT} * {n} + 99) div 100 + 1)"


def _room(n: str, at: str, m: str, place: str) -> str:
    """Whether sizes n and m and the places of a common token allow a link in which it is the first common one."""
    most = f"least({n} - {at}, {m} - {place})"
    return f"least({n}, {m}) * 100 >= greatest({n}, {m}) * {PERCENT} and {100 + PERCENT} * {most} >= {PERCENT} * ({n} + {m})"


def _open_members(rows: DataFrame) -> DataFrame:
    """(token, node, n, at, label, c, other): members of lists for each size class in which they may have a link.

    A class is known by its sizes, the most tokens a member has left from the
    list's token on, and whether it has another component.  A member and a
    class cannot meet if that leaves too few common tokens even for the
    smallest set of the class; texts that share boilerplate beside words of
    their own end here.
    """
    rows = rows.withColumn("c", F.floor(F.log("n") / float(np.log(CLASS))).cast("int"))
    per = rows.groupBy("token", "c").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.max(F.col("n") - F.col("at")).alias("left"), F.min("label").alias("low"), F.max("label").alias("high"))
    # a row for each class of a token: as many as powers of CLASS between the sizes of all sets
    lists = cut(per.groupBy("token").agg(F.collect_list(F.struct("c", "least", "most", "left", "low", "high")).alias("classes")))
    fits = f"x.most * 100 >= n * {PERCENT} and n * 100 >= x.least * {PERCENT} and {100 + PERCENT} * least(n - at, x.left) >= {PERCENT} * (n + x.least)"
    some = f"transform(filter(classes, x -> {fits} and not (x.low = label and x.high = label)), x -> x.c)"
    return cut(rows.join(lists, "token").select("token", "node", "n", "at", "label", "c", F.explode(F.expr(some)).alias("other")))


def _verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The links among (a, b): prefixes must meet under the other two orders as well, then the sets are compared."""
    third = F.expr(f"slice(tokens, 1, {_need('size(tokens)')})")
    left = sets.select(F.col("node").alias("a"), F.col("tokens").alias("ta"), F.col("second").alias("sa"), third.alias("ca"))
    right = sets.select(F.col("node").alias("b"), F.col("tokens").alias("tb"), F.col("second").alias("sb"), third.alias("cb"))
    met = pairs.join(left, "a").join(right, "b").where(F.arrays_overlap("sa", "sb") & F.arrays_overlap("ca", "cb"))
    na, nb, both = F.size("ta"), F.size("tb"), F.size(F.array_intersect("ta", "tb"))
    return met.select("a", "b", na.alias("na"), nb.alias("nb"), both.alias("i")).where(f"100 * i >= {PERCENT} * (na + nb - i)").select("a", "b")


def _prefixes(shared: DataFrame, sizes: DataFrame) -> DataFrame:
    """(node, doc, n, skip, first, second): prefixes under two orders of the nodes that can have a link.

    Tokens of one node fill the front of both prefixes: ``skip`` of them.
    """
    # dealt out first: sets of one token each, as a partial aggregate makes, take four times the room in a shuffle
    listed = shared.repartition("node").groupBy("node").agg(F.collect_set(F.struct("df", "token")).alias("list"))
    return (
        listed.join(sizes, "node")
        .withColumn("skip", F.expr("cast(n - size(list) as int)"))
        .withColumn("room", F.expr(f"cast({_need('n')} - skip as int)"))
        .where("room > 0")
        .select(
            "node",
            "doc",
            F.col("n").cast("int").alias("n"),
            "skip",
            F.expr("transform(slice(array_sort(list), 1, room), x -> x.token)").alias("first"),
            F.expr("transform(slice(array_sort(transform(list, x -> struct(x.df, xxhash64(x.token) as h, x.token as token))), 1, room), x -> x.token)").alias("second"),
        )
    )


def _near_labels(found: DataFrame) -> DataFrame:
    """(node, label) for linked nodes: the least neighbour's least neighbour.

    Equal labels mean one component, though not the reverse; that is all the
    posting lists need, and it takes two joins where components take many.
    """
    both = found.union(found.select(F.col("b"), F.col("a")))
    # written, so that a join on a node very many others are near to has plain exchanges on both sides
    one = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near")).select("node", F.least("node", "near").alias("near")))
    further = one.select(F.col("node").alias("near"), F.col("near").alias("label"))
    return one.join(further, "near", "left").select("node", F.coalesce("label", "near").alias("label"))


def _labelled(df: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return df.withColumn("label", F.col("node"))
    return df.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))


def links(texts: DataFrame, named: DataFrame, total_tokens: int) -> DataFrame | None:
    """(a, b) links between nodes whose closure is the closure of all links; None if there can be none.

    ``texts`` has doc and text, ``named`` has doc, n and node of each row.
    """
    buckets = max(8, -(-total_tokens // BUCKET_TOKENS))
    sizes = named.where("n > 0").groupBy("node").agg(F.min("n").alias("n"), F.min("doc").alias("doc"))
    # written once, so that the packed tokens' shuffle files can go before the shared ones are dealt out
    with written(shared_tokens(texts, buckets)) as shared:
        chosen = cut(_prefixes(shared, sizes))
    many = chosen.count()
    if many < 2:
        return None
    # null for the sets that rows without a key alone hold
    ids = chosen.select(F.col("doc").alias("id")).distinct()
    ids = F.broadcast(ids) if many <= BROADCAST_IDS else ids
    some = texts.select("doc", "text").join(ids, F.col("doc").eqNullSafe(F.col("id")), "left_semi")
    sets = map_texts(some, [], "text", "node long, tokens array<long>", _with_tokens)
    sets = cut(sets.dropDuplicates(["node"]).join(chosen.select("node", "second"), "node"))

    def postings(labels: DataFrame | None) -> DataFrame:
        """(token, node, n, at, label) of the lists under the first order that still mix components."""
        rows = chosen.select("node", "n", "skip", F.posexplode("first").alias("k", "token"))
        rows = _labelled(rows.select("token", "node", "n", (F.col("skip") + F.col("k")).alias("at")), labels)
        mixed = rows.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("token")
        return cut(rows.join(mixed, "token", "left_semi"))

    def compared(rows: DataFrame, others: DataFrame, which: str, classes: bool = False) -> DataFrame:
        """Links between rows and others of one list: (token, node, n, at, label) on both sides, with ``classes`` also (c, other)."""
        more = [F.col("other").alias("c"), F.col("c").alias("other")] if classes else []
        to = others.select("token", F.col("node").alias("p"), F.col("n").alias("m"), F.col("at").alias("place"), F.col("label").alias("pl"), *more)
        pairs = rows.join(to, ["token", "c", "other"] if classes else "token").where(f"{which} and {_room('n', 'at', 'm', 'place')}")
        return cut(_verify(pairs.select(F.least("node", "p").alias("a"), F.greatest("node", "p").alias("b")).distinct(), sets))

    found: DataFrame | None = None
    labels: DataFrame | None = None
    for turn in range(PIVOT_ROUNDS):
        rows = postings(labels)
        # first the member with the least of its own, which is most like the rest; then any
        best = F.struct(F.col("at") / F.col("n"), F.xxhash64("node"), "node") if not turn else F.struct(F.xxhash64("node", F.lit(turn)), F.lit(0), "node")
        pivots = rows.groupBy("token").agg(F.min_by(F.struct("node", "n", "at", "label"), best).alias("p")).select("token", "p.*")
        # written, so that the join's both sides are plain exchanges and a long list can be split
        new = compared(rows, cut(pivots), "label <> pl")
        found = new if found is None else found.union(new)
        labels = cut(_near_labels(found))
    rest = postings(labels)
    if rest.limit(1).count():
        labels = components(found)
        rest = _open_members(postings(labels))
        found = found.union(compared(rest, rest, "node < p and label <> pl", classes=True))
    return found


def ngram_components(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, component_id) per row.

    Words are lower-cased in A-Z only and cut at ASCII white space.  A text of
    one to four words is one shingle, the whole sequence; a null, empty or
    blank text has none and is alone in its component.  Rows with equal keys
    are separate rows; keys are integers.  A row with a null key has links like
    any other, but a component's id is its least key that is not null, or null
    if it has none.  Texts of any length are taken whole.
    """
    return _components_of(df, key, text, []).select(F.col("doc").alias(key), F.col("n").alias("n_shingles"), "component_id")


def _components_of(df: DataFrame, key: str, text: str, marks: list[Column]) -> DataFrame:
    """(doc, marks, n, component_id) per row; ``marks`` are further columns of the row to carry along."""
    rows = df.select(F.col(f"`{key}`").alias("doc"), F.col(f"`{text}`").cast("string").alias("text"), *marks)
    carried = [c for c in rows.columns if c != "text"]
    named = cut(map_texts(rows, carried, "text", "n long, node long", _named))
    total = named.agg(F.sum("n")).first()[0] or 0
    heads = named.where("n > 0").groupBy("node").agg(F.min("doc").alias("low"))
    found = links(rows, named, total) if total else None
    if found is not None:
        labels = components(found)
        heads = heads.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        heads = cut(heads)
        # written as well: a large component is one key of this join
        lows = cut(heads.groupBy("label").agg(F.min("low").alias("component_id")))
        heads = heads.join(lows, "label").select("node", "component_id")
    else:
        heads = heads.select("node", F.col("low").alias("component_id"))
    heads = heads.withColumnRenamed("node", "of")
    return (
        named.join(heads, (F.col("node") == F.col("of")) & (F.col("n") > 0), "left")
        .select(*carried, "n", F.coalesce("component_id", "doc").alias("component_id"))
    )


def without_near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``df`` that stay: of each component the one of the least key.

    Rows that share the kept key stay together; rows with a null key stay.  A
    row goes by its key and text, so another text of the same key stays.  The
    rows that go are broadcast up to ``BROADCAST_IDS``, else joined by shuffle.
    """
    mark = F.xxhash64(F.col(f"`{text}`").cast("string"))
    gone = _components_of(df, key, text, [mark.alias("mark")]).where("doc <> component_id")
    gone = cut(gone.select(F.col("doc").alias("__gone"), F.col("mark").alias("__mark")).distinct())
    side = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    return df.join(side, (F.col(f"`{key}`") == F.col("__gone")) & (mark == F.col("__mark")), "left_anti")
