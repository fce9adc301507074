"""Mixing sources to target weights, with DataFrame functions only.

The words of each source form one stream, cut into blocks of ``BLOCK`` words.
The mix is a row of output shards of ``SHARD_SLOTS`` block slots each, common
to all sources.  Every slot of a shard draws its source with the targets as
probabilities, so a shard's source counts are multinomial.  The draws of all
shards together miss a source's target by chance; the running count of the
source over the shards is therefore scaled to end exactly at its target's
number of slots (a monotone rounding that moves each shard's count by its share
of the miss).  The slots a shard then gives a source are consecutive numbers g
of that source; slot g takes block perm(g mod blocks) of pass g div blocks,
where perm is a keyed "swap or not" permutation of exactly that many indices,
and blocks are joined by index.  A source never gets more than two passes, so
no text is used more than twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.llm.common import WORD, cut

BLOCK = 32
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
ROUNDS = 20
#: Block slots of an output shard, and how many slots one task deals with.
SHARD_SLOTS = 1 << 12
TASK_SLOTS = 1 << 18
#: Shards that are counted up together before the groups are.
SHARD_GROUP = 1 << 12
ROWS_A_BUCKET = 20_000
SEED = 1729


def permuted(x: Column, n: Column, *key: Column) -> Column:
    """Swap-or-not shuffle of 0..n-1: in each round x may trade places with its mirror image about a key."""

    def turn(v: Column, r: Column) -> Column:
        mirror = F.pmod(F.pmod(F.xxhash64(*key, r), n) - v, n)
        return F.when(F.xxhash64(*key, r, F.greatest(v, mirror)).bitwiseAND(F.lit(1)) == 1, mirror).otherwise(v)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), x, turn)


def targets(sizes: DataFrame) -> DataFrame:
    """(source, s, source_size, target) of (source, size): one row per source, null last.

    Water-filling in one pass: sources in order of their limit per weight; a
    source stays at its limit exactly if the level that the rest would reach
    lies above it.  The table has a row per source, hence the plain windows.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = per.withColumn("s", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    w = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("s") % len(WEIGHTS) + 1).cast("int"))
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_limit = Window.orderBy("limit_per_weight", "s")
    upto = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    filled = (
        ranked.withColumn("w", w.cast("double"))
        .withColumn("limit", (F.col("source_size") * MOST).cast("double"))
        .withColumn("limit_per_weight", F.col("limit") / F.col("w"))
        .withColumn("all", F.sum("source_size").over(everything) * SHARE)
        .withColumn("weights", F.sum("w").over(everything))
        .withColumn("level", (F.col("all") - F.coalesce(F.sum("limit").over(upto), F.lit(0.0))) / (F.col("weights") - F.coalesce(F.sum("w").over(upto), F.lit(0.0))))
        .withColumn("capped", F.col("level") >= F.col("limit_per_weight"))
        # the level of the first source below its limit holds for all after it
        .withColumn("final", F.min(F.when(~F.col("capped"), F.struct("limit_per_weight", "s", "level"))).over(everything)["level"])
    )
    return filled.select("source", "s", "source_size", F.when(F.col("capped"), F.col("limit")).otherwise(F.col("final") * F.col("w")).alias("target"))


def slots_of(goals: DataFrame) -> DataFrame:
    """(s, blocks, slots) of every source that the mix takes words of."""
    blocks = F.expr(f"(source_size + {BLOCK - 1}) div {BLOCK}")
    slots = F.least(F.round(F.col("target") * blocks / F.col("source_size")).cast("long"), blocks * MOST)
    return goals.where("source_size > 0").select("s", blocks.alias("blocks"), slots.alias("slots")).where("slots > 0")


def draws(many: DataFrame, tasks: int = 8) -> DataFrame:
    """(shard, s, drawn): the multinomial source counts of the output shards, without zeros.

    Slot j of a shard draws the source in whose part of the cumulated slots a
    keyed hash of (shard, j) falls.  The sources' running sums are one array,
    searched by halving.
    """
    one = many.agg(F.array_sort(F.collect_list(F.struct("s", "slots"))).alias("by"), F.sum("slots").alias("all"))
    one = one.where("all > 0").select(
        F.expr("transform(by, x -> x.s)").alias("names"),
        F.expr("slice(aggregate(by, array(0L), (a, x) -> concat(a, array(element_at(a, -1) + x.slots))), 1, size(by))").alias("from"),
        "all",
        F.expr(f"explode(sequence(0L, (all - 1) div {SHARD_SLOTS}))").alias("shard"),
    )

    def source(j: Column) -> Column:
        point = F.pmod(F.xxhash64(F.lit(SEED), F.lit("draw"), F.col("shard"), j), F.col("all"))
        # the last of the ascending starts that is not above the point
        halves = F.sequence(F.ceil(F.log2(F.size("from").cast("double"))).cast("int"), F.lit(0))

        def step(at: Column, r: Column) -> Column:
            further = at + F.pow(F.lit(2), r).cast("int")
            return F.when((further <= F.size("from")) & (F.get("from", further - 1) <= point), further).otherwise(at)

        return F.element_at("names", F.aggregate(halves, F.lit(0), step))

    size = F.least(F.lit(SHARD_SLOTS).cast("long"), F.col("all") - F.col("shard") * SHARD_SLOTS)
    # a fixed number of tasks, since the few bytes of the shards' rows would be gathered into one
    parts = one.repartition(tasks, "shard")
    return parts.select("shard", F.explode(F.transform(F.sequence(F.lit(1).cast("long"), size), source)).alias("s")).groupBy("shard", "s").agg(F.count(F.lit(1)).alias("drawn"))


def deal(many: DataFrame, tasks: int = 8) -> DataFrame:
    """(s, blocks, shard, begin, upto): the slots of each source that each output shard gets, numbers begin to upto - 1.

    The source's running draws are scaled to its slots.  A source that no shard
    has drawn, since it is so small, goes to a shard by a hash.
    """
    counts = cut(draws(many, tasks).withColumn("part", F.expr(f"shard div {SHARD_GROUP}")))
    groups = counts.groupBy("s", "part").agg(F.sum("drawn").alias("held"))
    # as many rows as groups of shards
    before = Window.partitionBy("s").orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    groups = groups.select("s", "part", (F.sum("held").over(before) - F.col("held")).alias("base"), F.sum("held").over(Window.partitionBy("s")).alias("total"))
    inside = Window.partitionBy("s", "part").orderBy("shard").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = counts.withColumn("run", F.sum("drawn").over(inside)).join(groups, ["s", "part"]).join(many, "s")

    def scaled(n: Column) -> Column:
        return F.round(n * (F.col("slots") / F.col("total"))).cast("long")

    upto = F.col("base") + F.col("run")
    drawn = placed.select("s", "blocks", "shard", scaled(upto - F.col("drawn")).alias("begin"), scaled(upto).alias("upto")).where("begin < upto")
    shards = many.agg(F.sum("slots").alias("all")).select(F.expr(f"(all - 1) div {SHARD_SLOTS} + 1").alias("shards"))
    never = many.join(counts.select("s").distinct(), "s", "left_anti")
    never = never.withColumn("shard", F.pmod(F.xxhash64(F.lit(SEED), "s"), F.lit(shards.first()[0] or 1)))
    return drawn.unionByName(never.select("s", "blocks", "shard", F.lit(0).cast("long").alias("begin"), F.col("slots").alias("upto")))


def plan(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", mark: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The mix of ``df``: (rows, pieces, picks).

    rows: doc, s, size, start (in the source's stream), source_size, target, and
    the column ``mark`` of ``df``, if named, which also orders rows of equal doc and size.
    pieces: s, start, block, at, n - the words of a row that lie in a block.
    picks: s, block, pass, shard - one row per slot of the mix, with the output shard that draws it.
    """
    size = F.coalesce(F.regexp_count(F.col(f"`{text}`").cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    marks = [mark] if mark else []
    sizes = cut(df.select(F.col(f"`{key}`").alias("doc"), F.col(f"`{source}`").cast("string").alias("source"), size.alias("size"), *marks))
    goals = cut(targets(sizes))
    buckets = max(1, -(-sizes.count() // ROWS_A_BUCKET))
    named = sizes.join(goals.withColumnRenamed("source", "name"), F.col("source").eqNullSafe(F.col("name"))).withColumn("bucket", F.pmod(F.xxhash64("doc"), F.lit(buckets)))
    base = named.groupBy("s", "bucket").agg(F.sum("size").alias("held"))
    base = base.select("s", "bucket", (F.sum("held").over(Window.partitionBy("s").orderBy("bucket")) - F.col("held")).alias("base"))
    inside = Window.partitionBy("s", "bucket").orderBy("doc", "size", *marks).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = (
        named.withColumn("upto", F.sum("size").over(inside))
        .join(base, ["s", "bucket"])
        .select("doc", "s", "size", (F.col("base") + F.col("upto") - F.col("size")).alias("start"), "source_size", "target", *marks)
    )
    rows = cut(rows)
    pieces = (
        rows.where("size > 0")
        .select("s", "start", "size", F.explode(F.expr(f"sequence(start div {BLOCK}, (start + size - 1) div {BLOCK})")).alias("block"))
        .select(
            "s",
            "start",
            "block",
            F.greatest(F.lit(0), F.col("block") * BLOCK - F.col("start")).alias("at"),
            (F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * BLOCK) - F.greatest("start", F.col("block") * BLOCK)).alias("n"),
        )
    )
    many = slots_of(goals)
    slots_in_all = many.agg(F.sum("slots")).first()[0] or 0
    tasks = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-slots_in_all // TASK_SLOTS))
    each = deal(many, tasks).repartition(tasks, "s", "shard").select("s", "blocks", "shard", F.explode(F.expr("sequence(begin, upto - 1)")).alias("g"))
    pass_ = F.expr("g div blocks")
    picks = each.select("s", permuted(F.expr("g % blocks"), F.col("blocks"), F.lit(SEED), F.col("s"), pass_).alias("block"), (pass_ + 1).alias("pass"), "shard")
    return rows, pieces, picks


def mix_sizes(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(key, size, source_size, target, taken, first_shard) per row of ``df``.

    ``first_shard`` is the first output shard that takes words of the row, null
    where none does.  A null text has size 0 and takes nothing; a null source
    is a source of its own, last in order.  Rows with equal keys are separate
    rows; of rows equal in key and size it is not told which takes which words.
    A text of any length is as many blocks as it needs.
    """
    rows, pieces, picks = plan(df, key, text, source)
    times = picks.groupBy("s", "block").agg(F.count(F.lit(1)).alias("times"), F.min("shard").alias("shard"))
    taken = pieces.join(times.hint("merge"), ["s", "block"]).groupBy("s", "start").agg(F.sum(F.col("n") * F.col("times")).alias("taken"), F.min("shard").alias("first_shard"))
    none = rows.where("size = 0").withColumn("taken", F.lit(0).cast("long")).withColumn("first_shard", F.lit(None).cast("long"))
    full = rows.where("size > 0").join(taken.hint("merge"), ["s", "start"], "left").unionByName(none)
    return full.select(F.col("doc").alias(key), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first_shard")


def mixed_blocks(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(shard, source, block, pass, words): the packed blocks of the mix, one row per slot, for writing by shard.

    Words of a block are those of one or several texts of its source, in the
    stream's order; only a source's last block is shorter than ``BLOCK``.
    """
    counted = df.select(F.col(f"`{key}`").alias("doc"), F.col(f"`{text}`").cast("string").alias("text"), F.col(f"`{source}`").cast("string").alias("source"))
    counted = counted.withColumn("mark", F.xxhash64("text"))
    rows, pieces, picks = plan(counted, "doc", "text", "source", "mark")
    # rows of equal key and text are alike, so one of them gives the words of all
    texts = counted.dropDuplicates(["doc", "mark", "source"])
    placed = rows.where("size > 0").join(texts.hint("merge"), rows["doc"].eqNullSafe(texts["doc"]) & (rows["mark"] == texts["mark"]))
    words = placed.select(rows["s"], rows["start"], "source", F.regexp_extract_all("text", F.lit(f"({WORD})")).alias("words"))
    parts = pieces.join(words.hint("merge"), ["s", "start"]).select("s", "source", "block", "start", F.slice("words", (F.col("at") + 1).cast("int"), F.col("n").cast("int")).alias("words"))
    blocks = parts.groupBy("s", "source", "block").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("start", "words"))), lambda x: x["words"])).alias("words"))
    return picks.join(blocks.hint("merge"), ["s", "block"]).select("shard", "source", "block", "pass", "words")


def row_mark(df: DataFrame, *needed: str) -> Column:
    """A 64-bit name of a row's content: of the needed columns and all others that can be hashed."""
    plain = [f.name for f in df.schema.fields if not any(k in f.dataType.simpleString() for k in ("map<", "variant"))]
    return F.xxhash64(*[F.col(f"`{c}`") for c in dict.fromkeys([*needed, *plain])], *[F.col(f"`{c}`").isNull() for c in dict.fromkeys(needed)])


def mix_documents(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", size: str = "n_chars") -> DataFrame:
    """The mixed documents with the columns of ``df``: a row for each pass in which a document has words.

    A document all of whose words a pass takes keeps its text; else its text is
    the words taken, with one space between.  Documents without a word take
    part in no mix and stay as they are.  Null and repeated keys are rows like
    any other: texts and their runs of words meet by a mark of the whole row.
    """
    counted = df.withColumn("__size", F.coalesce(F.regexp_count(F.col(f"`{text}`").cast("string"), F.lit(WORD)), F.lit(0)).cast("long")).withColumn("__mark", row_mark(df, key, text, source))
    rows, pieces, picks = plan(counted, key, text, source, "__mark")
    # rows of equal mark are numbered on both sides; they are alike, so it does not matter which gets which number
    alike = Window.partitionBy("__mark", "__size")
    rows = rows.where("size > 0").withColumnRenamed("size", "__size")
    full = counted.where("__size > 0")
    if rows.groupBy("__mark", "__size").count().where("count > 1").limit(1).count():
        rows = rows.withColumn("__copy", F.row_number().over(alike.orderBy("s", "start")))
        full = full.withColumn("__copy", F.row_number().over(alike.orderBy("__mark")))
    else:
        rows, full = rows.withColumn("__copy", F.lit(1)), full.withColumn("__copy", F.lit(1))
    chosen = (
        pieces.join(picks.hint("merge"), ["s", "block"])
        .groupBy("s", "start", "pass")
        .agg(F.array_sort(F.collect_list(F.struct("at", "n"))).alias("__runs"), F.sum("n").alias("__taken"))
        .join(rows.select("s", "start", "__mark", "__size", "__copy").hint("merge"), ["s", "start"])
        .select("__mark", "__size", "__copy", "__runs", "__taken")
    )
    words = F.regexp_extract_all(F.col(f"`{text}`"), F.lit(f"({WORD})"))

    def joined(ws: Column) -> Column:
        return F.array_join(F.flatten(F.transform("__runs", lambda r: F.slice(ws, (r["at"] + 1).cast("int"), r["n"].cast("int")))), " ")

    # the words are bound once by the outer function; inside the inner one they would be cut anew for every run
    kept = F.transform(F.array(words), joined)[0]
    mixed = full.join(chosen.hint("merge"), ["__mark", "__size", "__copy"])
    mixed = mixed.withColumn("__new", F.when(F.col("__taken") == F.col("__size"), F.col(f"`{text}`")).otherwise(kept))
    cols = {text: F.col("__new"), size: F.length("__new").cast(df.schema[size].dataType)} if size in df.columns else {text: F.col("__new")}
    out = mixed.select(*[cols.get(c, F.col(f"`{c}`")).alias(c) for c in df.columns])
    return out.unionByName(counted.where("__size = 0").select(*[F.col(f"`{c}`") for c in df.columns]))
