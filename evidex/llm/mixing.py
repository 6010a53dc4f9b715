"""Mixing sources to target weights, with DataFrame functions alone.

Tokens are words. Each source's documents are laid end to end in a fixed pseudorandom order and packed into blocks of BLOCK
words (the last may be shorter). A source's target fixes how many slots of the mix it fills.

The draw: an output shard has SHARD slots, and each draws its source with the sources' shares of all slots, so a shard's counts
of sources are a multinomial draw. A source's slots are numbered through, shard after shard, from these counts. What a source
drew beyond its slots is left empty; what it drew too few follows in further shards, so the mix meets the targets to a word.

Slot k of a source is place k mod n of epoch k div n; a swap-or-not permutation, keyed by source and epoch, maps the place to a
block index (a short last block keeps the last place, so that the words before a slot are known in closed form and the last
slot can be cut where the target is reached). Blocks are joined to slots by (source, index).

Targets: sources by code point, null last, weigh 5, 2, 1, repeating, and share the total size; a target stops at three times
its source's size and the excess is reshared by weight, which is min(3 size, level x weight) at the level that sums up.

Scale: word positions come from two-level prefix sums over SEGMENTS hash segments of a source, and a source's slot numbers from
such sums over runs of shards, so one source may hold any share of the rows. Only the list of sources is ever ordered as a whole.

Odd input: null or blank texts have size 0, take part in nothing and have taken 0; null sources are a source; rows that repeat
an id count as rows of their own, each with its own text; sources of size 0 have target 0; an empty table gives none; other
columns pass by, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evidex.llm.shared import table, written

WEIGHTS = (5, 2, 1)
MOST = 3
BLOCK = 128
SHARD = 1024
SEGMENTS = 4096
RUN = 4096
SHARDS_A_RUN = 4096
ROUNDS = 24
SEED = 20


def size_of(text: Column) -> Column:
    """Number of words [^\\x20\\x09-\\x0D]+; null: 0."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """Of (source, source_size), one row per source: rank (from 0), source, source_size, target."""
    ranked = sizes.select("source", F.col("source_size").cast("double").alias("size"), (F.row_number().over(W.orderBy(F.col("source").isNull(), "source")) - 1).alias("rank"))
    weighed = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("rank") % len(WEIGHTS) + 1).cast("int")).cast("double")).withColumn("cap", MOST * F.col("size"))
    order = W.orderBy(F.col("cap") / F.col("weight"), "rank")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    every = W.orderBy(F.lit(0)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    # the level if just the sources before this one are at their caps; the right one is the first that its own source's cap allows
    level = (F.sum("size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    levelled = weighed.withColumn("level", level).withColumn("place", F.row_number().over(order))
    levelled = levelled.withColumn("right", F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct("place", "level"))).over(every)["level"])
    return levelled.select("rank", "source", F.col("size").cast("long").alias("source_size"), F.least(F.col("cap"), F.coalesce(F.col("right") * F.col("weight"), F.col("cap"))).alias("target"))


def layout(docs: DataFrame, row: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, row, rank, size, start, source_size, target): a document's words are start to start + size - 1 of its source; and the sources' targets.

    row: a number that tells rows apart, where the caller needs one.
    """
    segment = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(SEED)), F.lit(SEGMENTS)).cast("int")
    text = F.col("text").cast("string")
    columns = [F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size_of(text).alias("size"), segment.alias("segment"), F.xxhash64(text).alias("tie"), (F.lit(None) if row is None else row).cast("long").alias("row")]
    sized = written(docs.select(*columns), "mix-sizes")
    parts = sized.groupBy("source", "segment").agg(F.sum("size").alias("words"))
    by_source = targets(parts.groupBy("source").agg(F.sum("words").alias("source_size")))
    parts = parts.withColumn("base", F.sum("words").over(W.partitionBy("source").orderBy("segment")) - F.col("words"))
    inner = W.partitionBy("source", "segment").orderBy("doc_id", "size", "tie", "row").rowsBetween(W.unboundedPreceding, 0)
    laid = sized.withColumn("within", F.sum("size").over(inner) - F.col("size")).alias("a")
    joined = laid.join(parts.alias("p"), F.col("a.source").eqNullSafe(F.col("p.source")) & (F.col("a.segment") == F.col("p.segment")))
    named = by_source.select("source", "rank", "source_size", "target").alias("s")
    joined = joined.select("a.*", (F.col("p.base") + F.col("a.within")).alias("start")).alias("j").join(named, F.col("j.source").eqNullSafe(F.col("s.source")))
    return joined.select("j.doc_id", "j.row", "s.rank", "j.size", "j.start", "s.source_size", "s.target"), by_source


def permuted(place: Column, n: Column, key: Column) -> Column:
    """A pseudorandom bijection of 0 to n - 1, fixed by key: ROUNDS rounds of swap-or-not."""

    def one(x: Column, r: Column) -> Column:
        pivot = F.pmod(F.xxhash64(key, r, F.lit(SEED)), n)
        other = F.pmod(pivot - x, n)
        return F.when(F.xxhash64(key, r, F.greatest(x, other)).bitwiseAND(1) == 1, other).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), place, one)


def planned(sources: DataFrame, block: int = BLOCK) -> DataFrame:
    """Of every source that the mix takes from: rank, source_size, take (words), blocks (of an epoch), count (slots), upto (slots of all sources up to this one)."""
    per = sources.where("source_size > 0").select("rank", "source_size", F.round("target").cast("long").alias("take"))
    per = per.withColumn("epochs", F.floor(F.col("take") / F.col("source_size"))).withColumn("blocks", F.ceil(F.col("source_size") / block))
    per = per.withColumn("rest", F.col("take") - F.col("epochs") * F.col("source_size")).withColumn("count", F.col("epochs") * F.col("blocks") + F.ceil(F.col("rest") / block))
    per = per.where("count > 0").withColumn("upto", F.sum("count").over(W.orderBy("rank")))
    return per.select("rank", "source_size", "take", "blocks", "count", "upto")


def drawn(plan: DataFrame, shard: int = SHARD) -> DataFrame:
    """The multinomial draw: rank, shard, n (slots of the shard that drew the source). All shards but the last have `shard` slots."""
    partitions = int(plan.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # one row: the ends of the sources' shares of all slots, in order
    shares = plan.agg(F.array_sort(F.collect_list(F.struct("upto", "rank"))).alias("shares"), F.max("upto").alias("total")).where("total > 0")
    shards = shares.select("*", F.explode(F.expr(f"sequence(0L, (total - 1) div {shard} div {SHARDS_A_RUN})")).alias("run")).repartition(partitions, "run")
    shards = shards.select("*", F.explode(F.expr(f"sequence(run * {SHARDS_A_RUN}, least((total - 1) div {shard}, (run + 1) * {SHARDS_A_RUN} - 1))")).alias("shard")).repartition(partitions, "shard")
    each = shards.select("shares", "shard", "total", F.explode(F.expr(f"sequence(shard * {shard}, least(total, (shard + 1) * {shard}) - 1)")).alias("place"))
    each = each.withColumn("u", F.pmod(F.xxhash64("place", F.lit(SEED + 1)), F.col("total")))
    # by halves: the first share that ends above u
    halves = F.sequence(F.lit(1), F.ceil(F.log2(F.size("shares").cast("double"))).cast("int") + 1)
    both = F.struct(F.lit(0).alias("lo"), (F.size("shares") - 1).alias("hi"))

    def half(a: Column, _: Column) -> Column:
        middle = F.floor((a["lo"] + a["hi"]) / 2).cast("int")
        above = F.get("shares", middle)["upto"] > F.col("u")
        return F.struct(F.when(above, a["lo"]).otherwise(F.least(middle + 1, a["hi"])).alias("lo"), F.when(above, middle).otherwise(a["hi"]).alias("hi"))

    source = F.get("shares", F.aggregate(halves, both, half)["lo"])["rank"]
    return each.select(source.alias("rank"), "shard").groupBy("rank", "shard").agg(F.count(F.lit(1)).alias("n"))


def slots(sources: DataFrame, block: int = BLOCK, shard: int = SHARD) -> DataFrame:
    """One row per slot of the mix: rank, shard, slot (number within its source), epoch, block (index within its source), words (how many of the block's words it takes)."""
    partitions = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    plan = written(planned(sources, block), "mix-plan")
    draw = written(drawn(plan, shard).withColumn("run", F.expr(f"shard div {SHARDS_A_RUN}")), "mix-draw")
    runs = draw.groupBy("rank", "run").agg(F.sum("n").alias("in_run"))
    runs = runs.withColumn("before", F.sum("in_run").over(W.partitionBy("rank").orderBy("run")) - F.col("in_run")).drop("in_run")
    within = F.sum("n").over(W.partitionBy("rank", "run").orderBy("shard")) - F.col("n")
    counts = draw.withColumn("within", within).join(runs, ["rank", "run"]).join(plan.select("rank", "count"), "rank")
    first = F.col("before") + F.col("within")
    counts = counts.select("rank", "shard", first.alias("first"), (F.least(F.col("count"), first + F.col("n")) - 1).alias("last")).where("last >= first")
    # few and short rows become many, which Spark can't foresee: a number of tasks of its own, and no broadcast of what comes of it
    taken = counts.repartition(partitions, "rank", "shard").select("rank", "shard", F.explode(F.sequence("first", "last")).alias("slot"))
    short = plan.join(draw.groupBy("rank").agg(F.sum("n").alias("got")), "rank", "left").select("rank", F.coalesce("got", F.lit(0)).alias("got"), "count", F.max("upto").over(W.orderBy(F.lit(0)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias("total"))
    short = short.where("got < count").withColumn("base", F.sum(F.col("count") - F.col("got")).over(W.orderBy("rank")) - (F.col("count") - F.col("got")))
    short = short.select("*", F.explode(F.expr(f"sequence(0L, (count - got - 1) div {RUN})")).alias("run")).repartition(partitions, "rank", "run")
    short = short.select("*", F.explode(F.expr(f"sequence(run * {RUN}, least(count - got, (run + 1) * {RUN}) - 1)")).alias("i"))
    short = short.select("rank", F.expr(f"(total - 1) div {shard} + 1 + (base + i) div {shard}").alias("shard"), F.expr("got + i").alias("slot"))
    each = taken.unionByName(short).join(plan.drop("upto"), "rank")
    each = each.withColumn("epoch", F.expr("slot div blocks")).withColumn("place", F.expr("slot % blocks"))
    full = F.expr(f"source_size div {block}")
    index = F.when(F.col("place") < full, permuted(F.col("place"), F.greatest(full, F.lit(1)), F.xxhash64("rank", "epoch"))).otherwise(F.col("place"))
    left = F.col("take") - F.col("epoch") * F.col("source_size") - F.col("place") * block
    each = each.withColumn("block", index)
    return each.select("rank", "shard", "slot", "epoch", "block", F.least(left, F.lit(block), F.col("source_size") - F.col("block") * block).alias("words"))


def mix(docs: DataFrame, block: int = BLOCK, row: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """The laid-out documents, and the mix: rank, shard, slot, epoch, start, row, size, first, last - words first to last - 1 of the document at start of its source fill a part of that slot."""
    laid, sources = layout(docs, row)
    laid = written(laid, "mix-layout")
    spans = laid.where("size > 0").select("rank", "row", "start", "size", F.explode(F.expr(f"sequence(start div {block}, (start + size - 1) div {block})")).alias("block"))
    filled = slots(sources, block).hint("merge").join(spans, ["rank", "block"])
    first = F.greatest(F.col("block") * block - F.col("start"), F.lit(0))
    last = F.least(F.col("block") * block + F.col("words") - F.col("start"), F.col("size"))
    return laid, filled.select("rank", "shard", "slot", "epoch", "start", "row", "size", first.alias("first"), last.alias("last")).where("last > first")


def mix_amounts(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, size, source_size, target, taken, shards (in which output shards how many of its words stand) of every row."""
    laid, filled = mix(docs, block)
    taken = filled.groupBy("rank", "start", "shard").agg(F.sum(F.col("last") - F.col("first")).alias("words"))
    taken = taken.groupBy("rank", "start").agg(F.sum("words").alias("taken"), F.array_sort(F.collect_list(F.struct("shard", "words"))).alias("shards"))
    # a row of size 0 starts where another may start, and takes nothing
    own = F.when(F.col("size") > 0, F.col("start"))
    out = laid.withColumn("start", own).join(taken, ["rank", "start"], "left")
    none = F.array().cast("array<struct<shard: bigint, words: bigint>>")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), F.coalesce("shards", none).alias("shards"))


def mixed_documents(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """The mix as documents: for every row of docs and epoch that takes of it, one row with docs' columns, in the order of the output shards.

    A document that an epoch takes whole keeps its text; one that is taken in part has the words taken, in order, with single
    spaces. It stands in the shard and at the slot of its first words. Documents of size 0 pass unchanged. n_chars, where docs
    has it, is the length of the new text. Rows that repeat an id are rows of their own.
    """
    # rows are numbered once and written, so that a number always means the same row
    held = written(docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")), "mix-rows")
    laid, filled = mix(held.select("row", "doc.doc_id", "doc.source", "doc.text"), block, F.col("row"))
    parts = filled.groupBy("row", "epoch").agg(F.first("size").alias("size"), F.sum(F.col("last") - F.col("first")).alias("n"), F.array_sort(F.collect_list(F.struct("first", "last"))).alias("spans"), F.min_by(F.struct("shard", "slot"), "first").alias("at"))
    parts = parts.select("row", "at", F.when(F.col("n") < F.col("size"), F.col("spans")).alias("spans"))
    blank = laid.where("size = 0").select("row", F.struct(F.lit(0).cast("long").alias("shard"), F.lit(0).cast("long").alias("slot")).alias("at"), F.lit(None).cast("array<struct<first: bigint, last: bigint>>").alias("spans"))
    joined = held.join(parts.unionByName(blank), "row").withColumn("text", F.col("doc.text"))
    listed = F.split(F.trim(F.regexp_replace("text", r"[\x20\x09-\x0D]+", " ")), " ")
    # a lambda's variable holds the words, so that a text is cut into words once and not for each span
    some = lambda words: F.array_join(F.flatten(F.transform("spans", lambda s: F.slice(words, (s["first"] + 1).cast("int"), (s["last"] - s["first"]).cast("int")))), " ")
    cut = F.get(F.transform(F.array(listed), some), F.lit(0))
    out = joined.select("doc", "at", F.when(F.col("spans").isNull(), F.col("text")).otherwise(cut).alias("text")).repartition("at.shard").sortWithinPartitions("at")
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return out.select(*[new[c].alias(c) if c in new else F.col(f"doc.`{c}`") for c in docs.columns])


def op5_mixing(spark, sf_dir: str) -> DataFrame:
    return mix_amounts(table(spark, sf_dir, "documents"))
