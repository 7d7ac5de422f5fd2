"""Mixing sources to target weights by pivotal dependent rounding; DataFrame functions only.

1. Sources share the words of the whole table by weight.  A target stops at
   ``most`` times its source's size and the excess is shared again by weight:
   a target is least(most * size, level * weight), and the level rises round by
   round from three sums.
2. Every document of a source gets the same expected number of copies,
   target / source size.  The whole part is taken; the fraction is mass, in
   units of 1 / UNIT words.
3. Pivotal rounding: two documents with fractional copies meet, and mass moves
   from one to the other, with odds that keep both expectations, until one
   copy is none or whole.  Mass is a whole number, so a source's words do not
   change at all.
4. Chunks of about FAN documents of a source leave one fractional document
   each; these meet in chunks again, a tree of logarithmic height.  The last
   one of a source is rounded to the nearer side, so a source's taken words
   differ from its target by half of one document at most (and by the rounding
   to units); that one document is the only one whose odds the rounding bends.

Chunks and odds come from hashes of the rows, so reruns agree on any cluster.
Equal rows are one item with a count: a row that is repeated a million times is
no hot chunk, and its copies are spread evenly over the repeats.

Defined cases: null and empty texts have size 0 and take nothing; a null source
is a source of its own, after all others; a null doc_id is an id like others;
repeated rows keep their rows; a source without words has target 0; an empty
table gives no rows; extra columns are ignored by ``mix`` and kept by ``mixed``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import materialize, sized_broadcast

#: Units of mass in a word; documents of a chunk on average; rows of one repeated item that are made at a time.
UNIT, FAN, REPEATS = 1 << 20, 64, 4096
_SPACE = " \t\n\x0b\x0c\r"
_ITEM = ["doc_id", "source", "size", "text_key"]


def word_count(text: Column) -> Column:
    """Number of runs [^\\x20\\x09-\\x0D]+: each run, with the white space behind it, becomes one letter."""
    text = F.ltrim(F.coalesce(text.cast("string"), F.lit("")), F.lit(_SPACE))
    return F.length(F.regexp_replace(text, r"[^\x20\x09-\x0D]++[\x20\x09-\x0D]*+", "x")).cast("long")


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumns({"source": F.col("source").cast("string"), "size": word_count(F.col("text")), "text_key": F.xxhash64(F.col("text").cast("string"))})


def cyclic_weights(sources: DataFrame, weights: Sequence[int]) -> DataFrame:
    """sources(source, ...) with their weights: by code point, null last, weights repeating.

    Ranks are counted inside ranges of sources, and the ranges' sizes are added up, so no task holds all sources.
    """
    order = [F.col("source").isNull(), F.col("source")]
    ranged = materialize(sources.repartitionByRange(64, *order).withColumn("part", F.spark_partition_id()), "ranged")
    before = ranged.groupBy("part").count().select("part", (F.sum("count").over(W.orderBy("part")) - F.col("count")).alias("before"))
    rank = F.col("before") + F.row_number().over(W.partitionBy("part").orderBy(*order)) - 1
    cycle = F.array(*[F.lit(w).cast("long") for w in weights])
    return ranged.join(F.broadcast(before), "part").withColumn("rank", rank).withColumn("weight", F.get(cycle, F.pmod("rank", F.lit(len(weights))).cast("int"))).drop("part", "before")


def targets(sources: DataFrame, most: int = 3) -> DataFrame:
    """sources(source, rank, source_size, weight) with target, the words each is to give (double)."""
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    total, weights = (int(v or 0) for v in sources.agg(F.sum(wide("source_size")), F.sum(wide("weight"))).first())
    share, of = total, weights
    while of:
        above = wide("weight") * F.lit(share).cast("decimal(19,0)") > F.lit(most) * wide("source_size").cast("decimal(19,0)") * F.lit(of).cast("decimal(15,0)")
        stopped, heavy = (int(v or 0) for v in sources.where(above).agg(F.sum(F.lit(most) * wide("source_size")), F.sum(wide("weight"))).first())
        if (total - stopped, weights - heavy) == (share, of):
            break
        share, of = total - stopped, weights - heavy
    level = F.col("weight").cast("double") * F.lit(float(share)) / F.lit(float(of)) if of else F.lit(float("inf"))
    ceiling = (F.lit(most) * F.col("source_size")).cast("double")
    return sources.withColumn("target", F.when(F.col("weight") == 0, 0.0).otherwise(F.least(level, ceiling)))


def _met(held: Column, other: Column) -> tuple[Column, Column]:
    """Two items after mass moved; at least one of them is none or whole then."""
    gain = F.least(held["whole"] - held["mass"], other["mass"])
    loss = F.least(held["mass"], other["whole"] - other["mass"])
    # The chance of a gain is loss / (gain + loss), so neither expectation changes.
    move = F.when(other["odds"] * (gain + loss).cast("double") < loss.cast("double"), gain).otherwise(-loss)
    return held.withField("mass", held["mass"] + move), other.withField("mass", other["mass"] - move)


def _chunk_result(items: Column) -> Column:
    """All items of a chunk, of which one at most is still fractional."""

    def step(acc: Column, other: Column) -> Column:
        # The pair is bound once, as the only element of an array, and used several times.
        pair = F.transform(F.array(F.struct(acc["held"].alias("held"), other.alias("other"))), lambda p: F.struct(*(c.alias(n) for c, n in zip(_met(p["held"], p["other"]), ("a", "b")))))

        def sort_out(p: Column) -> Column:
            settled = (p["a"]["mass"] == 0) | (p["a"]["mass"] == p["a"]["whole"])
            return F.struct(F.when(settled, p["b"]).otherwise(p["a"]).alias("held"), F.array_append(acc["done"], F.when(settled, p["a"]).otherwise(p["b"])).alias("done"))

        return F.get(F.transform(pair, sort_out), F.lit(0))

    start = F.struct(F.get(items, F.lit(0)).alias("held"), F.slice(items, 1, 0).alias("done"))
    return F.aggregate(F.slice(items, F.lit(2), F.greatest(F.size(items) - 1, F.lit(0))), start, step, lambda acc: F.array_append(acc["done"], acc["held"]))


def _rounded(items: DataFrame, seed: int) -> DataFrame:
    """items(rank, mass, whole, ...) with every mass none or whole."""
    fields = [c for c in items.columns if c != "rank"]
    fractional = (F.col("mass") > 0) & (F.col("mass") < F.col("whole"))
    settled, level = [items.where(~fractional)], 0
    left = items.where(fractional)
    while True:
        counts = materialize(left.groupBy("rank").count(), "fractional")
        most = counts.agg(F.max("count")).first()[0] or 0
        if most <= 1:
            break
        chunks = F.ceil(F.col("count") / FAN).cast("long")
        level += 1
        mark = lambda salt: F.xxhash64("doc_id", "size", "text_key", F.lit(level), F.lit(seed), F.lit(salt))  # noqa: B023,E731
        # Documents of one size meet in an order of its own; sorted by their odds they would not meet by chance.
        odds = F.shiftrightunsigned(mark(1), 11).cast("double") * F.lit(2.0**-53)
        chunked = left.join(sized_broadcast(counts, 16), "rank").select("rank", F.pmod(mark(0), chunks).alias("chunk"), F.struct((-F.col("size")).alias("order"), mark(2).alias("turn"), odds.alias("odds"), *fields).alias("item"))
        met = chunked.groupBy("rank", "chunk").agg(_chunk_result(F.array_sort(F.collect_list("item"))).alias("items"))
        met = materialize(met.select("rank", F.explode("items").alias("item")).select("rank", *[f"item.{c}" for c in fields]), "rounded")
        settled.append(met.where(~fractional))
        left = met.where(fractional)
    settled.append(left.withColumn("mass", F.when(F.col("mass") * 2 >= F.col("whole"), F.col("whole")).otherwise(F.lit(0).cast("long"))))
    out = settled[0]
    for rows in settled[1:]:
        out = out.unionByName(rows)
    return out


def _decided(docs: DataFrame, weights: Sequence[int] | DataFrame, most: int, seed: int) -> DataFrame:
    """Items (doc_id, source, size, text_key, repeats) with source_size, target, base copies of each repeat, and extra copies of all."""
    items = materialize(_keyed(docs.select("doc_id", "source", "text")).groupBy(*_ITEM).agg(F.count("*").alias("repeats")), "items")
    sources = items.groupBy("source").agg(F.sum(F.col("size") * F.col("repeats")).alias("source_size"))
    if isinstance(weights, DataFrame):
        given = weights.select(F.col("source").alias("given"), F.col("weight").cast("long").alias("weight"))
        sources = sources.join(given, F.col("source").eqNullSafe(F.col("given")), "left").drop("given").fillna(0, ["weight"])
        sources = sources.withColumn("rank", F.xxhash64("source", F.col("source").isNull()))
    else:
        sources = cyclic_weights(sources, weights)
    sources = materialize(targets(materialize(sources, "sources"), most), "targets")
    copies = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    shares = sources.select(F.col("source").alias("of"), "rank", F.floor(copies).alias("base"), (copies - F.floor(copies)).alias("part"))
    shared = items.join(sized_broadcast(shares, 40 + F.coalesce(F.octet_length("of"), F.lit(0))), F.col("source").eqNullSafe(F.col("of"))).drop("of", "source")
    whole = F.col("size") * UNIT
    unit = F.least(whole, F.floor(F.col("part") * whole.cast("double") + 0.5))
    mass = F.col("repeats").cast("decimal(19,0)") * unit.cast("decimal(19,0)")
    # Of equal rows so many get one more that less than one copy is left to chance.
    shared = shared.withColumn("whole", whole).withColumn("extra", F.when(whole > 0, F.floor(mass / F.col("whole"))).otherwise(0).cast("long")).withColumn("mass", (mass - F.col("extra").cast("decimal(19,0)") * F.col("whole").cast("decimal(19,0)")).cast("long")).drop("part")
    rounded = _rounded(shared, seed)
    won = F.when((F.col("whole") > 0) & (F.col("mass") == F.col("whole")), 1).otherwise(0)
    rounded = rounded.select("rank", "doc_id", "size", "text_key", "repeats", "base", (F.col("extra") + won).alias("extra"))
    sources = sources.select("rank", "source", "source_size", "target")
    return rounded.join(sized_broadcast(sources, 40 + F.coalesce(F.octet_length("source"), F.lit(0))), "rank").drop("rank")


def mix(docs: DataFrame, weights: Sequence[int] | DataFrame = (1, 2, 3), most: int = 3, seed: int = 0) -> DataFrame:
    """doc_id, size, source_size, target, taken, source, copies of each row of docs(doc_id, source, text).

    weights: numbers that repeat over the sources in code-point order, or rows (source, weight); others weigh 0.
    """
    items = _decided(docs, weights, most, seed)
    ends = (F.col("repeats") - 1) / REPEATS
    blocks = items.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(ends))).alias("block"))
    first = F.col("block") * REPEATS
    rows = blocks.select("*", F.explode(F.sequence(first, F.least(F.col("repeats"), first + REPEATS) - 1)).alias("at"))
    copies = F.col("base") + F.when(F.col("at") < F.col("extra"), 1).otherwise(0)
    return rows.select("doc_id", "size", "source_size", "target", (copies * F.col("size")).alias("taken"), "source", copies.alias("copies"))


def mixed(docs: DataFrame, weights: Sequence[int] | DataFrame = (1, 2, 3), most: int = 3, seed: int = 0) -> DataFrame:
    """The mix itself: rows of docs, each as often as it was taken; columns as they are."""
    items = _decided(docs, weights, most, seed).select(*[F.col(c).alias(f"_{c}") for c in _ITEM], F.col("repeats").alias("_repeats"), F.col("base").alias("_base"), F.col("extra").alias("_extra"))
    items = materialize(items.where("_base + _extra > 0"), "copies")
    names = [f"_c{i}" for i in range(len(docs.columns))]
    rows = docs.toDF(*names)
    place = {c: F.col(names[docs.columns.index(c)]) for c in ("doc_id", "source", "text")}
    keys = {"_doc_id": place["doc_id"], "_source": place["source"].cast("string"), "_size": word_count(place["text"]), "_text_key": F.xxhash64(place["text"].cast("string"))}
    rows = rows.withColumns({f"{k}_": v for k, v in keys.items()})
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"{k}_").eqNullSafe(F.col(k))
    found = rows.join(sized_broadcast(items, 64 + F.coalesce(F.octet_length("_source"), F.lit(0))), same)
    times = lambda rows, n: rows.where(n > 0).select(*names, F.explode(F.sequence(F.lit(1).cast("long"), n)))
    repeated = found.where("_repeats > 1")
    parts = times(found, F.col("_base") + F.when(F.col("_repeats") == 1, F.col("_extra")).otherwise(0))
    extra = repeated.dropDuplicates([f"{k}_" for k in keys])
    blocks = extra.where("_extra > 0").select(*names, "_extra", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_extra") - 1) / REPEATS))).alias("_block"))
    return parts.unionByName(times(blocks, F.least(F.lit(REPEATS).cast("long"), F.col("_extra") - F.col("_block") * REPEATS))).select(*names).toDF(*docs.columns)
