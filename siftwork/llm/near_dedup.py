"""MinHash near-duplicate detection: one-permutation hashing with optimal densification.

1. One pass hashes each text's word shingles, keeps the smallest hash of each of
   256 bins (one permutation), fills empty bins from the full bin of least rank
   in a fixed random order (optimal densification) and folds the bins to bands.
2. Texts with the same shingle set collapse to one representative each.
3. In each band bucket, star-shaped edges go from the smallest id to the other
   members, so a bucket of m texts gives m - 1 edges.  The connected components
   of the stars are *clusters*: texts that share any bucket share a cluster.
4. Clusters are compared on whole sets, blockwise.  A small cluster is one block.
   A large one is split in blocks: first a few members against all, then every
   member outside the largest component found so far against all, so no link
   between components is missed, while only spanning links leave a block.
5. Components of the confirmed links give the result.

The nodes of all this are sets, not ids: rows of one id with different texts
are compared like any others.

Defined cases: null or empty texts have an empty set, link with nothing and are
kept; equal sets link; a null doc_id gets a null component and is not kept;
repeated rows keep their rows and share a component; rows of one doc_id are one
document, so ``near_duplicates`` links all that their texts link with, an empty
text beside another one included; ``one_of_each`` goes by texts, and keeps each
text that is no near copy of a kept one, whatever ids it shares; extra columns
are ignored by ``near_duplicates`` and kept by ``one_of_each``.

What may be missed: a pair at the threshold shares no bucket with chance MISS.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .shared import byte_texts, lower_ascii, materialize, mix, signed, sized_broadcast, small_batches, windows, word_hashes

BINS = 256
#: A band scheme may miss a pair at the threshold with this probability at most.
MISS = 1e-8
#: A cluster up to this many members and bytes is compared in one block.
BLOCK_MEMBERS, BLOCK_BYTES = 256, 4 << 20
#: Members of a large cluster that are compared with all of it in the first round; centres in a block of the second.
PIVOTS, CENTRES = 16, 64

_rng = np.random.default_rng(20240229)
#: For each bin, the order in which it looks for a full bin.
_RANK = np.argsort(_rng.random((BINS, BINS)), axis=1).argsort(axis=1).astype(np.int16)


def band_rows(threshold: float) -> int:
    """The most rows a band may have for a miss probability of MISS."""
    return max([r for r in range(1, 9) if (1 - threshold**r) ** (BINS // r) <= MISS], default=1)


def shingle_set(data: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles of ``size`` words; a shorter text's whole sequence as one."""
    words = word_hashes(lower_ascii(data))
    if len(words) == 0:
        return words
    return np.unique(windows(words, min(size, len(words))))


def signature(shingles: np.ndarray) -> np.ndarray:
    """One hash per bin; the top bits of a hash name its bin."""
    bins = (shingles >> np.uint64(56)).astype(np.int64)
    first = np.flatnonzero(np.diff(bins, prepend=-1))
    full = bins[first]
    out = np.empty(BINS, np.uint64)
    out[full] = shingles[first]
    if len(full) < BINS:
        empty = np.setdiff1d(np.arange(BINS), full, assume_unique=True)
        out[empty] = out[full[_RANK[np.ix_(empty, full)].argmin(axis=1)]]
    return out


def bands(sig: np.ndarray, rows: int) -> np.ndarray:
    n = BINS // rows
    key = np.arange(n, dtype=np.uint64)
    for column in sig[: n * rows].reshape(n, rows).T:
        key = mix(key * np.uint64(0x9FB21C651E98DF25) + column)
    return key


def _sketch(size: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_shingles, n_bytes, keys, found = [], [], [], []
            for data in byte_texts(batch.column("text")):
                shingles = shingle_set(data, size)
                n_shingles.append(len(shingles))
                n_bytes.append(len(data))
                keys.append(hashlib.blake2b(shingles.tobytes(), digest_size=16).digest() if len(shingles) else None)
                found.append(signed(bands(signature(shingles), rows)) if len(shingles) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_key"), pa.array(n_shingles, pa.int64()), pa.array(n_bytes, pa.int64()), pa.array(keys, pa.binary()), pa.array(found, pa.list_(pa.int64()))],
                names=["doc_id", "text_key", "n_shingles", "n_bytes", "set_key", "bands"],
            )

    return run


class _Forest(dict):
    def find(self, x):
        while (up := self.get(x, x)) != x:
            self[x] = up = self.get(up, up)
            x = up
        return x

    def join(self, x, y) -> bool:
        x, y = self.find(x), self.find(y)
        if x == y:
            return False
        self[max(x, y)] = min(x, y)
        return True


def _compare(size: int, percent: int):
    """A block: rows that are centres are compared with all rows after them and all others; spanning links come out."""

    def run(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values(["centre", "node"], ascending=[False, True]).drop_duplicates("node")
        nodes, centres = block["node"].tolist(), int(block["centre"].sum())
        sets = [shingle_set(np.frombuffer(t.encode(), np.uint8), size) for t in block["text"]]
        lengths = np.array([len(s) for s in sets])
        ends = np.concatenate(([0], np.cumsum(lengths)))
        names, places = np.unique(np.concatenate(sets), return_inverse=True)
        held = np.zeros(len(names), bool)
        forest, links = _Forest(), []
        for i in range(min(centres, len(nodes) - 1)):
            if len(links) == len(nodes) - 1:
                break
            own, rest = places[ends[i] : ends[i + 1]], places[ends[i + 1] :]
            held[own] = True
            shared = np.add.reduceat(held[rest], ends[i + 1 : -1] - ends[i + 1], dtype=np.int64)
            held[own] = False
            near = np.flatnonzero(100 * shared >= percent * (lengths[i] + lengths[i + 1 :] - shared)) + i + 1
            links += [(nodes[i], nodes[j]) for j in near.tolist() if forest.join(nodes[i], nodes[j])]
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    return run


def _sets(docs: DataFrame, shingle: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of docs(doc_id, text): the rows with their sets, the sets with an id, and node, joined for nodes that link by their texts."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("text_key", F.xxhash64("text"))
    sketched = docs.mapInArrow(_sketch(shingle, band_rows(percent / 100)), "doc_id long, text_key long, n_shingles long, n_bytes long, set_key binary, bands array<long>")
    sketched = materialize(sketched, "sketches")
    groups = sketched.where("set_key is not null and doc_id is not null").groupBy("set_key")
    groups = groups.agg(F.min(F.struct("doc_id", "text_key")).alias("rep"), F.first("bands").alias("bands"), F.first("n_bytes").alias("n_bytes"))
    groups = materialize(groups.select("set_key", F.xxhash64("set_key").alias("node"), "rep", "bands", "n_bytes"), "sets")

    keyed = groups.select(F.explode("bands").alias("band"), "node")
    shared = keyed.groupBy("band").agg(F.min("node").alias("centre"), F.max("node").alias("last")).where("centre < last").select("band", "centre")
    stars = keyed.join(shared, "band").where("node > centre").select("centre", "node").distinct()
    clusters = materialize(connected_components(materialize(stars, "stars"), "centre", "node"), "clusters")
    return sketched, groups, _confirmed(docs, sketched, groups, clusters, shingle, percent)


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs(doc_id, text)."""
    sketched, groups, links = _sets(docs, shingle, percent)
    several = F.min("set_key") < F.max("set_key")
    beside = (F.count("set_key") > 0) & (F.count("set_key") < F.count("*"))
    ids = sketched.where("doc_id is not null").groupBy("doc_id").agg(several.alias("several"), beside.alias("beside"))
    ids = materialize(ids.where("several or beside"), "ids")
    named = groups.select("set_key", "node", F.col("rep.doc_id").alias("rep"))
    if ids.where("several").limit(1).count():
        held = sketched.join(sized_broadcast(ids.where("several").select("doc_id"), 16), "doc_id").select("doc_id", "set_key").distinct()
        held = materialize(held.join(named, "set_key").select("doc_id", "node"), "held")
        least = held.groupBy("doc_id").agg(F.min("node").alias("a"))
        links = links.union(held.join(least, "doc_id").where("node > a").select("a", F.col("node").alias("b")).distinct())
    found = materialize(connected_components(links, "a", "b"), "found")
    lowest = found.join(named, "node").groupBy("component").agg(F.min("rep").alias("joined"))
    found = found.join(lowest, "component").select("node", "joined")
    reps = named.join(sized_broadcast(found, 16), "node", "left").select("set_key", F.coalesce("joined", "rep").alias("set_component"))
    rows = sketched.select("doc_id", "n_shingles", "set_key").join(reps, "set_key", "left")
    if ids.where("beside").limit(1).count():
        other = rows.where("set_key is not null").join(sized_broadcast(ids.where("beside").select("doc_id"), 16), "doc_id").groupBy("doc_id").agg(F.min("set_component").alias("other"))
        rows = rows.join(sized_broadcast(other, 16), "doc_id", "left").withColumn("set_component", F.coalesce("set_component", "other"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("set_component", "doc_id"))
    return rows.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def _confirmed(docs: DataFrame, sketched: DataFrame, groups: DataFrame, clusters: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Links (a, b) of nodes that span the components inside each cluster."""
    members = clusters.select("node", F.col("component").alias("cluster"))
    members = members.join(groups.select("node", "rep", "n_bytes"), "node")
    sizes = members.groupBy("cluster").agg(F.count("*").alias("n"), F.sum("n_bytes").alias("bytes"))
    chunks = F.greatest(F.ceil(F.col("n") / BLOCK_MEMBERS), F.ceil(F.col("bytes") / BLOCK_BYTES)).cast("int")
    members = members.select("node", "rep", "cluster").join(sizes.select("cluster", "n", chunks.alias("chunks")), "cluster")
    members = members.withColumn("turn", F.xxhash64(F.col("node"), F.lit(7)))
    members = materialize(members, "members")
    compare = _compare(shingle, percent)

    def compared(rows: DataFrame) -> DataFrame:
        """rows: node, rep, cluster, block, chunk, centre; one text a node travels, and once a row."""
        places = rows.groupBy("rep").agg(F.first("node").alias("node"), F.collect_list(F.struct("cluster", "block", "chunk", "centre")).alias("places"))
        places = materialize(places.select(F.col("rep.doc_id").alias("doc_id"), F.col("rep.text_key").alias("text_key"), "node", "places"), "places")
        texts = docs.join(sized_broadcast(places, 56 + 32 * F.size("places")), ["doc_id", "text_key"])
        if repeated:
            texts = texts.groupBy("doc_id", "text_key", "node").agg(F.first("text").alias("text"), F.first("places").alias("places"))
        return texts.select("node", "text", F.explode("places").alias("p")).select("node", "text", "p.*").groupBy("cluster", "block", "chunk").applyInPandas(compare, "a long, b long")

    copies = sketched.select("doc_id", "text_key").join(sized_broadcast(members.select(F.col("rep.doc_id").alias("doc_id"), F.col("rep.text_key").alias("text_key")), 24), ["doc_id", "text_key"])
    repeated = copies.groupBy("doc_id", "text_key").count().where("count > 1").limit(1).count()
    small = members.where("chunks = 1").select("node", "rep", "cluster", F.lit(0).alias("block"), F.lit(0).alias("chunk"), F.lit(True).alias("centre"))
    links = compared(small)
    large = members.where("chunks > 1")
    if large.limit(1).count() == 0:
        return materialize(links, "links")
    place = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")

    def against_all(centres: DataFrame) -> DataFrame:
        """centres: node, rep, cluster, block, chunks."""
        blocks = centres.select("cluster", "block").distinct()
        rest = large.join(blocks, "cluster").select("node", "rep", "cluster", "block", place.alias("chunk"), F.lit(False).alias("centre"))
        spread = centres.select("node", "rep", "cluster", "block", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(True).alias("centre"))
        return compared(rest.unionByName(spread))

    # A member is a pivot with a chance that makes PIVOTS of them on average.
    chance = F.pmod("turn", F.lit(1 << 20)) * F.col("n") < PIVOTS * (1 << 20)
    first = materialize(links.unionByName(against_all(large.where(chance).select("node", "rep", "cluster", F.lit(0).alias("block"), "chunks"))), "links")
    parts = connected_components(first, "a", "b").select("node", "component")
    known = materialize(large.join(parts, "node", "left").withColumn("component", F.coalesce("component", "node")), "known")
    counts = known.groupBy("cluster", "component").count()
    largest = counts.groupBy("cluster").agg(F.max_by("component", F.struct("count", "component")).alias("component"))
    rest = known.join(largest, ["cluster", "component"], "left_anti").where(~chance)
    block = F.pmod(F.xxhash64("node", F.lit(3)), F.greatest(F.ceil(F.col("size") / CENTRES), F.lit(1))).cast("int") + 1
    rest = rest.join(rest.groupBy("cluster").agg(F.count("*").alias("size")), "cluster").select("node", "rep", "cluster", block.alias("block"), "chunks")
    rest = materialize(rest, "rest")
    if rest.limit(1).count() == 0:
        return first
    return materialize(first.unionByName(against_all(rest)), "links")


def one_of_each(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs that stay: one for each component of texts, and those without an id; columns as they are."""
    sketched, groups, links = _sets(docs.select("doc_id", "text"), shingle, percent)
    found = materialize(connected_components(links, "a", "b"), "found")
    named = groups.select("set_key", "node", "rep").join(sized_broadcast(found, 16), "node", "left").withColumn("component", F.coalesce("component", "node"))
    first = named.groupBy("component").agg(F.min("rep").alias("stays"))
    named = materialize(named.join(first, "component").select("set_key", "stays"), "named")
    rows = sketched.where("doc_id is not null").select("doc_id", "text_key", "set_key").join(named, "set_key", "left")
    stays = F.coalesce(F.col("stays") == F.struct("doc_id", "text_key"), F.lit(True))
    verdicts = materialize(rows.groupBy("doc_id", "text_key").agg(F.min(stays).alias("stays"), F.count("*").alias("copies")), "verdicts")
    gone = verdicts.where("not stays").select(F.col("doc_id").alias("_gone_id"), F.col("text_key").alias("_gone_key"))
    names = [f"_c{i}" for i in range(len(docs.columns))]
    place = {c: F.col(names[docs.columns.index(c)]) for c in ("doc_id", "text")}
    key = (place["doc_id"].cast("long"), F.xxhash64(place["text"].cast("string")))
    left = docs.toDF(*names)
    left = left.join(sized_broadcast(gone, 24), (key[0] == F.col("_gone_id")) & (key[1] == F.col("_gone_key")), "left_anti")
    if verdicts.where("stays and copies > 1").limit(1).count():
        known = place["doc_id"].isNotNull()
        left = left.where(known).dropDuplicates([names[docs.columns.index(c)] for c in ("doc_id", "text")]).unionByName(left.where(~known))
    return left.toDF(*docs.columns)
