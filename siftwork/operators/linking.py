"""Linking documents: letters to résumés, copies, and documents to targets.

Every link is an equality join (on a key, a phrase or a title word) with a
ranked choice after it; no step compares all pairs.
"""

from __future__ import annotations

import hashlib
import heapq
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dictionaries as d
from ..functions.automaton import Phrases, flat
from ..functions.parse import skills as skills_of
from ..functions.phrases import phrases, placed_phrases
from ..functions.text import WORD, bind, file_stem, found, norm, quoted, title_similarity, title_words, tokens
from .set_join import overlapping, sized
from .stored import stored

#: Blocking keeps this many smallest phrases of a text, and links at this overlap.
BLOCK, NEAR = 8, 0.8
#: Characters of a text in which people say what they apply for; targets that a task holds at once.
HEAD, TARGETS = 1500, 20_000


def link_letters(docs: DataFrame) -> DataFrame:
    """letter_id, cv_id, how from docs(id, kind, email, name, file_name, capture_id, tag, added_at, error).

    Rules in order: mail address, name, capture, file stem; of several hits the one for the same tag, then the latest, then the least id.
    """
    sound = docs.where("error is null") if "error" in docs.columns else docs
    rule = lambda number, how, key: F.struct(F.lit(number).alias("rule"), F.lit(how).alias("how"), F.nullif(key, F.lit("")).alias("key"))
    keys = F.array(
        rule(1, "email", F.lower(F.trim("email"))),
        rule(2, "name", norm(F.col("name"))),
        rule(3, "capture", F.col("capture_id")),
        rule(4, "file", bind(file_stem(F.col("file_name")), lambda s: F.when(F.length(s) > 2, s))),
    )
    keyed = sound.select("id", "kind", "tag", "added_at", F.explode(keys).alias("k")).select("id", "kind", "tag", "added_at", "k.*").where("key is not null")
    letters = keyed.where("kind = 'letter'").select(F.col("id").alias("letter_id"), F.col("tag").alias("letter_tag"), "rule", "how", "key")
    cvs = keyed.where("kind <> 'letter'").select(F.col("id").alias("cv_id"), F.col("tag").alias("cv_tag"), "added_at", "rule", "key")
    # One résumé a key and tag, and one a key, before any letter meets it: a name that many share stays one row.
    latest = F.min_by("cv_id", F.struct(-F.col("added_at").cast("long"), F.col("cv_id")))
    of_tag = cvs.groupBy("rule", "key", F.col("cv_tag").alias("letter_tag")).agg(latest.alias("tagged"))
    of_key = cvs.groupBy("rule", "key").agg(latest.alias("any"))
    pairs = letters.join(of_key, ["rule", "key"]).join(of_tag, ["rule", "key", "letter_tag"], "left").withColumn("cv_id", F.coalesce("tagged", "any"))
    return pairs.groupBy("letter_id").agg(F.min_by(F.struct("cv_id", "how"), "rule").alias("b")).select("letter_id", "b.*")


def with_letters(docs: DataFrame, links: DataFrame) -> DataFrame:
    """Résumés with their letters nested; linked letters leave, others stay as rows of their own."""
    letters = docs.where("kind = 'letter'").join(links.withColumnRenamed("letter_id", "id"), "id")
    nested = letters.groupBy("cv_id").agg(F.array_sort(F.collect_list(F.struct("id", "text"))).alias("letters"))
    rest = docs.join(links.select(F.col("letter_id").alias("id")), "id", "left_anti")
    joined = rest.join(nested.withColumnRenamed("cv_id", "id"), "id", "left")
    return joined.withColumn("letter_text", F.coalesce(F.array_join(F.transform("letters", lambda x: x["text"]), "\n\n"), F.lit(""))).withColumn("letter_only", F.col("kind") == "letter")


def exact_copies(docs: DataFrame) -> DataFrame:
    """id, duplicates: other documents with the same fingerprint; a pre-aggregated count joined back to fingerprints that are made once."""
    docs = stored(docs.select("id", "hash"), "fingerprints")
    counts = docs.groupBy("hash").agg(F.count("*").alias("n"))
    return docs.select("id", "hash").join(counts, "hash").select("id", (F.col("n") - 1).alias("duplicates"))


def same_holder(docs: DataFrame) -> DataFrame:
    """id, same_holder: other tags under which the same person sent another wording, from docs(id, holder, tag, hash).

    Counted from distinct (holder, tag, hash): a tag counts unless all its wordings equal the row's own.
    """
    forms = docs.where("holder is not null and holder <> ''").select("holder", "tag", "hash").distinct()
    by_tag = forms.groupBy("holder", "tag").agg(F.count("*").alias("n"), F.min("hash").alias("only"))
    tags = by_tag.groupBy("holder").agg(F.count("*").alias("n_tags"))
    # Tags whose single wording is the row's own do not count, nor does the row's tag.
    single = by_tag.where("n = 1").groupBy("holder", F.col("only").alias("hash")).agg(F.count("*").alias("n_single"))
    rows = docs.where("holder is not null and holder <> ''").select("id", "holder", "tag", "hash")
    own = by_tag.select("holder", "tag", F.col("n").alias("own_n"), F.col("only").alias("own_only"))
    joined = rows.join(tags, "holder").join(single, ["holder", "hash"], "left").join(own, ["holder", "tag"])
    own_single = F.when((F.col("own_n") == 1) & (F.col("own_only") == F.col("hash")), 1).otherwise(0)
    return joined.select("id", (F.col("n_tags") - 1 - (F.coalesce("n_single", F.lit(0)) - own_single)).alias("same_holder"))


def _phrase_sets(size: int, block: int, stopwords: list[str] | None):
    """The phrase set of each lower-case text in one pass: its digest, its ``block`` smallest phrases, and all, as 64-bit hashes; texts without one are left out."""
    stop = frozenset(d.PHRASE_STOPWORDS if stopwords is None else stopwords)
    key = lambda p: xxhash.xxh64_intdigest(p) - (1 << 63)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_of = regex.compile(WORD + "+")
        for batch in batches:
            for some in (batch.slice(at, 500) for at in range(0, batch.num_rows, 500)):
                ids, wholes, keys, sets = [], [], [], []
                for row, text in enumerate(some.column("text").to_pylist()):
                    words = words_of.findall(text)
                    telling = [0, *accumulate(len(w) > 2 and w not in stop for w in words)]
                    found_ = {" ".join(words[i : i + size]) for i in range(len(words) - size + 1) if telling[i + size] - telling[i] >= 2}
                    if found_:
                        ordered = sorted(found_)
                        ids.append(row)
                        wholes.append(hashlib.md5("\n".join(ordered).encode()).hexdigest())
                        keys.append([key(p) for p in ordered[:block]])
                        sets.append([key(p) for p in ordered])
                columns = [some.column("id").take(pa.array(ids, pa.int64())), pa.array(wholes, pa.string()), *(pa.array(x, pa.list_(pa.int64())) for x in (keys, sets))]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "whole", "keys", "set"])

    return run


def near_copies(docs: DataFrame, text: str = "text", size: int = 4, block: int | None = BLOCK, near: float = NEAR, stopwords: list[str] | None = None) -> DataFrame:
    """a, b, overlap, how: the near copies among docs(id, text), and the exact copies of their phrase sets.

    Rows of how 'near' are pairs of representatives that share at least ``near`` of the smaller set, found by an exact set join; with
    ``block`` only pairs that share one of their ``block`` smallest phrases, with None all.  Equal sets have one representative, their
    smallest id; rows of how 'copy' give its members, so a large group of copies gives one row a member and no pairs.  Phrases meet
    as 64-bit hashes.
    """
    texts = docs.select("id", F.lower(F.coalesce(text, F.lit(""))).alias("text"))
    kind = docs.schema["id"].dataType.simpleString()
    sets = stored(texts.mapInArrow(_phrase_sets(size, block or 0, stopwords), f"id {kind}, whole string, keys array<long>, set array<long>"), "phrases")
    first = sets.groupBy("whole").agg(F.min("id").alias("rep"))
    members = stored(sets.select("id", "whole").join(first, "whole").select("id", "rep"), "members")
    # The copies are fewer than the sets, and ids are small beside them: the sets stay where they are if the copies' ids can be sent to them.
    reps = sets.join(sized(members.where("id <> rep").select("id"), 16), "id", "left_anti").select("id", "keys", F.array_distinct("set").alias("set"))
    close = stored(overlapping(reps.select("id", "set"), near), "close")
    if block:
        side = lambda name: sets.select(F.col("id").alias(name), F.col("keys").alias(f"k_{name}"))
        close = close.join(side("a"), "a").join(side("b"), "b").where(F.arrays_overlap("k_a", "k_b")).select("a", "b", "overlap")
    copies = members.where("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("overlap"))
    return close.withColumn("how", F.lit("near")).unionByName(copies.withColumn("how", F.lit("copy")))


def copies_of(docs: DataFrame, text: str = "text", size: int = 4, stopwords: list[str] | None = None) -> DataFrame:
    """id, representative: the smallest id with the same phrase set."""
    sets = docs.select("id", F.md5(F.array_join(F.array_sort(phrases(F.col(text), size, stopwords)), "\n")).alias("key"))
    return sets.join(sets.groupBy("key").agg(F.min("id").alias("representative")), "key").select("id", "representative")


def letter_reuse(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """id, same_letter_targets, similar_letters from the rows of ``near_copies`` and docs(id, holder, tag, hash).

    A document is like all members of its own class of copies and of the classes near it.  Others are counted by class and
    holder, so copies are not paired with each other.
    """
    near, copies = pairs.where("how = 'near'"), pairs.where("how = 'copy'")
    reps = near.select(F.col("a").alias("id")).union(near.select("b")).union(copies.select("a")).distinct()
    members = reps.select("id", F.col("id").alias("rep")).union(copies.select(F.col("b").alias("id"), F.col("a").alias("rep")))
    rows = docs.select("id", F.coalesce("holder", F.lit("")).alias("holder"), "tag", "hash").join(members, "id")
    links = near.select(F.col("a").alias("rep"), F.col("b").alias("other")).union(near.select("b", "a")).union(reps.select("id", F.col("id").alias("other")))
    every = rows.groupBy(F.col("rep").alias("other")).agg(F.count("*").alias("n"))
    own = rows.where("holder <> ''").groupBy(F.col("rep").alias("other"), "holder").agg(F.count("*").alias("n_own"))
    holders_ = rows.select("rep", "holder").distinct().join(links, "rep").join(every, "other").join(own, ["other", "holder"], "left")
    # Without a holder all others are somebody else's, but for the row itself.
    others = holders_.groupBy("rep", "holder").agg((F.sum(F.col("n") - F.coalesce("n_own", F.lit(0))) - F.when(F.col("holder") == "", 1).otherwise(0)).alias("similar_letters"))
    forms = rows.where("holder <> ''").select(F.col("rep").alias("other"), "holder", F.col("tag").alias("o_tag"), F.col("hash").alias("o_hash")).distinct()
    again = rows.where("holder <> ''").join(links, "rep").join(forms, ["other", "holder"]).where("tag <> o_tag and hash <> o_hash")
    again = again.groupBy("id").agg(F.count_distinct("o_tag").alias("same_letter_targets"))
    counted = rows.join(others, ["rep", "holder"]).join(again, "id", "left")
    return counted.select("id", F.coalesce("same_letter_targets", F.lit(0)).alias("same_letter_targets"), "similar_letters")


# How people say what they apply for; a claim ends before these words.
_CLAIM_END = r"(?=\s+(?:position|role|vacancy|job|at|with|bij|in)\b|[.,;:!()\n]|$)"
_CLAIMS = [
    rf"(?im)(?:subject|re|regarding|betreft|onderwerp)\s*:\s*(?:application|sollicitatie|applying)?\s*(?:for|naar|voor|als|op)?\s*(?:the\s+|de\s+)?(?:position|role|functie|vacature)?\s*(?:of|van|als)?\s*(?:an?\s+|een\s+)?([^\n]{{3,80}}?){_CLAIM_END}",
    rf"(?i)\b(?:apply|applying|application)\s+for\s+(?:the\s+)?(?:position\s+of\s+|role\s+of\s+|post\s+of\s+|vacancy\s+(?:of|for)\s+)?(?:an?\s+)?([^\n]{{3,80}}?){_CLAIM_END}",
    rf"(?i)\bsollicit\w*\s+(?:ik\s+)?(?:graag\s+)?(?:naar|op|voor)\s+(?:de\s+)?(?:functie|vacature|positie|baan)?\s*(?:van|als|voor)?\s*(?:een\s+)?([^\n]{{3,80}}?){_CLAIM_END}",
    rf"(?i)\b(?:functie|vacature)\s+(?:van|als|voor)\s+(?:een\s+)?([^\n]{{3,60}}?){_CLAIM_END}",
    r"(?i)\bthe\s+([^\n]{3,60}?)\s+(?:position|role|vacancy|opening)\b",
]


def applied_for(text: Column) -> Column:
    """What a text says it applies for, in order."""
    said = F.transform(F.flatten(F.array(*[found(F.coalesce(text, F.lit("")), p, 1) for p in _CLAIMS])), lambda c: F.trim(F.regexp_replace(c, r"\s+", " ")))
    return F.filter(said, lambda c: (F.size(title_words(c)) > 0) & ~c.rlike(r"(?i)^(your|our|this|that|the|jullie|uw|deze)\b"))


def _stem5(words: Column) -> Column:
    """Keys under which similar title words meet."""
    return F.array_distinct(F.transform(words, lambda w: F.left(w, F.lit(5))))


class _Targets:
    """A block of targets as a task holds it: their titles as an automaton, and for each skill the targets that want it."""

    def __init__(self, rows: list):
        self.titles = [(r.tag, r.title) for r in rows if r.titled]
        self.names = Phrases([t.strip().lower() for _, t in self.titles])
        self.wants, self.asking = [(r.tag, r.want) for r in rows if len(r.want) >= 3], {}
        for i, (_, want) in enumerate(self.wants):
            for skill in want:
                self.asking.setdefault(skill, []).append(i)

    def named(self, text: str) -> tuple[int, str, str] | None:
        """How many tags a text names, the least of them, and the least title."""
        hits = [self.titles[i] for i in self.names.whole(flat(text))]
        return (len({tag for tag, _ in hits}), min(tag for tag, _ in hits), min(title for _, title in hits)) if hits else None

    def fits(self, skills: list[str]) -> list[tuple]:
        """The two best targets for some skills: share and number of wanted skills, then the least tag."""
        have = set(skills)
        got = Counter(i for skill in have for i in self.asking.get(skill, ()))
        best = heapq.nsmallest(2, ((-n / len(self.wants[i][1]), -n, self.wants[i][0], i) for i, n in got.items()))
        return [(-f, -n, len(self.wants[i][1]), tag, [s for s in self.wants[i][1] if s in have][:4]) for f, n, tag, i in best]

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        named = pa.struct([("n", pa.int64()), ("tag", pa.string()), ("title", pa.string())])
        fits = pa.list_(pa.struct([("f", pa.float64()), ("got", pa.int64()), ("n_want", pa.int64()), ("tag", pa.string()), ("listed", pa.list_(pa.string()))]))
        show = lambda values, fields: dict(zip(fields, values))
        for batch in batches:
            names = [self.named(t) for t in batch.column("said").to_pylist()]
            best = [self.fits(s or ()) for s in batch.column("skills").to_pylist()]
            columns = [
                batch.column("id"),
                pa.array([v and show(v, ("n", "tag", "title")) for v in names], named),
                pa.array([[show(v, ("f", "got", "n_want", "tag", "listed")) for v in vs] for vs in best], fits),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "named", "fits"])


def match_targets(docs: DataFrame, targets: DataFrame, known_skills: list[str] | None = None, head: int | None = HEAD) -> DataFrame:
    """id, tag, how, why: the target each of docs(id, text, letter_text, skills) is for, from targets(tag, title, text).

    Tiers: a claim whose title is at least 0.6 similar; the one target whose title is named; the best fit on skills with a clear lead.
    Ties go to the first claim, then the least tag.  Of a text its letter and its first ``head`` characters are read (None: all).
    Names and skills are looked up in one pass over docs for each block of at most TARGETS targets; no pair of a document and a
    target becomes a row.
    """
    text = F.coalesce("text", F.lit(""))
    docs = docs.select("id", F.coalesce("letter_text", F.lit("")).alias("letter"), (text if head is None else F.substring(text, 1, head)).alias("head"), "skills")
    known = d.SKILLS if known_skills is None else known_skills
    ads = targets.select("tag", "title", F.coalesce("text", F.lit("")).alias("text"), title_words(F.col("title")).alias("words"))

    claims = docs.select("id", F.posexplode(F.concat(applied_for(F.col("letter")), applied_for(F.col("head")))).alias("place", "claim"))
    claims = claims.select("id", "place", "claim", F.explode(_stem5(title_words(F.col("claim")))).alias("key"))
    by_word = ads.select("tag", "title", F.explode(_stem5(F.col("words"))).alias("key"))
    said = claims.join(by_word, "key").select("id", "place", "claim", "tag", "title").distinct().withColumn("s", title_similarity(F.col("claim"), F.col("title"))).where("s >= 0.6")
    applied = said.groupBy("id").agg(F.min_by(F.struct("tag", "claim"), F.struct(-F.col("s"), "place", "tag")).alias("b")).select("id", F.lit(1).alias("tier"), "b.tag", F.lit("applied").alias("how"), F.concat(F.lit("Says they apply for “"), F.left("b.claim", F.lit(70)), F.lit("”")).alias("why"))

    wanted = ads.select("tag", "title", (F.size("words") >= 2).alias("titled"), skills_of(F.concat_ws("\n", "title", "text"), known=known).alias("want"))
    wanted = stored(wanted.select("tag", "title", "titled", F.when(F.size("want") >= 3, F.col("want")).otherwise(F.array().cast("array<string>")).alias("want")), "wanted")
    n_rows, n_wanted = wanted.agg(F.count("*"), F.count_if(F.size("want") > 0)).first()
    blocks = -(-n_rows // TARGETS)
    kind = docs.schema["id"].dataType.simpleString()
    heard = docs.select("id", F.lower(F.concat_ws("\n", "letter", "head")).alias("said"), "skills")
    seen = None
    for k in range(blocks):
        # A block is bounded by TARGETS rows on average; a tag stays in one block.
        some = wanted.where(F.pmod(F.xxhash64("tag"), F.lit(blocks)) == k).collect()
        part = heard.mapInArrow(_Targets(some), f"id {kind}, named struct<n:long,tag:string,title:string>, fits array<struct<f:double,got:long,n_want:long,tag:string,listed:array<string>>>")
        seen = part if seen is None else seen.unionByName(part)
    if seen is None:
        return applied.select("id", "tag", "how", "why")
    if blocks > 1:
        best = F.array_sort(F.flatten(F.collect_list("fits")), lambda x, y: F.when(_before(x, y), -1).otherwise(1))
        named = F.struct(F.sum("named.n").alias("n"), F.min("named.tag").alias("tag"), F.min("named.title").alias("title"))
        seen = seen.groupBy("id").agg(named.alias("named"), F.slice(best, 1, 2).alias("fits"))
    names = seen.where("named.n = 1").select("id", F.lit(2).alias("tier"), "named.tag", F.lit("named").alias("how"), F.concat(F.lit("Names the target “"), "named.title", F.lit("”")).alias("why"))
    lead = F.get("fits", F.lit(0))["f"] - F.coalesce(F.get("fits", F.lit(1))["f"], F.lit(0.0))
    fit = seen.withColumn("b", F.get("fits", F.lit(0))).where((F.col("b.got") >= 3) & (F.col("b.f") >= 0.5) & (F.lit(n_wanted == 1) | (lead >= 0.2)))
    fit = fit.select("id", F.lit(3).alias("tier"), "b.tag", F.lit("fit").alias("how"), F.concat(F.lit("Best fit on skills: "), F.col("b.got").cast("string"), F.lit(" of "), F.col("b.n_want").cast("string"), F.lit(" ("), F.array_join("b.listed", ", "), F.lit(")")).alias("why"))

    tiers = applied.unionByName(names).unionByName(fit)
    return tiers.groupBy("id").agg(F.min_by(F.struct("tag", "how", "why"), "tier").alias("b")).select("id", "b.*")


def _before(x: Column, y: Column) -> Column:
    """Whether a fit comes before another: the larger share, then number, then the least tag."""
    return (x["f"] > y["f"]) | (x["f"] == y["f"]) & ((x["got"] > y["got"]) | (x["got"] == y["got"]) & (x["tag"] < y["tag"]))


def holders(docs: DataFrame, links: DataFrame) -> DataFrame:
    """docs(id, email, name) with holder: the own mail address or else name, else those of the résumé it is linked to; empty if none is known."""
    own = F.coalesce(F.nullif(F.lower(F.trim("email")), F.lit("")), F.nullif(norm(F.col("name")), F.lit("")))
    of_cv = docs.select(F.col("id").alias("cv_id"), own.alias("_cv_holder"))
    linked = links.select(F.col("letter_id").alias("id"), "cv_id").join(of_cv, "cv_id").select("id", "_cv_holder")
    return docs.join(linked, "id", "left").withColumn("holder", F.coalesce(own, "_cv_holder", F.lit(""))).drop("_cv_holder")


def with_target_text(docs: DataFrame, targets: DataFrame) -> DataFrame:
    """docs(tag, ...) with target_text from targets(tag, text); empty where a tag has none."""
    texts = targets.groupBy("tag").agg(F.min("text").alias("target_text"))
    return docs.join(texts, "tag", "left").withColumn("target_text", F.coalesce("target_text", F.lit("")))


def target_list(targets: DataFrame, docs: DataFrame) -> DataFrame:
    """tag, title, text for every tag of targets(tag, title, text) or docs(tag); the title is the known one or the tag's first part, in the order people expect of names."""
    tags = targets.select("tag").union(docs.select("tag")).where("tag <> ''").distinct()
    known = targets.groupBy("tag").agg(F.max("title").alias("title"), F.min("text").alias("text"))
    listed = tags.join(known, "tag", "left").select("tag", F.coalesce(F.nullif("title", F.lit("")), F.split_part("tag", F.lit(" – "), F.lit(1))).alias("title"), F.coalesce("text", F.lit("")).alias("text"))
    return listed.orderBy(F.collate("tag", "UNICODE_CI"), "tag")


def resolved_tags(docs: DataFrame, matches: DataFrame) -> DataFrame:
    """docs with tag: the one set by hand, else the matched one unless matching is off for the row."""
    found_ = matches.select("id", F.col("tag").alias("_tag"), F.col("how").alias("tag_how"), F.col("why").alias("tag_why"))
    off = F.coalesce(F.col("no_auto"), F.lit(False)) if "no_auto" in docs.columns else F.lit(False)
    manual = F.nullif(F.col("tag"), F.lit(""))
    return docs.join(found_, "id", "left").withColumn("tag", F.coalesce(manual, F.when(~off, F.col("_tag")), F.lit(""))).drop("_tag")


def named_in(text: Column, title: str) -> Column:
    """Whether a title occurs as a whole in a text."""
    return text.rlike(rf"(?iu)(?<!\p{{L}}){quoted(title.strip())}(?!\p{{L}})")


def copied_phrases(docs: DataFrame, targets: DataFrame, least: int = 4, size: int = 4, stopwords: list[str] | None = None) -> DataFrame:
    """id, tag, count: distinct phrases of targets(tag, text) that stand word for word in docs(id, text), at least ``least``.

    An equality join on phrases; a document meets only targets it shares a phrase with.
    """
    mine = docs.select("id", F.explode(phrases(F.col("text"), size, stopwords)).alias("phrase"))
    theirs = targets.select("tag", F.explode(phrases(F.col("text"), size, stopwords)).alias("phrase"))
    return mine.join(theirs, "phrase").groupBy("id", "tag").agg(F.count("*").alias("count")).where(F.col("count") >= least)


def copied_runs(docs: DataFrame, targets: DataFrame, least: int = 4, size: int = 4, stopwords: list[str] | None = None) -> DataFrame:
    """id, tag, count, run, first_word, words for docs(id, text) and targets(tag, text) that share at least ``least`` phrases.

    count: shared phrases; run: phrases of the longest stretch of a text whose phrases all stand in the target (the first of equals);
    first_word: its place, from 0; words: the stretch itself.  Places of shared phrases are the rows of a join on the phrase; a stretch
    is an island of places that follow each other.
    """
    mine = docs.select("id", F.explode(placed_phrases(F.col("text"), size, stopwords)).alias("p")).select("id", "p.*")
    theirs = targets.select("tag", F.explode(phrases(F.col("text"), size, stopwords)).alias("phrase")).distinct()
    hits = mine.join(theirs, "phrase")
    enough = hits.groupBy("id", "tag").agg(F.count_distinct("phrase").alias("count")).where(F.col("count") >= least)
    place = F.row_number().over(Window.partitionBy("id", "tag").orderBy("at"))
    islands = hits.select("id", "tag", "at", (F.col("at") - place).alias("island")).groupBy("id", "tag", "island").agg(F.count("*").alias("run"), F.min("at").alias("at"))
    longest = islands.groupBy("id", "tag").agg(F.min_by(F.struct("run", "at"), F.struct(-F.col("run"), F.col("at"))).alias("b"))
    best = enough.join(longest, ["id", "tag"]).select("id", "tag", "count", "b.run", "b.at")
    words = F.array_join(F.slice(tokens(F.coalesce("text", F.lit(""))), F.col("at") + 1, (F.col("run") + size - 1).cast("int")), " ")
    return best.join(docs.select("id", "text"), "id").select("id", "tag", "count", "run", F.col("at").alias("first_word"), words.alias("words"))
