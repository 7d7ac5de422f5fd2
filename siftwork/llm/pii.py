"""Personal data by fixed patterns, and terms that reveal it by corpus statistics.

Base kinds are found by patterns and checks.  Then, for every protected entity
(a found value) in at least ``support`` texts, the texts that hold it together
with each term of theirs are counted, and the texts of the whole corpus that
hold the term.  A text is the unit of all counts: a term may be of any length
and stand anywhere in it.  A term t discloses an entity e if

* at least ``support`` texts hold both,
* P(e | t) is at least ``certainty``,
* the pointwise information log2(P(e | t) / P(e)) is at least ``bits``, and
* t stands in at least ``support`` different surroundings (the words next to
  it) in these texts, by their effective number 1 / sum(share ** 2): copies and
  near copies of one passage are about one surrounding, however many there are.

``near`` narrows the candidates to terms within so many characters of an
entity.  Disclosing terms become spans of kind ``term`` wherever they occur;
sanitising replaces every span by the name of its kind.

DataFrame functions only.  Counts are pre-aggregated; a term or entity in a
third of all texts is one key of a partial aggregate.

Defined cases: null or empty texts have no spans; matches that fail their check
are dropped; terms never overlap base spans; repeated rows and copies count
once in the statistics; a null doc_id is carried through; extra columns are
ignored by ``find_private`` and kept by ``sanitise``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import materialize, sized_broadcast

#: Base kinds in their order. Possessive forms and look-behinds give the same leftmost matches as the plain patterns, in linear time.
KINDS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){11,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without this has no match; saves the costlier pattern.
_GATES = {"email": "@", "phone": "+"}
_TERM_SPLIT = r"[^\p{L}\p{N}_]+"
_IN_TERM = r"[\p{L}\p{N}_]"


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once."""
    return F.transform(F.array(value), use)[0]


def _total(lengths: Column) -> Column:
    return F.aggregate(lengths, F.lit(0), lambda a, b: a + b)


def _matches(text: Column, pattern: Column | str) -> Column:
    """Array of (start, end, value) of the leftmost non-overlapping matches, in code points."""
    regex = F.lit(pattern) if isinstance(pattern, str) else pattern

    def placed(s: Column) -> Column:
        def one(value: Column, i: Column) -> Column:
            start = _total(F.slice(s["gaps"], 1, i + 1)) + _total(F.slice(s["sizes"], 1, i))
            return F.struct(start.alias("start"), (start + F.length(value)).alias("end"), value.alias("value"))

        return F.transform(s["found"], one)

    def with_gaps(found: Column) -> Column:
        gaps = F.transform(F.split(text, regex, -1), lambda g: F.length(g))
        several = F.struct(found.alias("found"), gaps.alias("gaps"), F.transform(found, lambda v: F.length(v)).alias("sizes"))
        none = F.array().cast("array<struct<start:int,end:int,value:string>>")
        return F.when(F.size(found) > 0, _bound(several, placed)).otherwise(none)

    return _bound(F.regexp_extract_all(text, regex, F.lit(0)), with_gaps)


def _is_ip(value: Column) -> Column:
    return F.forall(F.split(value, r"\."), lambda p: F.coalesce(F.regexp_replace(p, "^0+(?=[0-9])", "").try_cast("int") <= 255, F.lit(False)))


def _is_card(value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")

    def luhn(d: Column) -> Column:
        n = F.length(d)
        figures = F.transform(F.split(d, ""), lambda x: x.try_cast("int"))
        doubled = F.transform(figures, lambda x, i: F.when((n - i) % 2 == 0, F.when(x > 4, 2 * x - 9).otherwise(2 * x)).otherwise(x))
        return n.between(12, 19) & (_total(doubled) % 10 == 0)

    return F.coalesce(_bound(digits, luhn), F.lit(False))


def _is_phone(value: Column) -> Column:
    return F.length(F.regexp_replace(value, "[^0-9]", "")).between(9, 15)


_CHECKS = {"ip": _is_ip, "card": _is_card, "phone": _is_phone}


def _checked(spans: Column, kind: str, number: int) -> Column:
    if kind in _CHECKS:
        spans = F.filter(spans, lambda s: _CHECKS[kind](s["value"]))
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(number).alias("kind"), s["end"].alias("end"), s["value"].alias("value")))


def base_spans(text: Column) -> Column:
    """Array of (start, kind number, end, value), sorted."""
    found = []
    for number, (kind, pattern) in enumerate(KINDS.items()):
        spans = _matches(text, pattern)
        spans = _checked(spans, kind, number)
        gate = F.contains(text, F.lit(_GATES[kind])) if kind in _GATES else text.rlike("[0-9]" if kind == "ip" else "[0-9](?:[\x20-]?[0-9]){11}")
        if kind == "ip":
            gate = text.rlike(r"[0-9]\.[0-9]")
        found.append(F.when(gate, spans).otherwise(F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>")))
    return F.array_sort(F.concat(*found))


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("row_key", F.xxhash64(F.col("doc_id"), F.col("text")))


def _terms(text: Column) -> Column:
    return F.filter(F.split(text, _TERM_SPLIT), lambda w: w != "")


def _sides(text: Column, start: Column, end: Column, near: int) -> Column:
    """The terms that begin and end within ``near`` characters of a span."""
    before = F.substring(text, F.greatest(start - near, F.lit(0)) + 1, F.least(start, F.lit(near)))
    before = F.when(F.substring(text, F.greatest(start - near, F.lit(1)), F.lit(1)).rlike(_IN_TERM) & (start > near), F.regexp_replace(before, f"^{_IN_TERM}+", "")).otherwise(before)
    after = F.substring(text, end + 1, F.lit(near))
    after = F.when(F.substring(text, end + near + 1, F.lit(1)).rlike(_IN_TERM), F.regexp_replace(after, f"(?<!{_IN_TERM}){_IN_TERM}+$", "")).otherwise(after)
    return F.array_distinct(F.concat(_terms(before), _terms(after)))


def disclosing_terms(texts: DataFrame, private: DataFrame, support: int, certainty: float, bits: float, near: int | None = None) -> DataFrame:
    """term: from texts(text) and private(text_key, text, spans) with the base spans of each distinct text."""
    spans = private.select("text_key", "text", F.explode("spans").alias("s"))
    entity = F.xxhash64("s.kind", F.lower("s.value"))
    held = materialize(spans.select(entity.alias("entity"), "text_key").distinct(), "held")
    n_texts = texts.select(F.xxhash64("text").alias("k")).agg(F.count_distinct("k").cast("double").alias("n_texts"))
    # An entity in few texts, or in so many that certainty itself gains too little, cannot be disclosed by any term.
    able = held.groupBy("entity").agg(F.count("*").alias("n_entity")).where(F.col("n_entity") >= support)
    able = able.join(F.broadcast(n_texts)).where(F.log2(F.col("n_texts") / F.col("n_entity")) >= bits)
    held = materialize(held.join(sized_broadcast(able, 40), "entity"), "able")
    holding = private.join(sized_broadcast(held.select("text_key").distinct(), 16), "text_key", "left_semi").select("text_key", "text")

    words = materialize(holding.select("text_key", F.explode(F.array_distinct(_terms(F.col("text")))).alias("term")), "words")
    # As many texts hold the term as hold it with some entity, at least; and at most the entity's texts hold both.
    at_least = words.groupBy("term").agg(F.count("*").alias("at_least")).where(F.col("at_least") >= support)
    most = held.agg(F.max("n_entity").alias("most"))
    at_least = at_least.join(F.broadcast(most)).where(F.col("at_least") * certainty <= F.col("most")).drop("most")
    pairs = words.join(at_least, "term").join(held, "text_key").where(F.col("at_least") * certainty <= F.col("n_entity"))
    if near is not None:
        beside = spans.select(entity.alias("entity"), "text_key", F.explode(_sides(F.col("text"), F.col("s.start"), F.col("s.end"), near)).alias("term"))
        pairs = pairs.join(beside.select("entity", "term").distinct(), ["entity", "term"])
    joint = pairs.groupBy("entity", "term", "n_entity", "n_texts", "at_least").agg(F.count("*").alias("together"))
    joint = materialize(joint.where((F.col("together") >= support) & (F.col("together") >= certainty * F.col("at_least"))).drop("at_least"), "joint")

    # Surroundings come before the corpus is counted: what stands in copies of one passage only drops out here.
    around = F.transform(F.sequence(F.lit(0), F.size("t") - 1), lambda i: F.struct(F.get("t", i).alias("term"), F.xxhash64(F.get("t", i - 1), F.get("t", i + 1)).alias("place")))
    places = holding.select("text_key", _terms(F.col("text")).alias("t")).where("size(t) > 0").select("text_key", F.explode(around).alias("p")).select("text_key", "p.*")
    wide = 24 + F.octet_length("term")
    places = places.join(sized_broadcast(joint.select("term").distinct(), wide), "term").distinct()
    # Each occurrence meets the entities of its text that the term may disclose.
    met = places.join(held.select("entity", "text_key"), "text_key").join(sized_broadcast(joint.select("entity", "term"), 8 + wide), ["entity", "term"])
    met = met.groupBy("entity", "term", "place").agg(F.count("*").alias("n"))
    effective = F.sum("n") * F.sum("n") / F.sum(F.col("n") * F.col("n"))
    varied = met.groupBy("entity", "term").agg(effective.alias("surroundings")).where(F.col("surroundings") >= support - 1e-9).drop("surroundings")
    joint = materialize(joint.join(varied, ["entity", "term"]), "varied")

    # One row for each distinct text, so copies count once.
    wanted = sized_broadcast(joint.select("term").distinct(), wide)
    everywhere = texts.select(F.xxhash64("text").alias("text_key"), F.explode(F.array_distinct(_terms(F.col("text")))).alias("term"))
    counted = everywhere.join(wanted, "term").distinct().groupBy("term").agg(F.count("*").alias("n_term"))
    known = F.col("together") / F.col("n_term")
    gained = F.log2(known * F.col("n_texts") / F.col("n_entity"))
    return joint.join(counted, "term").where((known >= certainty) & (gained >= bits)).select("term").distinct()


def _spans(docs: DataFrame, support: int, certainty: float, bits: float, near: int | None) -> DataFrame:
    """row_key, spans (start, kind, end) for each text with a span, base and disclosing terms."""
    texts = docs.select("row_key", "text").where(F.col("text") != "")
    base = materialize(texts.select("row_key", base_spans(F.col("text")).alias("spans")).where(F.size("spans") > 0).dropDuplicates(["row_key"]), "base")
    private = texts.join(sized_broadcast(base, 40 + F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + 40 + F.octet_length(x["value"]))), "row_key").select(F.xxhash64("text").alias("text_key"), "text", "spans").dropDuplicates(["text_key"])
    terms = materialize(disclosing_terms(texts, private, support, certainty, bits, near), "terms")
    plain = base.select("row_key", F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))).alias("spans"))
    if terms.limit(1).count() == 0:
        return plain
    holds = texts.select("row_key", F.explode(F.array_distinct(_terms(F.col("text")))).alias("term")).join(sized_broadcast(terms, 24 + F.octet_length("term")), "term").distinct()
    holds = texts.join(sized_broadcast(materialize(holds.groupBy("row_key").agg(F.collect_list("term").alias("terms")), "holds"), 40 + F.aggregate("terms", F.lit(0).cast("long"), lambda n, t: n + 24 + F.octet_length(t))), "row_key").dropDuplicates(["row_key"])
    term_spans = F.flatten(F.transform("terms", lambda t: _matches(F.col("text"), F.concat(F.lit(f"(?<!{_IN_TERM})"), t, F.lit(f"(?!{_IN_TERM})")))))
    term_spans = F.transform(term_spans, lambda s: F.struct(s["start"].alias("start"), F.lit(len(KINDS)).alias("kind"), s["end"].alias("end")))
    found = holds.select("row_key", term_spans.alias("term_spans"))
    both = plain.join(found, "row_key", "full_outer").select("row_key", F.coalesce("spans", F.array().cast("array<struct<start:int,kind:int,end:int>>")).alias("spans"), "term_spans")
    free = F.filter("term_spans", lambda t: ~F.exists("spans", lambda s: (s["start"] < t["end"]) & (t["start"] < s["end"])))
    return both.select("row_key", F.array_sort(F.concat("spans", F.coalesce(free, F.array().cast("array<struct<start:int,kind:int,end:int>>")))).alias("spans"))


def _with_spans(docs: DataFrame, support: int, certainty: float, bits: float, near: int | None) -> DataFrame:
    docs = _keyed(docs)
    spans = materialize(_spans(docs.select("row_key", "text"), support, certainty, bits, near), "private")
    joined = docs.join(sized_broadcast(spans, 40 + 24 * F.size("spans")), "row_key", "left").drop("row_key")
    return joined.withColumn("spans", F.coalesce("spans", F.array().cast("array<struct<start:int,kind:int,end:int>>")))


def find_private(docs: DataFrame, support: int = 3, certainty: float = 0.5, bits: float = 4.0, near: int | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans for each row of docs(doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = _with_spans(docs, support, certainty, bits, near)
    names = F.array(*map(F.lit, [*KINDS, "term"]))
    shown = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["end"])), ",")
    kinds = F.transform("spans", lambda s: s["kind"])
    counts = [(F.size("spans") - F.size(F.array_remove(kinds, n))).cast("long").alias(f"n_{kind}") for n, kind in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(shown(F.filter("spans", lambda s: s["kind"] < len(KINDS))), 256).alias("base_sha256"), shown(F.col("spans")).alias("spans"))


def sanitise(docs: DataFrame, support: int = 3, certainty: float = 0.5, bits: float = 4.0, near: int | None = None) -> DataFrame:
    """docs with every span of text replaced by its kind in brackets; other columns as they are, n_chars counted anew."""
    columns = docs.columns
    # Reserved names keep clashing columns apart.
    plain = docs.select(F.col("doc_id"), F.col("text"), F.struct(*[F.col(f"`{c}`") for c in columns]).alias("whole"))
    found = _with_spans(plain, support, certainty, bits, near)
    # Of overlapping spans the first wins and reaches to the furthest end.
    merged = F.aggregate(
        "spans",
        F.array().cast("array<struct<start:int,kind:int,end:int>>"),
        lambda out, s: F.when(
            (F.size(out) > 0) & (F.element_at(out, F.greatest(F.size(out), F.lit(1)).cast("int"))["end"] > s["start"]),
            F.concat(F.slice(out, 1, F.size(out) - 1), F.array(F.struct(F.get(out, F.size(out) - 1)["start"].alias("start"), F.get(out, F.size(out) - 1)["kind"].alias("kind"), F.greatest(F.get(out, F.size(out) - 1)["end"], s["end"]).alias("end")))),
        ).otherwise(F.concat(out, F.array(s))),
    )
    marks = F.array(*[F.lit(f"[{k.upper()}]") for k in (*KINDS, "term")])

    def replaced(m: Column) -> Column:
        parts = F.transform(m, lambda s, i: F.concat(F.substring(F.col("text"), F.when(i > 0, F.get(m, i - 1)["end"]).otherwise(0) + 1, s["start"] - F.when(i > 0, F.get(m, i - 1)["end"]).otherwise(0)), marks[s["kind"]]))
        tail = F.substring(F.col("text"), F.get(m, F.size(m) - 1)["end"] + 1, F.length("text"))
        return F.concat(F.array_join(parts, ""), tail)

    text = F.when(F.size("spans") > 0, _bound(merged, replaced)).otherwise(F.col("text"))
    out = found.select(F.col("whole"), text.alias("new_text"))
    kept = [F.col("new_text").alias("text") if c == "text" else F.length("new_text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col("whole")[c].alias(c) for c in columns]
    return out.select(*kept)
