"""Document search as Column predicates.

A search is built from terms: ``word``, ``phrase``, ``prefix``, ``similar`` and
``number``, each over all text or one field, combined with ``&``, ``|`` and
``~`` as any Column.  ``Words`` is the form a search box keeps: words that must
all occur, groups of which one must, and words that must not.  Catalyst sees
plain predicates, so filters on fields reach the scan.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import WORD, html_escaped, quoted, similar_word, stem, tokens

_BEFORE, _AFTER = rf"(?<!{WORD})", rf"(?!{WORD})"
_ENDINGS = "(?:s|es|en|er|ers|ing|ed|ment|ments)?"


def _or_empty(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def _joined(name: str, by: str = ", ") -> Column:
    return F.coalesce(F.array_join(name, by), F.lit(""))


def field_text(name: str) -> Column | None:
    """The text of a field by any of its names; None for an unknown one."""
    letter_only = F.coalesce(F.col("letter_only"), F.lit(False))
    fields = {
        ("name",): lambda: _or_empty("name"),
        ("email",): lambda: _or_empty("email"),
        ("phone",): lambda: _or_empty("phone"),
        ("location", "loc", "city"): lambda: _or_empty("location"),
        ("skill", "skills"): lambda: _joined("skills"),
        ("lang", "language"): lambda: F.concat_ws(", ", F.array_join("languages", ", "), "cv_language"),
        ("edu", "education"): lambda: _or_empty("education"),
        ("tag", "vacancy", "req"): lambda: _or_empty("tag"),
        ("file",): lambda: _or_empty("file_name"),
        ("text",): lambda: _or_empty("text"),
        ("cv",): lambda: F.when(letter_only, "").otherwise(_or_empty("text")),
        ("letter",): lambda: F.when(letter_only, _or_empty("text")).otherwise(_or_empty("letter_text")),
    }
    return next((make() for names, make in fields.items() if name.lower() in names), None)


def all_text() -> Column:
    """All searched text of a document; the phone number is not part of it."""
    letter = F.when(F.coalesce(F.col("letter_only"), F.lit(False)), F.lit("")).otherwise(_or_empty("letter_text"))
    parts = [F.col("text"), letter, F.col("name"), F.col("email"), F.col("location"), F.array_join("skills", " "), F.array_join("languages", " "), F.col("cv_language"), F.col("education"), F.col("tag"), F.col("file_name")]
    return F.array_join(F.filter(F.array(*parts), lambda p: p != ""), "\n")


#: Columns that a searched table may lack; they are added as nulls.
SEARCHED = {
    "text": "string", "letter_text": "string", "letter_only": "boolean", "name": "string", "email": "string", "phone": "string", "location": "string", "skills": "array<string>",
    "languages": "array<string>", "cv_language": "string", "education": "string", "tag": "string", "file_name": "string", "years": "double", "ai_score": "int", "tool_score": "int", "error": "string",
}


def searchable(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.lit(None).cast(t) for c, t in SEARCHED.items() if c not in df.columns})


def term_pattern(value: str, mode: str = "word") -> str:
    """The regular expression of a term; mode is word, phrase, prefix or similar. A star inside is any letters or digits."""
    body = quoted(value.strip()).replace(r"\*", WORD + "*")
    tail = {"prefix": WORD + "*", "similar": _ENDINGS + _AFTER}.get(mode, _AFTER)
    return f"(?iu){_BEFORE}{body}{tail}"


@dataclass(frozen=True)
class Term:
    """A term of a search box: text, how it matches, and where."""

    text: str
    mode: str = "similar"
    field: str = "any"

    def predicate(self) -> Column:
        where = None if self.field == "any" else field_text(self.field)
        text, mode = self.text.strip(), self.mode
        if self.field != "any" and where is None:
            # A field that is not known is text with a colon in it.
            text, mode = f"{self.field}:{text}", "phrase"
        hay = all_text() if where is None else where
        if mode != "exact" and not re.fullmatch(r"\w+", text.replace("_", " ")):
            mode = "phrase"
        matched = hay.rlike(term_pattern(text, mode))
        if mode == "similar":
            matched = matched | F.exists(F.array_distinct(tokens(hay)), lambda w: similar_word(w, text))
        return matched

    def label(self) -> str:
        shown = {"skill": "skills", "loc": "location", "edu": "education", "lang": "languages", "cv": "CV", "letter": "cover letter"}
        return self.text if self.field == "any" else f"{self.text} ({shown.get(self.field, self.field)})"


def word(value: str, where: str = "any") -> Column:
    return _term(value, "word", where)


def phrase(value: str, where: str = "any") -> Column:
    return _term(value, "phrase", where)


def prefix(value: str, where: str = "any") -> Column:
    return _term(value, "prefix", where)


def _term(value: str, mode: str, where: str) -> Column:
    hay = all_text() if where == "any" else field_text(where)
    if hay is None:
        return all_text().rlike(term_pattern(f"{where}:{value}", "phrase"))
    return hay.rlike(term_pattern(value, mode))


def similar(value: str, where: str = "any") -> Column:
    """The word, its usual endings, equal stems and typing errors."""
    return Term(value, "similar", where).predicate()


def number(name: str, op: str, value: float) -> Column:
    """Compares years, ai or tool; a missing number never matches."""
    left = F.col({"years": "years", "ai": "ai_score", "tool": "tool_score"}[name])
    found = {">": left > value, ">=": left >= value, "<": left < value, "<=": left <= value, "=": left == value}[op]
    return F.coalesce(found, F.lit(False))


@dataclass(frozen=True)
class Words:
    """all: every term; groups: one term of each; none: no term."""

    all: tuple[Term, ...] = ()
    groups: tuple[tuple[Term, ...], ...] = ()
    none: tuple[Term, ...] = ()
    more: tuple[Column, ...] = field(default=(), compare=False)

    @staticmethod
    def of(saved: dict) -> Words:
        """From a saved search; older ones hold plain strings and one list ``any``."""
        term = lambda t: Term(t) if isinstance(t, str) else Term(t["text"], t.get("mode", "similar"), t.get("field", "any"))
        groups = saved["groups"] if "groups" in saved else [saved.get("any", [])]
        return Words(tuple(map(term, saved.get("all", []))), tuple(tuple(map(term, g)) for g in groups if g), tuple(map(term, saved.get("none", []))))

    def predicate(self) -> Column:
        parts = [t.predicate() for t in self.all]
        parts += [reduce(lambda a, b: a | b, [t.predicate() for t in g]) for g in self.groups]
        parts += [~t.predicate() for t in self.none]
        return reduce(lambda a, b: a & b, [*parts, *self.more], F.lit(True))

    def positive(self) -> list[Term]:
        return [*self.all, *(t for g in self.groups for t in g)]

    def summary(self) -> str:
        """The search in plain words."""
        either = [" or ".join(t.label() for t in g) for g in self.groups]
        said = [*(t.label() for t in self.all), *(f"({e})" if " or " in e else e for e in either)]
        return " and ".join(said) + (f", without {', '.join(t.label() for t in self.none)}" if self.none else "")


def entered(raw: str, have: tuple[str, ...] = ()) -> list[str]:
    """Words typed in a box: split at commas and semicolons, trimmed, each once whatever its case."""
    out, seen = [], {h.lower() for h in have}
    for w in map(str.strip, re.split("[,;]", raw)):
        if w and w.lower() not in seen:
            seen.add(w.lower())
            out.append(w)
    return out


def search(df: DataFrame, words: Words | Column) -> DataFrame:
    """Rows that match; rows with an error never do."""
    predicate = words.predicate() if isinstance(words, Words) else words
    return searchable(df).where(F.col("error").isNull() & predicate)


def matched_terms(words: Words) -> Column:
    """Labels of the positive terms that a row matches."""
    return F.array_compact(F.array(*[F.when(t.predicate(), F.lit(t.label())) for t in words.positive()])) if words.positive() else F.array().cast("array<string>")


def term_counts(df: DataFrame, words: Words) -> DataFrame:
    """term, n: rows each positive term matches, all in one pass."""
    terms = words.positive()
    df = searchable(df).where(F.col("error").isNull())
    counts = df.agg(*[F.count_if(t.predicate()).alias(f"c{i}") for i, t in enumerate(terms)])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(t.label()).alias("term"), F.col(f"c{i}").alias("n")) for i, t in enumerate(terms)])).alias("e")).select("e.*")


def why_empty(df: DataFrame, **predicates: Column) -> DataFrame:
    """One row: how many rows there are, each predicate alone keeps, and all keep together."""
    both = reduce(lambda a, b: a & b, predicates.values())
    return searchable(df).agg(F.count("*").alias("n_rows"), *[F.count_if(p).alias(f"n_{name}") for name, p in predicates.items()], F.count_if(both).alias("n_all"))


def highlighted(text: Column, words: Words) -> Column:
    """HTML of text with every match of a positive text term in <mark>, in one pass."""
    terms = [t for t in words.positive() if t.field in ("any", "text", "cv", "letter")]
    out = html_escaped(text)
    if not terms:
        return out
    patterns = "|".join(f"(?:{term_pattern(t.text, t.mode if t.mode != 'exact' else 'phrase').removeprefix('(?iu)')})" for t in terms)
    return F.regexp_replace(out, f"(?iu){patterns}", "<mark>$0</mark>")


def suggestions(df: DataFrame, misspelled: str, text: str = "text", known: list[str] | None = None) -> DataFrame:
    """The closest word of the corpus within two edits of stems, known words first, then by frequency."""
    from ..functions.text import alignment_distance

    spark, low = df.sparkSession, misspelled.lower()
    # Words that cannot be an answer are dropped where they stand, before any shuffle.
    heard = df.select(F.explode(F.array_distinct(F.filter(tokens(F.col(text)), lambda w: w.startswith(low[:1]) & (w != low) & w.rlike(r"^\p{L}{3,}$")))).alias("word")).groupBy("word").agg(F.count("*").alias("n")).withColumn("place", F.lit(1 << 30))
    if known:
        listed = spark.createDataFrame([(w, 0, i) for i, w in enumerate(known)], "word string, n long, place int")
        heard = heard.select("word", "n", "place").unionByName(listed).groupBy("word").agg(F.max("n").alias("n"), F.min("place").alias("place"))
    near = heard.where((F.length("word") >= 3) & (F.col("word") != low) & F.col("word").startswith(low[:1]))
    # A swap is two plain edits, so words beyond four of these are further than two; the exact distance is left to the few others.
    close = F.levenshtein(stem(F.lit(low)), stem(F.col("word")), 4) >= 0
    near = near.withColumn("distance", F.when(close, alignment_distance(stem(F.lit(low)), stem(F.col("word"))))).where("distance <= 2")
    return near.orderBy("distance", "place", F.desc("n"), "word").select("word", "distance", "n").limit(1)


def filtered(df: DataFrame, location: str = "", language: str = "", years: tuple[float | None, float | None] = (None, None), hide: str = "", tag: str = "", tagged_members: DataFrame | None = None, members: DataFrame | None = None, letter: str = "") -> DataFrame:
    """The screening filters: place, language, years, score levels, tag or a list placed on it, list membership, cover letter."""
    df = searchable(df)
    if location:
        df = df.where(F.contains(F.lower(_or_empty("location")), F.lit(location.lower())))
    if language:
        df = df.where(F.coalesce(F.array_contains("languages", language), F.lit(False)) | F.coalesce(F.col("cv_language") == language, F.lit(False)))
    low, high = years
    if low is not None:
        df = df.where(F.col("years") >= low)
    if high is not None:
        df = df.where(F.col("years") <= high)
    # Rows without a score pass.
    high_ai, high_tool = (F.coalesce(F.col(c) >= 55, F.lit(False)) for c in ("ai_score", "tool_score"))
    some = F.coalesce(F.col("ai_score") >= 25, F.lit(False)) | F.coalesce(F.col("tool_score") >= 25, F.lit(False))
    df = df.where({"ai": ~high_ai, "tool": ~high_tool, "both": ~(high_ai | high_tool), "human": ~some}.get(hide, F.lit(True)))
    if tag:
        direct = F.coalesce(F.col("tag") == tag, F.lit(False))
        if tagged_members is None:
            df = df.where(direct)
        else:
            listed = tagged_members.where(F.col("tag") == tag).select(F.col("id").alias("_listed")).distinct()
            df = df.join(listed, F.col("id") == F.col("_listed"), "left").where(direct | F.col("_listed").isNotNull()).drop("_listed")
    if members is not None:
        df = df.join(members.select("id").distinct(), "id", "left_semi")
    has = F.coalesce(F.col("letter_only"), F.lit(False)) | (_or_empty("letter_text") != "")
    return df.where({"has": has, "missing": ~has}.get(letter, F.lit(True)))


#: Sort keys of the screening table; lists compare by size, a missing score is below all.
def ordered(df: DataFrame, key: str = "added_at", descending: bool | None = None) -> DataFrame:
    column = F.size(key) if df.schema[key].dataType.typeName() == "array" else F.coalesce(F.col(key), F.lit(-1)) if key in ("ai_score", "tool_score") else F.coalesce(F.col(key), F.lit("")) if df.schema[key].dataType.typeName() == "string" else F.col(key)
    down = key not in ("name", "location") if descending is None else descending
    return df.orderBy(column.desc() if down else column.asc(), "id")
