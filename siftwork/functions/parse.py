"""Typed columns from the text of a document; unknown is an empty string, 0 or an empty list."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import dictionaries as d
from .automaton import Phrases, flat, no_term_after, no_term_before
from .text import bind, capitalised, found, quoted, text_hash

_START, _END = r"(?<![\p{L}\p{N}#+.])", r"(?![\p{L}\p{N}#+])"


def _whole(term: str) -> str:
    """A term between marks that cannot belong to it."""
    return f"{_START}{quoted(term)}{_END}"


# Headings, particles and labels.
_HEADINGS = r"(?iu)^(curriculum vitae|cv|resume|résumé|lebenslauf|profiel|profile|persoonlijke gegevens|personal (details|information)|contact|over mij|about me|samenvatting|summary)$"
_PARTICLES = ["van", "de", "der", "den", "het", "ten", "ter", "te", "'t", "van der", "la", "le", "da", "di", "el", "al", "bin", "von"]
_NAME_LABEL = r"(?i)^(?:naam|name|volledige naam|full name)\s*[:\-]\s*(.+)$"
_PLACE_LABEL = r"(?i)(?:woonplaats|location|locatie|adres|address|wohnort|plaats|city)\s*[:\-]\s*([^\n]{2,80})"
_LANGUAGE_SECTION = r"(?:talen(?:kennis)?|languages?|sprachen|langues|taalvaardigheid)\s*[:\n][\s\S]{0,400}"
_LEVELS = "moedertaal|native|vloeiend|fluent|goed|good|basis|basic|c1|c2|b1|b2|a1|a2"
_STUDY = r"(?i)^(opleiding(en)?|education|studie|studies|cursussen|courses|certificat|ausbildung|scholing)"
_WORK = r"(?i)^(werkervaring|ervaring|work experience|experience|employment|loopbaan|career|berufserfahrung|professional experience|werk)"
_CLAIM = r"(?i)([0-9]{1,2})\+?\s*(?:jaar|jaren|years?|jahre)\s+(?:werk)?(?:ervaring|experience|erfahrung)"
_EDUCATION = [
    ("PhD", r"\b(phd|ph\.d|doctor(aat)?|promotie)\b"),
    ("Master", r"\b(master|msc|m\.sc|ma|mba|llm|drs\.?|mr\.|ir\.|wo)\b"),
    ("Bachelor", r"\b(bachelor|bsc|b\.sc|ba|hbo|bc\.|ing\.)\b"),
    ("Vocational (MBO)", r"\b(mbo|niveau [1-4])\b"),
    ("Secondary", r"\b(havo|vwo|vmbo|atheneum|gymnasium)\b"),
]
_MONTH_NAMES = sorted((n for ns in d.MONTHS.values() for n in ns), key=len, reverse=True)
_DATE = rf"(?:(?:{'|'.join(_MONTH_NAMES)})\.?\s+[0-9]{{4}}|[0-9]{{1,2}}[/.-][0-9]{{4}}|[0-9]{{4}})"
_UNTIL = rf"\s*(?:-|–|—|t/m|tot|to|until|bis|à)\s*({_DATE}|(?:{d.TODAY_WORDS}))"
_RANGE = rf"(?iu)({_DATE}){_UNTIL}"
# Every date ends with a year, so a text without this has no range; it starts at digits alone, which most texts hardly have.
_RANGE_END = rf"(?iu)[0-9]{{4}}{_UNTIL}"


def squeezed(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), "\r", ""), "[ \t ]+", " ")


def lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")


def name(text: Column) -> Column:
    """The labelled name, else the first of the first lines that reads like one, else the mail address."""

    def from_lines(ls: Column) -> Column:
        label = F.get(F.filter(F.transform(F.slice(ls, 1, 40), lambda x: F.trim(F.regexp_extract(x, _NAME_LABEL, 1))), lambda x: x != ""), F.lit(0))
        known = lambda w: F.lower(w).isin(_PARTICLES) | w.rlike(r"^\p{Lu}[\p{L}'’.-]*$")
        reads = lambda x: ~x.rlike(_HEADINGS) & ~x.rlike("[0-9@:/|]") & (F.length(x) <= 45) & F.size(F.split(x, " ")).between(2, 5) & F.forall(F.split(x, " "), known)
        first = F.get(F.filter(F.transform(F.slice(ls, 1, 10), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), reads), F.lit(0))
        shaped = bind(first, lambda f: F.when(f == F.upper(f), capitalised(f)).otherwise(f))
        return F.coalesce(label, shaped, F.lit(""))

    own = bind(lines(text), from_lines)
    mailed = capitalised(F.trim(F.regexp_replace(F.split_part(email(text), F.lit("@"), F.lit(1)), r"[._0-9]+", " ")))
    return bind(own, lambda n: F.when(n != "", n).otherwise(mailed))


def email(text: Column) -> Column:
    return F.lower(F.when(F.contains(text, F.lit("@")), F.regexp_extract(text, r"[\w.+-]+@[\w-]+(\.[\w-]+)+", 0)).when(text.isNotNull(), ""))


def phone(text: Column) -> Column:
    return F.trim(F.regexp_extract(text, r"(\+[0-9]{2}[\s-]?|0)(\(0\)\s?)?[0-9]([\s-]?[0-9]){7,10}", 0))


def profile(text: Column) -> Column:
    return F.regexp_extract(text, r"(?i)linkedin\.com/in/[\w-]+", 0)


def location(text: Column, cities: list[str] | None = None, regions: dict[int, str] | None = None) -> Column:
    """The city that stands first in the labelled place or the head; else the region of a postcode; else the label's last part."""
    cities, regions = d.CITIES if cities is None else cities, d.POSTCODE_REGIONS if regions is None else regions
    head = F.substring(text, 1, 1500)
    label = F.regexp_extract(head, _PLACE_LABEL, 1)
    zone = F.lower(F.when(label != "", label).otherwise(head))
    # Leftmost wins; at one place, the order of the list.
    city = F.regexp_extract(zone, f"(?iu){_START}(?:{'|'.join(map(quoted, cities))}){_END}", 0) if cities else F.lit("")
    code = F.regexp_extract(head, r"(?<![A-Za-z0-9_])([1-9][0-9])[0-9]{2}\s?[A-Z]{2}(?![A-Za-z0-9_])", 1).try_cast("int")
    region = F.element_at(F.create_map(*[F.lit(x) for kv in regions.items() for x in kv]), code)
    last = F.substring(F.trim(F.regexp_extract(label, r"([^,|]*)$", 1)), 1, 40)
    return F.when(city != "", capitalised(city)).when(region.isNotNull(), F.concat(capitalised(region), F.lit(" (regio)"))).otherwise(F.coalesce(last, F.lit("")))


def languages(text: Column) -> Column:
    """Languages named in the languages section, or with a level anywhere."""

    def of(s: Column) -> Column:
        low, section = s["low"], s["section"]
        held = lambda ns: reduce(lambda a, b: a | b, [F.contains(low, F.lit(n)) for n in ns])
        hit = lambda ns: section.rlike(f"(?iu){_START}(?:{'|'.join(map(quoted, ns))}){_END}") | low.rlike(rf"(?iu)(?<!\p{{L}})(?:{'|'.join(map(quoted, ns))})\s*[:(\-–]?\s*(?:{_LEVELS})")
        # A spelling that does not occur at all needs no pattern.
        return F.array_compact(F.array(*[F.when(held(ns), F.when(hit(ns), F.lit(k))) for k, ns in d.LANGUAGES.items()]))

    return bind(F.lower(text), lambda low: bind(F.struct(low.alias("low"), F.regexp_extract(low, _LANGUAGE_SECTION, 0).alias("section")), of))


def written_in(text: Column, stopwords: dict[str, list[str]] | None = None) -> Column:
    """The language with the most stop words, at least three; ties go to the first listed."""
    stopwords = d.STOPWORDS if stopwords is None else stopwords

    def best(words: Column) -> Column:
        n = [F.size(F.filter(words, _in(ws))) for ws in stopwords.values()]
        top = F.greatest(*n) if len(n) > 1 else n[0]
        out = reduce(lambda acc, kn: F.when(kn[1] == top, F.lit(kn[0])).otherwise(acc), list(zip(stopwords, n, strict=True))[::-1], F.lit(""))
        return F.when(top >= 3, out).otherwise("")

    return bind(found(F.lower(text), r"\p{L}+"), best)


def _in(values: list[str]):
    return lambda w: w.isin(*values)


def skills(text: Column, extra: list[str] | None = None, known: list[str] | None = None) -> Column:
    """Skills in list order, own ones first; a found skill is taken out of the text before the next is looked for."""
    listed = list(dict.fromkeys([*(s.lower() for s in extra or ()), *(d.SKILLS if known is None else known)]))
    terms = Phrases([s.lower() for s in listed], no_term_before, no_term_after)

    def found_in(texts: pa.Array) -> pa.Array:
        return pa.array([[listed[i] for i in terms.taken(flat(t))] if t else [] for t in texts.to_pylist()], pa.list_(pa.string()))

    # Type hints as objects: the function type is read from them.
    found_in.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(found_in, "array<string>")(F.lower(text))


def _month(date: Column, now: Column) -> Column:
    """Months since year 0 of a date as it stands in a range."""
    low = F.lower(F.trim(date))
    year = F.regexp_extract(low, "([0-9]{4})$", 1).try_cast("int") * 12
    numbered = F.regexp_extract(low, "^([0-9]{1,2})[/.-]", 1).try_cast("int") - 1
    names = F.create_map(*[F.lit(x) for m, ns in d.MONTHS.items() for n in ns for x in (n, m - 1)])
    named = F.element_at(names, F.regexp_extract(low, r"^([^0-9.\s]+)\.?\s", 1))
    return F.when(low.rlike(f"^(?:{d.TODAY_WORDS})$"), now).otherwise(year + F.coalesce(numbered, named, F.lit(0)))


def spans(text: Column, as_of: Column) -> Column:
    """Sorted work spans (a, b) in months, study sections left out."""
    now = F.year(as_of) * 12 + F.month(as_of) - 1
    state = F.struct(F.lit(False).alias("study"), F.array().cast("array<string>").alias("kept"))

    def line(s: Column, raw: Column) -> Column:
        t = F.trim(raw)
        short = F.length(t) < 40
        study = F.when(short & t.rlike(_STUDY), F.lit(True)).when(short & t.rlike(_WORK), F.lit(False)).otherwise(s["study"])
        return F.struct(study.alias("study"), F.when(~study & t.rlike(_RANGE_END) & t.rlike(_RANGE), F.concat(s["kept"], F.array(t))).otherwise(s["kept"]).alias("kept"))

    # Of a text without any range no line is read.
    work = F.aggregate(F.split(F.when(text.rlike(_RANGE_END), text).when(text.isNotNull(), ""), "\n"), state, line, lambda s: s["kept"])
    ranges = F.flatten(F.transform(work, lambda t: F.arrays_zip(found(t, _RANGE, 1).alias("a"), found(t, _RANGE, 2).alias("b"))))
    months = F.transform(ranges, lambda r: F.struct(_month(r["a"], now).alias("a"), _month(r["b"], now).alias("b")))
    valid = F.filter(months, lambda r: r["a"].isNotNull() & r["b"].isNotNull() & (r["b"] >= r["a"]) & (r["a"] >= 1960 * 12) & (r["b"] <= now + 1))
    return F.array_sort(F.transform(valid, lambda r: F.struct(r["a"].alias("a"), F.greatest(r["b"], r["a"] + F.when(r["a"] == r["b"], 1).otherwise(0)).alias("b"))))


def covered(sorted_spans: Column) -> Column:
    """Length of the union of spans that are sorted by their start."""
    start = F.struct(F.lit(0).alias("total"), F.lit(-(1 << 30)).alias("end"))
    step = lambda s, r: F.struct((s["total"] + F.greatest(r["b"] - F.greatest(r["a"], s["end"]), F.lit(0))).alias("total"), F.greatest(s["end"], r["b"]).alias("end"))
    return F.aggregate(sorted_spans, start, step, lambda s: s["total"])


def years(text: Column, as_of: Column) -> Column:
    """Years of work: overlapping ranges count once; without ranges, the years that are claimed."""
    dated = F.floor(covered(spans(text, as_of)) / 12 * 10 + 0.5) / 10
    claimed = F.regexp_extract(text, _CLAIM, 1).try_cast("double")
    return bind(dated, lambda y: F.when(y > 0, y).otherwise(F.coalesce(claimed, F.lit(0.0))))


def education(text: Column) -> Column:
    # One pass finds the texts that name any level; only these are asked for each.
    best = lambda low: reduce(lambda acc, lp: F.when(low.rlike(lp[1]), F.lit(lp[0])).otherwise(acc), _EDUCATION[::-1], F.lit(""))
    return bind(F.lower(text), lambda low: F.when(low.rlike("|".join(p for _, p in _EDUCATION)), best(low)).otherwise(""))


# What tells a letter from a résumé.
_GREETING = r"(?im)^\s*(dear|to whom it may concern|hello|geachte|beste|hallo|sehr geehrte|madame|monsieur)\b"
_CLOSING = r"(?imu)^\s*(sincerely|yours (sincerely|faithfully)|kind regards|best regards|warm regards|regards|met vriendelijke groet(en)?|vriendelijke groet(en)?|hoogachtend|mit freundlichen grüßen|cordialement)\b"
_LETTER_WORDS = r"(?i)\b(cover ?letter|motivation letter|letter of motivation|motivatiebrief|sollicitatiebrief|motivatie ?brief|anschreiben|lettre de motivation)\b"
_LETTER_FILE = r"(?i)(cover|motivat|letter|brief|anschreiben|lettre)"
_CV_FILE = r"(?iu)(^|[^a-z])(cv|resume|résumé|curriculum|lebenslauf)([^a-z]|$)"
_CV_HEADINGS = r"(?im)^\s*(work experience|experience|employment|education|skills|werkervaring|opleiding(en)?|vaardigheden|talen|languages|personal details|persoonlijke gegevens|berufserfahrung|ausbildung)\s*:?\s*$"
_DATE_RANGE = r"(?i)\b(19|20)[0-9]{2}\s*(-|–|—|to|tot|t/m)\s*((19|20)[0-9]{2}|present|heden|now|nu|current|huidig)\b"


def kind(text: Column, file_name: Column) -> Column:
    """'letter' or 'cv', by points for each."""
    text, file_name = F.coalesce(text, F.lit("")), F.coalesce(file_name, F.lit(""))
    points = lambda c, n: F.when(c, n).otherwise(0)

    def judged(ls: Column) -> Column:
        long = F.size(F.filter(ls, lambda x: F.length(x) > 120))
        bullets = F.size(F.filter(ls, lambda x: x.rlike(r"^[•▪●◦\-*–]\s")))
        letter = points(text.rlike(_GREETING), 3) + points(text.rlike(_CLOSING), 3) + points(F.substring(text, 1, 600).rlike(_LETTER_WORDS), 2) + points(file_name.rlike(_LETTER_FILE), 3) + points((F.size(ls) > 0) & (long / F.greatest(F.size(ls), F.lit(1)) > 0.3), 2)
        cv = points(file_name.rlike(_CV_FILE), 3) + F.least(F.lit(4), F.regexp_count(text, F.lit(_DATE_RANGE))) + F.least(F.lit(4), 2 * F.regexp_count(text, F.lit(_CV_HEADINGS))) + points(bullets >= 4, 2)
        return F.when((letter >= 4) & (letter > cv), "letter").otherwise("cv")

    return bind(lines(text), judged)


def parsed(df: DataFrame, as_of: str, extra_skills: list[str] | None = None) -> DataFrame:
    """df(text, ...) with the parsed columns; as_of is the day that 'now' in a range means."""
    clean = squeezed(F.col("text"))
    day = F.lit(as_of).cast("date")
    df = df.withColumn("_clean", clean)
    c = F.col("_clean")
    out = df.withColumns({
        "name": name(c), "email": email(c), "phone": phone(c), "linkedin": profile(c), "location": location(c), "languages": languages(c),
        "cv_language": written_in(c), "skills": skills(c, extra_skills), "years": years(c, day), "education": education(c), "hash": text_hash(F.col("text")),
    })
    manual = F.col("kind_manual") if "kind_manual" in df.columns else F.lit(None).cast("string")
    file_name = F.col("file_name") if "file_name" in df.columns else F.lit("")
    return out.withColumn("kind", F.coalesce(manual, kind(F.col("text"), file_name))).drop("_clean")
