"""Text functions as Column expressions.

Regular expressions are Java's; ``\\b`` is written as ASCII look-arounds where
that matters, and white space includes the no-break space.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .dictionaries import ENDINGS, ENTITIES, TITLE_NOISE, TRACKING

SPACE = r"[\s ]"
WORD = r"[\p{L}\p{N}]"


def quoted(text: str) -> str:
    """text as a literal inside a regular expression; any white space matches any."""
    return re.sub(r"\s+", r"\\s+", re.sub(r"([.*+?^${}()|\[\]\\])", r"\\\1", text))


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.transform(F.array(value), use)[0]


def found(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def tokens(text: Column) -> Column:
    """Lower-case words of letters and digits."""
    return found(F.lower(text), WORD + "+")


def capitalised(text: Column) -> Column:
    """Upper case for each letter at the start or after a space or hyphen."""
    return F.aggregate(
        F.split(F.lower(text), ""),
        F.struct(F.lit("").alias("out"), F.lit(" ").alias("last")),
        lambda a, c: F.struct(F.concat(a["out"], F.when(a["last"].rlike(r"[\s-]"), F.upper(c)).otherwise(c)).alias("out"), F.when(c == "", a["last"]).otherwise(c).alias("last")),
        lambda a: a["out"],
    )


def decoded(text: Column) -> Column:
    """Numeric and the listed named character references; others stay."""
    numbers = F.array_distinct(found(text, r"&#(?:[xX][0-9a-fA-F]{1,6}|[0-9]{1,7});"))
    code = lambda m: F.when(m.rlike("^&#[xX]"), F.conv(F.substring(m, 4, 6), 16, 10)).otherwise(F.regexp_extract(m, "([0-9]+)", 1)).try_cast("int")
    # Code points are written as UTF-8 bytes and read back.
    hexes = lambda c: F.lpad(F.hex(c), 8, "0")
    point = lambda c: F.when(c.between(1, 0x10FFFF) & ~c.between(0xD800, 0xDFFF), F.decode(F.unhex(hexes(c)), "UTF-32"))
    out = F.aggregate(numbers, text, lambda acc, m: F.replace(acc, m, F.coalesce(point(code(m)), m)))
    for name, mark in ENTITIES.items():
        out = F.regexp_replace(out, f"(?i)&{name};", mark)
    return F.when(F.contains(text, F.lit("&")), out).otherwise(text)


def html_to_text(html: Column) -> Column:
    """Text of a piece of HTML: blocks on lines, list items with bullets; HTML escaped twice is unescaped first."""
    html = F.coalesce(html, F.lit(""))
    escaped = html.rlike("(?i)&lt;/?[a-z]") & ~html.rlike("(?i)</?[a-z][^>]*>")
    out = F.when(escaped, decoded(html)).otherwise(html)
    for pattern, by in (
        (r"(?is)<(script|style|noscript|svg).*?</\1>", " "),
        (r"(?i)<br\s*/?>", "\n"),
        (r"(?i)</(p|div|li|h[1-6]|tr|section|ul|ol)>", "\n"),
        (r"(?i)<li[^>]*>", "• "),
        (r"<[^>]+>", " "),
    ):
        out = F.regexp_replace(out, pattern, by)
    out = decoded(out)
    for pattern, by in ((r"[ \t ]+", " "), (r" *\n *", "\n"), (r"\n{3,}", "\n\n"), (r"^\s+|\s+\z", "")):
        out = F.regexp_replace(out, pattern, by)
    return out


def clean(text: Column) -> Column:
    """Decoded, with single spaces, trimmed; null as empty."""
    return F.trim(F.regexp_replace(decoded(F.coalesce(text, F.lit(""))), SPACE + "+", " "))


def canonical_url(url: Column) -> Column:
    """Without tracking parameters, fragment and trailing slash, in lower case; one address for one page."""
    url = F.trim(url)
    base = F.regexp_replace(F.regexp_extract(url, r"^([^?#]*)", 1), r"^([A-Za-z][A-Za-z0-9+.-]*://[^/]*)$", "$1/")
    query = F.filter(F.split(F.regexp_extract(url, r"\?([^#]*)", 1), "&"), lambda p: (p != "") & ~F.lower(F.regexp_extract(p, "^([^=]*)", 1)).rlike(TRACKING))
    joined = F.array_join(query, "&")
    return F.lower(F.concat(F.regexp_replace(base, "/$", ""), F.when(joined != "", F.concat(F.lit("?"), joined)).otherwise("")))


_FNV, _FNV_START = 16777619, 0x811C9DC5
_powers: dict[int, np.ndarray] = {}


def _powers_of(base: int, n: int) -> np.ndarray:
    """The first n powers (at least) of base modulo 2**32."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(1 << 16, 1 << n.bit_length()), base, np.uint32)
        have[0] = 1
        have = _powers[base] = np.multiply.accumulate(have)
    return have


def folds(units: np.ndarray, seed: int) -> tuple[int, int]:
    """FNV-1a and the sum of powers of 31 over 16-bit units, both modulo 2**32.

    FNV's exclusive or changes the low bits alone.  These are found bit by bit for all places at once: bit k of a product with an odd
    factor is bit k of the other, changed where the bits below it carry.  With them known the rest is a sum of powers.
    """
    n = len(units)
    # Past the last place powers have the order of the units, from the highest.
    poly = seed * pow(31, n, 1 << 32) + int((units * _powers_of(31, n)[:n][::-1]).sum(dtype=np.uint32))
    width = int(units.max()).bit_length() if n else 0
    kind = np.uint8 if width <= 8 else np.uint16
    own, low = units.astype(kind), np.zeros(n, kind)
    factor = kind(_FNV & np.iinfo(kind).max)
    for k in range(width):
        mine = (own >> kind(k)) & kind(1)
        after = np.bitwise_xor.accumulate((((low * factor) >> kind(k)) & kind(1)) ^ mine) ^ kind(_FNV_START >> k & 1)
        mine[1:] ^= after[:-1]
        mine[0] ^= kind(_FNV_START >> k & 1)
        low |= mine << kind(k)
    changed = low.astype(np.uint32) - (low ^ own).astype(np.uint32)
    fnv = _FNV_START * pow(_FNV, n, 1 << 32) + int((changed * _powers_of(_FNV, n + 1)[1 : n + 1][::-1]).sum(dtype=np.uint32))
    return fnv & 0xFFFFFFFF, poly & 0xFFFFFFFF


def _fold(text: Column, seed: int) -> Column:
    """struct(a, b): the two hashes of ``folds`` of a text's UTF-16 units."""

    def folded(texts: pa.Array) -> pa.Array:
        pairs = [None if t is None else dict(zip("ab", folds(np.frombuffer(t.encode("utf-16-le"), np.uint16).astype(np.uint32), seed), strict=True)) for t in texts.to_pylist()]
        return pa.array(pairs, pa.struct([("a", pa.int64()), ("b", pa.int64())]))

    # Type hints as objects: the function type is read from them.
    folded.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(folded, "a long, b long")(text)


def hash_id(text: Column) -> Column:
    """j and the two hashes in base 36."""
    return bind(_fold(text, 7), lambda h: F.concat(F.lit("j"), F.lower(F.conv(h["a"], 10, 36)), F.lower(F.conv(h["b"], 10, 36))))


def text_hash(text: Column) -> Column:
    """Fingerprint of the letters and digits alone."""
    return bind(_fold(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", ""), 0), lambda h: F.lower(F.concat(F.hex(h["a"]), F.hex(h["b"]))))


_ACCENTED = "àáâãäåāăąçćĉčďđèéêëēĕėęěĝğġģĥìíîïĩīĭįĵķĺļľłñńņňòóôõöøōŏőŕŗřśŝşšţťùúûüũūŭůűųŵýÿŷźżž"
_PLAIN = "aaaaaaaaaccccddeeeeeeeeegggghiiiiiiiijkllllnnnnooooooooorrrssssttuuuuuuuuuuwyyyzzz"


def unaccented(text: Column) -> Column:
    return F.translate(F.lower(text), _ACCENTED, _PLAIN)


def norm(text: Column) -> Column:
    """Lower case without accents; only letters, digits, @ and dots, single spaces."""
    return F.trim(F.regexp_replace(unaccented(F.coalesce(text, F.lit(""))), "[^a-z0-9@.]+", " "))


def file_stem(name: Column) -> Column:
    """The person part of a file name."""
    stem = norm(F.regexp_replace(F.coalesce(name, F.lit("")), r"(?i)\.[a-z0-9]+$", ""))
    words = r"\b(cv|resume|curriculum|vitae|cover|letter|motivation|motivatie|motivatiebrief|sollicitatiebrief|brief|final|def|v\d+|nl|en|\d+)\b"
    return F.trim(F.regexp_replace(F.regexp_replace(stem, words, " "), r"\s+", " "))


def title_words(title: Column) -> Column:
    words = found(unaccented(F.coalesce(title, F.lit(""))), "[a-z0-9+#]+")
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(TITLE_NOISE)))


def title_similarity(a: Column, b: Column) -> Column:
    """Dice on title words; words of five letters or more are equal by their first five."""
    same = lambda x, y: (x == y) | ((F.length(x) >= 5) & (F.length(y) >= 5) & (F.left(x, F.lit(5)) == F.left(y, F.lit(5))))
    pair = F.struct(title_words(a).alias("a"), title_words(b).alias("b"))
    score = lambda p: 2 * F.size(F.filter(p["a"], lambda x: F.exists(p["b"], lambda y: same(x, y)))) / (F.size(p["a"]) + F.size(p["b"]))
    return bind(pair, lambda p: F.when((F.size(p["a"]) > 0) & (F.size(p["b"]) > 0), score(p)).otherwise(F.lit(0.0)))


def stem(word: Column) -> Column:
    """The word without its first matching ending, if three letters stay."""
    low = F.lower(word)
    ends = [F.when(low.endswith(e) & (F.length(low) - len(e) >= 3), F.substring(low, F.lit(1), F.length(low) - len(e))) for e in ENDINGS]
    return F.coalesce(*ends, low)


def within_one_edit(a: Column, b: Column) -> Column:
    """Optimal string alignment distance of at most 1: one change, or one swap of neighbours."""

    def swapped(i: Column) -> Column:
        head, x, y = F.substring(a, F.lit(1), i - 1), F.substring(a, i, F.lit(1)), F.substring(a, i + 1, F.lit(1))
        return F.concat(head, y, x, F.substring(a, i + 2, F.length(a))) == b

    swaps = F.when((F.length(a) == F.length(b)) & (F.length(a) >= 2), F.exists(F.sequence(F.lit(1), F.greatest(F.length(a) - 1, F.lit(1))), swapped)).otherwise(F.lit(False))
    return (F.levenshtein(a, b) <= 1) | swaps


def alignment_distance(a: Column, b: Column) -> Column:
    """Optimal string alignment distance, as a fold over a's letters with the last two rows as state."""

    def one(pair: Column) -> Column:
        x, y = pair["x"], pair["y"]
        n, m = F.length(x), F.length(y)
        first = F.sequence(F.lit(0), m)
        state = F.struct(F.lit(0).alias("i"), first.alias("last"), first.alias("prior"))

        def row(s: Column, c: Column) -> Column:
            i = s["i"] + 1

            def cell(acc: Column, j: Column) -> Column:
                d = F.substring(y, j, F.lit(1))
                best = F.least(s["last"][j] + 1, F.element_at(acc, -1) + 1, s["last"][j - 1] + F.when(c == d, 0).otherwise(1))
                swap = (i > 1) & (j > 1) & (c == F.substring(y, j - 1, F.lit(1))) & (F.substring(x, i - 1, F.lit(1)) == d)
                return F.concat(acc, F.array(F.when(swap, F.least(best, F.get(s["prior"], j - 2) + 1)).otherwise(best)))

            cells = F.when(m > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(m, F.lit(1))), F.array(i), cell)).otherwise(F.array(i))
            return F.struct(i.alias("i"), cells.alias("last"), s["last"].alias("prior"))

        return F.aggregate(F.filter(F.split(x, ""), lambda c: c != ""), state, row, lambda s: F.element_at(s["last"], -1))

    return bind(F.struct(a.alias("x"), b.alias("y")), one)


def similar_word(word: Column, target: str) -> Column:
    """Equal stems, or the same first letter and at most one edit (4 to 7 letters) or two (8 and more)."""
    low, t = F.lower(word), target.lower()
    to = F.lit(t)
    shorter = F.least(F.length(low), F.lit(len(t)))
    near = F.when(shorter <= 3, F.lit(False)).when(shorter <= 7, within_one_edit(low, to)).when(F.abs(F.length(low) - len(t)) <= 2, alignment_distance(low, to) <= 2).otherwise(F.lit(False))
    return (stem(low) == stem(to)) | (low.startswith(t[:1]) & near)


def level(score: Column) -> Column:
    return F.when(score >= 55, "high").when(score >= 25, "medium").otherwise("low")


def scrubbed(text: Column) -> Column:
    """Mail addresses, long numbers and addresses of pages as placeholders."""
    steps = ((r"[\w.+-]+@[\w-]+(\.[\w-]+)+", "<email>"), (r"\+?[0-9][0-9\s-]{7,}[0-9]", "<num>"), (r"(blob|filesystem|https?)://\S+", "<url>"))
    return reduce(lambda t, s: F.regexp_replace(t, *s), steps, F.coalesce(text, F.lit("")))


def size_bucket(size: Column) -> Column:
    return F.when(size.isNull(), "").when(size < 1e5, "<100KB").when(size < 1e6, "<1MB").when(size < 5e6, "<5MB").when(size < 2e7, "<20MB").otherwise(">=20MB")


def html_escaped(text: Column) -> Column:
    return reduce(lambda t, s: F.replace(t, F.lit(s[0]), F.lit(s[1])), (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")), text)


def date_only(value: Column) -> Column:
    """YYYY-MM-DD of an ISO date, an RFC 822 date or epoch milliseconds; else empty."""
    text = F.trim(value.cast("string"))
    millis = F.when(text.rlike("^[0-9]{11,}$"), F.timestamp_millis(text.try_cast("long")))
    rfc = F.try_to_timestamp(F.regexp_replace(F.regexp_extract(text, r"([0-9]{1,2} [A-Za-z]{3} [0-9]{4})", 1), "^([0-9]) ", "0$1 "), F.lit("dd MMM yyyy"))
    iso = F.try_to_timestamp(F.regexp_extract(text, r"^([0-9]{4}-[0-9]{2}-[0-9]{2})", 1), F.lit("yyyy-MM-dd"))
    return F.coalesce(F.date_format(F.coalesce(millis, iso, rfc), "yyyy-MM-dd"), F.lit(""))
