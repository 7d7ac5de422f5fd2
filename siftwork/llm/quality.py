"""Line-first quality rules.

Every line is judged by itself: it fails if it has no sentence end and is no
list of words long enough to be prose (punctuation), looks like a menu or a
table row (navigation), holds a stock phrase for every WORDS_A_PHRASE of its
words (boilerplate), or is mostly symbols, shouting or stuttered words (noise).
A line of any length is judged whole.  Failing lines go; a text that loses more than
``max_loss`` of its words is rejected.  Before that stand the base rules: fewer
than ``min_words`` words, or over ``max_repeat`` percent of the words in 8-word
windows that occur twice in the text.

Defined cases: null or empty texts have no words and fail; lines without words
count for nothing; repeated rows get equal verdicts; a null doc_id is carried
through; lines without words stay where they are; extra columns are ignored by
``judge`` and kept by ``clean``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import byte_texts, prefix_hashes, small_batches, span_hashes, windows, word_bounds

SYMBOLS = b"#*$%&|<>"
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True

#: Marks a sentence may end with, closing quotes and brackets after them included.
_END = re.compile("[.!?…。！？:;,\"'”’»)\\]]\\s*$")
#: Separators of menus, breadcrumbs and table rows.
_SEPARATOR = re.compile(r"\s(?:\||»|›|·|•|>|::)\s")
#: Stock phrases in English, German, French, Spanish and Dutch (fixed values, lower case).
PHRASES = (
    "all rights reserved|privacy policy|terms of use|terms of service|cookie policy|cookie settings|cookie notice|accept cookies|accept all cookies|"
    "enable javascript|click here|sign up for our newsletter|subscribe to our|login to|log in to|follow us on|share this|share on|back to top|"
    "skip to content|skip to main content|read more|lorem ipsum|powered by|"
    "alle rechte vorbehalten|datenschutzerklärung|nutzungsbedingungen|cookies akzeptieren|jetzt anmelden|weiterlesen|mehr lesen|zum inhalt springen|"
    "tous droits réservés|politique de confidentialité|mentions légales|conditions d'utilisation|accepter les cookies|accepter tous les cookies|lire la suite|abonnez-vous|"
    "todos los derechos reservados|política de privacidad|aviso legal|términos de uso|aceptar cookies|aceptar las cookies|aceptar todas las cookies|leer más|suscríbete|"
    "alle rechten voorbehouden|privacybeleid|gebruiksvoorwaarden|cookies accepteren|lees meer"
).split("|")
#: A line with at least one stock phrase for so many of its words fails, however long it is.
WORDS_A_PHRASE = 50


@lru_cache(maxsize=1000)
def _any_of(phrases: tuple[str, ...]) -> re.Pattern:
    return re.compile(rf"\b(?:{'|'.join(map(re.escape, phrases))})\b")


def stock_phrases(text: str) -> tuple[str, ...]:
    """The stock phrases that a text holds anywhere; most hold none, and their lines need no search."""
    low = text.lower()
    return tuple(p for p in PHRASES if p in low)


def line_fails(line: str, max_symbols: float = 0.1, phrases: tuple[str, ...] = tuple(PHRASES)) -> str:
    """The first rule that a line with words breaks, or an empty string; phrases: the stock phrases to look for."""
    words = line.split()
    n = len(words)
    marked = sum(any(c in "#*$%&|<>" for c in w) for w in words)
    if marked > max_symbols * n and marked > 1:
        return "noise"
    letters = sum(map(str.isalpha, line))
    if letters and n >= 5 and sum(map(str.isupper, line)) > 0.7 * letters and line.count("!") > n / 4:
        return "noise"
    if n >= 10 and sum(map(str.__eq__, words, words[1:])) > 0.3 * n:
        return "noise"
    if len(_SEPARATOR.findall(line)) >= 3:
        return "navigation"
    if phrases and WORDS_A_PHRASE * len(_any_of(phrases).findall(line.lower())) >= n:
        return "boilerplate"
    if not letters or letters < 0.4 * sum(map(len, words)):
        return "noise"
    if n < 5 and not _END.search(line):
        return "punctuation"
    return ""


def _judged(batches: Iterator[pa.RecordBatch], min_words: int, max_repeat: int, max_loss: float, cleaned: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: dict[str, list] = {k: [] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_words", "lost_lines", "clean_text")}
        for data in byte_texts(batch.column("text")):
            start, end = word_bounds(data)
            n = len(start)
            lead = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
            hashes = span_hashes(prefix_hashes(data), start, end) if n else np.zeros(0, np.uint64)
            grams = windows(hashes, 8)
            covered = np.zeros(n + 1, np.int64)
            if len(grams) > 1:
                order = np.argsort(grams, kind="stable")
                same = grams[order][1:] == grams[order][:-1]
                again = np.unique(np.concatenate((order[1:][same], order[:-1][same])))
                np.add.at(covered, again, 1)
                np.add.at(covered, again + 8, -1)
            repeat = int((np.cumsum(covered)[:n] > 0).sum())
            text = data.tobytes().decode()
            lines = text.split("\n")
            seen, dup, lost, lost_lines, kept_lines, phrases = set(), 0, 0, 0, [], stock_phrases(text)
            for line in lines:
                size = len(line.encode().split())
                if not size:
                    kept_lines.append(line)
                    continue
                if line in seen:
                    dup += 1
                seen.add(line)
                if line_fails(line, phrases=phrases):
                    lost += size
                    lost_lines += 1
                else:
                    kept_lines.append(line)
            failed = n < min_words or 100 * repeat > max_repeat * n
            out["n_words"].append(n)
            out["word_chars"].append(int((lead[end] - lead[start]).sum()))
            out["n_symbols"].append(int(_SYMBOL[data].sum()))
            out["n_dup_lines"].append(dup)
            out["n_repeat_words"].append(repeat)
            out["base_failed"].append(failed)
            out["kept"].append(not failed and lost <= max_loss * n)
            out["lost_words"].append(lost)
            out["lost_lines"].append(lost_lines)
            out["clean_text"].append("\n".join(kept_lines) if cleaned else None)
        kinds = {"base_failed": pa.bool_(), "kept": pa.bool_(), "clean_text": pa.string()}
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(v, kinds.get(k, pa.int64())) for k, v in out.items())], names=["doc_id", *out])


_SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, lost_words long, lost_lines long, clean_text string"


def judge(docs: DataFrame, min_words: int = 20, max_repeat: int = 30, max_loss: float = 0.3, cleaned: bool = False) -> DataFrame:
    """Counts and verdict for each row of docs(doc_id, text); with ``cleaned`` also the text without its failing lines."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(lambda b: _judged(b, min_words, max_repeat, max_loss, cleaned), _SCHEMA)


def _passing(docs: DataFrame, min_words: int, max_repeat: int, max_loss: float, cleaned: bool) -> DataFrame:
    small_batches(docs.sparkSession)
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            texts = pa.RecordBatch.from_arrays([batch.column(names.index("text"))] * 2, names=["doc_id", "text"])
            for judged in _judged(iter([texts]), min_words, max_repeat, max_loss, cleaned):
                columns = list(batch.columns)
                if cleaned:
                    text = judged.column("clean_text")
                    new = {"text": text, "n_chars": pc.utf8_length(text)}
                    columns = [new[n].cast(c.type) if n in new else c for n, c in zip(names, columns, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, schema=batch.schema).filter(judged.column("kept"))

    return docs.mapInArrow(run, schema)


def keep_good(docs: DataFrame, min_words: int = 20, max_repeat: int = 30, max_loss: float = 0.3) -> DataFrame:
    """The rows of docs whose text passes, columns as they are; a filter in one pass, without a join."""
    return _passing(docs, min_words, max_repeat, max_loss, False)


def clean(docs: DataFrame, min_words: int = 20, max_repeat: int = 30, max_loss: float = 0.3) -> DataFrame:
    """The rows of docs whose text passes, text without its failing lines, n_chars counted anew; other columns as they are."""
    return _passing(docs, min_words, max_repeat, max_loss, True)
