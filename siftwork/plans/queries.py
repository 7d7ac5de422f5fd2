"""The library's operators on the driver's tables, with the same in DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dictionaries as d
from ..functions import parse
from ..functions.dictionaries import ENTITIES
from ..functions.text import canonical_url, file_stem, hash_id, html_to_text, level, scrubbed, size_bucket, text_hash, title_similarity
from ..operators import facets, linking, postings, reports, scoring, tables
from ..operators.intervals import union_length
from ..sources import addresses, documents as files
from ..sources import postings as found_postings
from ..streaming import limits
from . import search as s

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Dictionaries for the invented vocabulary of the test tables.
SKILLS = ["the", "and the", "thing", "er", "on the", "and", "le", "die", "que"]
STOPWORDS = {"English": ["the", "and", "of", "to"], "German": ["der", "die", "und", "das"], "French": ["le", "la", "les", "des"], "Spanish": ["el", "los", "que", "las"]}


def _query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _spread(df: DataFrame) -> DataFrame:
    """For milliseconds of work a row: rows of a few large row groups are dealt to all cores; a table that fills them is left alone."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(3 * cores) if df.rdd.getNumPartitions() < 2 * cores else df


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _table(spark, sf_dir, "documents")
    return s.searchable(d.select(F.col("doc_id").alias("id"), "text", F.col("source").alias("tag"), F.col("lang").alias("cv_language"), F.col("n_chars").cast("double").alias("years")))


def _has(word: str, column: str = "text") -> str:
    """A whole word in SQL, without look-around."""
    return rf"regexp_matches({column}, '(?i)(^|[^\p{{L}}\p{{N}}]){word}($|[^\p{{L}}\p{{N}}])')"


# All searched text of a document in this binding: text, language and source.
_ALL = "concat_ws(chr(10), nullif(text, ''), nullif(lang, ''), nullif(source, ''))"


@_query(f"select doc_id as id, source as tag, lang as cv_language from documents where {_has('the', _ALL)} and not {_has('anhe', _ALL)} and {_has('en', 'lang')}")
def search_boolean(spark, sf_dir):
    hits = s.search(_docs(spark, sf_dir), s.word("the") & ~s.word("anhe") & s.word("en", "lang"))
    return hits.select("id", "tag", "cv_language")


@_query(rf"select doc_id as id from documents where {_has(r'of\s+the', _ALL)} or {_has(r'de\s+la', _ALL)}")
def search_phrase(spark, sf_dir):
    return s.search(_docs(spark, sf_dir), s.phrase("of the") | s.phrase("de la")).select("id")


@_query(rf"select doc_id as id from documents where regexp_matches({_ALL}, '(?i)(^|[^\p{{L}}\p{{N}}])thoni[\p{{L}}\p{{N}}]*')")
def search_prefix(spark, sf_dir):
    return s.search(_docs(spark, sf_dir), s.prefix("thoni")).select("id")


_STEM = "case " + " ".join(f"when ends_with({{0}}, '{e}') and length({{0}}) >= {len(e) + 3} then left({{0}}, length({{0}}) - {len(e)})" for e in ("ments", "ment", "ers", "ing", "es", "er", "ed", "en", "s")) + " else {0} end"


@_query(rf"""select doc_id as id from documents where
  regexp_matches({_ALL}, '(?i)(^|[^\p{{L}}\p{{N}}])thound(?:s|es|en|er|ers|ing|ed|ment|ments)?($|[^\p{{L}}\p{{N}}])')
  or len(list_filter(list_distinct(regexp_extract_all(lower({_ALL}), '[\p{{L}}\p{{N}}]+')), lambda w: ({_STEM.format("w")}) = 'thound'
    or (w[1] = 't' and length(w) >= 4 and damerau_levenshtein(w, 'thound') <= 1))) > 0""")
def search_similar(spark, sf_dir):
    return s.search(_spread(_docs(spark, sf_dir)), s.similar("thound")).select("id")


@_query("select doc_id as id, n_chars::double as years from documents where n_chars >= 5000 and not n_chars > 20000")
def search_number(spark, sf_dir):
    return s.search(_docs(spark, sf_dir), s.number("years", ">=", 5000) & ~s.number("years", ">", 20000)).select("id", "years")


_WORDS = {"all": [{"text": "the", "mode": "word"}], "groups": [[{"text": "erand", "mode": "word"}, {"text": "src1", "mode": "word", "field": "tag"}], [{"text": "of", "mode": "word"}]], "none": [{"text": "moron", "mode": "word"}]}


@_query(f"select doc_id as id from documents where {_has('the', _ALL)} and ({_has('erand', _ALL)} or {_has('src1', 'source')}) and {_has('of', _ALL)} and not {_has('moron', _ALL)}")
def search_words(spark, sf_dir):
    return s.search(_docs(spark, sf_dir), s.Words.of(_WORDS)).select("id")


@_query(f"""select term, n from (select count(*) filter ({_has('the', _ALL)}) as a, count(*) filter ({_has('erand', _ALL)}) as b, count(*) filter ({_has('src1', 'source')}) as c, count(*) filter ({_has('of', _ALL)}) as d from documents),
  unnest([{{'term': 'the', 'n': a}}, {{'term': 'erand', 'n': b}}, {{'term': 'src1 (tag)', 'n': c}}, {{'term': 'of', 'n': d}}]) as t(e), lateral (select e.term as term, e.n as n)""")
def term_counts(spark, sf_dir):
    return s.term_counts(_docs(spark, sf_dir), s.Words.of(_WORDS))


@_query(f"select count(*) as n_rows, count(*) filter ({_has('moron', _ALL)}) as n_words, count(*) filter (source = 'src3') as n_place, count(*) filter ({_has('moron', _ALL)} and source = 'src3') as n_all from documents")
def why_empty(spark, sf_dir):
    return s.why_empty(_docs(spark, sf_dir), words=s.word("moron"), place=F.col("tag") == "src3")


@_query(f"select doc_id as id, list_filter(['the', 'erand', 'of'], lambda w: case w when 'the' then {_has('the', _ALL)} when 'erand' then {_has('erand', _ALL)} else {_has('of', _ALL)} end)::varchar as matched from documents")
def matched_terms(spark, sf_dir):
    words = s.Words(tuple(s.Term(w, "word") for w in ("the", "erand", "of")))
    return _docs(spark, sf_dir).select("id", F.concat(F.lit("["), F.array_join(s.matched_terms(words), ", "), F.lit("]")).alias("matched"))


@_query("select doc_id as id from documents where lang = 'fr' and n_chars >= 1000 and n_chars <= 9000 and source = 'src2'")
def filters(spark, sf_dir):
    return s.filtered(_docs(spark, sf_dir), language="fr", years=(1000, 9000), tag="src2", hide="human").select("id")


@_query("select doc_id as id, source as tag, n_chars::double as years from documents order by years desc, id limit 100")
def sorted_top(spark, sf_dir):
    return s.ordered(_docs(spark, sf_dir), "years", descending=True).select("id", "tag", "years").limit(100)


@_query("select word, count(*) as n from (select doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '\\p{L}{3,}'))) as word from documents) group by word")
def document_frequency(spark, sf_dir):
    return facets.document_frequency(_docs(spark, sf_dir))


@_query("select source as tag, count(*) as n from documents where source <> '' group by source")
def tag_counts(spark, sf_dir):
    return facets.tag_counts(_docs(spark, sf_dir))


@_query("select distinct lang as language from documents where lang <> ''")
def language_facet(spark, sf_dir):
    return facets.language_facet(_docs(spark, sf_dir))


@_query("""with w as (select doc_id, unnest(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z]+'), lambda x: length(x) between 4 and 6))) as skill from documents)
select skill, count(*) as n from w where skill not in ('with', 'what') group by skill order by n desc, skill limit 10""")
def top_skills(spark, sf_dir):
    words = F.array_distinct(F.filter(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)), lambda w: F.length(w).between(4, 6)))
    return facets.top_skills(_docs(spark, sf_dir).withColumn("skills", words), chosen=["with", "what"])


@_query("""select doc_id as id, count(*) over (partition by regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', '', 'g')) - 1 as duplicates from documents""")
def exact_copies(spark, sf_dir):
    return linking.exact_copies(_docs(spark, sf_dir).withColumn("hash", F.md5(F.regexp_replace(F.lower("text"), r"[^\p{L}\p{N}]+", ""))))


@_query("""with f as (select doc_id as id, source as holder, lang as tag, md5(text) as hash from documents)
select a.id, count(distinct b.tag) as same_holder from f a left join (select distinct holder, tag, hash from f) b on a.holder = b.holder and a.tag <> b.tag and a.hash <> b.hash where a.holder <> '' group by a.id""")
def same_holder(spark, sf_dir):
    d = _table(spark, sf_dir, "documents")
    return linking.same_holder(d.select(F.col("doc_id").alias("id"), F.col("source").alias("holder"), F.col("lang").alias("tag"), F.md5("text").alias("hash")))


def _shingles(table: str, key: str) -> str:
    from ..functions.dictionaries import PHRASE_STOPWORDS

    stop = ", ".join("'" + w.replace("'", "''") + "'" for w in PHRASE_STOPWORDS)
    return rf"""(select {key} as id, list_distinct(list_transform(list_filter(range(1, len(ws) - 2), lambda i: len(list_filter(ws[i:i+3], lambda w: length(w) > 2 and w not in ({stop}))) >= 2), lambda i: array_to_string(ws[i:i+3], ' '))) as grams
  from (select {key}, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') as ws from {table}))"""


@_query(f"""with every as (select id, list_sort(grams) as grams from {_shingles("documents", "doc_id")} where len(grams) > 0), sets as (select min(id) as id, grams from every group by grams),
keys as (select id, unnest(grams[1:8]) as key from sets), pairs as (select distinct a.id as a, b.id as b from keys a join keys b using (key) where a.id < b.id)
select a, b, round(overlap, 9) as overlap, 'near' as how from (select a, b, len(list_intersect(x.grams, y.grams)) / least(len(x.grams), len(y.grams)) as overlap from pairs join sets x on x.id = a join sets y on y.id = b) where overlap >= 0.8
union all select sets.id, every.id, 1.0, 'copy' from every join sets using (grams) where every.id <> sets.id""")
def near_copies(spark, sf_dir):
    pairs = linking.near_copies(_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text").transform(_spread))
    return pairs.select("a", "b", F.round("overlap", 9).alias("overlap"), "how")


# Every pair of sets that shares a phrase at all is counted.
@_query(f"""with every as (select id, list_sort(grams) as grams from {_shingles("documents", "doc_id")} where len(grams) > 0), sets as (select min(id) as id, grams from every group by grams),
keys as (select id, unnest(grams) as key from sets), shared as (select a.id as a, b.id as b, count(*) as n from keys a join keys b using (key) where a.id < b.id group by a.id, b.id)
select a, b, round(n / least(len(x.grams), len(y.grams)), 9) as overlap, 'near' as how from shared join sets x on x.id = a join sets y on y.id = b where n / least(len(x.grams), len(y.grams)) >= 0.8
union all select sets.id, every.id, 1.0, 'copy' from every join sets using (grams) where every.id <> sets.id""")
def near_copies_all(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text").transform(_spread)
    pairs = linking.near_copies(docs, block=None)
    return pairs.select("a", "b", F.round("overlap", 9).alias("overlap"), "how")


@_query(f"""with d as (select id, unnest(grams) as g from {_shingles("documents", "doc_id")}), b as (select id as tag, unnest(grams) as g from {_shingles("benchmark", "item_id")})
select d.id, b.tag, count(*) as count from d join b using (g) group by all having count(*) >= 4""")
def copied_phrases(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text").transform(_spread)
    return linking.copied_phrases(docs, _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("tag"), "text"))


# Places of shared phrases are islands where they follow each other.
@_query(rf"""with w as (select doc_id as id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') as ws from documents),
p as (select id, i, array_to_string(ws[i:i+3], ' ') as phrase from (select id, ws, unnest(range(1, len(ws) - 2)) as i from w)),
t as (select id as tag, unnest(grams) as phrase from {_shingles("benchmark", "item_id")}),
h as (select p.id, tag, i, phrase from p join t using (phrase)),
n as (select id, tag, i, i - row_number() over (partition by id, tag order by i) as island from h),
r as (select id, tag, island, count(*) as run, min(i) - 1 as first_word from n group by id, tag, island),
b as (select id, tag, run, first_word, row_number() over (partition by id, tag order by run desc, first_word) as place from r),
c as (select id, tag, count(distinct phrase) as count from h group by id, tag having count(distinct phrase) >= 4)
select id, tag, count, run, first_word::int as first_word, array_to_string(ws[first_word + 1:first_word + run + 3], ' ') as words from b join c using (id, tag) join w using (id) where place = 1""")
def copied_runs(spark, sf_dir):
    items = _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("tag"), "text")
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text").transform(_spread)
    return linking.copied_runs(docs, items)


def _decoded_sql(text: str) -> str:
    """Character references in SQL: numbers, then names in the order of the table."""
    out = rf"""list_reduce(list_prepend({text}, list_distinct(regexp_extract_all({text}, '&#[0-9]{{1,7}};'))), lambda acc, m: replace(acc, m, case when m[3:-2]::int between 1 and 1114111 and m[3:-2]::int not between 55296 and 57343 then chr(m[3:-2]::int) else m end))"""
    for name, mark in ENTITIES.items():
        quote = mark.replace("'", "''")
        out = f"regexp_replace({out}, '(?i)&{name};', '{quote}', 'g')"
    return out


def _text_sql(html: str) -> str:
    """html_to_text in SQL, for pages that are not escaped as a whole."""
    out = html
    for pattern, by in ((r"(?is)<script.*?</script>|<style.*?</style>|<noscript.*?</noscript>|<svg.*?</svg>", "' '"), (r"(?i)<br\s*/?>", "chr(10)"), ("(?i)</(p|div|li|h[1-6]|tr|section|ul|ol)>", "chr(10)"), ("(?i)<li[^>]*>", "'• '"), ("<[^>]+>", "' '")):
        out = f"regexp_replace({out}, '{pattern}', {by}, 'g')"
    out = f"(select {_decoded_sql('x')} from (select {out} as x))"
    for pattern, by in ((r"[ \t\x{00A0}]+", "' '"), (r" *\n *", "chr(10)"), (r"\n{3,}", "chr(10) || chr(10)")):
        out = f"regexp_replace({out}, '{pattern}', {by}, 'g')"
    return f"trim({out}, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ')"


@_query(f"select page_id, length(t) as n_chars, md5(t) as digest from (select page_id, {_text_sql('html')} as t from pages)")
def html_text(spark, sf_dir):
    text = html_to_text(F.col("html"))
    return _table(spark, sf_dir, "pages").select("page_id", text.alias("t")).select("page_id", F.length("t").alias("n_chars"), F.md5("t").alias("digest"))


@_query(r"""with p as (select page_id, regexp_replace(regexp_extract(trim(url), '^([^?#]*)', 1), '^([A-Za-z][A-Za-z0-9+.-]*://[^/]*)$', '\1/') as base,
  array_to_string(list_filter(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'), lambda q: q <> '' and not regexp_matches(lower(regexp_extract(q, '^([^=]*)', 1)), '^(utm_.*|trk|trkinfo|ref|refid|referrer|trackingid|from|src|source|position|pagenum|origin|gclid|fbclid|mc_[a-z]+|sid|lipi)$')), '&') as q from pages)
select page_id, lower(regexp_replace(base, '/$', '') || case when q <> '' then '?' || q else '' end) as address from p""")
def canonical_addresses(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", canonical_url(F.col("url")).alias("address"))


_ADDRESS_SQL = r"""(select page_id, url, lower(regexp_replace(base, '/$', '') || case when q <> '' then '?' || q else '' end) as address from (
  select page_id, url, regexp_replace(regexp_extract(trim(url), '^([^?#]*)', 1), '^([A-Za-z][A-Za-z0-9+.-]*://[^/]*)$', '\1/') as base,
  array_to_string(list_filter(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'), lambda q: q <> '' and not regexp_matches(lower(regexp_extract(q, '^([^=]*)', 1)), '^(utm_.*|trk|trkinfo|ref|refid|referrer|trackingid|from|src|source|position|pagenum|origin|gclid|fbclid|mc_[a-z]+|sid|lipi)$')), '&') as q from pages))"""


def _hash_sql(text: str) -> str:
    """j and two 32-bit folds of a text's characters in base 36."""
    codes = f"list_transform(string_split({text}, ''), lambda c: unicode(c)::bigint)"
    a = f"list_reduce(list_prepend(2166136261::bigint, {codes}), lambda h, c: (xor(h, c) * 16777619) & 4294967295)"
    b = f"list_reduce(list_prepend(7::bigint, {codes}), lambda h, c: (h * 31 + c) & 4294967295)"
    return f"'j' || lower(to_base({a}, 36)) || lower(to_base({b}, 36))"


_POSTINGS_SQL = f"""(select url, {_text_sql("regexp_replace(html, '(?is)<header.*?</header>|<nav.*?</nav>|<footer.*?</footer>', ' ', 'g')")} as text,
  split_part({_text_sql("coalesce(nullif(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), ''), regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1))")}, chr(10), 1) as title from pages)"""


@_query(f"""with p as {_POSTINGS_SQL}
select url, title, md5(text) as digest from p where title <> '' and regexp_matches(text, '(?i)(thing|eaux)')""")
def pages_as_postings(spark, sf_dir):
    rows = found_postings.page_postings(_table(spark, sf_dir, "pages"), cues="(?i)(thing|eaux)")
    return rows.select("url", "title", F.md5("text").alias("digest"))


@_query(r"""select page_id, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1)) as host, 'page' as type, null::varchar as verdict,
  regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1)), '^www\.', '') || coalesce('/' || nullif(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/+([^/?#]+)', 1), ''), '') as label from pages""")
def source_types(spark, sf_dir):
    rows = _table(spark, sf_dir, "pages").select("page_id", addresses.host(F.col("url")).alias("host"), addresses.detect_source(F.col("url")).alias("s"), addresses.check_url(F.col("url")).alias("verdict"))
    return rows.select("page_id", "host", F.col("s.type").alias("type"), "verdict", F.col("s.label").alias("label"))


@_query(r"""with i as (select doc_id, unnest(regexp_extract_all(text, '[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}')) as ip from documents), q as (select doc_id, ip, string_split(ip, '.')[1]::int as a, string_split(ip, '.')[2]::int as b from i)
select doc_id, ip, a in (0, 10, 127) or a >= 224 or (a = 169 and b = 254) or (a = 172 and b between 16 and 31) or (a = 192 and b in (0, 168)) or (a = 100 and b between 64 and 127) or (a = 198 and b in (18, 19)) as private from q""")
def private_addresses(spark, sf_dir):
    ips = F.explode(F.regexp_extract_all("text", F.lit(r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}"), F.lit(0)))
    return _table(spark, sf_dir, "documents").select("doc_id", ips.alias("ip")).select("doc_id", "ip", addresses.is_private(F.col("ip")).alias("private"))


@_query(r"""select doc_id, md5(regexp_replace(regexp_replace(regexp_replace(text, '[\w.+-]+@[\w-]+(\.[\w-]+)+', '<email>', 'g'), '\+?[0-9][0-9\s-]{7,}[0-9]', '<num>', 'g'), '(blob|filesystem|https?)://\S+', '<url>', 'g')) as digest,
  case when n_chars * 1000 < 1e5 then '<100KB' when n_chars * 1000 < 1e6 then '<1MB' when n_chars * 1000 < 5e6 then '<5MB' when n_chars * 1000 < 2e7 then '<20MB' else '>=20MB' end as bucket from documents""")
def scrubbed_texts(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", F.md5(scrubbed(F.col("text"))).alias("digest"), size_bucket(F.col("n_chars") * 1000).alias("bucket"))


@_query(r"""select doc_id, lower(regexp_extract(text, '[\w.+-]+@[\w-]+(\.[\w-]+)+', 0)) as email, trim(regexp_extract(text, '(\+[0-9]{2}[\s-]?|0)(\(0\)\s?)?[0-9]([\s-]?[0-9]){7,10}', 0)) as phone from documents""")
def contacts(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", parse.email(F.col("text")).alias("email"), parse.phone(F.col("text")).alias("phone"))


def _count(words: list[str]) -> str:
    return f"len(list_filter(ws, lambda w: w in ({', '.join(repr(w) for w in words)})))"


@_query(rf"""with w as (select doc_id, regexp_extract_all(lower(text), '\p{{L}}+') as ws from documents), c as (select doc_id, {", ".join(f"{_count(ws)} as {k}" for k, ws in STOPWORDS.items())} from w)
select doc_id, case when greatest({", ".join(STOPWORDS)}) < 3 then '' {" ".join(f"when {k} = greatest({', '.join(STOPWORDS)}) then '{k}'" for k in STOPWORDS)} end as written from c""")
def written_language(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", parse.written_in(F.col("text"), STOPWORDS).alias("written"))


_TITLE_WORDS = r"list_distinct(list_filter(regexp_extract_all(lower({0}), '[a-z0-9+#]+'), lambda w: length(w) > 1 and w not in ('the', 'of', 'in', 'and')))"


@_query(f"""with p as (select p_partkey, {_TITLE_WORDS.format("p_name")} as a, {_TITLE_WORDS.format("p_type || ' ' || p_name")} as b from part)
select p_partkey, round(case when len(a) = 0 or len(b) = 0 then 0 else 2.0 * len(list_filter(a, lambda x: len(list_filter(b, lambda y: x = y or (length(x) >= 5 and length(y) >= 5 and left(x, 5) = left(y, 5)))) > 0)) / (len(a) + len(b)) end, 9) as similarity from p""")
def title_similarities(spark, sf_dir):
    both = title_similarity(F.col("p_name"), F.concat_ws(" ", "p_type", "p_name"))
    return _table(spark, sf_dir, "part").select("p_partkey", F.round(both, 9).alias("similarity"))


@_query("""with l as (select doc_id, source, lang from documents where doc_id % 3 = 0), c as (select doc_id, source, lang, n_chars from documents where doc_id % 3 <> 0),
r as (select l.doc_id as letter_id, c.doc_id as cv_id, row_number() over (partition by l.doc_id order by case when c.lang = l.lang then 0 else 1 end, c.n_chars desc, c.doc_id) as n from l join c using (source))
select letter_id, cv_id, 'name' as how from r where n = 1""")
def linked_letters(spark, sf_dir):
    d = _table(spark, sf_dir, "documents")
    none = F.lit("")
    docs = d.select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 3 == 0, "letter").otherwise("cv").alias("kind"), none.alias("email"), F.col("source").alias("name"), none.alias("capture_id"), none.alias("file_name"), F.col("lang").alias("tag"), F.col("n_chars").alias("added_at"))
    return linking.link_letters(docs)


@_query("""with s as (select user_id, epoch_us(ts) // 60000000 as a, epoch_us(ts) // 60000000 + 30 + event_id % 90 as b from events), r as (select *, max(b) over (partition by user_id order by a, b rows between unbounded preceding and 1 preceding) as p from s)
select user_id, sum(greatest(b - greatest(a, coalesce(p, a)), 0))::bigint as covered, count(*) filter (p is null or a > p) as n_islands from r group by user_id""")
def covered_minutes(spark, sf_dir):
    minutes = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 60_000_000)
    spans = _table(spark, sf_dir, "events").select("user_id", minutes.alias("a"), (minutes + 30 + F.col("event_id") % 90).alias("b"))
    return union_length(spans, "user_id", "a", "b")


@_query("""with k as (select page_id, url from pages where page_id % 2 = 0), f as (select page_id, url from pages where page_id % 2 = 1 or page_id % 3 = 0)
select coalesce(f.page_id, k.page_id) as id, coalesce(f.url, k.url) as url, k.page_id is null as is_new, case when k.page_id is null then '2024-02-01' else '2024-01-01' end as first_seen, case when f.page_id is null then '2024-01-01' else '2024-02-01' end as last_seen,
  case when k.page_id is null then 'b' when f.page_id is null then 'a' else 'a,b' end as searched_for, k.page_id is not null and k.page_id % 8 = 0 as hidden from k full join f on k.page_id = f.page_id""")
def merged_postings(spark, sf_dir):
    pages = _table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), "url")
    old = F.lit("2024-01-01").cast("timestamp")
    known = pages.where("id % 2 = 0").select("id", "url", F.array(F.lit("a")).alias("searched_for"), old.alias("first_seen"), old.alias("last_seen"), (F.col("id") % 8 == 0).alias("hidden"))
    out = postings.merged(known, pages.where("id % 2 = 1 or id % 3 = 0").withColumn("searched_for", F.array(F.lit("b"))), "2024-02-01")
    day = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    return out.select("id", "url", "is_new", day("first_seen"), day("last_seen"), F.array_join("searched_for", ",").alias("searched_for"), "hidden")


@_query("""select o_orderkey, o_custkey, case when o_orderkey % 7 = 0 then 'X' else o_orderstatus end as o_orderstatus from orders where o_orderkey % 11 <> 0
union all select o_orderkey + 1000000000, o_custkey, 'X' from orders where o_orderkey % 13 = 0""")
def upserted(spark, sf_dir):
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    changed = orders.where("o_orderkey % 7 = 0").unionByName(orders.where("o_orderkey % 13 = 0").withColumn("o_orderkey", F.col("o_orderkey") + 1_000_000_000)).withColumn("o_orderstatus", F.lit("X"))
    gone = orders.where("o_orderkey % 11 = 0").select("o_orderkey")
    return tables.delete(tables.upsert(orders, changed, "o_orderkey"), gone, "o_orderkey")


_EMPTY = '""'


@_query(f"""select 1 as at, '"' || replace('n' || doc_id, '"', '""') || '",{",".join([_EMPTY] * 5)},"' || lang || '",{_EMPTY},"' || n_chars::double || '",{",".join([_EMPTY] * 6)},"' || source || '",{",".join([_EMPTY] * 2)},"' || replace(text, '"', '""') || '",{_EMPTY},{_EMPTY}' as line from documents
union all select 0, chr(65279) || '{",".join(f'"{t}"' for t, _ in reports.EXPORT)}'""")
def csv_export(spark, sf_dir):
    d = _table(spark, sf_dir, "documents")
    rows = d.select(F.concat(F.lit("n"), "doc_id").alias("name"), F.col("lang").alias("cv_language"), F.col("n_chars").cast("double").alias("years"), F.col("source").alias("tag"), F.col("text").alias("file_name"))
    return reports.csv_lines(rows)


@_query("""with e as (select user_id, event_type, min(ts) as ts from events group by user_id, event_type), r as (select *, row_number() over (partition by user_id order by ts, event_type) as n from e)
select user_id as session, event_type as step, left(sha256(event_type || '|' || event_type), 10) as signature from r where n <= 25""")
def session_reports(spark, sf_dir):
    e = _table(spark, sf_dir, "events")
    errors = e.select(F.col("user_id").alias("session"), F.col("ts").alias("at"), F.col("event_type").alias("step"), F.col("event_type").alias("message"), F.lit("").alias("stack"), F.lit(False).alias("manual"))
    return reports.error_reports(errors).select("session", "step", "signature")


@_query("""select l_orderkey, round(case when count(*) < 2 or avg(l_quantity) = 0 then 1 else stddev_pop(l_quantity) / avg(l_quantity) end, 6) as variation from lineitem group by l_orderkey""")
def variations(spark, sf_dir):
    grouped = _table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_quantity").alias("q"))
    return grouped.select("l_orderkey", F.round(scoring.variation(F.col("q")), 6).alias("variation"))


@_query("""select page_id, case when url like '%.html' or url like '%.htm' then 'html' else 'unknown' end as kind, case when page_id % 100 >= 55 then 'high' when page_id % 100 >= 25 then 'medium' else 'low' end as level from pages""")
def kinds_and_levels(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", files.file_kind(F.col("url"), F.lit("")).alias("kind"), level(F.col("page_id") % 100).alias("level"))


@_query("""with w as (select word, count(*) as n from (select doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'))) as word from documents) where regexp_matches(word, '^\\p{L}{3,}$') group by word),
d as (select word, n, damerau_levenshtein('thesonou', """ + _STEM.format("word") + """) as distance from w where word <> 'thesonou' and word[1] = 't')
select word, distance, n from d where distance <= 2 order by distance, n desc, word limit 1""")
def did_you_mean(spark, sf_dir):
    return s.suggestions(_table(spark, sf_dir, "documents").select("text").transform(_spread), "thesonou")


@_query("""with recursive e as (select user_id as caller, event_id as call_id, epoch_us(ts) as us, row_number() over (partition by user_id order by ts, event_id) as n from events),
r as (select caller, call_id, n, [us] as recent, true as allowed from e where n = 1
  union all select caller, call_id, n, case when len(left_) < 3 then list_append(left_, us) else left_ end, len(left_) < 3
  from (select e.caller, e.call_id, e.n, e.us, list_filter(r.recent, lambda x: x > e.us - 21600000000) as left_ from r join e on e.caller = r.caller and e.n = r.n + 1))
select caller, call_id, allowed from r""")
def rate_limits(spark, sf_dir):
    calls = _table(spark, sf_dir, "events").select(F.col("user_id").alias("caller"), F.col("event_id").alias("call_id"), "ts")
    return limits.rate_limited(calls, limit=3, window_s=6 * 3600)


def _tokens_sql(text: str) -> str:
    """Words, white space and the rest between them, in order."""
    return rf"regexp_extract_all(lower({text}), '\p{{L}}+|\s+|[^\p{{L}}\s]+')"


_LETTERS = r"len(regexp_extract_all({}, '\p{{L}}+'))"
_SPREAD = "case when len({0}) < 2 or list_avg({0}) = 0 then 1 else list_stddev_pop({0}) / list_avg({0}) end"
#: The signals of generated_score that read a text alone, for texts without a place, a producer or years of work.
_GENERATED_SQL = rf"""with t as (select doc_id as id, text, doc_id % 2 = 0 as letter, greatest({_LETTERS.format("text")}, 1) as n, {_tokens_sql("text")} as ts from documents),
u as (select *, (len(list_filter(ts, lambda x: x in ('the', 'and'))) + len(list_filter(range(1, len(ts) - 1), lambda i: trim(ts[i + 1], chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') = '' and (ts[i] = 'of' and ts[i + 2] = 'the' or ts[i] = 'de' and ts[i + 2] = 'la')))) / n * 100 as per100,
  len(regexp_extract_all(text, '(?i)(^|[^\p{{L}}])\p{{L}}[\p{{L}}''’ -]{{0,40}}?,\s+\p{{L}}[\p{{L}}''’ -]{{0,40}}?,?\s+(?:and|en)\s+\p{{L}}+')) as triplets,
  len(regexp_extract_all(text, '(?i)\byour (organi[sz]ation|company|team|firm|business)\b')) as generic,
  len(list_filter(list_zip(regexp_extract_all(text, {{rounds}}, 1), regexp_extract_all(text, {{rounds}}, 2)), lambda m: try_cast(m[1] || m[2] as int) % 5 = 0)) as metrics,
  len(regexp_extract_all(text, '—')) as dashes,
  list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '\n+', ' ', 'g'), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: {_LETTERS.format("x")}), lambda k: k >= 4) as sentences,
  list_filter(list_transform(string_split_regex(text, '\n\s*\n'), lambda x: {_LETTERS.format("x")}), lambda k: k >= 25) as paragraphs,
  list_transform(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: regexp_matches(x, '^[•▪●◦\-*–]\s+\S')), lambda x: length(x)) as bullets,
  {{left_over}} as left_over, regexp_matches(text, '(?im)^\s*(dear (hiring manager|hiring team|recruit(er|ment team)|sir or madam|sir/madam)|to whom it may concern|geachte heer/mevrouw|geachte heer of mevrouw|geachte lezer)\b') as greeted from t),
p as (select id, per100, [least(case when letter then 60 else 40 end, greatest(0, per100 - 0.4) * 22),
  case when triplets >= 3 then least(case when letter then 15 else 8 end, (triplets / n * 100 - 0.5) * case when letter then 10 else 8 end) end,
  case when letter and generic >= 2 then least(10, generic * 2.5) end, case when letter and greeted then 4 end, case when metrics > 0 then least(8, metrics * 4) end, least(12, dashes / n * 1000 * 1.5),
  case when len(sentences) >= 8 then least(15, (0.45 - {_SPREAD.format("sentences")}) * 60) end,
  case when letter and len(paragraphs) >= 4 then least(6, (0.3 - {_SPREAD.format("paragraphs")}) * 40) end,
  case when len(bullets) >= 6 then least(10, (0.3 - {_SPREAD.format("bullets")}) * 50) end,
  case when left_over > 0 then least(60, 45 + 10 * (left_over - 1)) end] as points from u),
k as (select id, per100, list_filter(points, lambda x: x > 0) as ps from p), r as (select *, least(100, floor(coalesce(list_sum(ps), 0) + 0.5))::int as score from k)
select id, score, case when score >= 55 then 'high' when score >= 25 then 'medium' else 'low' end as level, len(ps)::int as n_reasons, floor(per100 * 10 + 0.5) / 10 as wording from r"""


def _generated_sql() -> str:
    sql = lambda pattern: "'" + pattern.replace("'", "''") + "'"
    left_over = " + ".join(f"regexp_matches(text, {sql('(?i)' + p)})::int" for p in d.PLACEHOLDERS)
    return _GENERATED_SQL.replace("{rounds}", sql(scoring._ROUND)).replace("{left_over}", left_over)


@_query(_generated_sql())
def generated_scores(spark, sf_dir):
    d = _docs(spark, sf_dir).select("id", "text", "location").transform(_spread)
    score = scoring.generated_score(F.col("text"), F.lit(""), F.when(F.col("id") % 2 == 0, "letter").otherwise("cv"), F.col("location"), F.lit(0.0), phrases=["the", "of the", "and", "de la"])
    return d.select("id", score.alias("r")).select("id", "r.score", "r.level", F.size("r.reasons").alias("n_reasons"), "r.wording")


#: Documents with every trace that the score reads, spread over ids.
_TOOL_DOCS = {
    "text": "text || case when doc_id % 9 = 0 then '\nAn ATS friendly text, based on the job description.' else '' end || case when doc_id % 11 = 0 then '\nKeywords: ' || repeat('plan, ', 24) || 'sell' else '' end || case when doc_id % 13 = 0 then '\nI want the Sales Manager position.' else '' end",
    "kind": "case when doc_id % 2 = 0 then 'letter' else 'cv' end",
    "producer": "case when doc_id % 7 = 0 then 'LazyApply 2.1' else 'Writer' end",
    "file_name": "case when doc_id % 5 = 0 then 'x_tailored.pdf' else 'x.pdf' end",
    "target_text": "case when doc_id % 10 = 0 then left(text, 300) else 'A nurse is wanted' end",
    "hidden_words": "cast(doc_id % 40 as int)",
    "same_holder": "cast(doc_id % 4 as int)",
    "similar_letters": "cast(doc_id % 3 as int)",
    "same_letter_targets": "cast(doc_id % 6 as int)",
}
_TOOL_TABLE = "(select doc_id, text as plain, " + ", ".join(f"{v} as {k}" for k, v in _TOOL_DOCS.items()) + " from documents)"


@_query(rf"""with t as {_TOOL_TABLE.replace(chr(10), "' || chr(10) || '")},
c as (select a.id, len(list_intersect(a.grams, b.grams)) as copied from {_shingles("t", "doc_id")} a join {_shingles("(select doc_id, target_text as text from t)", "doc_id")} b on a.id = b.id),
w as (select doc_id, count(*) over (partition by regexp_replace(lower(plain), '[^\p{{L}}\p{{N}}]+', '', 'g')) - 1 as duplicates from t),
p as (select t.doc_id as id, [case when copied >= 4 then least(70, 14 + (copied - 4) * 4) end, case when same_holder > 0 then least(40, 22 + 8 * (same_holder - 1)) end, case when duplicates > 0 then least(30, 18 + 6 * duplicates) end,
  case when hidden_words >= 10 then least(45, 22 + hidden_words / 5) end, case when doc_id % 7 = 0 then 35 end, case when doc_id % 5 = 0 then 15 end, case when doc_id % 9 = 0 then 30 end, case when doc_id % 11 = 0 then 20 end,
  case when kind = 'letter' and same_letter_targets > 0 then least(45, 30 + 8 * (same_letter_targets - 1)) end, case when kind = 'letter' and similar_letters > 0 then least(40, 25 + 5 * similar_letters) end, case when kind = 'letter' and doc_id % 13 = 0 then 30 end]::double[] as points
  from t join c on c.id = t.doc_id join w using (doc_id)),
k as (select id, list_filter(points, lambda x: x > 0) as ps from p), r as (select *, least(100, floor(coalesce(list_sum(ps), 0) + 0.5))::int as score from k)
select id, score, case when score >= 55 then 'high' when score >= 25 then 'medium' else 'low' end as level, len(ps)::int as n_reasons from r""")
def tool_scores(spark, sf_dir):
    table = _table(spark, sf_dir, "documents").select("doc_id", "text").transform(_spread)
    docs = table.select(F.col("doc_id").alias("id"), *[F.expr(v.replace("\n", "\\n")).alias(k) for k, v in _TOOL_DOCS.items()])
    copies = linking.exact_copies(table.select(F.col("doc_id").alias("id"), text_hash(F.col("text")).alias("hash")))
    rows = docs.join(copies, "id")
    return rows.select("id", scoring.sent_by_tool_score(rows).alias("r")).select("id", "r.score", "r.level", F.size("r.reasons").alias("n_reasons"))


@_query()
def parsed_documents(spark, sf_dir):
    d = _docs(spark, sf_dir).select("id", "text").transform(_spread)
    out = parse.parsed(d, as_of="2026-01-01")
    return out.select("id", "name", "email", "phone", "location", F.array_join("languages", ",").alias("languages"), "cv_language", F.array_join("skills", ",").alias("skills"), "years", "education", "kind", "hash")


#: Documents as profiles: a head that spreads every parsed column over ids, then the text.
_PROFILE = r"""'Name: Ada ' || source || case when doc_id % 3 = 0 then '\nWoonplaats: Utrecht' when doc_id % 3 = 1 then '\nLocation: Main street 4, Spring' || lang else '\nAddress: 3511 AB' end
  || '\nada.' || source || '@mail.example | +31 6 1234' || lpad(cast(doc_id % 10000 as string), 4, '0') || '\nlinkedin.com/in/ada-' || source
  || '\nSkills: Python, SQL' || case when doc_id % 2 = 0 then ', machine learning' else '' end || '\nWerkervaring\n2010 - 2015 A\n01/2012 - 01/' || cast(2016 + doc_id % 5 as string) || ' B\nOpleiding\n1990 - 2009 school'
  || case when doc_id % 4 = 0 then '\nPhD' when doc_id % 4 = 1 then '\nMBO' else '' end || '\nTalen: Engels' || case when doc_id % 5 = 0 then ', Duits' else '' end || repeat('\n-', 210) || '\n' || text"""
_PROFILE_SQL = _PROFILE.replace("\\n", "\n").replace("as string", "as varchar")


def _profile_sql() -> str:
    stop = {k: f"len(list_filter(ws, lambda w: w in ({', '.join(repr(w) for w in ws)})))" for k, ws in d.STOPWORDS.items()}
    levels = " ".join(f"when regexp_matches(lower(clean), '{p}') then '{name}'" for name, p in parse._EDUCATION)
    first = " ".join(f"when {k.lower()} = greatest({', '.join(stop).lower()}) then '{k}'" for k in stop)
    units = r"regexp_replace(lower(profile), '[^\p{L}\p{N}]+', '', 'g')"
    codes = "list_transform(list_filter(string_split(u, ''), lambda c: c <> ''), lambda c: unicode(c)::bigint)"
    fold = lambda seed, step: f"upper(to_hex(list_reduce(list_prepend({seed}::bigint, {codes}), lambda h, c: ({step}) & 4294967295)))"
    count = lambda pattern: f"len(regexp_extract_all(profile, '{pattern}'))"
    has = lambda pattern, text="profile": f"regexp_matches({text}, '{pattern}')::int"
    return rf"""with t as (select doc_id, source, lang, {_PROFILE_SQL} as profile from documents where text is not null),
v as (select *, regexp_replace(replace(profile, chr(13), ''), '[ \t\x{{00A0}}]+', ' ', 'g') as clean, {units} as u, list_filter(list_transform(string_split(profile, chr(10)), lambda x: trim(x)), lambda x: x <> '') as ls from t),
w as (select *, regexp_extract_all(lower(clean), '\p{{L}}+') as ws from v), c as (select *, {", ".join(f"{n} as {k.lower()}" for k, n in stop.items())},
  3 * {has(parse._GREETING)} + 3 * {has(parse._CLOSING.replace("(?imu)", "(?im)"))} + 2 * {has(parse._LETTER_WORDS, "left(profile, 600)")} + 2 * (len(list_filter(ls, lambda x: length(x) > 120)) / len(ls) > 0.3)::int as letter,
  least(4, {count(parse._DATE_RANGE)}) + least(4, 2 * {count(parse._CV_HEADINGS)}) + 2 * (len(list_filter(ls, lambda x: regexp_matches(x, '^[•▪●◦\-*–]\s'))) >= 4)::int as cv from w)
select doc_id as id, 'Ada ' || source as name, 'ada.' || source || '@mail.example' as email, '+31 6 1234' || lpad((doc_id % 10000)::varchar, 4, '0') as phone, 'linkedin.com/in/ada-' || source as linkedin,
  case doc_id % 3 when 0 then 'Utrecht' when 1 then 'Spring' || lang else 'Utrecht (regio)' end as location, 'English' || case when doc_id % 5 = 0 then ',German' else '' end as languages,
  case when greatest({", ".join(stop).lower()}) < 3 then '' {first} end as cv_language, case when doc_id % 2 = 0 then 'machine learning,' else '' end as ml, ((2016 + doc_id % 5) - 2010)::double as years,
  case {levels} else '' end as education, case when letter >= 4 and letter > cv then 'letter' else 'cv' end as kind, {fold(2166136261, "xor(h, c) * 16777619")} || {fold(0, "h * 31 + c")} as hash from c"""


@_query(_profile_sql())
def parsed_profiles(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").where("text is not null").transform(_spread).select(F.col("doc_id").alias("id"), F.expr(_PROFILE).alias("text"))
    out = parse.parsed(docs, as_of="2026-01-01", extra_skills=None)
    ml = F.when(F.array_contains("skills", "machine learning"), "machine learning,").otherwise("")
    return out.select("id", "name", "email", "phone", "linkedin", "location", F.array_join("languages", ",").alias("languages"), "cv_language", ml.alias("ml"), "years", "education", "kind", F.upper("hash").alias("hash"))


# Postings of pages have no company, so equal titles make one ad; chains are followed by labels along shared ids and titles.
@_query(rf"""with recursive k as (select *, {_hash_sql("address")} as id from (select p.url, trim(regexp_replace(p.title, '\s+', ' ', 'g')) as title, left(p.text, 20000) as text, a.address from {_POSTINGS_SQL} p join {_ADDRESS_SQL} a using (url) where p.title <> '' and p.text <> '')),
l as (select distinct id, lower(title) as name from k),
r as (select id, id as label from l union select b.id, r.label from r join l a on a.id = r.id join l b on b.name = a.name),
m as (select id, min(label) as label from r group by id),
best as (select label, arg_max(struct_pack(title := title, url := url, n := length(text)), struct_pack(n := length(text), id := k.id)) as b from k join m using (id) group by label)
select label as id, b.title as title, b.url as url, b.n as n_chars from best""")
def deduplicated_postings(spark, sf_dir):
    pages = _table(spark, sf_dir, "pages")
    rows = found_postings.page_postings(pages, cues="(?s).")
    return postings.deduplicated(postings.normalised(rows)).select("id", "title", "url", F.length("text").alias("n_chars"))


@_query()
def matched_targets(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text").transform(_spread)
    words = parse.skills(F.col("text"), known=SKILLS)
    rows = docs.select(F.col("doc_id").alias("id"), "text", F.lit("").alias("letter_text"), words.alias("skills"))
    items = _table(spark, sf_dir, "benchmark")
    targets = items.select(F.concat(F.lit("t"), "item_id").alias("tag"), F.array_join(F.slice(F.split("text", " "), 2, 3), " ").alias("title"), "text")
    return linking.match_targets(rows, targets, known_skills=SKILLS)


@_query(rf"""select page_id, {_hash_sql("address")} as id,
  trim(regexp_replace(regexp_replace(trim(regexp_replace(lower(regexp_replace(regexp_extract(url, '([^/]+)$', 1), '(?i)\.[a-z0-9]+$', '')), '[^a-z0-9@.]+', ' ', 'g')),
  '\b(cv|resume|curriculum|vitae|cover|letter|motivation|motivatie|motivatiebrief|sollicitatiebrief|brief|final|def|v\d+|nl|en|\d+)\b', ' ', 'g'), '\s+', ' ', 'g')) as stem from {_ADDRESS_SQL}""")
def hash_ids(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", hash_id(canonical_url(F.col("url"))).alias("id"), file_stem(F.regexp_extract("url", "([^/]+)$", 1)).alias("stem"))


# The links of the tables' pages have no numbers, which those of single postings need: they get the page's.
@_query(r"""with h as (select url, page_id, unnest(list_distinct(regexp_extract_all(html, '(?i)<a\b[^>]*\bhref=["''](/[^"''#]+)', 1))) as href from pages),
l as (select url, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) || '/jobs/' || page_id || '-' || href[2:] as link from h)
select url, link from l where not regexp_matches(regexp_extract(link, '^https?://[^/?#]*([^?#]*)', 1), '(?i)\b(login|signin|apply|solliciteer|privacy|cookie|contact)\b')""")
def page_links(spark, sf_dir):
    numbered = F.regexp_replace(F.col("html"), F.lit('href="/'), F.concat(F.lit('href="/jobs/'), "page_id", F.lit("-")))
    return found_postings.job_links(_table(spark, sf_dir, "pages").withColumn("html", numbered))


@_query("select doc_id as id, len(list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'), lambda w: w in ('the', 'of'))) as n_marks from documents")
def highlights(spark, sf_dir):
    words = s.Words(tuple(s.Term(w, "word") for w in ("the", "of")))
    d = _docs(spark, sf_dir)
    return d.select("id", F.regexp_count(s.highlighted(F.col("text"), words), F.lit("<mark>")).alias("n_marks"))
