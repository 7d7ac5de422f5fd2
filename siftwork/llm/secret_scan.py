"""Secret scan: pattern candidates, then a random forest that removes false positives.

Candidates are

* unbroken runs of SHORTEST or more token characters with a digit and a letter
  (an equals sign only ends one, as padding),
* LETTERS or more letters in a row,
* whatever stands without white space or quotes, SHORT characters or more,
  behind a word that names a secret (in five languages) and an assignment mark,
* the password part of an address such as scheme://user:password@host.

What they are is the forest's verdict.  Features: length, shares of character
classes, class transitions, distinct characters, longest repeat, dictionary
coverage, usual letter pairs and consonant clusters, path and file marks, and
the BEFORE and AFTER characters around.  The forest is trained on labelled
findings (a bounded, generated sample: ``TRAINED`` rows of known secret shapes
and known look-alikes such as checksums, UUIDs, paths, versions, identifiers,
product names, measures and long words).

DataFrame and Spark ML functions only; nothing is shuffled but the training rows.

Defined cases: null or empty texts have no findings; repeated rows give their
findings each; a candidate of any length is judged whole; a null doc_id is carried through; extra columns are
ignored.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .pii import _matches
from .shared import materialize

#: Labelled findings for training; a bound on the sample, not on the data.
TRAINED = 6000
#: Least lengths of a run with digits and letters, of letters alone, and of an assigned value; a candidate has no greatest length.
SHORTEST, LETTERS, SHORT = 8, 16, 6
#: Characters around a candidate that its neighbouring words are read from.
BEFORE, AFTER = 40, 16
_MARKS = "+/_.!#%*?$^~-"
_CHARS = f"A-Za-z0-9{_MARKS}"
CANDIDATE = rf"(?<![{_CHARS}])(?:(?=[A-Za-z{_MARKS}]*[0-9])(?=[0-9{_MARKS}]*[A-Za-z])[{_CHARS}]{{{SHORTEST},}}+={{0,2}}|[A-Za-z]{{{LETTERS},}}+(?![{_CHARS}]))"
#: The password of an address (group 1).
ADDRESSED = r"[A-Za-z][A-Za-z0-9+.-]{1,20}://[^\s/:@]+:([^\s/@]{4,})@"
#: Usual pairs of letters in words of European languages (fixed values).
PAIRS = "th|he|in|er|an|re|on|at|en|nd|ti|es|or|te|of|ed|is|it|al|ar|st|to|nt|ng|se|ha|as|ou|io|le|ve|co|me|de|hi|ri|ro|ic|ne|ea|ra|ce|li|ch|ll|be|ma|si|om|ur|ge|ie|ei|el|la|un|au|ss|ka|ij|aa|oe|qu|ta|us|ol|ul|am|im|em|um|wh|sh|tr|pr|pe|po|ca|sc|ck|ct|rt|rs|ns|ts|ee|oo|ow|wi|we|wa|fo|fi|fe|ho|di|da|do|mo|mi|no|na|ni|lo|so|su|pa|pl|ab|ac|ad|ag|ap|av|ec|eg|et|ig|il|ir|iv|id|ot|os|op|ut|ly|ty|ry"
#: Words that name secrets and words that name harmless values (fixed values).
SECRET_WORDS = "token|secret|passw(?:or)?d|pwd|api[_ -]?key|apikey|access[_ -]?key|private[_ -]?key|credential|auth|bearer|client[_ -]?secret|signature|mot de passe|jeton|passwort|kennwort|geheimnis|schl(?:ü|ue)ssel|contrase(?:ñ|n)a|clave|wachtwoord|geheim|sleutel"
HARMLESS_WORDS = "sha(?:1|256|512)?|md5|checksum|digest|hash|commit|revision|uuid|guid|etag|version|build|integrity|fingerprint|file|path|url|href|src|example|sample|placeholder|doi|isbn|order|invoice|ref(?:erence)?"
#: A secret's name, an assignment and the value (group 1).
ASSIGNED = rf"(?i)(?:{SECRET_WORDS})[A-Za-z0-9_.-]{{0,24}}[\"'`]?[ \t]{{0,3}}(?:=>|:=|=|:)[ \t]{{0,3}}[\"'`]?([^\s\"'`]{{{SHORT},}})"
#: Common parts of identifiers, for the dictionary coverage (fixed values).
DICTIONARY = "account|admin|application|archive|article|backup|button|cache|class|client|code|color|column|com|config|container|content|count|data|database|date|default|document|download|element|email|error|event|example|field|file|first|form|format|function|group|handler|height|home|html|http|image|index|info|input|item|key|label|last|layout|left|length|level|library|link|list|load|local|login|main|manager|message|method|model|module|name|network|node|number|object|option|order|output|page|param|path|photo|position|primary|product|project|public|query|record|release|report|request|response|result|right|root|sample|script|search|section|select|server|service|session|size|source|start|state|static|status|string|style|system|table|target|task|template|test|text|thread|time|title|type|update|upload|user|value|version|video|view|widget|width|window|www"
#: Parts of words, and long words, of European languages, for look-alikes without digits (fixed values).
SYLLABLES = "tion ment er ing con pro ver lich keit ung schaft ati ous able ness inter trans over under ge be ent ism al ly for man land stad heid ique ciones ac know led ments res pons ibil ity pub lish ed dis trib ut work soft ware free lic ense auth or ship fig ure sec chap ter tab le ap pen dix psalm phone play star".split()
LONG_WORDS = "acknowledgements responsibilities internationalization telecommunications misunderstanding characteristics recommendations representatives notwithstanding unconstitutional incomprehensible interoperability straightforward multidimensional environmentally administratively Geschwindigkeitsbegrenzung Rechtsschutzversicherung Wirtschaftswissenschaften Haftpflichtversicherung Verantwortungsbewusstsein Lebensmittelgeschaeft arbeidsongeschiktheidsverzekering verantwoordelijkheden wetenschappelijke gemeenteraadsverkiezingen maatschappelijk constitutionnellement professionnalisation anticonstitutionnel responsabilidades internacionalmente electrodomesticos desafortunadamente caracteristicas".split()
#: Shapes that providers give their keys (fixed values).
PREFIX = r"^(?:AKIA|ASIA|ghp_|gho_|ghs_|github_pat_|glpat-|sk_live_|sk_test_|rk_live_|sk-|xox[abp]-|AIza|ya29\.|eyJ|SG\.|npm_|pypi-)"
FEATURES = [
    "size", "digits", "uppers", "lowers", "marks", "hex_only", "to_digit", "to_letter", "case_turns", "distinct", "covered", "slashes", "dots",
    "dashes", "extension", "uuid", "dated", "prefix", "assigned", "quoted", "secret_word", "harmless_word", "path_before", "same_run", "pairs", "vowels", "cluster", "addressed", "mailbox", "word_first", "inner_marks",
]


def _features(value: Column, before: Column, after: Column) -> list[Column]:
    n = F.length(value).cast("double")
    share = lambda pattern: F.regexp_count(value, F.lit(pattern)) / n
    yes = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    near = F.lower(before)
    found = {
        "size": n,
        "digits": share("[0-9]"),
        "uppers": share("[A-Z]"),
        "lowers": share("[a-z]"),
        "marks": share("[^A-Za-z0-9]"),
        "hex_only": yes(value.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")),
        "to_digit": share("(?<=[A-Za-z])[0-9]"),
        "to_letter": share("(?<=[0-9])[A-Za-z]"),
        "case_turns": share("(?<=[a-z])[A-Z]|(?<=[A-Z])[a-z]"),
        "distinct": F.size(F.array_distinct(F.split(value, ""))) / n,
        "covered": 1 - F.length(F.regexp_replace(F.lower(value), DICTIONARY, "")) / n,
        "slashes": share("/"),
        "dots": share(r"\."),
        "dashes": share("[-_]"),
        "extension": yes(value.rlike(r"\.[a-z]{1,5}[0-9]?$")),
        "uuid": yes(value.rlike("(?i)^[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}$")),
        "dated": yes(value.rlike("(?:19|20)[0-9]{2}[-_./]?[01][0-9]")),
        "prefix": yes(value.rlike(PREFIX)),
        "assigned": yes(before.rlike(r"(?:=|:|=>)\s*[\"'`]?$")),
        "quoted": yes(before.rlike("[\"'`]$") & after.rlike("^[\"'`]")),
        "secret_word": yes(near.rlike(rf"(?:{SECRET_WORDS})[^\n]{{0,12}}$")),
        "harmless_word": yes(near.rlike(rf"(?:^|[^a-z])(?:{HARMLESS_WORDS})[^\n]{{0,12}}$")),
        "path_before": yes(before.rlike(r"[/\\@#]$")),
        "same_run": yes(value.rlike(r"(.)\1{4}")),
        "pairs": F.regexp_count(F.lower(value), F.lit(f"(?=(?:{PAIRS}))")) / n,
        "vowels": share("[aeiouyAEIOUY]"),
        "cluster": yes(value.rlike("(?i)[bcdfghjklmnpqrstvwxz]{5}")),
        "addressed": yes(before.rlike(r"://[^\s/:@]+:$") & after.startswith("@")),
        "mailbox": yes(after.startswith("@") & ~before.rlike(r"://[^\s/:@]+:$")),
        "inner_marks": share(r"[!#%*?$^~](?=.)"),
        "word_first": yes(value.rlike(rf"^(?i:{DICTIONARY})")),
    }
    return [found[name].cast("double").alias(name) for name in FEATURES]


def _text(seed: str, n: int, alphabet: str, length: Column | int) -> Column:
    """Pseudo-random text over an alphabet, from digests of id and seed."""
    digest = F.concat(*[F.sha2(F.concat(F.col("id").cast("string"), F.lit(f"{seed}{i}")), 256) for i in range(-(-n // 32))])
    letters = F.array(*map(F.lit, alphabet))
    pick = lambda i: letters[F.pmod(F.conv(F.substring(digest, i * 2 + 1, 2), 16, 10).cast("int"), F.lit(len(alphabet)))]
    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(length) - 1 if isinstance(length, int) else length - 1), pick), "")


def labelled_findings(spark: SparkSession, n: int = TRAINED, seed: str = "train") -> DataFrame:
    """before, value, after, label: known secrets and known look-alikes, half and half."""
    hexes, base64, alnum, words = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", DICTIONARY.split("|")
    number = lambda k, m: F.pmod(F.xxhash64(F.col("id"), F.lit(f"{seed}{k}")), F.lit(m)).cast("int")
    choose = lambda k, xs: F.array(*map(F.lit, xs))[number(k, len(xs))]
    text = lambda k, alphabet, length: _text(f"{seed}{k}", 64, alphabet, length)
    hex40 = text("h", hexes, 40)
    cased = F.when(number("case", 4) == 0, F.upper(hex40)).otherwise(hex40)
    secrets = F.array(
        cased, cased, F.substring(cased, 1, 32), text("h6", hexes, 64), F.concat(F.lit("AKIA"), F.upper(text("a", alnum, 16))), F.concat(F.lit("ghp_"), text("g", alnum, 36)),
        F.concat(F.lit("sk_live_"), text("s", alnum, 24)), F.concat(F.lit("xoxb-"), text("x1", "0123456789", 11), F.lit("-"), text("x2", alnum, 24)), text("b", base64, 40), F.concat(text("b2", base64, 43), F.lit("=")),
        F.concat(F.lit("AIza"), text("z", alnum + "-_", 35)), F.concat(F.lit("eyJ"), text("e", alnum, 24), F.lit("."), text("e2", alnum, 40)), text("p", alnum, 20 + number("len", 20)),
        text("q", alnum + "!#%&*?@$^", 8 + number("len", 8)), text("q2", alnum, 8 + number("len", 8)), text("q3", alnum[:52], 12 + number("len", 8)),
        text("q4", alnum[26:52], 16 + number("len", 9)), text("q5", alnum[:52], 16 + number("len", 9)), text("q6", alnum + "!#%*?$^~", 10 + number("len", 8)), F.concat(F.when(number("pwk", 2) == 0, choose("pw", words)).otherwise(text("qa", alnum[26:52], 4 + number("len", 4))), text("q7", "0123456789", 1 + number("len", 3)), text("q8", "!#%*?$^~", 1), text("q9", alnum, 3 + number("len", 3)), text("q0", "!#%*?$^~", 1)),
    )
    names = ["token", "secret", "password", "api_key", "apikey", "access_key", "client_secret", "private_key", "auth_token", "Authorization: Bearer", "passwd", "credential", "mot de passe", "Passwort", "contraseña", "wachtwoord", "clave", "Kennwort"]
    opens = [' = "', "=", ': "', ": ", " = '", '="', "=> '", " : "]
    k = number("open", len(opens))
    lead = choose("lead", ["", "the ", "\n", "export ", "set ", "in the text, ", "const my_"])
    name = choose("name", names)
    name = F.when(number("up", 4) == 0, F.upper(name)).otherwise(name)
    close = F.array(*[F.lit('"' if '"' in o else "'" if "'" in o else "") for o in opens])[k]
    tail = choose("tail", [" and", "\n", "", ";", " the", "### in", "*** of"])
    bare = number("bare", 8) == 0
    kinds = 20
    kind = number("kind", kinds)
    # Provider keys, random letters and passwords with marks are known by themselves; the last two stand free half of the time.
    has_shape = F.array(*[F.lit(i in (4, 5, 6, 7, 10, 11, 16, 17, 18, 19)) for i in range(kinds)])[kind]
    free = has_shape & (bare | (kind >= 16) & (number("free", 2) == 0))
    url = (number("url", 14) == 0) & kind.isin(13, 14, 15, 18)
    address = F.concat(lead, choose("scheme", ["postgres://", "mysql://", "https://", "ftp://", "redis://", "amqp://", "mongodb+srv://"]), choose("user", ["bob", "admin", "app_user", "root", "svc-1"]), F.lit(":"))
    positive = F.struct(
        F.when(url, address).when(free, lead).otherwise(F.concat(lead, name, F.array(*map(F.lit, opens))[k])).alias("before"),
        F.when(url, text("qu", alnum, 6 + number("len", 10))).otherwise(F.get(secrets, kind)).alias("value"),
        F.when(url, F.lit("@host.example:5432/db")).when(free, tail).otherwise(F.concat(close, tail)).alias("after"),
    )
    part = lambda i: choose(f"w{i}", words)
    shaped = lambda word: F.when(number("shape", 3) == 0, F.initcap(word)).when(number("shape", 9) == 1, F.upper(word)).otherwise(word)
    digits = lambda i, m: number(f"d{i}", m).cast("string")
    uuid = F.concat_ws("-", text("u1", hexes, 8), text("u2", hexes, 4), text("u3", hexes, 4), text("u4", hexes, 4), text("u5", hexes, 12))
    path = F.concat(F.lit("/"), F.concat_ws("/", part(1), part(2), part(3)), digits(1, 90), choose("ext", [".html", ".txt", ".py", ".png", "", ".tar.gz", ".js"]))
    others = F.array(
        F.concat(choose("sha", ["sha256: ", "SHA1 ", "checksum = ", "md5=", "commit ", "digest: ", "etag: ", "hash ", "integrity: "]), F.lit("\0"), cased),
        F.concat(choose("sha", ["sha256: ", "SHA1 ", "checksum = ", "md5=", "commit ", "revision ", "fingerprint: ", "build "]), F.lit("\0"), F.substring(hex40, 1, 32)),
        F.concat(choose("uu", ["id ", "uuid: ", "", "request=", "guid "]), F.lit("\0"), uuid),
        F.concat(choose("pa", ["see ", "open ", "file ", "", "path: "]), F.lit("\0"), path),
        F.concat(lead, F.lit("\0"), F.concat_ws("_", part(4), part(5), part(6), digits(2, 1000))),
        F.concat(lead, F.lit("\0"), F.concat(part(4), F.initcap(part(5)), F.initcap(part(6)), digits(3, 100))),
        F.concat(choose("ver", ["version ", "v ", "build ", ""]), F.lit("\0"), F.concat(part(7), F.lit("-"), digits(4, 20), F.lit("."), digits(5, 20), F.lit("."), digits(6, 20), F.lit("-release"), digits(7, 9))),
        F.concat(lead, F.lit("\0"), F.concat(digits(8, 28), F.lit("."), F.lower(text("dom", alnum[:52], 9)), F.lit(".example."), part(8), F.lit(".com"))),
        F.concat(choose("dt", ["on ", "at ", "date=", ""]), F.lit("\0"), F.concat(F.lit("20"), digits(9, 30), F.lit("-0"), digits(10, 9), F.lit("-1"), digits(11, 9), F.lit("T1"), digits(12, 9), F.lit("-00-00Z"))),
        F.concat(name, F.lit(" = \""), F.lit("\0"), F.concat(choose("ph", ["your_", "example_", "my-", "xxxxx"]), part(9), F.lit("_"), part(10), F.lit("_here"), digits(13, 10))),
        F.concat(name, F.lit("="), F.lit("\0"), F.concat(F.repeat(choose("rep", ["0", "x", "1", "a", "A"]), 20), digits(14, 100), F.lit("a"))),
        F.concat(name, F.array(*map(F.lit, opens))[k], F.lit("\0"), F.concat(part(11), choose("glue", ["", "_", "-", "."]), part(12), choose("glued", ["", "_value", "s", ".default"]))),
        F.concat(name, choose("say", [": ", " = ", "=", ": '"]), F.lit("\0"), choose("pl", ["required", "disabled", "undefined", "changeme", "<password>", "********", "${SECRET}", "os.environ", "getpass()", "something", "redacted", "{{token}}", "string(255)", "optional", "incorrect"])),
        F.concat(lead, F.lit("\0"), F.initcap(part(14)), digits(15, 3000), choose("suf", ["", "Pro", "a", "th", "!", "?", "."])),
        F.concat(lead, F.lit("\0"), F.concat_ws("-", part(15), digits(16, 30), part(16))),
        F.concat(lead, F.lit("\0"), digits(17, 4000), choose("unit", ["x1080px", "th-century", "nd-generation", "km/h-limit", "mm-lens", "h30m45s", "-year-old", "GHz-band", "kWh/100km", ",000-strong"])),
        F.concat(lead, F.lit("\0"), shaped(F.concat(*[choose(f"sy{i}", SYLLABLES) for i in range(6)]))),
        F.concat(lead, F.lit("\0"), *[choose(f"bi{i}", ["th", "in", "er", "an", "re", "on", "at", "en", "nd", "ti", "es", "or", "te", "ed", "is", "it", "al", "ar", "st", "to", "nt", "wh", "sh", "ou", "ea", "ha", "der", "und", "la", "que"]) for i in range(9)]),
        F.concat(lead, F.lit("\0"), part(17), F.lit("."), part(18), digits(18, 2000), F.lit("@mail.example")),
        F.concat(lead, choose("web", ["http:", "https:"]), F.lit("\0"), choose("www", ["//www.", "//", "//docs."]), part(19), F.lit("."), part(20), choose("tld", [".org/", ".com/", ".example/", ".net/en/"]), choose("deep", ["page-", "licenses/LICENSE-", "articles/2021/", "~user/v", "item"]), digits(19, 90), choose("end", ["", ".0", "/list.html", "/item7"])),
        F.concat(lead, F.lit("\0"), shaped(choose("long", LONG_WORDS))),
        F.concat(lead, F.lit("\0"), shaped(F.concat(*[choose(f"sz{i}", SYLLABLES) for i in range(3)])), digits(21, 400), choose("let", ["", "a", "b", "th", "Pro", "-B7", "v2"])),
        F.concat(lead, F.lit("\0"), part(21), part(22), part(23), choose("plural", ["", "s", "ing"])),
        F.concat(choose("ord", ["order ", "invoice ", "ref ", "isbn ", "doi "]), F.lit("\0"), F.concat(F.upper(text("or", alnum[:52], 3)), F.lit("-"), text("on", "0123456789", 12))),
    )
    pieces = F.split(F.get(others, number("other", 24)), "\0")
    negative = F.struct(F.get(pieces, F.lit(0)).alias("before"), F.get(pieces, F.lit(1)).alias("value"), F.concat(F.when(F.get(pieces, F.lit(0)).endswith('"'), F.lit('"')).otherwise(F.lit("")), tail).alias("after"))
    label = (F.col("id") % 2).cast("double")
    rows = spark.range(n).select("id", label.alias("label"), F.when(label == 1, positive).otherwise(negative).alias("r"))
    made = materialize(rows.select("id", "label", F.length("r.before").alias("at"), F.concat("r.before", "r.value", "r.after").alias("text")), "made")
    # The rows are candidates as texts give them, those at the generated value.
    found = candidates(made.select(F.col("id").alias("doc_id"), "text"))
    return found.join(F.broadcast(made.select(F.col("id").alias("doc_id"), F.col("at").alias("start"), "label")), ["doc_id", "start"]).select("before", "value", "after", "label")


_ASSEMBLER = {"inputCols": FEATURES, "outputCol": "features", "handleInvalid": "keep"}


def _with_features(rows: DataFrame) -> DataFrame:
    return VectorAssembler(**_ASSEMBLER).transform(rows.select("*", *_features(F.col("value"), F.col("before"), F.col("after")))).drop(*FEATURES)


def train(findings: DataFrame, trees: int = 24, depth: int = 8) -> RandomForestClassificationModel:
    """A forest from findings(before, value, after, label)."""
    features = materialize(findings.select("label", *_features(F.col("value"), F.col("before"), F.col("after"))), "findings")
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=11, subsamplingRate=0.8).fit(VectorAssembler(**_ASSEMBLER).transform(features))


def score(rows: DataFrame, model: RandomForestClassificationModel) -> DataFrame:
    """rows(before, value, after, ...) with the probability of a secret."""
    return model.transform(_with_features(rows)).withColumn("score", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, start, end, before, value, after for each candidate in docs(doc_id, text); trailing dots and dashes are not part of it."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    runs = F.when(F.col("text").rlike(CANDIDATE), _matches(F.col("text"), CANDIDATE)).otherwise(none)
    runs = F.transform(runs, lambda m: F.struct(m["start"].alias("start"), F.regexp_replace(m["value"], "[.-]+$", "").alias("value")))
    runs = F.filter(runs, lambda m: F.length(m["value"]) >= SHORTEST)

    def named(m: Column) -> Column:
        value = F.regexp_extract(m["value"], ASSIGNED, 1)
        return F.struct((m["end"] - F.length(value)).alias("start"), F.regexp_replace(value, "[.,;)\\]]+$", "").alias("value"))

    values = F.when(F.col("text").rlike(ASSIGNED), F.transform(_matches(F.col("text"), ASSIGNED), named)).otherwise(F.array().cast("array<struct<start:int,value:string>>"))

    def password(m: Column) -> Column:
        value = F.regexp_extract(m["value"], ADDRESSED, 1)
        return F.struct((m["end"] - 1 - F.length(value)).alias("start"), value.alias("value"))

    nothing = F.array().cast("array<struct<start:int,value:string>>")
    passwords = F.when(F.contains("text", F.lit("://")), F.transform(_matches(F.col("text"), ADDRESSED), password)).otherwise(nothing)
    apart = lambda side: lambda v: ~F.exists(side, lambda r: (r["start"] < v["start"] + F.length(v["value"])) & (v["start"] < r["start"] + F.length(r["value"])))
    # Passwords of addresses go first, then runs, then assigned values that hold none of them.
    both = docs.select("doc_id", "text", runs.alias("runs"), F.filter(values, lambda v: F.length(v["value"]) >= SHORT).alias("values"), passwords.alias("passwords"))
    both = both.where("size(runs) + size(values) + size(passwords) > 0").withColumn("runs", F.concat("passwords", F.filter("runs", apart("passwords"))))
    cut = both.select("doc_id", "text", F.explode(F.concat("runs", F.filter("values", apart("runs")))).alias("m")).select("doc_id", "text", F.col("m.start").alias("start"), F.col("m.value").alias("value"))
    end = F.col("start") + F.length("value")
    before = F.substring("text", F.greatest(F.col("start") - BEFORE, F.lit(0)) + 1, F.least(F.col("start"), F.lit(BEFORE)))
    return cut.select("doc_id", "start", end.alias("end"), before.alias("before"), "value", F.substring("text", end + 1, F.lit(AFTER)).alias("after"))


def find_secrets(docs: DataFrame, model: RandomForestClassificationModel, threshold: float = 0.5) -> DataFrame:
    """doc_id, start, end, value_sha256, score for each accepted finding; secrets leave only as digests."""
    scored = score(candidates(docs), model).where(F.col("score") >= threshold)
    return scored.select("doc_id", "start", "end", F.sha2("value", 256).alias("value_sha256"), F.round("score", 6).alias("score"))
