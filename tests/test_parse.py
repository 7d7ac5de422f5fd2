from pyspark.sql import functions as F

from siftwork.functions import parse
from siftwork.functions.text import canonical_url, date_only, decoded, file_stem, html_to_text, scrubbed, text_hash, title_similarity
from siftwork.operators import scoring


def one(spark, make, **columns):
    df = spark.createDataFrame([tuple(columns.values())], ", ".join(f"{k} string" for k in columns))
    return df.select(make(*[F.col(c) for c in columns]).alias("x")).first().x


DUTCH = """Curriculum Vitae
Jana de Bruin
Woonplaats: Utrecht
jana.debruin@mail.example | 06-12345678
Werkervaring
mrt 2019 - heden Recruiter
2015 - 2019 Adviseur
Opleiding
2011 - 2015 HBO Bachelor
Talen: Nederlands (moedertaal), Engels, Duits goed
Ik werk met de klant en het team van Python, SQL en machine learning."""


def test_parsed(spark):
    df = spark.createDataFrame([("a", DUTCH, "jana-cv.pdf")], "id string, text string, file_name string")
    r = parse.parsed(df, as_of="2026-10-01").first()
    assert (r["name"], r.email, r.phone, r.location, r.cv_language, r.education, r.kind) == ("Jana de Bruin", "jana.debruin@mail.example", "06-12345678", "Utrecht", "Dutch", "Bachelor", "cv")
    assert r.languages == ["Dutch", "English", "German"]
    assert set(r.skills) >= {"python", "sql", "machine learning"}
    assert 11 <= r.years < 12


def test_years(spark):
    years = lambda text: one(spark, lambda t: parse.years(t, F.lit("2026-01-01").cast("date")), text=text)
    assert years("Werkervaring\n2010 - 2015 A\n2012 - 2014 B\n2016 - 2018 C") == 7
    assert years("Over 12 years of work, 8 years experience") == 8
    assert years("Education\n2000 - 2004 school\nWork experience\n01/2020 - 01/2022 x") == 2
    assert years("January 2024 – Present") == 2
    assert years("2015 - 2010") == 0
    assert years("") == 0


def test_names_places_skills(spark):
    assert one(spark, parse.name, t="JOHN PETERSEN\nEngineer") == "John Petersen"
    assert one(spark, parse.name, t="Name: Ada B. Cole\nx") == "Ada B. Cole"
    assert one(spark, parse.name, t="cv\nmail: mary.jones2@x.example") == "Mary Jones"
    assert one(spark, parse.location, t="live in Gent near Amsterdam") == "Gent"
    assert one(spark, parse.location, t="Postbus 3511 AB") == "Utrecht (regio)"
    assert one(spark, parse.location, t="Address: Main street 4, Springfield") == "Springfield"
    assert one(spark, lambda t: parse.skills(t, ["Lego"]), t="lego, Node.js, C# and C++, JavaScript, deep learning") == ["lego", "deep learning", "node.js", "c#", "c++", "javascript"]
    assert one(spark, parse.kind, t="Dear hiring manager,\n" + "long text " * 20 + "\nKind regards", f="x.pdf") == "letter"
    assert one(spark, parse.kind, t="Experience\nEducation\n2010 - 2012", f="my_cv.pdf") == "cv"


def test_texts(spark):
    assert one(spark, html_to_text, h="<p>a&amp;b</p><ul><li>x</li><li>y&#233;</li></ul><script>no</script>") == "a&b\n• x\n• yé"
    assert one(spark, html_to_text, h="&lt;p&gt;a &amp;amp; b&lt;/p&gt;") == "a & b"
    assert one(spark, decoded, t="&#x20AC;&nbsp;&unknown;&euro;") == "€ &unknown;€"
    assert one(spark, canonical_url, u="https://A.example/Job/?utm_source=x&jk=5&ref=y#top") == "https://a.example/job?jk=5"
    assert one(spark, canonical_url, u="https://a.example") == "https://a.example"
    assert one(spark, date_only, d="Mon, 05 Oct 2026 10:00:00 GMT") == "2026-10-05"
    assert one(spark, date_only, d="1790000000000") == "2026-09-21"
    assert one(spark, date_only, d="soon") == ""
    assert one(spark, file_stem, n="jan-jansen-cv.pdf") == one(spark, file_stem, n="Jan_Jansen_motivation.docx") == "jan jansen"
    assert one(spark, scrubbed, t="mail a@b.example or +31 6 12345678, see https://x.example/y") == "mail <email> or <num>, see <url>"
    assert one(spark, text_hash, t="A b\nC") == one(spark, text_hash, t="abc") != one(spark, text_hash, t="abd")
    assert one(spark, text_hash, t="") == "811C9DC50".lower()
    assert one(spark, title_similarity, a="Marketing Communications Specialist", b="Specialist marketing & communication (m/v)") == 1.0


def test_scores(spark):
    stock = "I am excited to leverage my proven track record. I am a results-driven, passionate about delivering robust, seamless and innovative solutions. [Company Name] is a dynamic, fast-paced place. Moreover, I thrive in pivotal roles."
    plain = "I fixed bikes in my shop for years. Then I sold it. Now I teach. My pupils build frames and ride them to school."
    score = lambda text, kind: one(spark, lambda t, k: scoring.generated_score(t, F.lit(""), k, F.lit(""), F.lit(0.0)), t=text, k=kind)
    assert score(stock, "letter").score >= 55 and score(stock, "letter").level == "high"
    assert any("template" in r for r in score(stock, "cv").reasons)
    assert score(plain, "letter").score < 25
    row = spark.createDataFrame([("we need someone who plans complex migrations of large databases every quarter and reports weekly", "We need someone who plans complex migrations of large databases every quarter and reports weekly to us", "cv", "ats_optimized.pdf")], "text string, target_text string, kind string, file_name string")
    r = row.select(scoring.sent_by_tool_score(row).alias("r")).first().r
    assert r.score >= 40 and "Copies" in r.reasons[0]
    letter = spark.createDataFrame([("I apply for the Sales Manager position", "A nurse is wanted", "letter", "")], "text string, target_text string, kind string, tag string")
    assert letter.select(scoring.wrong_addressee(F.col("text"), F.col("target_text"), F.col("tag")).alias("x")).first().x == "Sales Manager"
