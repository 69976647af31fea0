from pyspark.sql import functions as F

from biblioflow.functions import text as X


def value(spark, make, given):
    return spark.createDataFrame([(given,)], "x string").select(make(F.col("x"))).first()[0]


def test_normalizers(spark):
    assert value(spark, X.normalize_doi, "https://doi.org/10.1038/NATURE.12345") == "10.1038/nature.12345"
    assert value(spark, X.normalize_doi, "doi:10.1000/a(1).,;") == "10.1000/a(1"
    assert value(spark, X.normalize_doi, "  ") is None and value(spark, X.normalize_doi, None) is None
    assert value(spark, X.normalize_title, "An ASAP Study: In Press!") == "an study"
    assert value(spark, X.normalize_title, None) == ""
    assert value(spark, X.normalize_url, "HTTPS://Nature.com/article?utm_source=a&x=1&utm_medium=b&fbclid=abc") == "https://nature.com/article?x=1"
    assert value(spark, X.normalize_url, "https://doi.org/10.1/x") == "https://doi.org/10.1/x"
    assert value(spark, X.normalize_url, "no host/") == "no host"
    assert value(spark, X.norm_text, "MnO₂ zinc-air li_ion") == "mno₂ zinc air li ion"


def test_cleaners(spark):
    assert value(spark, X.clean_title, "[ASAP] A title ") == "A title"
    assert value(spark, X.clean_abstract, "&lt;b&gt;Bold&lt;/b&gt; &#233;&eacute; DOI: 10.1/x\n y") == "Bold éé y"
    assert value(spark, X.clean_abstract, "<p> </p>") is None
    assert value(spark, X.unescape, "a & b &unknown; &amp;lt;") == "a & b &unknown; &lt;"


def test_dates(spark):
    assert value(spark, X.date_text, "2024/5/1") == "2024-05-01"
    assert value(spark, X.date_text, "2024-05-01T10:00") == "2024-05"
    assert value(spark, X.date_text, "in 1999") == "1999"
    assert value(spark, X.date_text, "no year") is None


def test_sources(spark):
    assert value(spark, X.source_from_url, "https://www.nature.com/x") == "Nature"
    assert value(spark, X.source_from_url, "https://www.plain.example/x") == "Plain"
    assert value(spark, X.sender_email, "Alerts <News@Mail.example>") == "news@mail.example"
    assert value(spark, lambda c: X.source_from_sender(c, {"a@b.example": "Mapped"}, ["toc-alerts@x.example"]), "toc-alerts@x.example") == "Toc Alerts"


def test_identity_keys(spark):
    df = spark.createDataFrame([("10.1234/A", "https://x.example/a/", "T"), (None, None, "T"), ("", "", "")], "doi string, url string, title string")
    rows = [[(k.kind, k.value) for k in r[0]] for r in df.select(X.identity_keys(F.col("doi"), F.col("url"), F.col("title"))).collect()]
    assert rows == [[("doi", "10.1234/a"), ("url", "https://x.example/a")], [("title", "t")], []]


def test_entities_as_the_standard_library_resolves_them(spark):
    import html
    import random

    rng = random.Random(11)
    names = ["amp", "lt;", "copy", "copy;", "notit;", "notin;", "Eacute", "frac12", "hellip;", "nosuch;", "ampx", "#150;", "#82", "#xE9;", "#55296;", "#0;", "#1;", "#1114112;", "#x110000", "#99999999999999999999;", "#;", "#x;", "#128", "#65534;", "#13;", "CounterClockwiseContourIntegral;", ";", ""]
    texts = [" ".join(rng.choice(["a", "&" + rng.choice(names), "&&", "x<y", "é&" + rng.choice(names) + "z"]) for _ in range(8)) for _ in range(300)] + ["&" + n for n in names] + [None, "", "plain"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", X.unescape(F.col("t")).alias("u")).collect()
    wrong = [(r.t, r.u, html.unescape(r.t)) for r in rows if r.t is not None and r.u != html.unescape(r.t)]
    assert not wrong, wrong[:3]
