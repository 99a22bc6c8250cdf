import math

import duckdb
from pyspark.sql import functions as F

from voxmill.functions import fingerprint, language, stats, text
from voxmill.sources import views


def _one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_redaction_keeps_dates_and_versions(spark):
    said = "Write to a.b@c.example.org or see https://x.example/y ring +49 (30) 1234-56789; 2024-01-02, v1.2.3 stay, a@b.example."
    assert _one(spark, text.redact(F.lit(said))) == "Write to [email] or see [url] ring [phone]; 2024-01-02, v1.2.3 stay, [email]."


def test_compose_drops_parts_without_words(spark):
    assert _one(spark, text.compose(F.lit("!!!"), F.lit("  good\n app "))) == "good app"
    assert _one(spark, text.compose(F.lit(None).cast("string"), F.lit("🙂"))) == ""


def test_word_runs_of_short_texts_are_none(spark):
    assert _one(spark, text.word_ngrams(F.lit("a b"), 3)) == []
    assert _one(spark, text.word_ngrams(F.lit("A b c a b c"), 3)) == ["a b c", "b c a", "c a b"]


def test_topic_names(spark):
    assert _one(spark, text.clean_topic_name(F.lit('Topic: "Slow app start"\nmore'))) == "Slow app start"
    assert _one(spark, text.clean_topic_name(F.lit("One"))) is None
    assert _one(spark, text.clean_topic_name(F.lit("\n  'crashes on (old) phones!'"))) == "Crashes on (old) phones"
    assert _one(spark, text.clean_topic_name(F.lit("плохой app"))) is None


def test_stems(spark):
    words = {"buildings": "build", "build": "build", "game": "game", "games": "game", "changing": "chang", "change": "chang", "stories": "story", "need": "need", "class": "class", "ads": "ad", "learned": "learn"}
    assert {w: _one(spark, text.stem(F.lit(w))) for w in words} == words


def test_redaction_marks_places_not_digits(spark):
    assert _one(spark, text.redact(F.lit("0123456789 and x0123456789y"))) == "[phone] and x0123456789y"


def test_detector_tells_languages_apart(spark):
    said = {"en": "the weather is nice and we are going to the beach with our friends", "de": "das wetter ist schön und wir gehen mit unseren freunden an den strand", "es": "el tiempo es bueno y vamos a la playa con nuestros amigos"}
    rows = [(" ".join(t.split()[k:] + t.split()[:k]), lang) for lang, t in said.items() for k in range(6)]
    detector = language.NgramDetector.fit(spark.createDataFrame(rows, "text string, lang string"))
    new = [("the friends are nice and the beach is near", "en"), ("unser freund ist mit dem wetter zufrieden", "de"), ("nuestra playa es buena para los amigos", "es")]
    out = spark.createDataFrame(new, "text string, lang string").withColumn("d", language.detected(detector)(F.col("text"))).collect()
    assert [r.d.candidate for r in out] == [r.lang for r in out] and all(0 < r.d.confidence <= 1 for r in out)


def test_binomial_tail(spark):
    x = _one(spark, stats.ln_binomial_tail(F.lit(31), F.lit(41), F.lit(0.1)))
    assert math.isclose(math.exp(x), 4.04898520661e-23, rel_tol=1e-9)
    assert _one(spark, stats.ln_binomial_tail(F.lit(0), F.lit(5), F.lit(0.1))) == 0
    assert _one(spark, stats.ln_binomial_tail(F.lit(6), F.lit(5), F.lit(0.1))) is None


def test_split_position(spark):
    assert math.isclose(_one(spark, fingerprint.split_position(F.lit("a"))), 0.7913742705223816)


def test_language_ladder(spark):
    def told(words, candidate, confidence, hint, default):
        c = language.resolve(F.lit(words), F.lit(candidate), F.lit(confidence), F.lit(hint), F.lit(default))
        return tuple(_one(spark, c))

    long = "x" * 30
    assert told(long, "en", 0.95, "de", None) == ("en", "detected")
    assert told(long, "en", 0.6, "en", None) == ("en", "detected")
    assert told(long, "en", 0.6, "de", None) == ("de", "store_hint")
    assert told("short", "en", 0.99, None, "pt") == ("pt", "market_default")
    assert told("short", "en", 0.99, None, None) == (None, "unknown")


def test_upper_case_keeps_the_number_of_signs(spark):
    texts = ["Straße, ß\nmaß", "ŉ ǰ ΐ ﬁ", "éß𐐨ı", "", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(text.upper_signs(F.col("t"))).collect()
    c = duckdb.connect()
    assert [r[0] for r in rows] == [c.execute("select upper(?)", [t]).fetchone()[0] for t in texts]
    assert rows[0][0] == "STRAẞE, ẞ\nMAẞ"


def test_translations_of_the_view_are_in_capitals_as_in_sql(spark, monkeypatch):
    read = views.table
    monkeypatch.setattr(views, "table", lambda *at: read(*at).withColumn("text", F.lit("Maß")) if at[2] == "documents" else read(*at))
    assert {r[0] for r in views.star(spark, "/root/testdata/sf0.001")["translated"].select("translated_text").collect()} == {"MAẞ"}


def test_embedder_gets_a_bounded_number_of_texts(spark):
    class Counting(language.HashingEmbedder):
        def embed(self, texts, prefix=language.HashingEmbedder.DOCUMENT):
            return [[float(len(texts))] * 2 for _ in texts]

    rows = language.embedded(spark.range(1000, numPartitions=1).select(F.lit("Some words").alias("text")), Counting())
    assert rows.agg(F.max(F.get("embedding", 0))).first()[0] <= 256
    assert rows.count() == 1000
