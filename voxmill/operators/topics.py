"""Topics: candidates, clusters, statistics, keywords and labels."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import StopWordsRemover
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxmill.functions.text import enough_words, keyword_label, stem
from voxmill.operators.search import cosine
from voxmill.sources.shared import settled

# Words of app reviews that say nothing about their subject, and romanised Hindi function words.
GENERIC = """amazing app application apps awesome bad best better didn doesn don excellent good great isn just like ll lot love make makes
nice really super thank thanks thing things use used using ve want way far going got hi know let ok okay think wow yes aap acha achcha
accha aur bahut bhi bohot hai hain ho hota hoti ka kar ke ki ko kuch kuchh liye maine mein mera mujhe na nahi nahin raha rahe rahi sab
sakte se sikh sikhane sikhne yah yeh""".split()
TOPICS, LEAST_WORDS, KEYWORDS, SUPPORT, LEAST_REVIEWS = 20, 4, 6, 2, 50


def candidates(texts: DataFrame, max_rating: int = 3, least_words: int = LEAST_WORDS) -> DataFrame:
    """Rows with rating, model_text and an optional translation whose English text has enough words."""
    blank = F.coalesce(F.length(F.trim("translation")), F.lit(0)) == 0
    english = F.when(~blank, F.col("translation")).when(F.col("language") == "en", F.col("model_text"))
    shown = F.coalesce(english, F.col("model_text"))
    return texts.where(F.col("rating") <= max_rating).withColumn("english", english).where(enough_words(shown, least_words))


def _unit(v: Column) -> Column:
    length = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: F.when(length > 0, x / length).otherwise(0.0))


def kmeans_topics(vectors: DataFrame, k: int = TOPICS, seed: int = 0, restarts: int = 2, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """id, topic and cosine distance to the topic's centre, by Spark's k-means on unit vectors; the cheapest of some starts."""
    unit = vectors.where(f"{vector_column} is not null").select(F.col(id_column).alias("id"), _unit(F.col(vector_column)).alias("u")).withColumn("features", array_to_vector("u")).persist()
    count = unit.count()
    if not count:
        unit.unpersist()
        return unit.select("id", F.lit(None).cast("int").alias("topic"), F.lit(None).cast("double").alias("distance"))
    if min(k, count) == 1:
        mean = unit.select(F.posexplode("u").alias("place", "x")).groupBy("place").agg(F.avg("x").alias("x")).agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "x"))), lambda p: p.x).alias("centre"))
        placed = unit.crossJoin(F.broadcast(mean)).withColumn("topic", F.lit(0))
    else:
        fits = [KMeans(k=min(k, count), seed=seed + i, maxIter=30).fit(unit) for i in range(restarts)]
        best = min(fits, key=lambda m: m.summary.trainingCost)
        centres = unit.sparkSession.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(best.clusterCenters())], "topic int, centre array<double>")
        placed = best.transform(unit).withColumnRenamed("prediction", "topic").join(F.broadcast(centres), "topic")  # k rows
    distance = F.least(F.greatest(1 - F.coalesce(cosine(F.col("u"), F.col("centre")), F.lit(0.0)), F.lit(0.0)), F.lit(2.0))
    return placed.select("id", "topic", distance.alias("distance"))


def topic_stats(members: DataFrame, topic: str = "topic") -> DataFrame:
    """size, average_rating and negative_share of each topic."""
    return members.groupBy(topic).agg(F.count("*").alias("size"), F.avg("rating").alias("average_rating"), (F.count_if(F.col("rating") <= 2) / F.count("*")).alias("negative_share"))


def topic_languages(members: DataFrame, topic: str = "topic") -> DataFrame:
    """Reviews of each topic and language, most frequent first; null is unknown."""
    return members.groupBy(topic, F.coalesce("language", F.lit("unknown")).alias("language")).agg(F.count("*").alias("reviews")).orderBy(topic, F.desc("reviews"), "language")


def closest(members: DataFrame, n: int, topic: str = "topic") -> DataFrame:
    place = F.row_number().over(Window.partitionBy(topic).orderBy("distance", "id"))
    return members.withColumn("place", place).where(F.col("place") <= n)


def terms(text: Column, stop_words: list[str]) -> Column:
    """Distinct words (two Latin letters or more, no stop words) and pairs of neighbours among them."""
    words = F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"(?<![\p{L}\p{N}_])([a-z][a-z]+)(?![\p{L}\p{N}_])"), F.lit(1)), lambda w: ~w.isin(stop_words))
    # zip_with pads with null, which concat keeps
    both = lambda w: F.array_distinct(F.concat(w, F.filter(F.zip_with(w, F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b)), lambda x: x.isNotNull())))
    return F.get(F.transform(F.array(words), both), 0)


def app_stop_words(name: str, slug: str) -> list[str]:
    """An app's own name says nothing about what its reviews are about."""
    return sorted({w.lower() for w in name.split()} | {slug.lower()})


def stop_words(extra: list[str] | None = None) -> list[str]:
    return sorted({*StopWordsRemover.loadDefaultStopWords("english"), *GENERIC, *(w.lower() for w in extra or [])})


def term_scores(members: DataFrame, stop: list[str] | None = None, topic: str = "topic", text: str = "text", support: int = SUPPORT) -> DataFrame:
    """c-TF-IDF: topic, term, n and score.  tf is of a topic's counts; idf is ln(1 + mean topic total / term total), where
    the mean is over all topics, those without a term too."""
    stop = stop_words() if stop is None else stop
    held = members.select(F.col(topic).alias("topic"), F.explode(terms(F.col(text), stop)).alias("term"))
    # Most terms are rare: where they are sorted, a number tells them apart, and they are counted once for all that follows.
    counts = held.withColumn("code", F.xxhash64("term")).groupBy("code", "topic", "term").agg(F.count("*").alias("n")).where(F.col("n") >= support)
    counts = settled(counts)
    by_topic = counts.groupBy("topic").agg(F.sum("n").alias("topic_total"))
    by_term = counts.groupBy("code", "term").agg(F.sum("n").alias("term_total"))
    many = members.agg(F.count_distinct(F.coalesce(F.col(topic).cast("string"), F.lit(""))).alias("topics"))
    mean = by_topic.agg(F.sum("topic_total").alias("total")).crossJoin(many).select((F.col("total") / F.col("topics")).alias("mean_total"))  # one row
    joined = counts.join(by_topic, "topic").join(by_term, ["code", "term"]).crossJoin(F.broadcast(mean))
    score = F.col("n") / F.col("topic_total") * F.log(1 + F.col("mean_total") / F.col("term_total"))
    return joined.select("topic", "term", "n", score.alias("score"))


def diverse_keywords(scores: DataFrame, keep: int = KEYWORDS) -> DataFrame:
    """topic and its keywords: terms in falling score (equal ones in reverse order) whose stems are all new.

    One round for each keyword: the best term that shares no stem with those chosen, by a partial aggregate.  What comes to
    the driver is a term a topic and round.
    """
    stems = F.transform(F.split("term", " "), stem)
    left = scores.where("score > 0").withColumn("stems", stems).where(F.size(F.array_distinct("stems")) == F.size("stems")).persist()
    chosen: dict = {}
    for _ in range(keep):
        now = left
        if chosen:
            rows = [(t, sorted({s for _, of in c for s in of}), len(c)) for t, c in chosen.items()]
            covered = scores.sparkSession.createDataFrame(rows, f"topic {scores.schema['topic'].dataType.simpleString()}, covered array<string>, many int")
            now = left.join(F.broadcast(covered), "topic", "left").where("covered is null or not arrays_overlap(stems, covered)")
        best = now.groupBy("topic").agg(F.max_by(F.struct("term", "stems"), F.struct("score", "term")).alias("b")).select("topic", "b.*").collect()
        for r in best:
            chosen.setdefault(r.topic, []).append((r.term, r.stems))
        if not best:
            break
    left.unpersist()
    rows = [(t, [term for term, _ in c]) for t, c in chosen.items()]
    return scores.sparkSession.createDataFrame(rows, f"topic {scores.schema['topic'].dataType.simpleString()}, keywords array<string>")


def resolved_labels(topics: DataFrame) -> DataFrame:
    """topic, keywords and a model's name (or null) to a label: a repeated name gets the first keyword it does not hold."""
    named = topics.withColumn("label", F.coalesce("name", keyword_label(F.col("keywords"))))
    repeats = F.count("*").over(Window.partitionBy(F.lower("label")))
    extra = F.get(F.filter("keywords", lambda k: ~F.contains(F.lower("label"), F.lower(k))), 0)
    more = (repeats > 1) & F.col("name").isNotNull() & extra.isNotNull()
    return named.withColumn("label", F.when(more, F.concat("label", F.lit(" ("), extra, F.lit(")"))).otherwise(F.col("label")))


def relabelled(runs: DataFrame, topics: DataFrame, labels: DataFrame) -> DataFrame:
    """topics with new labels and keywords where there are any; membership is not touched."""
    new = labels.join(runs.select("run_id"), "run_id", "left_semi").select("run_id", "topic", F.col("label").alias("_label"), F.col("keywords").alias("_keywords"))
    out = topics.join(new, ["run_id", "topic"], "left")
    return out.select(*(F.coalesce(f"_{c}", c).alias(c) if c in ("label", "keywords") else F.col(c) for c in topics.columns))


def relabel(runs: DataFrame, topics: DataFrame, member_texts: DataFrame, app: str, target: str = "en", name: str = "", names: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(topics, runs) of an app's latest run with keywords and labels anew; membership is not touched.

    member_texts: run_id, topic, text, language, translation.  Names (topic, name) are a model's, where there is one; how
    many topics had none is noted in the run's parameters.
    """
    latest = runs.where(F.col("slug") == app).orderBy(F.desc("created_at"), F.desc("run_id")).limit(1).select("run_id")
    known = member_texts.join(F.broadcast(latest), "run_id", "left_semi")
    blank = F.coalesce(F.length(F.trim("translation")), F.lit(0)) == 0
    english = F.when(~blank, F.col("translation")).when(F.col("language") == target, F.col("text"))
    words_ = diverse_keywords(term_scores(known.select("topic", english.alias("text")).where("text is not null"), stop_words(app_stop_words(name, app))))
    own = topics.join(F.broadcast(latest), "run_id", "left_semi").select("run_id", "topic").join(words_, "topic", "left")
    own = own.withColumn("keywords", F.coalesce("keywords", F.array().cast("array<string>")))
    own = own.join(names, "topic", "left") if names is not None else own.withColumn("name", F.lit(None).cast("string"))
    labels = resolved_labels(own)
    fallbacks = own.agg(F.count_if(F.col("name").isNull()).alias("fallbacks")) if names is not None else own.limit(1).select(F.lit(0).alias("fallbacks"))
    noted = F.map_concat("parameters", F.create_map(F.lit("naming"), F.concat(F.lit("fallbacks="), F.col("fallbacks").cast("string"))))
    one = latest.crossJoin(F.broadcast(fallbacks))
    run_rows = runs.join(F.broadcast(one), "run_id", "left").withColumn("parameters", F.when(F.col("fallbacks").isNotNull(), noted).otherwise(F.col("parameters"))).drop("fallbacks")
    return relabelled(latest, topics, labels), run_rows
