"""Text analytics: lexicon sentiment, topics, TF-IDF search, and a linear text classifier."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.clustering import LDA
from pyspark.ml.feature import IDF, CountVectorizer, CountVectorizerModel, RegexTokenizer, StopWordsRemover
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import map_lookup, once, rate, risk_tier, words
from ..sources.io import Temporary, removed_path, shuffles_removed, stored, stored_path

#: Fixed values of the scoring rule: damping of a negated word, reach of a negation, marks' weight and bound, norm, label limit.
NEGATED, REACH, MARK, MARKS, NORM, LABEL = -0.75, 3, 0.1, 0.3, 15.0, 0.2


def lexicon_sentiment(df: DataFrame, text: str, lexicon: Mapping[str, float], negators: Sequence[str] = (), modifiers: Mapping[str, float] | None = None) -> DataFrame:
    """Add compound (-1 to 1), positive, negative and neutral shares, label and confidence.

    A word's score counts by -0.75 if one of the three words before it negates, and by the modifier just before it.
    Exclamation marks strengthen the sum in its direction. A blank text is neutral, with confidence 0.
    """
    w = F.col("_words")
    lookup = once(df, "_words", words(F.coalesce(F.col(text), F.lit(""))))

    def scored(word: Column, i: Column) -> Column:
        before = F.slice(w, F.greatest(i - REACH + 1, F.lit(1)), F.least(i, F.lit(REACH)))
        negated = F.exists(before, lambda x: x.isin(*negators)) if negators else F.lit(False)
        score = map_lookup(lexicon, word)
        around = score * F.when(negated, NEGATED).otherwise(1.0)
        # what stands before a word is looked at only if the word has a score
        return F.when(score == 0, 0.0).otherwise(around * map_lookup(modifiers, F.get(w, i - 1), 1.0) if modifiers else around)

    scores = once(lookup, "_s", F.transform(w, scored))
    total = F.aggregate("_s", F.lit(0.0), lambda a, x: a + x)
    marks = F.least(MARK * F.regexp_count(text, F.lit("!")), F.lit(MARKS))
    lifted = F.when(F.col("_sum") > 0, F.col("_sum") + marks).otherwise(F.col("_sum") - marks)
    out = once(once(scores, "_sum", total), "_total", F.when((F.size("_s") == 0) | (F.trim(text) == ""), 0.0).otherwise(lifted))
    part = lambda keep: F.when(F.size("_s") == 0, 0.0).otherwise(F.size(F.filter("_s", keep)) / F.size("_s"))
    out = once(out, "compound", F.bround(F.col("_total") / F.sqrt(F.col("_total") * F.col("_total") + NORM), 4))
    out = out.withColumns({"positive": F.bround(part(lambda x: x > 0), 4), "negative": F.bround(part(lambda x: x < 0), 4), "neutral": F.bround(part(lambda x: x == 0), 4)})
    label = F.when(F.col("compound") >= LABEL, "positive").when(F.col("compound") <= -LABEL, "negative").otherwise("neutral")
    return out.withColumns({"label": label, "confidence": F.abs("compound")}).drop("_words", "_s", "_sum", "_total")


def sentiment_by(scored: DataFrame, group: str) -> DataFrame:
    """Mean, median, deviation and label shares of each group, the best first."""
    by = scored.groupBy(group).agg(F.avg("compound").alias("mean"), F.median("compound").alias("median"), F.stddev_samp("compound").alias("std"),
                                   *[rate(F.col("label") == x).alias(f"pct_{x}") for x in ("positive", "negative", "neutral")], F.count("*").alias("n"))
    rounded = ("mean", "median", "std", "pct_positive", "pct_negative", "pct_neutral")
    return by.withColumns({c: F.round(c, 4) for c in rounded}).orderBy(F.desc("mean"), group)


def flagged(scored: DataFrame, limit: float = -0.3) -> DataFrame:
    """Rows at or below a score, the worst first. They are stored before, since a sort reads its rows twice."""
    return stored(scored.where(F.col("compound") <= limit), "flagged").orderBy("compound")


def topic_words(df: DataFrame, text: str, stop_words: Sequence[str]) -> DataFrame:
    """Add ``clean``: the letters a to z in lower case, without stop words and words of up to two letters; '' for texts under five characters."""
    letters = F.split(F.trim(F.regexp_replace(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^a-z\s]", " ")), r"\s+")
    kept = F.filter(letters, lambda x: (F.length(x) > 2) & ~x.isin(*stop_words))
    return df.withColumn("clean", F.when(F.length(text) >= 5, F.array_join(kept, " ")).otherwise(F.lit("")))


def fit_topics(docs: DataFrame, column: str = "clean", k: int = 6, seed: int = 42, least_docs: int = 3, most_share: float = 0.8, terms: int = 500, rounds: int = 20) -> PipelineModel:
    """Online LDA over word counts, each round over all texts; an error for fewer than 2k texts that aren't empty."""
    filled = docs.where(F.length(column) > 0)
    if filled.limit(2 * k).count() < 2 * k:
        raise ValueError(f"topics need at least {2 * k} texts that aren't empty")
    tokenizer = RegexTokenizer(inputCol=column, outputCol="_tokens", pattern=" ")
    with Temporary() as temporary:
        tokens = temporary.stored(tokenizer.transform(filled.select(column)).select("_tokens"), "topic-tokens")
        counter = CountVectorizerModel.from_vocabulary(common_terms(tokens, "_tokens", least_docs, most_share, terms), "_tokens", "_counts")
        # each round reads all of them: they are numbers of few terms by now
        counts = temporary.stored(counter.transform(tokens).select("_counts"), "topic-counts")
        lda = LDA(k=k, optimizer="online", maxIter=rounds, subsamplingRate=1.0, seed=seed, featuresCol="_counts", topicDistributionCol="_topics").fit(counts)
    return PipelineModel([tokenizer, counter, lda])


def common_terms(df: DataFrame, tokens: str, least_docs: int, most_share: float, n: int) -> list[str]:
    """The n most frequent terms, by name where they are equally frequent, of those in at least so many texts and at most in that share of them."""
    most = most_share * df.count()
    each = df.select(F.explode(F.concat(F.transform(tokens, lambda x: F.struct(x.alias("term"), F.lit(0).alias("doc"))), F.transform(F.array_distinct(tokens), lambda x: F.struct(x.alias("term"), F.lit(1).alias("doc"))))).alias("e"))
    by = each.groupBy("e.term").agg(F.sum(1 - F.col("e.doc")).alias("n"), F.sum("e.doc").alias("docs")).where((F.col("docs") >= least_docs) & (F.col("docs") <= most))
    found = [r.term for r in by.orderBy(F.desc("n"), "term").limit(n).collect()]
    if not found:
        raise ValueError("no term is in enough texts, or all are in too many")
    return found


def topic_table(model: PipelineModel, n: int = 10) -> DataFrame:
    """Rows (topic, words) with each topic's heaviest words."""
    vocabulary = F.array(*map(F.lit, model.stages[1].vocabulary))
    return model.stages[2].describeTopics(n).select("topic", F.transform("termIndices", lambda i: F.get(vocabulary, i)).alias("words"))


def dominant_topic(model: PipelineModel, docs: DataFrame) -> DataFrame:
    """Add each text's topic shares and its largest topic; empty texts have none."""
    out = once(model.transform(docs), "topics", vector_to_array("_topics"))
    known = F.length("clean") > 0
    best = F.array_position("topics", F.array_max("topics")).cast("int") - 1
    return out.withColumns({"topic": F.when(known, best), "topics": F.when(known, F.col("topics"))}).drop("_tokens", "_counts", "_topics")


def label_topics(topics: DataFrame, labels: Mapping[str, Sequence[str]]) -> DataFrame:
    """Name each topic by the keyword set that shares most with its first six words, two at least; else by three words."""
    head = F.slice("words", 1, 6)
    sets = F.array(*[F.struct(F.size(F.array_intersect(head, F.array(*map(F.lit, keys)))).alias("shared"), F.lit(-i).alias("order"), F.lit(name).alias("name")) for i, (name, keys) in enumerate(labels.items())])
    best = F.array_max(sets)
    fallback = F.array_join(F.transform(F.slice("words", 1, 3), lambda x: F.initcap(x)), " / ")
    return topics.withColumn("label", F.when(best["shared"] >= 2, best["name"]).otherwise(fallback))


def topic_weights_by(docs: DataFrame, group: str) -> DataFrame:
    """Mean share of each topic in each group."""
    return docs.where("topics IS NOT NULL").select(group, F.posexplode("topics").alias("topic", "share")).groupBy(group, "topic").agg(F.avg("share").alias("mean_share"))


PUNCTUATION = r"""!"#$%&'()*+,-./:;<=>?@[\]^_`{|}~"""
#: Documents in one block of a term's postings, about; terms that first tell how good a query's best documents are.
BLOCK, SEEDS = 1024, 4
#: Characters of text whose terms are dealt to one task, the share of texts (one in so many) from which a term is common,
#: and rows of queries' terms that are sent to all executors.
DEALT, COMMON, BROADCAST_ROWS = 8_000_000, 256, 200_000
#: Queries that an index deals its rows out in, each a share of them, so that shuffles hold a share on disk at a time.
SLICES = 4
#: What sums in another order may differ by.
MARGIN = 1e-9


def search_terms(text: Column) -> Column:
    """Words longer than two characters, without punctuation around them, in lower case."""
    stripped = F.transform(F.split(F.lower(text), r"\s+"), lambda x: F.btrim(x, F.lit(PUNCTUATION)))
    return F.filter(stripped, lambda x: F.length(x) > 2)


def text_parts(df: DataFrame) -> int:
    """Tasks among which the terms of the texts are dealt out, so that none gets more as the table grows."""
    return 1 + int(df.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0) // DEALT


def term_frequencies(df: DataFrame, key: str, parts: int) -> DataFrame:
    """Rows (key, term, tf): a term's count over the largest count in the text. Texts are dealt out by key once, to ``parts`` tasks."""
    counts = df.repartition(parts, key).select(key, F.explode(search_terms(F.col("text"))).alias("term")).groupBy(key, "term").agg(F.count("*").alias("c"))
    return counts.select(key, "term", (F.col("c") / F.max("c").over(Window.partitionBy(key))).alias("tf"))


def with_terms(tf: DataFrame, terms: DataFrame, n: int, parts: int) -> DataFrame:
    """Rows of ``tf`` with the columns of their term. Terms in more than one in COMMON of n texts, of which there are at most COMMON times as many as a text has, go to all tasks; so no term of those that are joined by it is a large key."""
    common, rare = F.broadcast(terms.where(F.col("df") * COMMON > n)), terms.where(F.col("df") * COMMON <= n)
    others = tf.join(common.select("term"), "term", "left_anti").repartition(parts, "term").join(rare.hint("merge"), "term")
    return tf.join(common, "term").unionByName(others)


def _block(doc: Column, blocks: Column) -> Column:
    return F.pmod(F.xxhash64(doc), blocks).cast("int")


def write_search_index(docs: DataFrame, path: str, block: int = BLOCK) -> None:
    """Write an inverted index of (doc_id, text) below ``path``.

    ``postings`` has blocks of a term's documents: their ids, their TF-IDF weights over the documents' norms, and the
    largest size of these. idf is ln(N / (1 + df)), negative for words in all texts. A term with more than ``block``
    documents has several blocks, by a hash of the document, so no term is one row, one group or one key; files have
    them in the order of terms. ``terms`` has idf, the number of blocks and the largest weight of each term. Null texts have no
    terms; documents of norm 0 are left out.
    """
    spark, parts = docs.sparkSession, text_parts(docs)
    with shuffles_removed(spark), Temporary() as temporary:
        tf = temporary.stored(term_frequencies(docs, "doc_id", parts), "search-terms")
        n = docs.count()
        idf = F.log(F.lit(n) / (1 + F.col("df")))
        terms = temporary.stored(tf.groupBy("term").agg(F.count("*").alias("df")).select("term", "df", idf.alias("idf"), F.ceil(F.col("df") / block).cast("int").alias("blocks")), "search-idf")
        # all rows are dealt out in so many queries, by documents and then by terms, each of which removes its shuffle
        each = 1 + parts // SLICES
        normed = []
        for k in range(SLICES):
            weighed = with_terms(tf.where(_block(F.col("doc_id"), F.lit(SLICES)) == k), terms, n, each).select("doc_id", "term", "blocks", (F.col("tf") * F.col("idf")).alias("w")).repartition(each, "doc_id")
            norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("doc_id")))
            normed.append(temporary.stored(weighed.withColumn("norm", norm).where("norm > 0"), "search-normed"))
        temporary.drop(tf)
        posts = reduce(DataFrame.unionByName, normed).select("term", _block(F.col("doc_id"), F.col("blocks")).alias("block"), F.struct("doc_id", (F.col("w") / F.col("norm")).alias("w")).alias("post"))
        for k in range(SLICES):
            blocks = posts.where(_block(F.col("term"), F.lit(SLICES)) == k).repartition(each, "term", "block").groupBy("term", "block").agg(F.collect_list("post").alias("posts"), F.max(F.abs("post.w")).alias("top"))
            blocks.sortWithinPartitions("term", "block").write.mode("append" if k else "overwrite").parquet(f"{path}/postings")
        temporary.drop(*normed)
        tops = spark.read.parquet(f"{path}/postings").groupBy("term").agg(F.max("top").alias("top"))
        terms.drop("df").join(tops, "term").write.mode("overwrite").parquet(f"{path}/terms")


def search_index(spark: SparkSession, path: str, queries: DataFrame, k: int = 5) -> DataFrame:
    """Rows (query_id, doc_id, score, rank): the best k documents of each query by cosine of TF-IDF weights; only scores above 0 count.

    Weights of a term have one sign, so every shared term adds to a score. A query's SEEDS terms of largest bounds give
    k documents at least so good; by that, terms whose bounds together can't lift a document so high are looked up only
    for documents that others have found, in the one block that a document falls into, and blocks whose best documents
    can't come so high are skipped.
    """
    postings, terms = spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/terms")
    with shuffles_removed(spark), Temporary() as temporary:
        q = term_frequencies(queries.select("query_id", "text"), "query_id", text_parts(queries)).join(terms, "term").withColumn("wq", F.col("tf") * F.col("idf"))
        mine = Window.partitionBy("query_id")
        q = q.withColumn("nq", F.sqrt(F.sum(F.col("wq") * F.col("wq")).over(mine))).where("nq > 0").withColumn("wq", F.col("wq") / F.col("nq"))
        q = q.withColumn("bound", F.abs("wq") * F.col("top"))
        q = q.select("query_id", "term", "blocks", "wq", "bound", F.row_number().over(mine.orderBy(F.desc("bound"), "term")).alias("nth"),
                     F.sum("bound").over(mine.orderBy("bound", F.desc("term")).rowsBetween(Window.unboundedPreceding, 0)).alias("below"), F.sum("bound").over(mine).alias("whole"))
        q = temporary.stored(q, "search-queries")

        def sums(wanted: DataFrame) -> DataFrame:
            return wanted.select("query_id", "wq", F.inline("posts")).groupBy("query_id", "doc_id").agg(F.sum(F.col("w") * F.col("wq")).alias("score"))

        def limits(found: DataFrame) -> DataFrame:
            """What a query's k-th document has at least; less than any score where it has fewer."""
            nth = F.row_number().over(mine.orderBy(F.desc("score")))
            by = found.withColumn("n", nth).where(F.col("n") <= k).groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("score"))
            return by.select("query_id", F.when(F.col("n") >= k, F.col("score") - MARGIN).otherwise(-1.0).alias("limit"))

        first = q.where(F.col("nth") <= SEEDS).select("query_id", "term", "wq").join(postings.select("term", "posts"), "term")
        q = temporary.stored(q.join(limits(sums(first)), "query_id").withColumn("extra", F.col("below") < F.col("limit")), "search-limits")
        searched = q.where("NOT extra").join(postings, "term").where(F.abs("wq") * F.col("top") + F.col("whole") - F.col("bound") >= F.col("limit"))
        found = temporary.stored(sums(searched), "search-found")
        # scores so far only grow, by no more than the terms left have together
        rest = q.groupBy("query_id").agg(F.coalesce(F.max(F.when(F.col("extra"), F.col("below"))), F.lit(0.0)).alias("rest"))
        found = found.join(limits(found), "query_id").join(rest, "query_id").where(F.col("score") + F.col("rest") >= F.col("limit"))
        found = temporary.stored(found.select("query_id", "doc_id", "score"), "search-candidates")
        probes = found.select("query_id", "doc_id").join(q.where("extra").select("query_id", "term", "wq", "blocks"), "query_id").withColumn("block", _block(F.col("doc_id"), F.col("blocks")))
        probes = temporary.stored(probes, "search-probes")
        held = postings.select("term", "block", "posts").join(probes.select("term", "block").distinct(), ["term", "block"], "left_semi").select("term", F.inline("posts"))
        more = probes.select("query_id", "doc_id", "term", "wq").join(held, ["term", "doc_id"]).select("query_id", "doc_id", (F.col("w") * F.col("wq")).alias("score"))
        scored = found.unionByName(more).groupBy("query_id", "doc_id").agg(F.round(F.sum("score"), 6).alias("score")).where("score > 0")
        top = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
        return stored(scored.withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= k).select("query_id", "doc_id", "score", "rank"), "search-best")


def tfidf_search(docs: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """``search_index`` for queries that come once, without an index.

    A document's norm and those of its terms that a query holds come from one aggregation by document, and where the
    queries' terms go to all executors its scores are summed where it is; only the best of each task are dealt out by query.
    """
    parts, n = text_parts(docs), docs.count()
    with shuffles_removed(docs.sparkSession), Temporary() as temporary:
        in_docs = temporary.stored(term_frequencies(docs, "doc_id", parts), "search-terms")
        in_queries = temporary.stored(term_frequencies(queries, "query_id", text_parts(queries)), "search-asked")
        asked = in_queries.select("term").distinct().withColumn("asked", F.lit(True))
        df = in_docs.groupBy("term").agg(F.count("*").alias("df"))
        terms = temporary.stored(df.join(asked, "term", "left").select("term", "df", "asked", F.log(F.lit(n) / (1 + F.col("df"))).alias("idf")), "search-idf")
        weight = F.col("tf") * F.col("idf")
        q = in_queries.join(terms.where("asked"), "term").select("query_id", "term", weight.alias("wq"))
        nq = q.groupBy("query_id").agg(F.sqrt(F.sum(F.col("wq") * F.col("wq"))).alias("nq")).where("nq > 0")
        q = temporary.stored(q.join(nq, "query_id"), "search-queries")
        weighed = with_terms(in_docs, terms, n, parts).select("doc_id", "term", "asked", weight.alias("w")).repartition(parts, "doc_id")
        d = weighed.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("nd"), F.collect_list(F.when(F.col("asked"), F.struct("term", F.col("w").alias("wd")))).alias("terms"))
        held = d.where("nd > 0").select("doc_id", "nd", F.inline("terms"))
        few = q.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
        dots = (held.join(F.broadcast(q), "term") if few else held.repartition(parts, "term").join(q, "term")).groupBy("query_id", "doc_id", "nd", "nq").agg(F.sum(F.col("wd") * F.col("wq")).alias("dot"))
        scored = dots.withColumn("score", F.round(F.col("dot") / (F.col("nd") * F.col("nq")), 6)).where("score > 0")
        best = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
        return stored(scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "doc_id", "score", "rank"), "search-best")


def indexed_search(docs: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """The best k documents of each query, by an index that is made for them and goes afterwards."""
    path = stored_path(docs.sparkSession, "search-index")
    write_search_index(docs, path)
    try:
        return search_index(docs.sparkSession, path, queries, k)
    finally:
        removed_path(docs.sparkSession, path)


def text_classifier(train: DataFrame, text: str, label: str, terms: int = 20_000) -> PipelineModel:
    """TF-IDF without English stop words, and logistic regression."""
    return Pipeline(stages=[
        RegexTokenizer(inputCol=text, outputCol="_tokens", pattern=r"\W+", minTokenLength=2), StopWordsRemover(inputCol="_tokens", outputCol="_kept"),
        CountVectorizer(inputCol="_kept", outputCol="_counts", vocabSize=terms), IDF(inputCol="_counts", outputCol="_weights"),
        LogisticRegression(featuresCol="_weights", labelCol=label, regParam=0.01)]).fit(train)


def strongest_words(model: PipelineModel, n: int = 10) -> DataFrame:
    """Rows (word, weight): the n highest and n lowest coefficients."""
    from pyspark.sql import SparkSession

    pairs = sorted(zip(model.stages[-1].coefficients.toArray().tolist(), model.stages[2].vocabulary, strict=True))
    chosen = dict.fromkeys([*pairs[:n], *pairs[-n:]])
    return SparkSession.getActiveSession().createDataFrame([(w, c) for c, w in chosen], "word string, weight double")


def classification_report(predicted: DataFrame, label: str, prediction: str = "prediction") -> DataFrame:
    """Precision, recall, F1 and support of each class; 0 where a denominator is 0."""
    classes = predicted.select(F.explode(F.array(F.col(label).cast("double"), F.col(prediction).cast("double"))).alias("class")).distinct()
    pairs = predicted.groupBy(F.col(label).cast("double").alias("a"), F.col(prediction).cast("double").alias("p")).count()
    joined = classes.join(pairs, (F.col("class") == F.col("a")) | (F.col("class") == F.col("p")))
    by = joined.groupBy("class").agg(*[F.coalesce(F.sum(F.when(c, F.col("count"))), F.lit(0)).alias(n) for n, c in (
        ("tp", (F.col("a") == F.col("class")) & (F.col("p") == F.col("class"))), ("fp", (F.col("a") != F.col("class"))), ("fn", (F.col("p") != F.col("class"))))])
    p = F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(0.0)
    r = F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn"))).otherwise(0.0)
    out = by.withColumns({"precision": p, "recall": r, "support": F.col("tp") + F.col("fn")})
    f1 = F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0)
    return out.select("class", "precision", "recall", f1.alias("f1"), "support")


def entity_brief(market: DataFrame, news: DataFrame, key: str, price: str, ratio: str, score: str, metrics: Sequence[str], headline: str, order: str) -> DataFrame:
    """Per entity of ``market``: key, price_text, news, metrics and tier; its headlines come from ``news``.

    Keys are joined in capitals. Headlines are in the given order (then by themselves), joined by a bar; an entity without
    any gets a sentence instead. ``metrics`` become one nested column. Entities without a key are left out; headlines of
    unknown entities too. Headlines of one entity are one row's text, so their number must suit a text.
    """
    by = news.where(F.col(key).isNotNull() & F.col(headline).isNotNull()).groupBy(F.upper(key).alias("_key")).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(headline).alias("h")))).alias("_news"))
    told = F.concat(F.upper(key), F.lit(" Current Price: $"), F.col(price).cast("string"), F.lit(" (P/E: "), F.coalesce(F.col(ratio).cast("string"), F.lit("n/a")), F.lit(")"))
    joined = market.where(F.col(key).isNotNull()).join(by, F.upper(key) == F.col("_key"), "left")
    return joined.select(
        F.upper(key).alias(key), told.alias("price_text"), F.coalesce(F.array_join(F.transform("_news", lambda x: x["h"]), " | "), F.lit("No recent news available.")).alias("news"),
        F.struct(*metrics).alias("metrics"), risk_tier(F.col(score)).alias("tier"))
