"""Search by a stored index against scores of all documents."""

import math
import re
import string
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkpulse.operators import text


def terms_of(x):
    return [w for w in (y.strip(string.punctuation) for y in re.split(r"[ \t\n\x0b\f\r]+", (x or "").lower())) if len(w) > 2]


def all_scores(docs, queries, k):
    counts = {d: Counter(terms_of(x)) for d, x in docs}
    df = Counter(w for c in counts.values() for w in c)
    idf = {w: math.log(len(docs) / (1 + n)) for w, n in df.items()}
    weights = lambda c: {w: n / max(c.values()) * idf[w] for w, n in c.items() if w in idf}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    known, out = {d: weights(c) for d, c in counts.items()}, {}
    for q, x in queries:
        v = weights(Counter(terms_of(x)))
        found = [(-round(sum(a * known[d][w] for w, a in v.items() if w in known[d]) / norm(v) / norm(known[d]), 6), d) for d in known if norm(v) and norm(known[d]) and set(v) & set(known[d])]
        for rank, (score, d) in enumerate(sorted(f for f in found if f[0] < 0)[:k], 1):
            out[q, rank] = d, -score
    return out


def corpus(n, seed):
    rng = np.random.default_rng(seed)
    word = lambda: f"w{min(int(rng.zipf(1.3)), 400)}xx"
    return [(i, "everywhere, " + " ".join(word() for _ in range(int(rng.integers(1, 60)))) + ("" if i % 5 else " EVERYWHERE!")) for i in range(n)]


@pytest.mark.parametrize("block", [16, 1024])
def test_agrees_with_all_scores_though_a_term_is_in_all_texts(spark, tmp_path, block):
    docs = corpus(300, 1) + [(900, None), (901, ""), (902, "everywhere"), (903, "a an -- !"), (904, "rare-word only"), (905, "rare-word only")]
    queries = [*corpus(12, 2), (50, "everywhere"), (51, "nothing known here"), (52, "rare-word"), (53, None), (54, "everywhere w1xx w2xx rare-word")]
    d, q = (spark.createDataFrame(x, f"{name} long, text string") for x, name in ((docs, "doc_id"), (queries, "query_id")))
    text.write_search_index(d.repartition(3), str(tmp_path), block)
    got = {(r.query_id, r.rank): (r.doc_id, r.score) for r in text.search_index(spark, str(tmp_path), q, 5).collect()}
    want = all_scores(docs, queries, 5)
    assert got.keys() == want.keys()
    for at, (doc, score) in want.items():
        assert abs(got[at][1] - score) < 2e-6, at
    assert sum(got[at][0] == want[at][0] for at in want) >= len(want) - 2  # where rounding parts equal scores
    blocks = spark.read.parquet(f"{tmp_path}/postings").where("term = 'everywhere'")
    sizes = [r.n for r in blocks.select(F.size("posts").alias("n")).collect()]
    assert sum(sizes) == 301 and (len(sizes) > 10 and max(sizes) < 3 * block if block == 16 else len(sizes) == 1)


def test_tasks_grow_with_the_texts(spark, tmp_path, monkeypatch):
    """With more text than one task gets, terms and postings go to more tasks than the session's number of shuffle partitions."""
    monkeypatch.setattr(text, "DEALT", 2000, raising=False)
    monkeypatch.setattr(text, "COMMON", 4, raising=False)
    docs, queries = corpus(150, 5), corpus(8, 6)
    d, q = (spark.createDataFrame(x, f"{name} long, text string") for x, name in ((docs, "doc_id"), (queries, "query_id")))
    text.write_search_index(d, str(tmp_path))
    assert len(spark.read.parquet(f"{tmp_path}/postings").inputFiles()) > 8 > int(spark.conf.get("spark.sql.shuffle.partitions"))
    want = all_scores(docs, queries, 5)
    for found in (text.search_index(spark, str(tmp_path), q, 5), text.tfidf_search(d, q, 5)):
        got = {(r.query_id, r.rank): r.score for r in found.collect()}
        assert got.keys() == want.keys() and all(abs(got[at] - want[at][1]) < 2e-6 for at in want)


def test_an_empty_index_and_no_queries(spark, tmp_path):
    docs = spark.createDataFrame([(1, "some words here")], "doc_id long, text string")
    queries = docs.withColumnRenamed("doc_id", "query_id")
    text.write_search_index(docs.where("1 = 0"), str(tmp_path))
    assert text.search_index(spark, str(tmp_path), queries).count() == 0
    assert text.indexed_search(docs, queries.where("1 = 0")).count() == text.tfidf_search(docs, queries.where("1 = 0")).count() == 0


def test_an_index_drops_tables_once_read_and_shuffles_a_share_at_a_time(spark, tmp_path, monkeypatch):
    """What shuffles leave behind goes with each query, and what was read goes before the block ends."""
    from sparkpulse.sources import io

    name, kept, cleaned, drop, keep = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", [], [], io.Temporary.drop, io.Temporary.stored
    monkeypatch.setattr(io.Temporary, "stored", lambda self, df, x: (cleaned.append(spark.conf.get(name)), keep(self, df, x))[1])
    monkeypatch.setattr(io.Temporary, "drop", lambda self, *tables: (drop(self, *tables), kept.append(len(self.tables)))[0])
    before = spark.conf.get(name)
    docs = corpus(40, 7)
    text.write_search_index(spark.createDataFrame(docs, "doc_id long, text string"), str(tmp_path))
    assert set(cleaned) == {"true"} and spark.conf.get(name) == before and kept[-1] == 1  # only the terms are left
    held = spark.read.parquet(f"{tmp_path}/postings").select("term", F.inline("posts"))
    assert held.count() == held.select("term", "doc_id").distinct().count() == sum(len(set(terms_of(x))) for _, x in docs)
