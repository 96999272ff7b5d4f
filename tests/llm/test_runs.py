"""Periodic runs against a walk over all periods."""

import hashlib
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as entry
from sparkpulse.llm import runs


def walked(words: list) -> list[tuple[int, int, int]]:
    """All runs (start, length, period): each period's stretches, less those that have a shorter period."""
    out = []
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            size, piece = j - i + q, words[i : j + q]
            if j > i and size >= max(6, 4 * q) and not any(piece[p:] == piece[:-p] for p in range(1, q)):
                out.append((i, size, q))
            i = max(j, i + 1)
    return sorted((a, n, q) for a, n, q in out)


def caught(words: list[int], step: int, longest: int | None = None) -> list[tuple[int, int, int]]:
    catcher = runs.SquareCatcher(longest)
    for at in range(0, len(words), step):
        catcher.append(np.array(words[at : at + step], np.int64))
    return [tuple(r) for r in catcher.runs().tolist()]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=9), st.integers(1, 7)), max_size=8), st.sampled_from([1, 5, 1000]))
def test_catchers_agree_with_a_walk_however_words_come(parts, step):
    words = [w for block, times in parts for w in block * times]
    assert caught(words, step) == walked(words)


@pytest.mark.parametrize("words", [[0] * 3000, [0, 1] * 1500, [*range(700)] * 5, [*range(50), *[*range(100, 130)] * 4, 100, 101, *range(50)], ([0] * 6 + [1]) * 40, [0, 0, 0, 0, 1] * 9])
def test_long_and_nested_runs(words):
    assert caught(words, len(words)) == walked(words) == caught(words, 64)


def test_an_appended_word_reports_the_run_it_lengthens():
    catcher = runs.SquareCatcher()
    assert catcher.append(np.array([1, 2] * 3 + [1])) == []
    assert catcher.append(np.array([2])) == [(0, 8, 2)]
    assert catcher.append(np.array([1])) == [(0, 9, 2)]
    assert catcher.append(np.array([7])) == [] and catcher.runs().tolist() == [[0, 9, 2]]


def test_hashes_that_collide_change_nothing(monkeypatch):
    monkeypatch.setattr(runs, "scrambled", lambda ids: np.zeros(len(ids), np.uint64))
    words = [0, 1, 2, 0, 1, 2, 0, 1, 2, 0, 1, 2, 5, 6, 7, 8, 8, 8, 8, 8, 8, 9]
    assert set(caught(words, len(words))) <= set(walked(words))  # whatever is reported is true, if every hash is alike


ODD = [
    (1, "a b c"), (2, None), (3, ""), (4, " \t\n"), (5, "x " * 30_000), (6, "naïve 日本 " * 4 + "z"), (7, "a b   " * 8), (8, "q\x0bq\x0cq\rq\tq\nq"),
    (9, "a b c d " * 2000 + "e"), (9, "a b c d " * 2000 + "e"), (None, "no id no id no id no id")]


def by_hand(words: list[str]) -> tuple:
    found = walked(words)
    gone = {i for a, n, q in found for i in range(a + q, a + n)}
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
    lines = "".join(f"{a},{n},{q}\n" for a, n, q in found)
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    return len(found), *best, best[0] is not None and 1000 * best[1] // best[2] or None, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest()



def test_odd_texts(spark):
    docs = spark.createDataFrame(ODD, "doc_id long, text string").withColumns({"runs": F.lit("taken"), "n_words": F.lit("taken"), "key": F.lit("taken"), "start": F.lit("taken")})
    found = runs.find_runs(docs)
    assert found.columns == ["doc_id", "n_words", "runs", "collapsed"]
    rows = sorted(found.collect(), key=lambda r: (r.doc_id is None, r.doc_id))
    assert len(rows) == len(ODD)
    for (key, text), r in zip(ODD, rows, strict=True):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        assert (r.doc_id, r.n_words) == (key, len(words))
        if len(words) < 1500:
            assert [tuple(x) for x in r.runs] == walked(words)
    by_id = {r.doc_id: r for r in rows}
    assert [tuple(x) for x in by_id[5].runs] == [(0, 30_000, 1)] and by_id[5].collapsed == "x"
    assert [tuple(x) for x in by_id[9].runs] == [(0, 8000, 4)] and by_id[9].collapsed == "a b c d e"
    assert runs.digest(runs.find_runs(docs.where("1 = 0"))).count() == 0
    got = {r.doc_id: tuple(r)[1:] for r in runs.digest(found).collect()}
    for key, text in ODD:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        if len(words) < 1500:
            assert got[key] == by_hand(words)


def test_query_agrees_with_the_walk(spark, small):
    got = {r.doc_id: tuple(r)[1:] for r in entry.queries()["op11_runs"](spark, small).collect()}
    docs, tried = spark.read.parquet(f"{small}/documents.parquet").collect(), 0
    assert len(got) == len(docs)
    for d in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", d.text or "")
        n, h = len(words), zlib.crc32(str(d.doc_id).encode())
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        if n < 1200:
            tried += 1
            assert got[d.doc_id] == by_hand(words)
    assert tried > 100
