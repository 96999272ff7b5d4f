"""Merkle manifests against trees built by hand."""

import hashlib
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from sparkpulse.llm import merkle

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row: dict) -> str:
    return digest(*["-" if row[c] is None else f"{len(str(row[c]).encode())}:{row[c]}" for c in FIELDS])


def tree(nodes: list[str]) -> list[list[str]]:
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([digest(*levels[-1][i : i + 3]) for i in range(0, len(levels[-1]), 3)])
    return levels


def siblings(levels: list[list[str]], i: int) -> list[tuple[str, str]]:
    out = []
    for nodes in levels[:-1]:
        first = i - i % 3
        out.append(("".join(nodes[first:i]), "".join(nodes[i + 1 : first + 3])))
        i //= 3
    return out


def by_hand(rows: list[dict]) -> list[tuple]:
    sources = sorted({r["source"] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    groups = {s: sorted((r for r in rows if r["source"] == s), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r))) for s in sources}
    trees = {s: tree([leaf(r) for r in group]) for s, group in groups.items()}
    top = tree([trees[s][-1][0] for s in sources])
    out = []
    for k, s in enumerate(sources):
        for i, r in enumerate(groups[s]):
            proof = siblings(trees[s], i) + siblings(top, k)
            spoiled = r["doc_id"] is not None and r["text"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0
            node = leaf(r | {"text": r["text"].replace("\n", "")} if spoiled else r)
            for left, right in proof:
                node = digest(left, node, right)
            out.append((r["doc_id"], leaf(r), trees[s][-1][0], top[-1][0], digest(*[x for pair in proof for x in pair]), node, node == top[-1][0]))
    return sorted(out, key=str)


def manifest(df):
    spoiled = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    return sorted((tuple(r) for r in merkle.manifest(df, changed=("text", spoiled), kept=merkle.verified).collect()), key=str)


ODD = [
    *[(k, "big", "en", k * 7, f"text {k}\n" * (k % 3)) for k in range(1, 30)], (1, None, None, None, None), (2, None, "en", 3, ""), (1, "one", "en", 1, "a\nb"), (7, "é", "日本", 2, "naïve 😀\n"), (7, "é", "日本", 2, "naïve 😀\n"),
    (7, "é", "日本", 2, "other"), (None, "é", None, None, "no id\n"), (None, "é", None, None, "no id\n"), (3, "", "en", 0, "x" * 200_000 + "\n"), (4, "-", "-", -5, "-"), (5, "Z", "en", 1, "t"), (5, "a", "en", 1, "t"), *[(k, "nine", "en", 1, "t\n") for k in range(9)]]


@pytest.mark.parametrize("rows", [ODD, ODD[:1], ODD[:28], [r for r in ODD if r[1] == "nine"]], ids=["odd", "one row", "one source of 28", "nine"])
def test_agrees_with_trees_by_hand(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("taken") for c in ("key", "tree", "pos", "size", "node", "proof", "slot0", "leaf")})
    assert manifest(df.repartition(3)) == by_hand([dict(zip(FIELDS, r, strict=True)) for r in rows])


def test_an_empty_table_gives_no_rows(spark):
    assert manifest(spark.createDataFrame([], SCHEMA)) == []


def test_a_proof_leads_from_its_leaf_to_the_root(spark):
    rows = merkle.manifest(spark.createDataFrame(ODD, SCHEMA)).collect()
    assert len(rows) == len(ODD) and {r.changed_leaf for r in rows} == {None}
    for r in rows:
        node = r.leaf
        for left, right in r.proof:
            node = digest(left, node, right)
        assert node == r.root


def test_query_agrees_with_sql(spark, small):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{small}/documents.parquet'")
    want = sorted(con.execute(entry.oracle_sql()["op13_merkle"]).fetchall(), key=str)
    assert sorted((tuple(r) for r in entry.queries()["op13_merkle"](spark, small).collect()), key=str) == want
    assert want == by_hand([r.asDict() for r in spark.read.parquet(f"{small}/documents.parquet").collect()])
