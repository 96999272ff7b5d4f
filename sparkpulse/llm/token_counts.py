"""Token counts as rollups that deltas maintain.

A ledger keeps, for each committed batch, signed entries of the documents it changed and the sums of those entries
by source, language and tokenizer version. Totals are the sums over all batches: an insertion adds, a deletion
takes away what was counted, a revision does both. A batch is known by its name and counts once, however often it
is committed, and costs what it changes: texts are counted where they are read, and earlier entries are looked up
by bucket.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch

GROUP = ("source", "lang", "tokenizer")
#: Folders of a new ledger's entries; one should hold some 100 MB at its fullest.
BUCKETS = 32
#: Batches whose entries lie in folders of their own before a commit makes one base of them.
TOGETHER = 100
#: Columns of an entry; ids are kept as text.
ENTRY = "doc_id string, source string, lang string, tokenizer string, n_docs long, n_tokens long"


@lru_cache(maxsize=4)
def _encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def rank_file_counter(path: str, pattern: str):
    """A counter of tokens for a file of merge ranks."""

    def run(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = _encoding(path, pattern).encode_ordinary
        for s in series:
            yield pd.Series([len(encode(t)) if t else 0 for t in s], dtype="int64")

    return F.pandas_udf(run, "long")


def word_counter(text: Column) -> Column:
    """Runs of characters other than white space."""
    return F.regexp_count(text, F.lit(r"[^ \t\n\r\f\x0b]+")).cast("long")


class TokenLedger:
    """A ledger in a folder that all executors share.

    ``tokenizers`` maps a version's name to a function from the text's column to the column of its count. Changes
    are rows (doc_id, op, source, lang, text); op is insert, revise or delete. An insertion of a document that is
    there counts as a revision, a revision of one that isn't as an insertion, and a deletion of one that isn't as
    nothing. Several changes of one document in a batch: the deletion wins, else the largest by source, language
    and SHA-256 of the text, a null text last. Null texts have 0 tokens, null sources and languages are groups of
    their own; rows without id or with another op are left out, other columns ignored. An empty batch commits and
    changes nothing.

    Entries lie in ``buckets`` folders by a hash of the id, sorted by id: a batch reads the buckets it touches, and
    of their entries only those of its own documents are shuffled. A new ledger takes the given number, which should
    leave a bucket of some 100 MB; one that exists keeps its own until ``compact`` deals it out anew. One program at
    a time may commit or compact. A commit that leaves more than ``together`` parts since the last base compacts them.
    """

    def __init__(self, spark: SparkSession, root: str, tokenizers: dict, buckets: int = BUCKETS, together: int = TOGETHER):
        self.spark, self.root, self.tokenizers, self.buckets, self.together = spark, root.rstrip("/"), tokenizers, buckets, together

    def _found(self, pattern: str) -> list[str]:
        """Paths below the root that match, without the root."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        files = path(self.root).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        depth = pattern.count("/") + 1
        found = files.globStatus(path(f"{self.root}/{pattern}")) or []
        return ["/".join(x.getPath().toString().split("/")[-depth:]) for x in found]

    def committed(self) -> list[str]:
        """Names of the batches whose sums have been written to the end, which is what commits them."""
        return sorted(x.split("/")[1].removeprefix("batch=") for x in self._found("sums/batch=*/_SUCCESS"))

    def _generation(self) -> tuple[str, int]:
        """Folder and number of buckets of the entries in use; a compaction makes the next one."""
        made = {int(x.split("/")[1].split("=")[1]): int(x.split("/")[2].split("=")[1]) for x in self._found("entries/gen=*/buckets=*/*/_SUCCESS")}
        done = [0, *(int(x.split("/")[1].split("=")[1]) for x in self._found("entries/gen=*/buckets=*/part=base/_SUCCESS"))]
        gen = max(done)
        buckets = made.get(gen, self.buckets)
        return f"entries/gen={gen}/buckets={buckets}", buckets

    def _parts(self, folder: str) -> list[str]:
        """Folders of entries that count: the base and the committed batches since."""
        names = {"part=base", *(f"part=batch-{b}" for b in self.committed())}
        return sorted(names.intersection(x.split("/")[-2] for x in self._found(f"{folder}/*/_SUCCESS")))

    def _entries(self, folder: str, touched: list[int] | None = None) -> DataFrame | None:
        """Entries of the committed batches and of the base they build on, in the given buckets only; one scan for all."""
        parts = self._parts(folder)
        if not parts:
            return None
        every = self.spark.read.schema(f"{ENTRY}, bucket int").option("basePath", f"{self.root}/{folder}").parquet(*[f"{self.root}/{folder}/{part}" for part in parts]).drop("part")
        return every if touched is None else every.where(F.col("bucket").isin(touched))

    def _write(self, entries: DataFrame, path: str) -> None:
        entries.repartition("bucket").sortWithinPartitions("bucket", "doc_id").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/{path}")

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Count a batch; False if it has been committed already. A half-written batch is written anew."""
        if batch in self.committed():
            return False
        folder, buckets = self._generation()
        gone = F.col("op") == "delete"
        text = F.when(~gone, F.col("text"))
        counts = F.array(*[F.coalesce(count(text), F.lit(0)).cast("long") for count in self.tokenizers.values()])
        # texts become counts and digests before anything is dealt out
        version = F.struct(gone.alias("gone"), "source", "lang", F.sha2(text.cast("binary"), 256).alias("digest"), counts.alias("counts"))
        rows = changes.where("doc_id IS NOT NULL AND op IN ('insert', 'revise', 'delete')").select(
            F.col("doc_id").cast("string").alias("doc_id"), version.alias("v"))
        with Scratch(self.spark) as scratch:
            last = scratch.written(rows.groupBy("doc_id").agg(F.max("v").alias("v")).select(bucket_of("doc_id", buckets).alias("bucket"), "doc_id", "v.*"), "ledger-batch")
            each = F.array(*[F.struct(F.lit(name).alias("tokenizer"), F.col("counts")[i].alias("n_tokens")) for i, name in enumerate(self.tokenizers)])
            entries = last.where("NOT gone").select("bucket", "doc_id", "source", "lang", F.explode(each).alias("c")).select(
                "bucket", "doc_id", "source", "lang", "c.tokenizer", F.lit(1).cast("long").alias("n_docs"), "c.n_tokens")
            # at most one value a bucket comes to the driver
            touched = [r.bucket for r in last.select("bucket").distinct().collect()]
            before = self._entries(folder, touched) if touched else None
            if before is not None:
                mine = before.join(last.select("bucket", "doc_id"), ["bucket", "doc_id"], "left_semi")
                entries = entries.unionByName(_net(mine).withColumns({"n_docs": -F.col("n_docs"), "n_tokens": -F.col("n_tokens")}))
            self._write(entries, f"{folder}/part=batch-{batch}")
        written = self.spark.read.schema(f"{ENTRY}, bucket int").parquet(f"{self.root}/{folder}/part=batch-{batch}")
        sums = written.groupBy(*GROUP).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        sums.write.mode("overwrite").parquet(f"{self.root}/sums/batch={batch}")
        if len(self._parts(folder)) > self.together:
            self.compact()
        return True

    def compact(self, buckets: int | None = None) -> None:
        """Write the entries of all committed batches as one base, in another number of buckets if given.

        Sums and names of batches stay, so totals don't change and a batch still counts once. The older entries
        aren't read any more; they are left to be deleted by whoever owns the folder.
        """
        folder, old = self._generation()
        entries = self._entries(folder)
        if entries is not None:
            gen = int(folder.split("/")[1].split("=")[1]) + 1
            buckets = buckets or old
            self._write(_net(entries.withColumn("bucket", bucket_of("doc_id", buckets))), f"entries/gen={gen}/buckets={buckets}/part=base")

    def totals(self) -> DataFrame:
        """Rows (source, lang, tokenizer, n_docs, n_tokens) over all committed batches; groups without documents are left out."""
        paths = [f"{self.root}/sums/batch={b}" for b in self.committed()]
        if not paths:
            return self.spark.createDataFrame([], "source string, lang string, tokenizer string, n_docs long, n_tokens long")
        sums = self.spark.read.parquet(*paths)
        return sums.groupBy(*GROUP).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).where("n_docs <> 0")


def bucket_of(doc_id: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(buckets)).cast("int")


def _net(entries: DataFrame) -> DataFrame:
    """What stands of signed entries, for each document, group and tokenizer."""
    return entries.groupBy("bucket", "doc_id", *GROUP).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).where("n_docs <> 0")
