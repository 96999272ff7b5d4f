"""BPE encoding and decoding by batched merge rounds in numpy.

A batch of texts is normalised and split into words; each distinct word is merged once. All symbols of the
distinct words lie in one flat array. A round looks up the rank of every adjacent pair by binary search over the
sorted pair keys, takes the lowest rank of each word, and merges all its non-overlapping occurrences from the
left. Words leave the rounds when no pair of theirs has a rank. Decoding gathers vocabulary bytes by id.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from .common import arrow_slices

#: Fixed values of the vocabulary file's format: its split pattern, its two special tokens, its end-of-word mark.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SPECIAL = regex.compile(r"(<\|startoftext\|>|<\|endoftext\|>)")
WORD_END = "</w>"
#: Words kept with their ids between batches of a task; beyond it the table starts anew. It bounds memory only.
CACHED_WORDS = 200_000
#: Characters of texts that are split and merged at a time.
TOGETHER = 1_000_000


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself where printable, else the next letter from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


WORD = regex.compile(WORD_PATTERN)
#: The same for texts in Latin-1, by explicit letters, digits and white space; only the apostrophe forms start alike.
LATIN_LETTERS, LATIN_DIGITS = "A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff", "0-9\u00b2\u00b3\u00b9\u00bc-\u00be"
LATIN_WORD = re.compile(rf"[{LATIN_LETTERS}]+|'(?:s|t|re|ve|m|ll|d)|[{LATIN_DIGITS}]|[^\t-\r \u0085\u00a0{LATIN_LETTERS}{LATIN_DIGITS}]+")


@lru_cache(maxsize=1)
def newer_letters() -> tuple[re.Pattern, regex.Pattern]:
    """Letters and digits newer than Python's Unicode tables, and WORD_PATTERN where they are neither, as in the library."""
    pattern, found = WORD_PATTERN, ""
    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    for kind in ("L", "N"):
        newer = "".join(c for c in regex.findall(rf"\p{{{kind}}}", every) if unicodedata.category(c) == "Cn")
        if newer:
            pattern = pattern.replace(rf"\p{{{kind}}}", rf"[\p{{{kind}}}--[{newer}]]")
            found += newer
    return re.compile(f"[{found}]" if found else r"(?!)"), regex.compile(pattern, regex.V1)


def words_of(text: str) -> list[str]:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        newer, exact = newer_letters()
        if newer.search(text):
            return exact.findall(text)
        return WORD.findall(text)
    return LATIN_WORD.findall(text)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indexes starts[i] .. starts[i] + lengths[i] - 1 for all i, in one flat array."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


class Vocabulary:
    """Merges and symbols of a vocabulary file as arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            model = json.load(file)
        vocab = model["model"]["vocab"]
        self.special = {x["content"]: x["id"] for x in model["added_tokens"]}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["model"]["merges"]]
        left = np.array([vocab[a] for a, _ in merges], dtype=np.int64)
        right = np.array([vocab[b] for _, b in merges], dtype=np.int64)
        self.base = max([*vocab.values(), *self.special.values()]) + 1
        keys = left * self.base + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order
        self.merged = np.array([vocab[a + b] for a, b in merges], dtype=np.int64)
        letters = byte_letters()
        self.inner = np.array([vocab[x] for x in letters], dtype=np.int64)
        self.last = np.array([vocab[x + WORD_END] for x in letters], dtype=np.int64)
        # without a decoder, the library joins the tokens' strings by spaces
        strings = [b""] * self.base
        for token, i in [*vocab.items(), *self.special.items()]:
            strings[i] = token.encode() + b" "
        self.lengths = np.array([len(s) for s in strings], dtype=np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.flat = np.frombuffer(b"".join(strings), dtype=np.uint8)

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in one flat array, and the number of ids of each word."""
        raw = [w.encode() for w in words]
        length = np.array([len(r) for r in raw], dtype=np.int64)
        data = np.frombuffer(b"".join(raw), dtype=np.uint8)
        symbols = self.inner[data]
        ends = np.cumsum(length) - 1
        # words that end in a character of several bytes: the end mark belongs to the last byte's letter
        symbols[ends] = self.last[data[ends]]
        word = np.repeat(np.arange(len(words)), length)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbols):
            pair = np.full(len(symbols), len(self.ranks), dtype=np.int64)
            if len(symbols) > 1:
                key = symbols[:-1] * self.base + symbols[1:]
                at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                hit = (self.keys[at] == key) & (word[:-1] == word[1:])
                pair[:-1][hit] = self.ranks[at[hit]]
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            sizes = np.diff(np.r_[first, len(word)])
            best = np.minimum.reduceat(pair, first)
            open_word = best < len(self.ranks)
            if not open_word.all():
                shut = np.repeat(~open_word, sizes)
                done.append((word[shut], symbols[shut]))
                keep = ~shut
                symbols, word, pair = symbols[keep], word[keep], pair[keep]
                sizes, best = sizes[open_word], best[open_word]
                if not len(symbols):
                    break
            mine = pair == np.repeat(best, sizes)
            # in a run of equal overlapping pairs every second one merges, counted from its start
            spot = np.flatnonzero(mine)
            new_run = np.r_[True, np.diff(spot) != 1]
            run_start = spot[new_run][np.cumsum(new_run) - 1]
            spot = spot[(spot - run_start) % 2 == 0]
            symbols[spot] = self.merged[pair[spot]]
            keep = np.ones(len(symbols), dtype=bool)
            keep[spot + 1] = False
            symbols, word = symbols[keep], word[keep]
        if not done:
            return np.zeros(0, dtype=np.int64), np.zeros(len(words), dtype=np.int64)
        all_words = np.concatenate([w for w, _ in done])
        ids = np.concatenate([s for _, s in done])
        order = np.argsort(all_words, kind="stable")
        return ids[order], np.bincount(all_words, minlength=len(words))

    def decode(self, ids: np.ndarray) -> bytes:
        """The tokens' strings, joined by spaces."""
        return self.flat[ragged(self.starts[ids], self.lengths[ids])].tobytes()[:-1]


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def normalise(text: str) -> str:
    """Canonical composition and lower case, letter by letter (no final-sigma rule).

    The file also turns white space into one space; no word holds any, so that step changes nothing here.
    """
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


def split_words(text: str) -> list[str]:
    """Words of a text; the special tokens' own strings stay whole and are cut out before normalisation."""
    if "<|" not in text:
        return words_of(normalise(text))
    words: list[str] = []
    for k, part in enumerate(SPECIAL.split(text)):
        words += ["\n" + part] if k % 2 else words_of(normalise(part))
    return words


class Encoder:
    """Encodes batches; keeps the ids of words it has met."""

    def __init__(self, path: str):
        self.v = vocabulary(path)
        self._clear()

    def _clear(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.sizes = np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.int64)

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text in turn; a slice of about TOGETHER characters is held as words at a time."""
        part, size = [], 0
        for text in texts:
            part.append(text)
            size += len(text)
            if size >= TOGETHER:
                yield from self._slice(part)
                part, size = [], 0
        yield from self._slice(part)

    def _slice(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.known) > CACHED_WORDS:
            self._clear()
        per_text = [split_words(t) for t in texts]
        fresh = list(set().union(*per_text).difference(self.known))
        plain = [w for w in fresh if w[0] != "\n"]
        ids, sizes = self.v.merge(plain) if plain else (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))
        marked = [w for w in fresh if w[0] == "\n"]
        for w in [*plain, *marked]:
            self.known[w] = len(self.known)
        self.ids = np.concatenate([self.ids, ids.astype(np.uint32), np.array([self.v.special[w[1:]] for w in marked], dtype=np.uint32)])
        self.sizes = np.concatenate([self.sizes, sizes, np.ones(len(marked), dtype=np.int64)])
        starts = np.cumsum(self.sizes) - self.sizes
        out = []
        for words in per_text:
            k = np.fromiter(map(self.known.__getitem__, words), dtype=np.int64, count=len(words))
            out.append(self.ids[ragged(starts[k], self.sizes[k])] if len(k) else np.zeros(0, dtype=np.uint32))
        return out


def encode_rows(df: DataFrame, vocabulary_path: str, keep: list[str], text: str = "text", with_ids: bool = True) -> DataFrame:
    """Columns ``keep``, ids (array of int, if asked for), n_tokens, ids_sha256 and decoded_sha256 of each row, in one pass.

    Texts come and results go in pieces of about TOGETHER bytes, and a decoded text is forgotten once its digest is
    made. A null text counts as empty: no ids, and the digests of nothing. Rows are taken as they come: repeated
    rows give repeated results, and an empty table gives none. Columns of ``keep`` that clash with a result are left out.
    """
    made = [*["ids"] * with_ids, "n_tokens", "ids_sha256", "decoded_sha256"]
    kept = [c for c in keep if c not in made]
    source = df.select(*[F.col(c).alias(f"in_{c}") for c in kept], F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary_path)
        for part in arrow_slices(batches, "text", TOGETHER, 10_000):
            found = list(encoder.encode([t or "" for t in part.column("text").to_pylist()]))
            sizes = np.array([len(x) for x in found], dtype=np.int64)
            digest = [hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in found]
            decoded = [hashlib.sha256(encoder.v.decode(x.astype(np.int64)) if len(x) else b"").hexdigest() for x in found]
            out = [part.column(f"in_{c}") for c in kept]
            if with_ids:
                out.append(pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), pa.array(np.concatenate(found).astype(np.int32))))
            yield pa.RecordBatch.from_arrays([*out, pa.array(sizes), pa.array(digest), pa.array(decoded)], names=[*kept, *made])

    kinds = {"ids": ArrayType(IntegerType()), "n_tokens": LongType(), "ids_sha256": StringType(), "decoded_sha256": StringType()}
    schema = StructType([StructField(c, df.schema[c].dataType) for c in kept] + [StructField(c, kinds[c]) for c in made])
    return source.mapInArrow(run, schema)


def encode_texts(df: DataFrame, vocabulary_path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Add the ids of each text as an array of int. A null text counts as empty and gives an empty array.

    A column of the same name as ``ids`` is replaced; all other columns are kept.
    """

    def run(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = Encoder(vocabulary_path)
        for s in series:
            yield pd.Series([x.astype(np.int32) for x in encoder.encode([t or "" for t in s])], dtype=object)

    return df.withColumn(ids, F.pandas_udf(run, "array<int>")(F.col(text)))


def decode_ids(df: DataFrame, vocabulary_path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Add the text of an array of ids; null and empty arrays give an empty text."""

    def run(series: pd.Series) -> pd.Series:
        v = vocabulary(vocabulary_path)
        return pd.Series([v.decode(np.asarray(x, dtype=np.int64)).decode("utf-8", "replace") if x is not None and len(x) else "" for x in series])

    return df.withColumn(decoded, F.pandas_udf(run, "string")(F.col(ids)))


def digests(df: DataFrame, vocabulary_path: str, text: str = "text") -> DataFrame:
    """``df`` with n_tokens, ids_sha256 and decoded_sha256 of each text's ids and of their decoding, in place of its text."""
    return encode_rows(df, vocabulary_path, [c for c in df.columns if c != text], text, with_ids=False)
