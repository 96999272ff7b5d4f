"""Secret scans with DataFrame functions only: fixed patterns, and a battery of randomness tests.

Spark's SQL gives matches without their places; but splitting a text by a pattern yields exactly what lies between
its matches, so the running lengths of both give every span. Tokens of 20 characters or more are tested, in the
encoding inferred from their letters, for a uniform alphabet (chi-squared), for runs about the alphabet's middle,
and for serial correlation. Tokens that fail the battery are text or structure; false dismissals among them are
controlled at level Q within each class of length, by the step-up rule over a histogram of p-values. Tokens that
stay, and mix digits with letters, are reported as spans of kind ``random``.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import barrier, written

#: Fixed patterns of the contract, in the order of their kinds. A match of fewer characters than ``least`` is dropped.
ASSIGN = r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
#: Runs of at least 20 letters of an encoding, padding apart.
LEAST = 20
TOKEN = rf"[A-Za-z0-9+/_-]{{{LEAST},}}"
#: Cheap tests for texts that hold no match at all.
HAS_ASSIGN = r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]"
KINDS = ("assign", "access", "hex", "random")
#: Level of the false-discovery control, bins of p-values (a bin is a tenth of a power of ten), and level of the battery.
Q, BINS, ALPHA = 0.01, 120, 0.001
#: Matches whose places are added up together.
BLOCK = 256
#: Fixed values of the model of text: frequencies of English letters (of 1,000), and chances that a lower vowel, lower
#: consonant, upper vowel, upper consonant, digit or mark begins a token and follows each of these.
LETTERS = dict(a=82, b=15, c=28, d=43, e=127, f=22, g=20, h=61, i=70, j=1.5, k=8, l=40, m=24, n=67, o=75, p=19, q=1, r=60, s=63, t=91, u=28, v=10, w=24, x=1.5, y=20, z=0.7)
MARKS = {"-": 0.45, "_": 0.45, "/": 0.08, "+": 0.02}
FIRST = (0.15, 0.35, 0.10, 0.25, 0.10, 0.05)
FOLLOWS = (
    (0.15, 0.65, 0.02, 0.04, 0.04, 0.10), (0.50, 0.30, 0.02, 0.06, 0.04, 0.08), (0.08, 0.50, 0.10, 0.22, 0.04, 0.06),
    (0.42, 0.18, 0.16, 0.16, 0.04, 0.04), (0.02, 0.05, 0.02, 0.05, 0.78, 0.08), (0.22, 0.38, 0.06, 0.12, 0.17, 0.05))


def spans_of(text: Column, pattern: str, kind: str, group: int = 0, least: int = 0) -> Column:
    """All leftmost non-overlapping matches as structs (start, end, kind), in code points, the end exclusive.

    ``least`` drops matches whose ``group`` is shorter, after the scan: they still use up their characters.
    """
    whole = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    part = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(group + 1)) if group else whole
    both = F.arrays_zip(F.transform(F.split(text, pattern), lambda x: F.length(x)).alias("gap"), F.transform(whole, lambda x: F.length(x)).alias("size"), F.transform(part, lambda x: F.length(x)).alias("part"))
    # after the last match the split has one piece more, of no size; sums run within blocks, and over the blocks
    size = lambda x: x.gap + F.coalesce(x.size, F.lit(0))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(both) - 1) / BLOCK).cast("int")), lambda k: F.slice(both, k * BLOCK + 1, BLOCK))
    sums = F.transform(blocks, lambda block: F.aggregate(block, F.lit(0), lambda acc, x: acc + size(x)))
    offsets = F.aggregate(sums, F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))
    walk = lambda block, offset: F.aggregate(
        block, F.struct(offset.alias("at"), F.array().cast("array<struct<start:int,end:int,kind:string,part:int>>").alias("found")),
        lambda acc, x: F.struct(
            (acc.at + size(x)).alias("at"),
            F.when(x.size.isNull(), acc.found).otherwise(F.concat(acc.found, F.array(F.struct(
                (acc.at + x.gap).alias("start"), (acc.at + x.gap + x.size).alias("end"), F.lit(kind).alias("kind"), x["part"].alias("part"))))).alias("found")),
        lambda acc: acc.found)
    walked = F.flatten(F.zip_with(blocks, F.slice(offsets, 1, F.size(blocks)), walk))
    return F.transform(F.filter(walked, lambda s: s["part"] >= least), lambda s: F.struct(s.start.alias("start"), s.end.alias("end"), s.kind.alias("kind")))


def no_spans() -> Column:
    return F.array().cast("array<struct<start:int,end:int,kind:string>>")


def normal_tail(z: Column) -> Column:
    """P(|Z| > |z|) of a standard normal variable, by Abramowitz and Stegun's 26.2.17 (error under 1e-7)."""
    x = F.abs(z)
    t = F.lit(1.0) / (1.0 + 0.2316419 * x)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.least(F.lit(1.0), 2.0 * F.exp(-x * x / 2.0) / 2.5066282746310002 * poly)


def battery(tokens: DataFrame) -> DataFrame:
    """Add encoding, k (its alphabet), p of the three tests' Bonferroni bound, p_text and bin (of -10 log10 p_text) to rows with ``token``.

    Encodings: digits (10), hex of one case (16), letters of one case (26), base32 (32), letters and digits of one
    case (36), letters (52), all letters and digits (62), base64 in either alphabet (64).
    """
    t = F.col("token")
    encoding = (
        F.when(t.rlike("^[0-9]+$"), "digits").when(t.rlike("^([0-9a-f]+|[0-9A-F]+)$"), "hex").when(t.rlike("^([a-z]+|[A-Z]+)$"), "letters26").when(t.rlike("^[A-Z2-7]+$"), "base32")
        .when(t.rlike("^([0-9a-z]+|[0-9A-Z]+)$"), "alnum36").when(t.rlike("^[A-Za-z]+$"), "letters52").when(t.rlike("^[0-9A-Za-z]+$"), "alnum62").otherwise("base64"))
    df = tokens.withColumn("encoding", encoding)
    df = df.withColumn("k", F.expr("CASE encoding WHEN 'digits' THEN 10 WHEN 'hex' THEN 16 WHEN 'letters26' THEN 26 WHEN 'letters52' THEN 52 WHEN 'base32' THEN 32 WHEN 'alnum36' THEN 36 WHEN 'alnum62' THEN 62 ELSE 64 END").cast("double"))
    # a letter's value: its place in the alphabet of its encoding
    alphabet = F.expr("""CASE encoding WHEN 'digits' THEN '0123456789' WHEN 'hex' THEN '0123456789abcdef'
        WHEN 'letters26' THEN 'abcdefghijklmnopqrstuvwxyz' WHEN 'letters52' THEN 'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz' WHEN 'base32' THEN 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'
        WHEN 'alnum36' THEN '0123456789abcdefghijklmnopqrstuvwxyz' WHEN 'alnum62' THEN '0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz'
        ELSE 'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/' END""")
    cased = F.when(F.col("encoding").isin("hex", "alnum36", "letters26"), F.lower(t)).otherwise(F.translate(t, "-_", "+/"))
    df = barrier(df.withColumn("_alphabet", alphabet), "_v", F.transform(F.filter(F.split(cased, ""), lambda c: c != ""), lambda c: (F.instr(F.col("_alphabet"), c) - 1).cast("double")))
    df = df.withColumn("_n", F.size("_v").cast("double"))
    # chi-squared by counts of distinct letters; Wilson and Hilferty's cube root makes it normal
    squares = F.aggregate(F.array_distinct("_v"), F.lit(0.0), lambda acc, v: acc + F.pow(F.size(F.filter("_v", lambda x: x == v)).cast("double"), F.lit(2.0)))
    chi = F.col("k") * squares / F.col("_n") - F.col("_n")
    free = F.col("k") - 1.0
    z_chi = (F.pow(F.greatest(chi, F.lit(0.0)) / free, F.lit(1 / 3)) - (1.0 - 2.0 / (9.0 * free))) / F.sqrt(2.0 / (9.0 * free))
    # only too uneven an alphabet speaks against randomness: a one-sided test
    df = df.withColumn("p_chi", F.when(z_chi > 0, normal_tail(z_chi) / 2.0).otherwise(1.0))
    half = (F.col("k") - 1.0) / 2.0
    df = barrier(df, "_high", F.transform("_v", lambda v: (v > half).cast("double")))
    ones = F.aggregate("_high", F.lit(0.0), lambda a, x: a + x)
    runs = F.size(F.filter(F.transform("_high", lambda x, i: (i > 0) & (x != F.get("_high", i - 1))), lambda x: x)).cast("double") + 1.0
    df = df.withColumn("_a", ones).withColumn("_b", F.col("_n") - ones).withColumn("_runs", runs)
    mean = 2.0 * F.col("_a") * F.col("_b") / F.col("_n") + 1.0
    spread = F.sqrt(F.greatest((mean - 1.0) * (mean - 2.0) / (F.col("_n") - 1.0), F.lit(1e-9)))
    df = df.withColumn("p_runs", F.when((F.col("_a") == 0) | (F.col("_b") == 0), F.pow(F.lit(2.0), 1.0 - F.col("_n"))).otherwise(normal_tail((F.col("_runs") - mean) / spread)))
    middle = F.aggregate("_v", F.lit(0.0), lambda a, x: a + x) / F.col("_n")
    df = df.withColumn("_m", middle)
    variance = F.aggregate("_v", F.lit(0.0), lambda a, x: a + (x - F.col("_m")) * (x - F.col("_m")))
    lagged = F.aggregate(F.transform("_v", lambda x, i: F.when(i > 0, (x - F.col("_m")) * (F.get("_v", i - 1) - F.col("_m"))).otherwise(0.0)), F.lit(0.0), lambda a, x: a + x)
    serial = F.when(variance > 0, lagged / variance * F.sqrt(F.col("_n"))).otherwise(F.sqrt(F.col("_n")))
    df = df.withColumn("p_serial", normal_tail(serial))
    p = F.greatest(F.least(F.lit(1.0), 3.0 * F.least("p_chi", "p_runs", "p_serial")), F.lit(1e-12))
    df = df.withColumn("p", p)
    df = barrier(df, "_as", F.transform(F.filter(F.split(t, ""), lambda c: c != ""), lambda c: F.ascii(c)))
    kinds, logs = text_model()
    df = barrier(df, "_kinds", F.transform("_as", lambda c: F.get(F.array(*map(F.lit, kinds)), c)))
    chain = F.transform("_kinds", lambda x, i: F.when(i == 0, F.get(F.array(*[F.lit(float(np.log(p))) for p in FIRST]), x)).otherwise(
        F.get(F.array(*[F.lit(float(np.log(p))) for row in FOLLOWS for p in row]), F.get("_kinds", i - 1) * 6 + x)))
    letters = F.transform("_as", lambda c: F.get(F.array(*map(F.lit, logs)), c))
    as_text = F.aggregate(F.concat(chain, letters), F.lit(0.0), lambda a, x: a + x)
    ratio = -F.col("_n") * F.log("k") - as_text
    df = df.withColumn("p_text", F.exp(-F.least(F.greatest(ratio, F.lit(0.0)), F.lit(100.0))))
    df = df.withColumn("length_class", F.floor(F.log2("_n")).cast("int")).withColumn("bin", F.least(F.floor(-10.0 * F.log10("p_text")), F.lit(BINS)).cast("int"))
    return df.drop("_v", "_n", "_high", "_a", "_b", "_runs", "_m", "_alphabet", "_as", "_kinds")


def text_model() -> tuple[list[int], list[float]]:
    """By ASCII code: the kind of a letter, digit or mark (0 to 5, as in FIRST), and the log of its share of that kind in text."""
    kinds, logs = [5] * 128, [float(np.log(0.001))] * 128
    vowels = {c: n for c, n in LETTERS.items() if c in "aeiou"}
    for c, n in LETTERS.items():
        share = float(np.log(n / (sum(vowels.values()) if c in vowels else sum(LETTERS.values()) - sum(vowels.values()))))
        for x, upper in ((c, 0), (c.upper(), 2)):
            kinds[ord(x)], logs[ord(x)] = upper + (c not in vowels), share
    for c in "0123456789":
        kinds[ord(c)], logs[ord(c)] = 4, float(np.log(0.1))
    for c, p in MARKS.items():
        logs[ord(c)] = float(np.log(p))
    return kinds, logs


def reported_from(tested: DataFrame) -> DataFrame:
    """Rows (length_class, least_bin): the step-up rule over p-value bins. Tokens of that bin or higher are reported.

    The rule takes the largest p-value p for which m * p / (number of tokens with p-values up to p) <= Q; here p is
    the upper edge of a bin, which errs to the side of fewer reports. All tested tokens count, and tokens that fail
    the battery count as not found. The table has BINS rows a length class at most.
    """
    counts = tested.groupBy("length_class", "bin").agg(F.count("*").alias("all"), F.count_if(F.col("p") >= ALPHA).alias("c"))
    lists = counts.groupBy("length_class").agg(F.sum("all").alias("m"), F.collect_list(F.struct("bin", "c")).alias("x"))
    passing = F.filter("x", lambda b: F.col("m") * F.pow(F.lit(10.0), -b.bin / 10.0) <= Q * F.aggregate(
        F.filter("x", lambda o: o.bin >= b.bin), F.lit(0).cast("long"), lambda a, o: a + o.c))
    return lists.select("length_class", F.array_min(F.transform(passing, lambda b: b.bin)).alias("least_bin"))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random), one for each row of ``docs``.

    Base spans are the contract's patterns; ``spans`` has those and the random tokens, or what of them lies outside base spans.
    A null text counts as empty: it has no spans, and base_sha256 is that of the empty string. Equal texts have
    equal spans. Thresholds of the false-discovery control come from all rows. An empty table gives no rows.
    """
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    t = F.col("text")
    base = F.concat(
        F.when(t.rlike(HAS_ASSIGN), spans_of(t, ASSIGN, "assign", 2, 8)).otherwise(no_spans()),
        F.when(F.contains(t, F.lit("AKIA")), spans_of(t, ACCESS, "access")).otherwise(no_spans()),
        F.when(t.rlike(HEX), spans_of(t, HEX, "hex")).otherwise(no_spans()))
    tokens = F.when(t.rlike(TOKEN), spans_of(t, TOKEN, "random")).otherwise(no_spans())
    rows = barrier(rows, "base", base)
    rows = barrier(rows, "runs", tokens)

    def outside(s: Column) -> Column:
        over = F.filter("base", lambda b: (b.start < s.end) & (s.start < b.end))
        begins = F.filter(F.concat(F.array(s.start), F.transform(over, lambda b: b.end)), lambda a: (a < s.end) & ~F.exists(over, lambda b: (b.start <= a) & (a < b.end)))
        parts = F.transform(F.array_distinct(begins), lambda a: F.struct(a.alias("start"), F.coalesce(F.array_min(F.filter(F.transform(over, lambda b: b.start), lambda e: e >= a)), s.end).alias("end")))
        return F.when(F.size(over) == 0, F.array(F.struct(s.start.alias("start"), s.end.alias("end")))).otherwise(F.filter(parts, lambda x: x.end - x.start >= LEAST))

    free = F.flatten(F.transform("runs", outside))
    rows = barrier(rows, "tokens", F.transform(free, lambda s: F.struct(s.start.alias("start"), s.end.alias("end"), F.substring(t, s.start + 1, s.end - s.start).alias("token"))))
    held = written(rows.select(F.monotonically_increasing_id().alias("_row"), "doc_id", "base", "tokens"), "secret-spans")
    tested = written(battery(held.select("_row", F.explode("tokens").alias("s")).select("_row", "s.*")), "secret-tokens")
    limits = reported_from(tested)  # one row for each doubling of length
    stays = tested.join(F.broadcast(limits), "length_class").where((F.col("bin") >= F.col("least_bin")) & (F.col("p") >= ALPHA))
    found = stays.groupBy("_row").agg(F.collect_list(F.struct("start", "end", F.lit("random").alias("kind"))).alias("_random"))
    judged = held.join(found, "_row", "left").withColumn("_random", F.coalesce("_random", no_spans()))

    def joined(spans: Column) -> Column:
        ranked = F.array_sort(F.transform(spans, lambda s: F.struct(
            s.start.alias("start"), F.array_position(F.array(*map(F.lit, KINDS)), s.kind).alias("rank"), s.end.alias("end"), s.kind.alias("kind"))))
        return F.array_join(F.transform(ranked, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")

    return judged.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"),
                         joined(F.concat("base", "_random")).alias("spans"), F.size("_random").cast("long").alias("n_random"))
