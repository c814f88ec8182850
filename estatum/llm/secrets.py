"""Secret scan with a randomness test battery, in built-in functions only.

Three patterns give the base findings.  Beside them, every long token is tested.  Its
encoding is the smallest alphabet that holds it (letters, hex, base32, base36, base62,
base64, url-safe base64).  The battery asks whether a random generator could have
written it: chi-squared for a uniform alphabet, runs above and below its middle, and
lag-one serial correlation; a token whose combined p-value is under ALPHA is no
generator's (and ALPHA of those that are get lost).

What is left is reported only if plain writing is rejected.  Plain writing draws its
characters as the table's own texts do (counted over all of them, long tokens left
out, restricted to the token's alphabet); the mean and variance of a token's
log-likelihood under these frequencies follow from its length, and the lower tail is
the p-value against plain.  Benjamini and Hochberg's rule, among tokens of equal encoding and length class
over the whole table, keeps the expected share of plain tokens among the reported
ones under FDR (over 1 - ALPHA).  A token too short to be told from writing has a
large p-value and is reported only where many such are.

Reported tokens are ``random`` spans, where no base span overlaps.  Digits alone are
numbers and are not tested.  Offsets are code points, ends exclusive.  Null text
counts as empty: no spans.  Repeated rows are repeated, and their tokens count once;
an empty table gives no rows; extra columns travel in ``keep``.  Arrays of matches
are built in chunks, so a long text with many matches costs little more than its
length.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from estatum.llm.common import materialize, table

#: The base patterns, and the least length of what they must match.
ASSIGN = r"""((?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))"""
ACCESS = r"(AKIA[A-Z0-9]{16,})"
HEX = r"([0-9a-f]{24,})"
TOKEN = r"([A-Za-z0-9+/_-]{20,}={0,2})"
KINDS = ("assign", "access", "hex", "random")
LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: Encodings in the order they are tried: name, alphabet in value order.
ENCODINGS = (
    ("hex", DIGITS + LOWER[:6]),
    ("HEX", DIGITS + UPPER[:6]),
    ("lower", LOWER),
    ("upper", UPPER),
    ("base32", UPPER + "234567"),
    ("base36", DIGITS + LOWER),
    ("BASE36", DIGITS + UPPER),
    ("base62", UPPER + LOWER + DIGITS),
    ("base64", UPPER + LOWER + DIGITS + "+/"),
    ("base64url", UPPER + LOWER + DIGITS + "-_"),
)
#: Length classes of the control, shares that it and the battery may err by.
LENGTHS = (24, 32, 48, 96)
FDR, ALPHA = 0.05, 0.01
#: Share of plain writing's characters taken as uniform, as names and paths hold digits and capitals that prose lacks.
EVEN = 0.1
#: Resolution and reach of the p-value histogram, in tenths of powers of ten.
BINS, REACH = 20, 400
#: Matches that are gathered in one array before arrays are joined.
CHUNK = 256
SPAN = "struct<start:int,kind:int,end:int>"


def running(rows: Column, kind: str, start: Column, step) -> Column:
    """struct<at, out>: ``step(at, x)`` gives the next ``at`` and the elements of x, an
    array of ``kind``; ``out`` joins them.  Joining goes by chunks of CHUNK rows."""
    none = F.array().cast(f"array<{kind}>")
    last = F.greatest(F.lit(0), F.floor((F.size(rows) - 1) / CHUNK).cast("int"))
    chunks = F.transform(F.sequence(F.lit(0), last), lambda c: F.slice(rows, c * CHUNK + 1, CHUNK))

    def one(acc, x):
        at, out = step(acc["at"], x)
        return F.struct(at.alias("at"), F.concat(acc["out"], out).alias("out"))

    def many(acc, xs):
        inner = F.aggregate(xs, F.struct(acc["at"].alias("at"), none.alias("out")), one)
        return F.get(F.transform(F.array(inner), lambda r: F.struct(r["at"].alias("at"), F.concat(acc["out"], F.array(r["out"])).alias("out"))), F.lit(0))

    return F.aggregate(chunks, F.struct(start.alias("at"), F.array().cast(f"array<array<{kind}>>").alias("out")), many, lambda acc: F.struct(acc["at"].alias("at"), F.flatten(acc["out"]).alias("out")))


def found(text: Column, pattern: str, order: int, group: int = 0, least: int = 0) -> Column:
    """Matches of one kind as array<struct<start, kind, end>>.  What lies between
    matches gives their places; ``least``: of the characters of ``group``."""
    parts, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    groups = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if least else hits
    size = lambda x: F.transform(x, lambda y: F.char_length(y))
    rows = F.arrays_zip(F.slice(size(parts), 1, F.size(hits)).alias("before"), size(hits).alias("hit"), size(groups).alias("group"))

    def step(at, x):
        begin = at + x["before"]
        one = F.array(F.struct(begin.alias("start"), F.lit(order).alias("kind"), (begin + x["hit"]).alias("end")))
        return begin + x["hit"], F.when(x["group"] >= least, one).otherwise(F.array().cast(f"array<{SPAN}>"))

    return F.when(text.rlike(pattern), running(rows, SPAN, F.lit(0), step)["out"]).otherwise(F.array().cast(f"array<{SPAN}>"))


def normal_tail(z: Column) -> Column:
    """P(Z > z) by a rational approximation of the error function (7e-8)."""
    x = F.abs(z) / F.lit(2.0) ** 0.5
    t = 1 / (1 + 0.3275911 * x)
    coefficients = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)  # fixed values
    poly = reduce(lambda acc, c: (acc + c) * t, reversed(coefficients), F.lit(0.0))
    half = 0.5 * poly * F.exp(-x * x)
    return F.when(z >= 0, half).otherwise(1 - half)


def encoding(token: Column) -> Column:
    """Index of the smallest alphabet that holds a token, null for numbers."""
    out = F.lit(None).cast("int")
    for i, (_, alphabet) in reversed(list(enumerate(ENCODINGS))):
        chars = alphabet.replace("-", r"\-")
        out = F.when(token.rlike(f"^[{chars}]+$"), F.lit(i)).otherwise(out)
    return F.when(~token.rlike("^[0-9]+$"), out)


def letters_of(texts: DataFrame, text: str) -> dict[str, int]:
    """How often each letter, in either case, and each other character of the encodings
    occurs in all texts, outside of long tokens."""
    every = sorted(set("".join(a for _, a in ENCODINGS).lower()))
    rest = texts.select(F.lower(F.regexp_replace(text, TOKEN, " ")).alias("rest"))
    shorter = lambda c: F.length("rest") - F.length(F.replace(F.col("rest"), F.lit(c), F.lit("")))
    each = rest.select(*[shorter(c).alias(f"u{ord(c)}") for c in every])
    sums = each.agg(*[F.sum(c).alias(c) for c in each.columns]).first()
    return {c: sums[f"u{ord(c)}"] or 0 for c in every}


def plain_logs(counts: dict[str, int]) -> list[list[float]]:
    """Log-frequencies of plain writing, by value in each encoding."""
    out = []
    for _, alphabet in ENCODINGS:
        total = sum(counts.get(c.lower(), 0) for c in alphabet)
        out.append([math.log((1 - EVEN) * (counts.get(c.lower(), 0) / total if total else 1 / len(alphabet)) + EVEN / len(alphabet)) for c in alphabet])
    return out


def battery(df: DataFrame, token: str, code: str, logs: list[list[float]]) -> DataFrame:
    """Add ``p``, the smallest of the battery's three p-values, times three, and
    ``plain``, the p-value against plain writing."""
    alphabets = F.array(*[F.lit(a) for _, a in ENCODINGS])
    pick = lambda values: F.get(F.array(*values), F.col(code))
    means = [sum(math.exp(x) * x for x in own) / sum(map(math.exp, own)) for own in logs]
    spreads = [sum(math.exp(x) * (x - m) ** 2 for x in own) / sum(map(math.exp, own)) for own, m in zip(logs, means, strict=True)]
    table_ = pick([F.array(*map(F.lit, own)) for own in logs])
    n = F.length(token).cast("double")
    base = df.withColumn("_alphabet", F.get(alphabets, F.col(code))).withColumn("_a", F.length("_alphabet").cast("double"))
    chars = F.filter(F.split(token, ""), lambda c: c != "")
    coded = base.withColumn("_v", F.transform(chars, lambda c: (F.position(c, F.col("_alphabet")) - 1).cast("double")))
    # counts by symbol, summed as squares over the distinct ones
    square = F.aggregate(F.array_distinct("_v"), F.lit(0.0), lambda s, u: s + F.pow(F.size(F.filter("_v", lambda w: w == u)).cast("double"), F.lit(2.0)))
    mean = F.aggregate("_v", F.lit(0.0), lambda s, x: s + x) / n
    stats = coded.withColumns({"_square": square, "_mean": mean, "_pairs": F.arrays_zip(F.slice("_v", 1, F.size("_v") - 1).alias("x"), F.slice("_v", 2, F.size("_v") - 1).alias("y")), "_high": F.size(F.filter("_v", lambda x: x >= F.col("_a") / 2)).cast("double")})
    df_, chi = F.col("_a") - 1, F.col("_square") * F.col("_a") / n - n
    # mean and variance of the statistic are exact for few draws as well
    z_chi = (chi - df_) / F.sqrt(2 * df_ * (1 - 1 / n))
    low = n - F.col("_high")
    runs = 1 + F.size(F.filter("_pairs", lambda p: (p["x"] >= F.col("_a") / 2) != (p["y"] >= F.col("_a") / 2)))
    mu = 2 * F.col("_high") * low / n + 1
    z_runs = (runs - mu) / F.sqrt(F.greatest((mu - 1) * (mu - 2) / (n - 1), F.lit(1e-9)))
    dev = lambda x: x - F.col("_mean")
    lag = F.aggregate("_pairs", F.lit(0.0), lambda s, p: s + dev(p["x"]) * dev(p["y"]))
    var = F.aggregate("_v", F.lit(0.0), lambda s, x: s + dev(x) * dev(x))
    z_lag = (lag / F.greatest(var, F.lit(1e-9)) + 1 / n) * F.sqrt(n)
    p = F.least(F.lit(1.0), 3 * F.least(normal_tail(z_chi), 2 * normal_tail(F.abs(z_runs)), 2 * normal_tail(F.abs(z_lag))))
    # likelihood of plain writing; n draws have n times its mean and variance
    own = F.aggregate("_v", F.lit(0.0), lambda s, v: s + F.get(table_, v.cast("int")))
    plain = normal_tail((n * pick(list(map(F.lit, means))) - own) / F.sqrt(F.greatest(n * pick(list(map(F.lit, spreads))), F.lit(1e-9))))
    return stats.withColumns({"p": p, "plain": plain}).drop("_alphabet", "_a", "_v", "_square", "_mean", "_pairs", "_high")


def stratum(code: Column, length: Column) -> Column:
    return (code * 10 + sum((length >= x).cast("int") for x in LENGTHS)).cast("int")


def thresholds(tested: DataFrame, fdr: float = FDR) -> DataFrame:
    """(stratum, below): p-values against plain up to ``below`` reject it.  Works on a
    histogram on a log scale, so one pass and a bounded table do."""
    bins = F.least(F.lit(REACH), F.floor(-F.log10(F.greatest("plain", F.lit(1e-30))) * BINS)).cast("int")
    counts = tested.select("stratum", bins.alias("bin")).groupBy("stratum", "bin").agg(F.count(F.lit(1)).alias("n"))
    smaller = Window.partitionBy("stratum").orderBy(F.col("bin").desc())
    summed = counts.withColumns({"cum": F.sum("n").over(smaller), "m": F.sum("n").over(Window.partitionBy("stratum"))})
    upper = F.pow(F.lit(10.0), -F.col("bin") / BINS)
    return summed.filter(upper <= F.col("cum") * fdr / F.col("m")).groupBy("stratum").agg(F.max(upper).alias("below"))


def find_secrets(df: DataFrame, keep: list[str], text: str = "text", fdr: float = FDR) -> DataFrame:
    """``keep`` columns plus ``spans``: array<struct<start, kind, end>>, kind an
    index into KINDS, in order of start, then kind."""
    source = df.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("_t"))
    t = F.col("_t")
    base = F.array_sort(F.concat(found(t, ASSIGN, 0, 2, 6), found(t, ACCESS, 1), found(t, HEX, 2)))
    tokens = F.transform(found(t, TOKEN, 3), lambda s: s.withField("token", F.regexp_replace(F.substring(t, s["start"] + 1, s["end"] - s["start"]), "=+$", "")))
    free = F.filter(tokens, lambda s: encoding(s["token"]).isNotNull())
    scanned = source.withColumn("_base", base)
    clear = F.filter(free, lambda s: ~F.exists("_base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    stored = materialize(scanned.withColumn("_free", clear).withColumn("_id", F.monotonically_increasing_id()).drop("_t"), "spans")
    logs = plain_logs(letters_of(source, "_t"))
    coded = stored.select(F.explode("_free").alias("s")).select("s.token", encoding(F.col("s.token")).alias("code"))
    distinct_tests = battery(coded.distinct(), "token", "code", logs).withColumn("stratum", stratum(F.col("code"), F.length("token")))
    tested = materialize(distinct_tests.select("token", "p", "plain", "stratum"), "tested")
    secret = tested.join(F.broadcast(thresholds(tested, fdr)), "stratum").filter((F.col("plain") <= F.col("below")) & (F.col("p") >= ALPHA)).select(F.col("token").alias("_secret"))
    spans = stored.select("_id", F.explode("_free").alias("s")).join(secret, F.col("s.token") == F.col("_secret"))
    more = spans.groupBy(F.col("_id").alias("_o")).agg(F.collect_list(F.struct(F.col("s.start").alias("start"), F.lit(3).alias("kind"), F.col("s.end").alias("end"))).alias("_more"))
    joined = stored.join(more, F.col("_id") == F.col("_o"), "left")
    return joined.select(*keep, F.array_sort(F.concat("_base", F.coalesce("_more", F.array().cast("array<struct<start:int,kind:int,end:int>>")))).alias("spans"))


def spell(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op6_secrets(spark, sf_dir: str) -> DataFrame:
    out = find_secrets(table(spark, sf_dir, "documents"), ["doc_id"])
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return out.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(spell(F.filter("spans", lambda s: s["kind"] < 3)), 256).alias("base_sha256"), spell(F.col("spans")).alias("spans"))
