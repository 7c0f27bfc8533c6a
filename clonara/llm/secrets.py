"""Secret scan: base patterns, and a battery of randomness tests on other long tokens.

Everything is a built-in column expression. A regular expression sets marks around its matches, the text is split at
the marks, and running lengths of the pieces are the places. Tokens of 20 or more characters outside the base spans
get an encoding, the smallest usual alphabet they fit in, and p values of four tests of the hypothesis that their
characters were drawn evenly from it: chi-squared on characters and on character classes, runs about the middle of the
alphabet, and correlation of neighbours. The least p value decides, as the chance that the least of four is so small.

Text has tiny p values. Those of random tokens are nearly even, but not quite: the tests depend on each other and short
tokens have few different counts. So the same battery runs on tokens drawn evenly from every encoding at every class of
lengths (``null_bins``). In each class of lengths the number of random tokens is estimated, per encoding, from the p
values over a quarter and the share that drawn tokens have there, and the bound is the least p value at which no more
than ``FALSE_SHARE`` of the tokens above it are expected to be text: the tests are weak on short tokens, so these need
a higher bound or get none.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clonara.llm.common import stage

#: Kinds in the order in which spans of equal start are listed, with the pattern that marks them.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A run of the last two classes is as long as it can be, so asking for the length finds the same matches.
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
TOKEN = r"[A-Za-z0-9+/_-]{20,}={0,2}"
KINDS = ("assign", "access", "hex", "random")

#: Lower ends of the classes of lengths.
LENGTHS = (20, 24, 32, 48, 96)
FALSE_SHARE = 0.1
BINS = 100
#: Number of random tokens is estimated from this bin on.
ESTIMATE_FROM = 25
#: Tokens drawn for each encoding and class of lengths; longest token drawn.
DRAWN, LONGEST_DRAWN = 1500, 160

_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Name, alphabet and the pattern of tokens that fit, smallest alphabet first.
ENCODINGS = (
    ("hex", _DIGITS + "abcdef", "^[0-9a-f]+$"),
    ("hex upper", _DIGITS + "ABCDEF", "^[0-9A-F]+$"),
    ("base32", _UPPER + "234567", "^[A-Z2-7]+$"),
    ("base36", _DIGITS + _LOWER, "^[0-9a-z]+$"),
    ("base36 upper", _DIGITS + _UPPER, "^[0-9A-Z]+$"),
    ("base62", _DIGITS + _UPPER + _LOWER, "^[0-9A-Za-z]+$"),
    ("base64", _UPPER + _LOWER + _DIGITS + "+/", "^[A-Za-z0-9+/]+$"),
    ("base64url", _UPPER + _LOWER + _DIGITS + "-_", "^[A-Za-z0-9_-]+$"),
)
_CHUNK = 64


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("int"), lambda a, x: a + x)


def _running(values: Column, start: Column) -> Column:
    """Sums of the values before each place, plus ``start``."""
    empty = F.struct(start.cast("int").alias("at"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(values, empty, lambda a, x: F.struct((a["at"] + x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")), lambda a: a["out"])


def starts(lengths: Column) -> Column:
    """Place of each piece, from the lengths of all; in chunks, so that long lists are not copied for every item."""
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / _CHUNK).cast("int")), lambda c: F.slice(lengths, c * _CHUNK + 1, _CHUNK))
    firsts = _running(F.transform(chunks, _sum), F.lit(0))
    return F.flatten(F.zip_with(chunks, firsts, _running))


def _marked(text: Column, pattern: str) -> Column:
    """Pieces of the text, every second one a match."""
    return F.split(F.regexp_replace(text, pattern, "\x01$0\x01"), "\x01", -1)


def _spans(pieces: str, keep) -> Column:
    """Structs (start, stop, value) of the matches among marked pieces that ``keep`` accepts."""
    p = F.col(pieces)
    at = starts(F.transform(p, F.length))
    pairs = F.arrays_zip(p.alias("value"), at.alias("start"))
    matches = F.filter(pairs, lambda x, i: (i % 2 == 1) & keep(x["value"]))
    spans = F.transform(matches, lambda x: F.struct(x["start"].alias("start"), (x["start"] + F.length(x["value"])).alias("stop"), x["value"].alias("value")))
    return F.when(F.size(p) > 1, spans).otherwise(F.array().cast("array<struct<start:int, stop:int, value:string>>"))


def _let(value: Column, of) -> Column:
    """``of`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), of), 1)


def _two_sided(z: Column) -> Column:
    """Two-sided p value of a standard normal value, by a logistic approximation."""
    p = lambda a: F.least(F.lit(1.0), 2.0 / (1.0 + F.exp(1.5976 * a + 0.070566 * a * a * a)))
    return _let(F.least(F.abs(z), F.lit(20.0)), p)


def encoding_of(body: Column) -> Column:
    """The first encoding that a token without its closing equals signs fits in, as a struct; null if none."""
    found = []
    for name, alphabet, fits in ENCODINGS:
        shares = [F.lit(sum(c in group for c in alphabet) / len(alphabet)).alias(k) for k, group in (("upper", _UPPER), ("lower", _LOWER))]
        found.append(F.when(body.rlike(fits), F.struct(F.lit(name).alias("name"), F.lit(alphabet).alias("alphabet"), F.lit(float(len(alphabet))).alias("m"), *shares)))
    return F.coalesce(*found)


def _characters_even(body: Column, n: Column, m: Column) -> Column:
    """Chi-squared of the characters' counts, less its mean, over its deviation for n draws."""
    distinct = F.array_distinct(F.split(body, "(?<=.)(?=.)"))
    squares = F.aggregate(distinct, F.lit(0.0), lambda a, c: a + F.pow(n - F.length(F.replace(body, c, F.lit(""))), F.lit(2.0)))
    return (squares * m / n - n - (m - 1)) / F.sqrt(2 * (m - 1) * (n - 1) / n)


def _classes_even(body: Column, n: Column, code: Column) -> Column:
    """p value of chi-squared on the counts of upper case, lower case and all else."""
    upper, lower = (F.length(F.regexp_replace(body, f"[^{group}]", "")).cast("double") for group in (_UPPER, _LOWER))
    parts = ((upper, code["upper"]), (lower, code["lower"]), (n - upper - lower, 1 - code["upper"] - code["lower"]))
    squares = reduce(lambda a, b: a + b, [F.when(share > 0, F.pow(have - n * share, F.lit(2.0)) / (n * share)).otherwise(F.lit(0.0)) for have, share in parts])
    both = (code["upper"] > 0) & (code["lower"] > 0)
    return _let(squares, lambda x: F.when(both, F.exp(-x / 2)).otherwise(_two_sided(F.sqrt(x))))


def _runs(x: Column, n: Column, m: Column) -> Column:
    """Runs above and below the middle of the alphabet, against their number in random order."""
    def test(high: Column) -> Column:
        changes = F.aggregate(F.sequence(F.lit(1), F.size(high) - 1), F.lit(0.0), lambda a, i: a + F.abs(F.get(high, i) - F.get(high, i - 1)))

        def against(n1: Column) -> Column:
            mean = 1 + 2 * n1 * (n - n1) / n
            spread = (mean - 1) * (mean - 2) / (n - 1)
            return F.when(spread > 0, (1 + changes - mean) / F.sqrt(spread)).otherwise(F.lit(30.0))

        return _let(F.aggregate(high, F.lit(0.0), lambda a, v: a + v), against)

    return _let(F.transform(x, lambda v: F.when(v >= m / 2, 1.0).otherwise(0.0)), test)


def _serial(x: Column, n: Column) -> Column:
    """Correlation of neighbouring characters' places, corrected for its mean of -1 / n."""
    def test(d: Column) -> Column:
        var = F.aggregate(d, F.lit(0.0), lambda a, v: a + v * v)
        cov = F.aggregate(F.sequence(F.lit(1), F.size(d) - 1), F.lit(0.0), lambda a, i: a + F.get(d, i) * F.get(d, i - 1))
        return _let(var, lambda v: F.when(v > 0, (cov / v + 1 / n) * F.sqrt(n)).otherwise(F.lit(30.0)))

    mean = F.aggregate(x, F.lit(0.0), lambda a, v: a + v) / n
    return _let(mean, lambda mu: _let(F.transform(x, lambda v: v - mu), test))


def judged(token: Column) -> Column:
    """Struct (p, code): p value of a token under even drawing from its alphabet, zero if it fits none, and its encoding."""
    def tests(t: Column) -> Column:
        body, code, n = t["body"], t["code"], t["n"]
        places = F.transform(F.split(body, "(?<=.)(?=.)"), lambda c: F.position(c, code["alphabet"]).cast("double") - 1.0)
        least = _let(places, lambda x: F.least(_two_sided(_characters_even(body, n, code["m"])), _classes_even(body, n, code), _two_sided(_runs(x, n, code["m"])), _two_sided(_serial(x, n))))
        p = F.when(code.isNull(), F.lit(0.0)).otherwise(1 - F.pow(1 - least, F.lit(4.0)))
        return F.struct(p.alias("p"), code["name"].alias("code"))

    whole = lambda body: F.struct(body.alias("body"), encoding_of(body).alias("code"), F.length(body).cast("double").alias("n"))
    return _let(F.regexp_replace(token, "=+$", ""), lambda body: _let(whole(body), tests))


def battery(token: Column) -> Column:
    """p value of a token under even drawing from its alphabet; zero if it fits no alphabet."""
    return judged(token)["p"]


def _length_class(token: Column) -> Column:
    return reduce(lambda a, low: F.when(F.length(token) >= low, F.lit(low)).otherwise(a), LENGTHS, F.lit(0))


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, base, others): base spans with kind number; other long tokens with p value and class of length."""
    text = F.replace(F.coalesce(F.col("text"), F.lit("")), F.lit("\x01"), F.lit("\x02"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    rows = rows.select("doc_id", *[_marked(F.col("text"), p).alias(n) for n, p in (("assign", ASSIGN), ("access", ACCESS), ("hex", HEX), ("random", TOKEN))])
    every = lambda v: F.lit(True)
    keeps = {"assign": lambda v: F.length(F.regexp_extract(v, ASSIGN, 1)) >= 12}
    rows = rows.select("doc_id", *[_spans(n, keeps.get(n, every)).alias(n) for n in KINDS])
    of_kind = lambda k: lambda s: F.struct(s["start"].alias("start"), F.lit(k).alias("kind"), s["stop"].alias("stop"))
    listed = F.concat(*[F.transform(n, of_kind(k)) for k, n in enumerate(KINDS[:3])])
    rows = rows.withColumn("base", F.array_sort(listed))
    free = F.filter("random", lambda s: ~F.exists("base", lambda b: (b["start"] < s["stop"]) & (s["start"] < b["stop"])))
    others = F.transform(free, lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), judged(s["value"]).alias("j"), _length_class(s["value"]).alias("length")))
    others = F.transform(others, lambda o: F.struct(o["start"].alias("start"), o["stop"].alias("stop"), o["j"]["p"].alias("p"), o["j"]["code"].alias("code"), o["length"].alias("length")))
    return rows.select("doc_id", "base", others.alias("others"))


def _binned(rows: DataFrame, *keys: str) -> dict[tuple, list[int]]:
    """Number of rows by bin of their p value, for each of the keys; the keys have few values."""
    binned = rows.select(*keys, F.least(F.floor(F.col("p") * BINS), F.lit(BINS - 1)).cast("int").alias("bin"))
    counts: dict[tuple, list[int]] = {}
    for r in binned.groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n")).collect():
        counts.setdefault(tuple(r[k] for k in keys), [0] * BINS)[r.bin] = r.n
    return counts


def null_bins(spark: SparkSession, drawn: int = DRAWN) -> dict[tuple, list[int]]:
    """Bins of the p values of tokens drawn evenly, by (class of lengths, encoding); the draws are hashes of their number."""
    ends = [*LENGTHS[1:], LONGEST_DRAWN + 1]
    spans = F.array(*[F.struct(F.lit(low).alias("low"), F.lit(end - low).alias("wide")) for low, end in zip(LENGTHS, ends)])
    codes = F.array(*[F.struct(F.lit(alphabet).alias("alphabet"), F.lit(len(alphabet)).alias("m")) for _, alphabet, _ in ENCODINGS])
    rows = spark.range(drawn * len(ENCODINGS), numPartitions=16).withColumn("code", F.element_at(codes, (F.col("id") % len(ENCODINGS)).cast("int") + 1))
    rows = rows.select("id", "code", F.explode(spans).alias("span"))
    size = (F.col("span.low") + F.pmod(F.xxhash64("id", "span.low"), F.col("span.wide"))).cast("int")
    letter = lambda i: F.substr(F.col("code.alphabet"), (F.pmod(F.xxhash64("id", "span.low", i), F.col("code.m")) + 1).cast("int"), F.lit(1))
    tokens = rows.select(F.array_join(F.transform(F.sequence(F.lit(1), size), letter), "").alias("value"))
    return _binned(tokens.select(_length_class(F.col("value")).alias("length"), judged(F.col("value")).alias("j")).select("length", "j.code", "j.p"), "length", "code")


def bounds(found: DataFrame) -> dict[int, float]:
    """For each class of lengths, the p value above which tokens count as random; classes without one are left out.

    At most ``BINS`` counts for each of the classes and encodings come to the driver.
    """
    others = found.select(F.explode("others").alias("o")).select("o.length", "o.code", "o.p")
    counts = _binned(others, "length", "code")
    if not any(sum(n[ESTIMATE_FROM:]) for n in counts.values()):
        return {}
    null = null_bins(found.sparkSession)
    found_bounds = {}
    for length in sorted({length for length, _ in counts}):
        here = [(n, null[length, code]) for (other, code), n in counts.items() if other == length and (length, code) in null]
        random = [(sum(n[ESTIMATE_FROM:]) * sum(even) / max(1, sum(even[ESTIMATE_FROM:])), even) for n, even in here]
        most = min(1.0, sum(sum(n) for n, _ in here) / max(1.0, sum(r for r, _ in random)))
        for b in range(1, BINS // 2 + 1):
            above = sum(sum(n[b:]) for n, _ in here)
            expected = most * sum(r * sum(even[b:]) / sum(even) for r, even in random)
            if above and 1 - expected / above <= FALSE_SHARE:
                found_bounds[length] = b / BINS
                break
    return found_bounds


def find_secrets(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_assign, n_access, n_hex (base spans), base_sha256, spans (base spans and random tokens).

    Spans are kind:start:end by start, then kind, in code points. A null text is empty. Repeated rows give repeated
    results; a null doc_id stays null. U+0001 in a text is an ordinary character. Other columns are not read.
    """
    found = stage(scan(docs), "secrets")
    least = bounds(found)
    accepted = lambda o: reduce(lambda a, b: a | ((o["length"] == b[0]) & (o["p"] >= b[1])), sorted(least.items()), F.lit(False))
    random = F.filter("others", accepted)
    more = F.transform(random, lambda o: F.struct(o["start"].alias("start"), F.lit(3).alias("kind"), o["stop"].alias("stop")))
    item = lambda s: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1), s["start"].cast("string"), s["stop"].cast("string"))
    text = lambda spans: F.array_join(F.transform(spans, item), ",")
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
                        F.sha2(text(F.col("base")).cast("binary"), 256).alias("base_sha256"), text(F.array_sort(F.concat("base", more))).alias("spans"))
