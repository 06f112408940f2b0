"""Secret scans: fixed patterns, and a randomness test battery over other tokens.

Everything is built from DataFrame functions.  Pattern spans come from the
pieces between the matches, whose lengths add up to positions.  The battery
takes long mixed tokens outside the patterns' spans, infers each one's encoding
from its symbols, and tests whether the symbols look drawn at random from that
alphabet.  The same tests run over decoys, ordinary names made of neighbouring
words of the same texts and a number.  A token is reported as ``random`` if it
passes at a level that so few decoys of its lengths pass that the share of
ordinary tokens among those reported stays below the false discovery rate.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geopatch.llm.common import few, kept, source, text_key

#: The patterns, in the order of their kinds.
PATTERNS = {
    "assign": r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"[0-9a-f]{32,}",
}
KINDS = [*PATTERNS, "random"]
#: What a token that the battery tests looks like, and what it must contain.
TOKEN, MIXED = r"[A-Za-z0-9+/_-]{20,}", r"(?=.*[0-9])(?=.*[A-Za-z])"
#: Neighbouring words that make a decoy.
WORDS = r"[A-Za-z]{2,14}(?: [A-Za-z]{2,14}){3,9}"
#: The least p of a token that is reported, whatever the decoys.
LEVEL = 0.001
#: Alphabets in the order in which they are tried; the first that has all symbols of a token is its encoding.
ALPHABETS = {
    "hex": "0123456789abcdef",
    "upper_hex": "0123456789ABCDEF",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "lower36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "upper36": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "base62": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base64url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
    "any": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_",
}
SPAN = "array<struct<start:int,rank:int,end:int,token:string>>"


def _matches(rank: int, pattern: str, good: Callable[[Column], Column]) -> Column:
    """An array of ``rank, i, gap, size, good, token`` of every match of a pattern in ``text``; gap is the length of the piece before it."""
    pairs = F.arrays_zip(F.regexp_extract_all("text", F.lit(pattern), F.lit(0)).alias("m"), F.split("text", pattern, -1).alias("piece"))
    of = lambda x, i: F.struct(F.lit(rank).alias("rank"), i.alias("i"), F.length(x["piece"]).alias("gap"), F.length(x["m"]).alias("size"), good(x["m"]).alias("good"), x["m"].alias("token"))
    none = F.array().cast("array<struct<rank:int,i:int,gap:int,size:int,good:boolean,token:string>>")
    return F.when(F.col("text").rlike(pattern), F.filter(F.transform(pairs, of), lambda x: x["token"].isNotNull())).otherwise(none)


def found_spans(texts: DataFrame) -> DataFrame:
    """``k1, k2, start, rank, end, token`` of the good matches of all kinds in each distinct text of ``texts(k1, k2, text)``.

    A match's place is the sum of all pieces and matches before it, over a
    window in the order of the matches, so the work is linear in them.  Copies
    of a text are put together before anything is summed.
    """
    good = {"assign": lambda m: F.length(F.regexp_extract(m, PATTERNS["assign"], 1)) >= 8, "access": lambda m: F.length(m) >= 16, "hex": lambda m: F.lit(True), "random": lambda m: m.rlike(MIXED)}
    each = F.concat(*[_matches(k, {**PATTERNS, "random": TOKEN}[kind], good[kind]) for k, kind in enumerate(KINDS)])
    rows = texts.select("k1", "k2", F.inline(each))
    keys = ["k1", "k2", "rank", "i"]
    once = rows.groupBy(*keys).agg(*[F.first(c).alias(c) for c in ("gap", "size", "good", "token")])
    before = Window.partitionBy("k1", "k2", "rank").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    placed = once.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(before).cast("int"))
    return placed.where("good").select("k1", "k2", (F.col("end") - F.col("size")).alias("start"), "rank", "end", "token")


def apart(spans: DataFrame) -> DataFrame:
    """The spans of the last kind that overlap none of the others of their text.

    With all spans in order, the furthest end of the others that begin before
    and the nearest begin of those that begin after are running values.
    """
    text = Window.partitionBy("k1", "k2")
    own = F.col("rank") < len(PATTERNS)
    reach = F.max(F.when(own, F.col("end"))).over(text.orderBy("start", "rank").rowsBetween(Window.unboundedPreceding, 0))
    following = F.min(F.when(own, F.col("start"))).over(text.orderBy(F.desc("start"), F.asc("rank")).rowsBetween(Window.unboundedPreceding, 0))
    rows = spans.withColumns({"reach": reach, "following": following}).where(~own)
    return rows.where(~(F.coalesce(F.col("reach") > F.col("start"), F.lit(False)) | F.coalesce(F.col("following") < F.col("end"), F.lit(False)))).select("k1", "k2", "start", "rank", "end", "token")


def erfc(x: Column) -> Column:
    """The complementary error function for x >= 0, to about 1e-7."""
    t = 1 / (1 + 0.3275911 * x)
    return t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * F.exp(-x * x)


def battery(tokens: DataFrame) -> DataFrame:
    """Adds encoding, n and p_chi, p_runs, p_serial, p to ``tokens(token)``.

    Uniformity: chi-squared over the whole alphabet, by its mean and variance
    under random draws.  Runs: of symbols of one class (capitals, small
    letters, digits, others), against what the alphabet's classes give at
    random.  Serial correlation: of the symbols' codes, lag one.  All are
    two-sided; where a statistic has no spread its p is 1 for the runs, and 0
    for the correlation (all symbols equal).  p is the smallest of the three,
    corrected for their number.
    """
    kind = F.coalesce(*[F.when(F.col("token").rlike(f"^[{a.replace('-', '') + '-' * ('-' in a)}]+$"), F.lit(k)) for k, a in ALPHABETS.items()])
    same = {k: sum((sum(f(c) for c in a) / len(a)) ** 2 for f in (str.isupper, str.islower, str.isdigit, lambda c: not c.isalnum())) for k, a in ALPHABETS.items()}
    of = lambda values: F.coalesce(*[F.when(F.col("encoding") == k, F.lit(float(v))) for k, v in values.items()])
    rows = tokens.withColumn("encoding", kind).withColumns({"m": of({k: len(a) for k, a in ALPHABETS.items()}), "same": of(same), "n": F.length("token"), "symbols": F.split("token", "")})
    total = lambda array: F.aggregate(array, F.lit(0.0), lambda a, x: a + x)
    n, before = F.col("n").cast("double"), F.slice("v", F.lit(1), F.col("n") - 1)
    times = lambda c: F.col("n") - F.length(F.replace(F.col("token"), c, F.lit("")))
    rows = rows.withColumns(
        {
            "chi": F.col("m") / n * total(F.transform(F.array_distinct("symbols"), lambda c: (times(c) * times(c)).cast("double"))) - n,
            "runs": F.regexp_count("token", F.lit("[A-Z]+|[a-z]+|[0-9]+|[^A-Za-z0-9]+")),
            "v": F.transform("symbols", lambda c: F.ascii(c).cast("double")),
        }
    )
    rows = rows.withColumn("mean", total(F.col("v")) / n)
    spread = lambda x: F.sqrt(F.nullif(F.greatest(x, F.lit(0.0)), F.lit(0.0)))
    from_mean = lambda x: x - F.col("mean")
    rows = rows.withColumns(
        {
            "z_chi": F.abs(F.col("chi") - (F.col("m") - 1)) / spread(2 * (F.col("m") - 1) * (n - 1) / n),
            "z_runs": F.abs(F.col("runs") - 1 - (n - 1) * (1 - F.col("same"))) / spread((n - 1) * F.col("same") * (1 - F.col("same"))),
            "var": total(F.transform("v", lambda x: from_mean(x) * from_mean(x))),
            "cov": total(F.zip_with(before, F.slice("v", F.lit(2), F.col("n") - 1), lambda x, y: from_mean(x) * from_mean(y))),
        }
    )
    z_serial = F.abs(F.col("cov") / F.nullif(F.col("var"), F.lit(0.0)) + 1 / n) * F.sqrt(n)
    tail = lambda z, none: F.least(F.lit(1.0), F.coalesce(erfc(z / math.sqrt(2)), F.lit(none)))
    rows = rows.withColumns({"p_chi": tail(F.col("z_chi"), 0.0), "p_runs": tail(F.col("z_runs"), 1.0), "p_serial": tail(z_serial, 0.0)})
    return rows.select(*tokens.columns, "encoding", "n", "p_chi", "p_runs", "p_serial", F.least(F.lit(1.0), 3 * F.least("p_chi", "p_runs", "p_serial")).alias("p"))


def decoys(rows: DataFrame) -> DataFrame:
    """Distinct ordinary names of all sizes, ``token``: neighbouring words of the texts of ``rows(text)`` and a number, joined as a name is in a program."""
    found = rows.where(F.col("text").rlike(WORDS)).select(F.explode(F.regexp_extract_all("text", F.lit(WORDS), F.lit(0))).alias("words"))
    draw = lambda k, m: F.pmod(F.xxhash64(F.lit(k), "words"), F.lit(m))
    joined = F.when(draw(1, 3) == 0, F.replace(F.lower("words"), F.lit(" "), F.lit("_"))).when(draw(1, 3) == 1, F.replace(F.initcap("words"), F.lit(" "), F.lit(""))).otherwise(F.replace(F.lower("words"), F.lit(" "), F.lit("-")))
    number = F.substring(draw(4, 100000000).cast("string"), F.lit(1), (1 + draw(2, 8)).cast("int"))
    name = F.concat(F.substring(joined, F.lit(1), (16 + draw(3, 64)).cast("int")), number)
    return found.select(name.alias("token")).where(F.length("token") >= 20).distinct()


def random_tokens(tested: DataFrame, ordinary: DataFrame, rate: float = 0.01) -> DataFrame:
    """The tokens of ``tested`` that look random, at a false discovery rate against ``ordinary``: ``token``.

    Both have the columns of ``battery``.  Classes are lengths up to 31, 63, ...
    p values are counted in bins of a tenth of a decade.  The tokens of a bin
    and those above are reported if the share of ordinary tokens that pass
    there (the decoys that do and one more, of all), were all tokens of the
    class ordinary, is at most ``rate`` of those reported; p must reach LEVEL.  Classes without decoys have
    none.  Only counts per class and bin, at most a few hundred rows, are ordered.
    """
    binned = {"size": F.floor(F.log2("n")).cast("int"), "bin": F.least(F.lit(40), F.floor(-10 * F.log10(F.greatest("p", F.lit(1e-30))))).cast("int")}
    rows = tested.withColumns(binned)
    counted = rows.select("size", "bin", F.lit(1).alias("t"), F.lit(0).alias("d")).unionByName(ordinary.withColumns(binned).select("size", "bin", F.lit(0).alias("t"), F.lit(1).alias("d")))
    counts = kept(counted.groupBy("size", "bin").agg(F.sum("t").alias("t"), F.sum("d").alias("d")))
    upper = counts.select("size", F.col("bin").alias("other"), F.col("t").alias("more_t"), F.col("d").alias("more_d"))
    within = F.col("other") <= F.col("bin")
    sums = counts.join(upper, "size").groupBy("size", "bin").agg(*[F.sum(F.when(within, F.col(f"more_{c}")).otherwise(0)).alias(c) for c in "td"], *[F.sum(f"more_{c}").alias(f"all_{c}") for c in "td"])
    false = (F.col("d") + 1) / F.col("all_d") * F.col("all_t")
    limits = sums.where((F.col("all_d") > 0) & (F.col("t") > 0) & (false <= rate * F.col("t")) & (F.col("bin") <= -10 * math.log10(LEVEL))).groupBy("size").agg(F.max("bin").alias("limit"))
    return rows.join(F.broadcast(limits), "size").where(F.col("bin") <= F.col("limit")).select("token")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float = 0.01) -> DataFrame:
    """``doc_id, base, random`` for every row: arrays of ``start, rank, end, token`` in code points, end exclusive.

    Pattern matches are leftmost and do not overlap within a kind; an ``assign``
    value needs 8 characters and an ``access`` key 16, or the match is dropped.
    rank is the kind's place in KINDS.  Null and empty texts have empty arrays.
    Repeated rows give repeated results; a token or decoy counts once in the
    false discovery control, however many texts hold it.  Where the texts give
    too few decoys to bound the rate, no token is reported as random.
    """
    texts = source(docs, id_col, text_col)
    rows = texts.select("doc_id", "text", *text_key(F.col("text")))
    found = kept(found_spans(rows))
    alone = kept(apart(found))
    tested = kept(battery(alone.select("token").distinct()))
    left = few(kept(random_tokens(tested, battery(decoys(texts)), rate)))
    held = found.where(F.col("rank") < len(PATTERNS)).unionByName(alone.join(left, "token", "left_semi"))
    span, own = F.struct("start", "rank", "end", "token"), F.col("rank") < len(PATTERNS)
    lists = held.groupBy("k1", "k2").agg(*[F.array_sort(F.collect_list(F.when(of, span))).alias(name) for name, of in (("base", own), ("random", ~own))])
    none = F.array().cast(SPAN)
    joined = kept(rows.select("doc_id", "k1", "k2")).join(few(kept(lists)), ["k1", "k2"], "left")
    return joined.select("doc_id", F.coalesce("base", none).alias("base"), F.coalesce("random", none).alias("random"))


def named(spans: Column) -> Column:
    """``kind:start:end`` of spans by start, then kind as listed, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", F.get(names, x["rank"]), x["start"].cast("string"), x["end"].cast("string"))), ",")
