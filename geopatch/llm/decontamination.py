"""Benchmark decontamination by canonical template windows.

Numbers, names and units become typed placeholders, so that a benchmark item
whose parameters were changed has the same windows as the original.  Windows
are joined by their hashes, once word for word and once with placeholders;
where placeholders stand for other values than in the item, the values must
correspond one to one throughout the passage.  Everything is built from
DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geopatch.llm.common import few, kept, row_key, settled, source

#: Tokens in a window; an item of fewer tokens is one window of its own length.
WINDOW = 8
#: Kinds of window hashes: word for word, and with placeholders.
KINDS = ("exact", "typed")
#: Share of an item's windows that a document must hold, or as many windows of it as this in one passage.
COVERAGE, RUN = 0.3, 24
#: Words that are units when they follow a number.
UNITS = (
    "mm cm m km mg g kg t ml cl l s ms min h hour hours minute minutes second seconds day days week weeks month months year years "
    "meter meters metre metres kilometer kilometers mile miles foot feet inch inches yard yards gram grams kilogram kilograms pound pounds ounce ounces "
    "liter liters litre litres gallon gallons dollar dollars cent cents euro euros percent degree degrees"
).split()
#: Words that are no names where they begin a sentence.
OPENERS = (
    "a an the this that these those there here it its he she they we you i my your our his her their in on at by for from to of with as if when while where who what which why how "
    "is are was were be do does did can could will would should may might has have had not no yes and or but so then than after before since because each every all some any one "
    "let suppose assume given find compute calculate show prove write name list choose "
    "der die das ein eine in im am um wenn wie was wer wo und oder el la los las un una en de si y o le les des du et ou que qui"
).split()


#: A number with its sign and separators; a run of capitalised words that are no openers; any other word.
#: Groups repeat without going back: Java's matcher calls itself for every turn of a group that may, so long runs would overflow its stack.
NUMBER = r"(?<![\p{L}\p{N}])[+-]?[0-9]++(?![\p{L}\p{N}])(?:[.,'][0-9]++(?![\p{L}\p{N}]))*+"
CAPITAL = r"(?=\p{Lu})(?!(?i:" + "|".join(OPENERS) + r")(?![\p{L}\p{N}]))[\p{L}\p{N}]+"
#: What begins with a small letter of ASCII is neither number nor name and is taken first, as most words are such; the looks ahead only save time.
TYPED = rf"[a-z]++[\p{{L}}\p{{N}}]*+|(?=[+\-0-9]){NUMBER}|(?=\p{{Lu}})(?<![\p{{L}}\p{{N}}]){CAPITAL}(?: {CAPITAL})*+|[\p{{L}}\p{{N}}]+"


def tokens_of(text: Column) -> Column:
    """Runs of letters and digits in lower case."""
    return F.array_remove(F.split(F.lower(text), r"[^a-z\p{L}\p{N}]+"), "")


def typed_of(text: Column) -> Column:
    """Numbers, names of one or more words, and other words, as they stand."""
    return F.regexp_extract_all(text, F.lit(TYPED), F.lit(0))


def is_number(token: Column) -> Column:
    """Whether it begins with a digit, after a sign or none.  Strings are compared by bytes, so two comparisons settle most words."""
    digit = lambda x: (x >= "0") & (x < ":")
    return digit(token) | ((token < ".") & (token >= "+") & digit(F.substring(token, 2, 1)))


def is_name(token: Column) -> Column:
    first = F.substring(token, 1, 1)
    capital = ((token >= "A") & (token < "[")) | ((token >= "\u0080") & (F.lower(first) != first))
    return capital & ~F.lower(token).isin(OPENERS)


def is_slot(token: Column) -> Column:
    return is_number(token) | is_name(token) | token.isin(UNITS)


def coded(rows: DataFrame) -> DataFrame:
    """Adds ``exact1``, odd hashes of the column ``tokens``, and ``typed1``, even ones of ``typed``, with small odd numbers as placeholders; and both over runs of 2, 4 and 8."""

    def of(token: Column, i: Column) -> Column:
        unit = token.isin(UNITS) & F.coalesce(is_number(F.get("typed", i - 1)), F.lit(False))
        word = F.when(unit, 5).otherwise(F.xxhash64(F.lower(token)).bitwiseAND(F.lit(-2).cast("long")))
        return F.when((token >= "a") & (token < "\u0080"), word).when(is_number(token), 1).when(is_name(token), 3).otherwise(word)

    rows = rows.withColumn("exact1", F.transform("tokens", lambda t: F.xxhash64(t).bitwiseOR(F.lit(1).cast("long"))))
    rows = rows.withColumn("typed1", F.transform("typed", of))
    for size in (1, 2, 4):
        for kind in KINDS:
            rows = rows.withColumn(f"{kind}{2 * size}", doubled(f"{kind}{size}", size))
    return rows


def doubled(hashes: str, size: int) -> Column:
    return F.zip_with(hashes, F.slice(hashes, F.lit(size + 1), F.size(hashes)), lambda x, y: F.xxhash64(x, y))


def windows(kind: str, size: int) -> Column:
    """The hash of every run of ``size`` tokens, up to 8, from the hashes of runs of powers of two; none if there are fewer."""
    parts = [k for k in (8, 4, 2, 1) if size & k]
    starts = [sum(parts[:n]) for n in range(len(parts))]
    first = f"{kind}{parts[0]}"
    whole = F.col(first) if len(parts) == 1 else F.transform(first, lambda x, i: F.xxhash64(x, *[F.get(f"{kind}{k}", i + at) for k, at in zip(parts[1:], starts[1:], strict=True)]))
    return F.slice(whole, F.lit(1), F.greatest(F.size(f"{kind}1") - (size - 1), F.lit(0)))


def benchmark_windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``key, kind, size, item, item_id, item_pos, item_tokens, n_windows`` of a benchmark's items; items without words have none.

    Words and typed tokens have windows of their own.  Those of typed tokens
    are there if at least half of their tokens are literal.
    """
    items = benchmark.select(benchmark[id_col].alias("item_id"), F.coalesce(benchmark[text_col], F.lit("")).alias("text")).distinct()
    items = items.select(F.xxhash64("item_id", "text").alias("item"), "item_id", tokens_of(F.col("text")).alias("tokens"), typed_of(F.col("text")).alias("typed")).where(F.size("tokens") > 0)
    rows = []
    for kind, own in zip(KINDS, ("tokens", "typed"), strict=True):
        sized = coded(items).withColumn("size", F.least(F.size(own), F.lit(WINDOW)))
        hashes = F.coalesce(*[F.when(F.col("size") == k, windows(kind, k)) for k in range(1, WINDOW + 1)])
        each = sized.select("item", "item_id", own, "typed1", "size", F.posexplode(hashes).alias("item_pos", "key"))
        if kind != KINDS[0]:
            slots = F.size(F.filter(F.slice("typed1", F.col("item_pos") + 1, F.col("size")), lambda x: x.bitwiseAND(F.lit(1).cast("long")) == 1))
            each = each.where(2 * slots <= F.col("size"))
        total = (F.size(own) - F.col("size") + 1).cast("long")
        rows.append(each.select("key", F.lit(kind).alias("kind"), "size", "item", "item_id", "item_pos", F.slice(own, F.col("item_pos") + 1, F.col("size")).alias("item_tokens"), total.alias("n_windows")))
    return kept(rows[0].unionByName(rows[1]))


def matches(rows: DataFrame, right: DataFrame) -> DataFrame:
    """``k1, k2, doc_id, pos, size, item, item_pos, n_windows, word_for_word`` of the windows of ``rows(k1, k2, doc_id, text)`` that stand in the benchmark.

    All window hashes of a row are one array, family after family (one for each
    size and kind), so that only places and hashes are spread out.
    """
    found = right.select("size", "kind").distinct().collect()
    families = sorted((r["size"], r["kind"]) for r in found) or [(WINDOW, KINDS[0])]
    hashed = coded(rows.select("k1", "k2", "doc_id", tokens_of(F.col("text")).alias("tokens"), typed_of(F.col("text")).alias("typed")))
    sizes = F.struct(*[F.size(f"{kind}1").alias(kind) for kind in KINDS]).alias("n")
    spread = hashed.select("k1", "k2", "doc_id", sizes, F.posexplode(F.concat(*[windows(kind, size) for size, kind in families])).alias("i", "key"))
    numbers = F.coalesce(*[F.when((F.col("size") == size) & (F.col("kind") == kind), F.lit(k)) for k, (size, kind) in enumerate(families)])
    met = spread.join(few(right.drop("item_tokens", "item_id")), "key").withColumn("family", numbers)
    counts = [F.greatest(F.col("n")[kind] - (size - 1), F.lit(0)) for size, kind in families]
    before = F.get(F.array(*[sum(counts[:k], F.lit(0)) for k in range(len(families))]), F.col("family"))
    own = F.get(F.array(*counts), F.col("family"))
    placed = met.withColumn("pos", F.col("i") - before).where((F.col("pos") >= 0) & (F.col("pos") < own))
    return kept(placed.select("k1", "k2", "doc_id", "pos", "size", "item", "item_pos", "n_windows", (F.col("kind") == KINDS[0]).alias("word_for_word")).distinct())


def found_items(docs: DataFrame, benchmark: DataFrame, coverage: float, run: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``contaminated`` with ``k1, k2``, 128 bits that stand for a document's id and text."""
    rows = source(docs, id_col, text_col).select(*row_key(F.col("doc_id"), F.col("text")), "doc_id", "text")
    right = benchmark_windows(benchmark)
    hits = matches(rows, right)
    spots = ["k1", "k2", "item", "shift"]
    hits = hits.withColumn("shift", F.col("pos") - F.col("item_pos"))
    alike = hits.where("not word_for_word")
    asked = alike.groupBy("k1", "k2").agg(F.collect_set(F.struct("pos", "size")).alias("asked"))
    texts = rows.select("k1", "k2", "text").join(few(kept(asked)), ["k1", "k2"]).select("k1", "k2", "asked", typed_of(F.col("text")).alias("typed"))
    slices = F.transform("asked", lambda a: F.struct(a["pos"].alias("pos"), a["size"].alias("size"), F.slice("typed", a["pos"] + 1, a["size"]).alias("here")))
    there = texts.select("k1", "k2", F.inline(slices)).distinct()
    items = right.where(F.col("kind") != KINDS[0]).select("item", "item_pos", "item_tokens")
    both = alike.join(there, ["k1", "k2", "pos", "size"]).join(few(items), ["item", "item_pos"])
    pairs = F.filter(F.zip_with("item_tokens", "here", lambda a, b: F.struct(F.lower(a).alias("a"), F.lower(b).alias("b"), is_slot(a).alias("slot"))), lambda x: x["slot"])
    slots = both.select(*spots, pairs.alias("pairs")).groupBy(*spots).agg(F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("pairs"))
    kinds = lambda side: F.size(F.array_distinct(F.col("pairs")[side]))
    one_to_one = slots.where((kinds("a") == F.size("pairs")) & (kinds("b") == F.size("pairs"))).select(*spots)
    held = ["k1", "k2", "doc_id", "item", "shift", "item_pos", "word_for_word"]
    marks = hits.where("word_for_word").select(*held).unionByName(alike.join(one_to_one, spots).select(*held))

    passage = ["k1", "k2", "item", "word_for_word"]
    marks = kept(marks)
    longest = marks.select(*passage, "shift", "item_pos").distinct().groupBy(*passage, "shift").count().groupBy(*passage).agg(F.max("count").alias("run"))
    places = marks.select(*passage, "item_pos").distinct().groupBy(*passage).agg(F.count("*").alias("n")).join(longest, passage)
    counts = places.groupBy("k1", "k2", "item").agg(*[F.coalesce(F.max(F.when(F.col("word_for_word") == exact, F.col("n"))), F.lit(0).cast("long")).alias(name) for exact, name in ((True, "n_exact"), (False, "n_typed"))], F.max("run").alias("n_run"))
    totals = right.groupBy("item", "item_id").agg(*[F.coalesce(F.max(F.when(F.col("kind") == kind, F.col("n_windows"))), F.lit(0).cast("long")).alias(name) for kind, name in zip(KINDS, ("n_windows", "n_typed_windows"), strict=True)])
    named = counts.join(few(totals), "item").join(marks.select("k1", "k2", "doc_id").distinct(), ["k1", "k2"])
    enough = lambda n, total: F.col(n) >= F.greatest(F.lit(1), F.ceil(coverage * F.col(total) - 1e-9))
    result = named.where(enough("n_exact", "n_windows") | enough("n_typed", "n_typed_windows") | (F.col("n_run") >= run))
    return result.select("k1", "k2", "doc_id", "item_id", "n_windows", "n_exact", "n_typed_windows", "n_typed", "n_run")


def contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, run: int = RUN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document and benchmark item it holds: ``doc_id, item_id, n_windows, n_exact, n_typed_windows, n_typed, n_run``.

    n_windows counts the windows of an item's words, n_exact those of them that
    stand in the document, whatever their case.  For n_typed_windows and
    n_typed a number with its sign and separators is one token and so is a run
    of capitalised words, and other numbers, names and units may stand in their
    place.  A passage is what stands at one distance from the item's tokens:
    within a passage, every value of the item must have one counterpart in the
    document and the other way round, else its typed windows do not count; so
    two copies of an item with different values do not spoil each other.  n_run
    is the most windows of one kind in one passage.  A document holds an item if
    n_exact or n_typed reaches ``coverage`` of its windows, or n_run reaches
    ``run``.  An item of fewer than WINDOW tokens is one window.  Windows of
    which less than half is literal are found word for word only.

    Null and empty texts, items without words and an empty benchmark match
    nothing; null ids are reported as null; rows with the same id and text
    give one result, and so do repeated items.
    """
    return found_items(docs, benchmark, coverage, run, id_col, text_col).drop("k1", "k2")


def clean(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, run: int = RUN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, with their columns; rows with a null id are judged like any others."""
    with settled(docs.sparkSession):
        gone = kept(found_items(docs, benchmark, coverage, run, id_col, text_col).select("k1", "k2").distinct())
    gone = few(gone)
    k1, k2 = row_key(docs[id_col], F.coalesce(docs[text_col], F.lit("")))
    return docs.join(gone, (k1 == gone["k1"]) & (k2 == gone["k2"]), "left_anti")
