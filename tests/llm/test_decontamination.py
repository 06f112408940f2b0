"""Benchmark decontamination against a plain version, and questions with other parameters."""

import math
import random
import re

from pyspark.sql import functions as F

from geopatch.llm import common, decontamination
from geopatch.llm.decontamination import COVERAGE, OPENERS, RUN, UNITS, WINDOW

ITEM = "If Maria buys 12 apples and gives 5 apples to Peter on the market, how many of the 12 apples does Maria still have in her basket then?"


def plain_words(text):
    """Lower-case words, none of which is a slot."""
    return [(w.lower(), None, False) for w in re.findall(r"[^\W_]+", text or "")]


def plain_tokens(text):
    """Words, numbers and names as (lower case, placeholder or None, whether it is a slot)."""
    out, rest = [], re.findall(r"[^\W_]+|[^\w]|_", text or "")
    while rest:
        part = rest.pop(0)
        sign = part in "+-" and rest and rest[0].isdigit() and rest[0].isascii() and not (out and out[-1] == "")
        if sign or (part.isdigit() and part.isascii()):
            number = part + (rest.pop(0) if sign else "")
            while len(rest) > 1 and rest[0] in ".,'" and rest[1].isdigit() and rest[1].isascii():
                number += rest.pop(0) + rest.pop(0)
            out.append((number, "n", True))
        elif part[0].isalnum():
            name = part[0].isupper() and part.lower() not in OPENERS
            while name and len(rest) > 1 and rest[0] == " " and rest[1][0].isupper() and rest[1].lower() not in OPENERS:
                part += rest.pop(0) + rest.pop(0)
            number = part[0] in "0123456789"
            before = next((x for x in reversed(out) if x), None)
            unit = part in UNITS and before is not None and before[0].lstrip("+-")[0] in "0123456789"
            out.append((part.lower(), "n" if number else "m" if name else "u" if unit else None, number or name or part in UNITS))
        if rest and out and out[-1] != "":
            out.append("")
        if part and not part[0].isalnum() and not sign and out and out[-1] == "":
            out.pop()
    return [x for x in out if x]


def brute(docs, items):
    """Every window of every item against every window of every document."""
    found = set()
    for doc_id, text in set(docs):
        for item_id, item_text in set(items):
            counts, longest = [], 0
            for tokens in (plain_words, plain_tokens):
                own, item, typed = tokens(text), tokens(item_text), tokens is plain_tokens
                size = min(WINDOW, len(item))
                total, passages = len(item) - size + 1 if item else 0, {}
                for i in range(total):
                    there = item[i : i + size]
                    if 2 * sum(t[1] is not None for t in there) > size:
                        continue
                    for p in range(len(own) - size + 1):
                        here = own[p : p + size]
                        if [x or w for w, x, _ in here] == [x or w for w, x, _ in there]:
                            passages.setdefault(p - i, []).append((i, {(a[0], b[0]) for a, b in zip(there, here) if a[2]}))
                marks = {}
                for shift, hits in passages.items():
                    pairs = set().union(*(p for _, p in hits))
                    if not typed or len({a for a, _ in pairs}) == len(pairs) == len({b for _, b in pairs}):
                        marks[shift] = {i for i, _ in hits}
                eligible = total if not typed or any(2 * sum(t[1] is not None for t in item[i : i + size]) <= size for i in range(total)) else 0
                counts += [eligible, len(set().union(*marks.values())) if marks else 0]
                longest = max(longest, max(map(len, marks.values()), default=0))
            enough = lambda n, total: n >= max(1, math.ceil(COVERAGE * total - 1e-9))
            if enough(counts[1], counts[0]) or enough(counts[3], counts[2]) or longest >= RUN:
                found.add((doc_id, item_id, *counts, longest))
    return found


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def changed(text, names):
    numbers = {}
    text = re.sub(r"\d+", lambda m: numbers.setdefault(m[0], str(1000 * (1 + len(numbers)) + int(m[0]))), text)
    return re.sub("|".join(names), lambda m: names[m[0]], text)


def frames(spark, docs, items):
    return spark.createDataFrame([(*d, 0, "x") for d in docs], "doc_id long, text string, k1 int, item string"), spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, key int")


ITEMS = [
    (1, ITEM),
    (2, "The capital of the old kingdom was moved three times before the river changed its course and the harbour fell dry."),
    (3, None),
    (4, "What is 17 times 23?"),
    (5, "3 4 5 6 7 8 9 10 11"),
    (6, "Tom has 3 red marbles. Tom buys 2 more marbles from Ann. How many marbles does Tom have?"),
    (7, "?!"),
    (8, "one word after another " * 40),
    (None, "an item without an id of its own, about 14 km of road"),
    (10, "A shop sells 12.50 kg of rice for 1,200 dollars to Maria Lopez and the rest to Tom for -3 dollars less."),
    (11, "Mary Ann Smith walks 3 km to town. How long does Mary Ann Smith walk?"),
]
ANNA = changed(ITEM, {"Maria": "Anna", "Peter": "Paul"})
OLGA = changed(ITEM.replace("12", "44"), {"Maria": "Olga", "Peter": "Igor"})
DOCS = [
    (10, "Some words first. " + ITEM + " And more."),
    (11, "intro, " + ANNA),
    (12, ITEM.replace("buys 12", "buys 31")),
    (13, "Nothing of the kind stands in this clean text about apples and markets."),
    (14, None),
    (15, ""),
    (16, ITEMS[1][1].upper()),
    (17, f"{ANNA} Between the two stands this. {OLGA}"),
    (18, "they asked: what is 17 times 23? and then: What is 5 times 9"),
    (19, "a table 3 4 5 6 7 8 9 10 11 12 and 3,4 5 6 7.5 8 9 10 11"),
    (20, changed(ITEMS[5][1], {"Tom": "Bob", "Ann": "Eve"})),
    (21, "word after another one " * 12),
    (22, "an item without an id of its own, about 99 miles of road"),
    (None, "no id but " + ITEM),
    (23, " ".join(["filler"] * 1000) + " " + ITEM + " filler" * 1000),
    (24, f"{ITEM} {ITEM} " * 20),
    (25, "A shop sells 9 kg of rice for 800 dollars to Ann and the rest to Karl Otto Braun for +1,7 dollars less."),
    (26, "Bob walks 10.5 km to town. How long does Bob walk?"),
    (27, "A shop sells 9 kg of rice for 9 dollars to Ann and the rest to Ann for 9 dollars less."),
]


HELD = brute(DOCS, ITEMS)


def test_every_window_against_every_window(spark):
    docs, items = frames(spark, [*DOCS, DOCS[0]], [*ITEMS, ITEMS[0]])
    df = decontamination.contaminated(docs, items)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan), plan
    got = rows_of(df)
    assert len(got) == len(set(got)) and set(got) == HELD
    held = {(r[0], r[1]) for r in got}
    assert {(10, 1), (11, 1), (16, 2), (17, 1), (18, 4), (19, 5), (20, 6), (22, None), (None, 1), (23, 1), (24, 1)} <= held
    assert not {12, 13, 14, 15} & {a for a, _ in held if a != 12}
    assert (25, 10) in held and (26, 11) in held and (27, 10) not in held


def test_without_broadcasts(spark, monkeypatch):
    some = [d for d in DOCS if d[0] in (10, 11, 12, 17)], ITEMS[:2]
    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    assert set(rows_of(decontamination.contaminated(*frames(spark, *some)))) == brute(*some)


def test_clean_judges_each_row_and_keeps_columns(spark):
    docs, items = frames(spark, [*DOCS, (10, "another text under the same id")], ITEMS)
    left = decontamination.clean(docs, items)
    assert left.columns == docs.columns
    found = {(d, t) for d, t in DOCS if d in {r[0] for r in HELD}}
    assert sorted((str(r["doc_id"]), r["text"] or "") for r in left.collect()) == sorted((str(d), t or "") for d, t in [*set(DOCS), (10, "another text under the same id")] if (d, t) not in found)
    assert decontamination.contaminated(docs, items.limit(0)).count() == 0
    assert decontamination.contaminated(docs.limit(0), items).count() == 0
    assert decontamination.clean(docs, items.limit(0)).count() == docs.count()


def test_recall_on_other_parameters(spark):
    rng = random.Random(1)
    words = [a + b for a in "ba de fi go lu mer nos pal rin tus".split() for b in "ka lo mi net rus".split()]
    names = ["Maria", "Peter Lund", "Olga", "Tom", "Ann Mary Bell", "Karl", "Eve Roth", "Bob"]
    shapes = ["{}", "{}.5", "1,{}00", "-{}", "2.{}25", "{},000,000"]

    def number():
        return rng.choice(shapes).format(rng.randrange(2, 99))

    def fill(parts, who):
        values = {}
        return " ".join(values.setdefault(p, number()) if p.startswith("#") else who.get(p, p) for p in parts) + "?"

    def question():
        return rng.choices(words, k=4) + sum(([f"@{rng.randrange(4)}", rng.choice(words), f"#{rng.randrange(6)}", *rng.choices(words, k=rng.randrange(3, 6))] for _ in range(rng.randrange(2, 5))), [])

    def distinct(parts, who):
        while True:
            text = fill(parts, who)
            found = re.findall(r"[+-]?\d[\d.,]*", text)
            if len(set(found)) == len({p for p in parts if p.startswith("#")}):
                return text

    first, second = ({f"@{k}": n for k, n in enumerate(own)} for own in (names[:4], names[4:]))
    parts = [question() for _ in range(80)]
    items = [(k, distinct(p, first)) for k, p in enumerate(parts)]
    docs = [(k, " ".join(rng.choices(words, k=50)) + ". " + distinct(p, second) + " " + distinct(p, {**second, "@0": "Xenia"})) for k, p in enumerate(parts)]
    docs += [(1000 + k, " ".join(rng.choices(words + names, k=120))) for k in range(60)]
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.contaminated(*frames(spark, docs, items)).collect()}
    assert len({(k, k) for k, _ in items} & got) >= 0.9 * len(items)
    assert not [d for d, _ in got if d >= 1000]


def test_tokens_and_kinds_of_odd_words(spark):
    text = "-3.5 of iPhone +12,000 Ärger Anna Maria The x-1 3rd ... Ǆ ߀ß 5 kg, "
    row = spark.createDataFrame([(text,)], "text string").select(decontamination.tokens_of(F.col("text")).alias("tokens"), decontamination.typed_of(F.col("text")).alias("typed"))
    typed = ["-3.5", "of", "iPhone", "+12,000", "Ärger Anna Maria", "The", "x", "1", "3rd", "Ǆ", "߀ß", "5", "kg"]
    kinds = row.select(F.explode("typed").alias("t")).select("t", decontamination.is_number(F.col("t")).alias("number"), decontamination.is_name(F.col("t")).alias("name")).collect()
    assert [r["t"] for r in kinds] == typed
    assert {r["t"] for r in kinds if r["number"]} == {"-3.5", "+12,000", "1", "3rd", "5"}
    assert {r["t"] for r in kinds if r["name"]} == {"Ärger Anna Maria", "Ǆ"}
    assert row.first()["tokens"][:5] == ["3", "5", "of", "iphone", "12"] and "" not in row.first()["tokens"]
    hashed = decontamination.coded(row).first()
    assert [h for h in hashed["typed1"] if h % 2] == [1, 1, 3, 1, 1, 3, 1, 5]
    assert len(hashed["typed8"]) == len(typed)


def test_long_runs_of_names_and_numbers(spark):
    names, numbers = " ".join(["Anna", "Åsa", "Ǆ"] * 20_000), ",".join(["12", "3"] * 30_000)
    texts = {1: f"of {names} The {names}", 2: f"{numbers} and -{numbers}.5abc 1,2x 7x", 3: f"{names} {ITEM} {numbers}", 4: f"{numbers}\n{names}"}
    docs, items = frames(spark, list(texts.items()), [(1, ITEM)])
    typed = {r["doc_id"]: r["typed"] for r in docs.select("doc_id", decontamination.typed_of(F.col("text")).alias("typed")).collect()}
    assert typed[1] == ["of", names, "The", names]
    assert typed[2] == [numbers, "and", f"-{numbers}", "5abc", "1", "2x", "7x"]
    assert sorted(r["doc_id"] for r in decontamination.clean(docs, items).collect()) == [1, 2, 4]
