import random
from collections import Counter

import numpy as np
import pytest

from geopatch.llm import common, language_id, line_dedup, suffix_dedup

WORDS = {"en": "the of and to in that it was for with his they at be this from have", "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein"}


def sentence(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang].split()) for _ in range(n))


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(1)
    rows = [(i, sentence(rng, lang := rng.choice(["en", "de"]), rng.randint(5, 40)), lang, "s") for i in range(400)]
    rows += [(1000, None, "en", "s"), (1001, "", None, "s"), (1002, "12 34 !!", "de", "s"), (1003, sentence(rng, "de", 30), None, None), (None, sentence(rng, "en", 30), "en", "s"), (5, "zzz", "en", "s"), (1004, sentence(rng, "en", 20000), "en", "s")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")


def test_languages_of_held_out_texts(labelled):
    rows = language_id.identify(labelled).collect()
    assert len(rows) == labelled.count()
    got = {r["doc_id"]: r for r in rows}
    held = [r for r in labelled.collect() if r["doc_id"] is not None and r["doc_id"] < 400 and got[r["doc_id"]]["held_out"]]
    assert len(held) > 80
    assert sum(got[r["doc_id"]]["lang_pred"] == r["lang"] for r in held) >= 0.97 * len(held)
    assert [got[i]["lang_pred"] for i in (1000, 1001, 1002, 1003, None, 1004)] == ["und", "und", "und", "de", "en", "en"]
    assert all(0 <= r["score"] <= 1 for r in rows)
    kept = language_id.known(labelled)
    assert kept.columns == labelled.columns
    ids = {r["doc_id"] for r in kept.collect()}
    assert not ids & {1000, 1001, 1002}
    assert len(ids) > 380


def test_counts_are_of_all_texts(spark):
    texts = ["Aba ab", "ab é🙂x", None, ""]
    df = spark.createDataFrame([("a", t) for t in texts], "lang string, text string").repartition(3)
    want = Counter()
    for t in texts:
        for w in language_id.letters(t or ""):
            marked = [1, 1, 1, *[ord(c) if ord(c) < 65536 else 0xE000 + ord(c) % 6400 for c in w], 2]
            for i in range(len(marked) - 3):
                want[sum(s << 16 * (3 - k) for k, s in enumerate(marked[i : i + 4]))] += 1
    assert {r["code"] % (1 << 64): r["n"] for r in language_id.count_ngrams(df).collect()} == want


def plain_kneser_ney(words):
    """Interpolated Kneser-Ney by its definition: the log probability of a symbol after the three before it."""
    counts = {4: Counter()}
    for w, n in words.items():
        marked = [1, 1, 1, *map(ord, w), 2]
        for i in range(len(marked) - 3):
            counts[4][tuple(marked[i : i + 4])] += n
    for k in (3, 2, 1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    ones, twos = ({k: sum(n == m for n in counts[k].values()) for k in counts} for m in (1, 2))
    discount = {k: ones[k] / (ones[k] + 2 * twos[k]) if ones[k] and twos[k] else 0.5 for k in counts}

    def p(gram):
        k = len(gram)
        if not k:
            return 1 / (len(counts[1]) + 1)
        own = {g: n for g, n in counts[k].items() if g[:-1] == gram[:-1]}
        if not own:
            return p(gram[1:])
        total = sum(own.values())
        return max(own.get(gram, 0) - discount[k], 0) / total + discount[k] * len(own) / total * p(gram[1:])

    return p


@pytest.mark.parametrize("shard", [language_id.SHARD, 7])
def test_models_against_the_definition(spark, shard):
    words = {"a": Counter({"abc": 3, "abd": 2, "b": 5, "cab": 1, "dd": 1, "abcd": 2, "dcba": 1}), "b": Counter({"xa": 2, "xx": 1, "aé": 4})}
    rows = [(lang, " ".join(w for w, n in own.items() for _ in range(n))) for lang, own in words.items()]
    models = language_id.fit(spark.createDataFrame(rows, "lang string, text string"))
    texts = ["abc", "zebra abcd", "xaé", "ABC, x1x", "1 ²½", "", None, "dcb " * 3000, "dcb " * 3000]
    docs = spark.createDataFrame(list(enumerate(texts)), "k1 long, text string")
    got = {r["k1"]: r for r in language_id.score(docs, models, keep=["k1"], shard=shard).collect()}
    plain = {lang: plain_kneser_ney(own) for lang, own in words.items()}
    assert len(got) == len(texts)
    for k, text in enumerate(texts):
        own = [w for w in "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()]
        if not own:
            assert (got[k]["lang_pred"], got[k]["score"], got[k]["bits"]) == ("und", 0, None)
            continue
        grams = [tuple(m[i : i + 4]) for w in own[:6] for m in [[1, 1, 1, *map(ord, w), 2]] for i in range(len(m) - 3)]
        cross = {lang: -sum(np.log(p(g)) for g in grams) / len(grams) for lang, p in plain.items()}
        n = sum(len(w) + 1 for w in own)
        assert got[k]["lang_pred"] == min(cross, key=cross.get) and got[k]["n_symbols"] == n
        assert got[k]["bits"] == pytest.approx(min(cross.values()) / np.log(2), rel=1e-9)
        assert got[k]["score"] == pytest.approx(1 / sum(np.exp(-(x - min(cross.values())) * min(n, 64)) for x in cross.values()), rel=1e-6)


def test_texts_like_none_learnt_are_rejected(spark):
    rng = random.Random(11)
    rows = [(i, sentence(rng, lang, 30), lang) for i, lang in enumerate(["en", "de"] * 450)] + [(5000, "qzxv kwqj xxqz vvkq " * 20, None), (5001, "²½① 12", None)]
    got = {r["doc_id"]: r for r in language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert not got[5000]["accepted"] and got[5001]["lang_pred"] == "und" and not got[5001]["accepted"]
    assert sum(got[i]["accepted"] for i in range(900)) >= 895


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert [r["lang_pred"] for r in language_id.identify(docs).collect()] == ["und"]
    assert language_id.identify(docs.limit(0)).count() == 0


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, before[j] + 1, before[j - 1] + (x != y)))
    return row[-1]


def units(line):
    words = line.split()
    return (words, 1) if len(words) >= line_dedup.WORDS else (line, 2 * (len(line) >= line_dedup.CHARS))


def brute_lines(rows):
    first = {}
    for i, text in rows:
        for n, line in enumerate((text or "").split("\n")):
            if line.strip():
                first.setdefault(line.strip(), (i, n))
    near = set()
    for a, p in first.items():
        for b, q in first.items():
            (x, k), (y, m) = units(a), units(b)
            if q < p and k == m and k and abs(len(x) - len(y)) < 2 and distance(x, y) <= 1:
                near.add(a)
    out = {}
    for i, text in rows:
        kept = [(n, x) for n, x in enumerate((text or "").split("\n")) if not x.strip() or (first[x.strip()] == (i, n) and x.strip() not in near)]
        out[i] = None if text is None else "\n".join(x for _, x in kept)
    return out


@pytest.mark.parametrize("shuffled", [False, True])
def test_lines_against_all_pairs(spark, monkeypatch, shuffled):
    if shuffled:
        monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    rng = random.Random(3)
    lines = [sentence(rng, "en", rng.randint(1, 14)) for _ in range(25)] + ["a b c d e f g h i j", "b c d e f g h i j a", "page 1 of the long book that has ten words", "page 2 of the long book that has ten words", "page 3 of the long book that has ten words"]
    for _ in range(25):
        words = rng.choice(lines).split()
        k = rng.randrange(len(words))
        lines.append(" ".join(rng.choice([words[:k] + words[k + 1 :], [*words[:k], "new", *words[k + 1 :]], [*words[:k], "new", *words[k:]]])))
    for _ in range(25):
        line = rng.choice([x for x in lines if len(x.split()) < 10])
        k = rng.randrange(len(line))
        lines.append(rng.choice([line[:k] + line[k + 1 :], line[:k] + "é" + line[k + 1 :], line[:k] + "ß" + line[k:]]))
    rows = [(i, "\n".join(rng.choice(["", " ", "\t"]) + rng.choice(lines) if rng.random() < 0.9 else "" for _ in range(rng.randint(1, 8)))) for i in range(40)]
    rows += [(100, None), (101, ""), (102, "\n\n"), (103, "w " * 2000 + "\n" + "v " + "w " * 1999)]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, row int, gone int").repartition(4)
    left = line_dedup.dedup(docs).cache()
    assert left.columns == ["doc_id", "text", "row", "gone", "n_lines", "n_exact", "n_near"]
    got = {r["doc_id"]: r for r in left.collect()}
    want = brute_lines(rows)
    assert {i: r["text"] for i, r in got.items()} == want
    assert got[103]["n_near"] == 1 and got[100]["n_lines"] == 0


@pytest.mark.parametrize("kind", [1, 2])
def test_lines_one_edit_apart_share_a_part(kind):
    rng = random.Random(5)
    for n in [*range(10, 80), 300]:
        for _ in range(20):
            a = [rng.choice("abcdefgh") for _ in range(n)]
            k = rng.randrange(n)
            b = rng.choice([a[:k] + a[k + 1 :], [*a[:k], "x", *a[k + 1 :]], [*a[:k], "x", *a[k:]]])
            own = [[w.encode() for w in x] if kind == 1 else "".join(x) for x in (a, b)]
            assert set(line_dedup.parts(own[0], kind)) & set(line_dedup.parts(own[1], kind))
            assert set(line_dedup.variants(own[0], kind).tolist()) & set(line_dedup.variants(own[1], kind).tolist())


def test_null_ids_with_the_same_short_hash(spark):
    """Two texts without an id whose 32-bit hashes are equal stay apart."""
    made = "concat(repeat(concat('word', id, ' '), 3), 'line of text\nshared line of text number one\nown ', id * id)"
    pair = spark.range(300000).selectExpr(f"{made} as text").selectExpr("text", "hash(text) as h").groupBy("h").agg({"text": "collect_list"}).toDF("h", "texts").where("size(texts) > 1").first()["texts"][:2]
    docs = spark.createDataFrame([(None, t) for t in pair] + [(None, pair[0] + "\n" + "abc " * 100), (None, "abc " * 100)], "doc_id long, text string")
    got = sorted(r["text"] for r in line_dedup.dedup(docs).select("text").collect())
    assert sum("shared line" in t for t in got) == 1 and sum(t.count("own") for t in got) == 2
    sizes = sorted(r["n_bytes"] for r in suffix_dedup.remove_repeats(docs).collect())
    assert sizes == sorted(len(r["text"].encode()) for r in docs.collect())


def test_repeated_rows_keep_the_same_lines(spark):
    docs = spark.createDataFrame([(1, "one\ntwo"), (1, "one\ntwo"), (2, "two\nthree"), (None, "three"), (3, "four")], "doc_id long, text string")
    got = sorted((r["doc_id"] or -1, r["text"]) for r in line_dedup.dedup(docs).collect())
    assert got == [(-1, "three"), (1, "one\ntwo"), (1, "one\ntwo"), (2, ""), (3, "four")]
    assert line_dedup.dedup(docs.limit(0)).count() == 0


def test_one_apart_is_the_edit_distance():
    rng = random.Random(4)
    for _ in range(3000):
        a, b = ([rng.choice("xyz") for _ in range(rng.randint(0, 6))] for _ in range(2))
        assert line_dedup.one_apart(a, b) == (distance(a, b) <= 1)


def brute_repeats(texts, size):
    seen = Counter(t[k : k + size] for t in texts for k in range(len(t) - size + 1))
    out = []
    for t in texts:
        mark = np.zeros(len(t), bool)
        for k in range(len(t) - size + 1):
            if seen[t[k : k + size]] > 1:
                mark[k : k + size] = True
        out.append(mark)
    return out


@pytest.mark.parametrize("hot", [suffix_dedup.HOT, 1])
def test_repeats_against_all_passages(spark, hot):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randint(2, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared, periodic = prose(80), "ab" * 300
    texts = [prose(rng.randint(0, 200)) for _ in range(20)]
    texts += [prose(10) + " " + shared[rng.randint(0, 60) :] + prose(rng.randint(0, 30)) for _ in range(12)]
    texts += [periodic, "x" + periodic[:250], "", None, "short", texts[0], texts[0], shared + " " + shared, "\x00" * 450, shared[:199], shared[:200]]
    docs = spark.createDataFrame([(i, t, 3) for i, t in enumerate(texts)] + [(None, texts[1], 3)], "doc_id long, text string, row int").repartition(3)
    rows = sorted(((r["doc_id"], r["text"] or "") for r in docs.collect()), key=lambda r: (r[0] is None, r[0]))
    marks = brute_repeats([t.encode() for _, t in rows], suffix_dedup.PASSAGE)
    got = sorted(suffix_dedup.remove_repeats(docs, hot=hot).collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"]))
    assert len(got) == len(rows)
    for (i, t), mark, r in zip(rows, marks, got, strict=True):
        data = np.frombuffer(t.encode(), np.uint8)
        assert (r["doc_id"], r["n_bytes"], bytes(r["kept"])) == (i, len(data), data[~mark].tobytes())
        assert [(x["s"], x["e"]) for x in r["removed"]] == [(x["s"], x["e"]) for x in suffix_dedup.runs(mark)]


def test_blocks_of_a_long_text(spark, monkeypatch):
    rng = random.Random(7)
    data = np.frombuffer("".join(rng.choice("ab") for _ in range(5000)).encode(), np.uint8)
    whole = [np.concatenate(x) for x in zip(*suffix_dedup.anchors(data), strict=True)]
    monkeypatch.setattr(suffix_dedup, "BLOCK", 700)
    parts = [np.concatenate(x) for x in zip(*suffix_dedup.anchors(data), strict=True)]
    of = lambda x: np.repeat(x[0], x[3] - x[2])
    assert (of(whole) == of(parts)).all()
    assert suffix_dedup.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_suffixes_are_in_order():
    rng = random.Random(8)
    for _ in range(200):
        data = bytes(rng.choice(b"\x01abc") for _ in range(rng.randint(1, 60))) + b"\0" * 12
        wanted = np.zeros(len(data), bool)
        wanted[[k for k in range(len(data) - 12) if rng.random() < 0.6]] = True
        order = suffix_dedup.suffix_order(np.frombuffer(data, np.uint8), wanted, 12)
        assert sorted(order.tolist()) == np.flatnonzero(wanted).tolist()
        keys = [data[p : p + 12] for p in order]
        assert keys == sorted(keys)
