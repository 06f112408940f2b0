"""Phrase collocations, archives and the source audit against plain versions."""

import glob
import hashlib
import io
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import zstandard

from geopatch.llm import collocations, divergence, warc

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def phrases_plainly(rows, least=10, top=2000):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in (1, 2, 3):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, own in f.items():
        cand = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in cand.items():
            if len(p) == 2 and any(len(q) == 3 and p in (q[:2], q[1:]) and 100 * b >= 50 * a for q, b in cand.items()):
                continue
            cuts = [(10**6 * a * a // (own[p[:k]] * own[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            found.append((-score, -a, " ".join(p).encode(), a, own[p[:k]], own[p[k:]], n[lang], score))
        out += [(lang, i, x[2].decode(), *x[3:]) for i, x in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    words = ["the", "Of", "new", "york", "city", "ÀB", "àb", "x\x0bsplit", "a-b", "İ", "K", "\x00", "\x1c", "z y"]
    rows = []
    for k in range(300):
        text = "".join(rng.choices(words, [9, 6, 4, 4, 3, 2, 2, 1, 1, 1, 1, 1, 1, 1])[0] + rng.choice([" ", " ", " ", "\t ", ", ", ".", "\n", "?! "]) for _ in range(rng.randint(0, 60)))
        rows.append((rng.choice(["en", "en", "", None, "fr"]), rng.choice(["s1", "s1", "s1", "s2", "s3", None, ""]), text, k))
    rows += [("en", "s1", None, 1), ("fr", None, "", 2), (None, None, None, None), ("de", "s9", "only words here", 3), ("de", "s8", "", 4)]
    rows += [("en", "s1", "New York city. " * 30, 5)] * 3 + [("en", "s2", "the of new york " * 3000, 6)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "lang string, source string, text string, prefix long").repartition(3)


@pytest.mark.parametrize("hot", [16_384, 50])
def test_phrases(spark, texts, monkeypatch, hot):
    monkeypatch.setattr(collocations, "HOT_LEAST", hot)
    monkeypatch.setattr(collocations, "HOT_SHARES", 10**9)
    got = sorted(tuple(r) for r in collocations.collocations(frame(spark, texts)).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())
    assert got == phrases_plainly([(r[0], r[2]) for r in texts])
    assert any(" " in r[2].partition(" ")[2] for r in got)


def test_few_phrases_of_each_language_and_a_full_filter(spark, texts, monkeypatch):
    monkeypatch.setattr(collocations, "FILTER_BITS", 64)
    got = sorted(tuple(r) for r in collocations.collocations(frame(spark, texts), top=5).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())
    assert got == phrases_plainly([(r[0], r[2]) for r in texts], top=5)


def test_no_phrases(spark, texts):
    assert collocations.collocations(frame(spark, texts).limit(0)).count() == 0
    assert collocations.collocations(frame(spark, [("en", "s", None, 1), ("en", "s", "one two", 2)])).count() == 0


def test_words_are_cut_at_ends_of_pieces_only(monkeypatch):
    monkeypatch.setattr(collocations, "SEGMENT", 7)
    text = "aa bb cc dd ee. ff gg, hh" + " ii" * 20 + "."
    parts = list(collocations.words_of(text.encode()))
    assert len(parts) > 1 and all(p[-1] == collocations.BREAK for p in parts)
    plain = [w for w in sum(parts, []) if w != collocations.BREAK]
    assert plain == re.findall(rb"\w+", text.encode())


def test_counts_beyond_64_bits(spark):
    rows = spark.createDataFrame([(5 * 10**14, 6 * 10**14, 7 * 10**14), (10, 10, 10)], "a long, l long, r long")
    assert [r[0] for r in rows.select(collocations.quotient("a", "l", "r")).collect()] == [10**6 * 25 // 42, 10**6]


PAGE = "page_id long, url string, html string, digest string, first long"


@pytest.fixture(scope="module")
def pages():
    long, other = "ä" * 60, "page " * 300_000
    return [(1, "http://a\r\nX-Page-ID: 9", "short"), (2, None, "short"), (9, "http://b", long), (4, "http://c", long), (7, "u", long), (3, "u", None), (5, "u", ""), (6, "u", other), (8, "u", other + "."), (10, "u", "\r\n\r\nWARC/1.1\r\n" * 20), (None, "u", long), (11, "u", "n" * 99), (12, "u", "n" * 99), (13, "u", "n" * 100), (14, "u", "n" * 100), (4, "http://d", long), (None, "u", "none" * 30), (None, "v", "none" * 30), (14, "u", "m" * 100), (15, "u", "m" * 100)]


def test_records_come_back(spark, pages):
    df = spark.createDataFrame([(*p, "x", 7) for p in pages], PAGE)
    got = sorted((tuple(r) for r in warc.report(df).collect()), key=str)
    least = {}
    for page, _, html in pages:
        if page is not None and len((html or "").encode()) >= 100:
            least[html] = min(page, least.get(html, page))
    want = []
    for page, _, html in pages:
        raw, first = (html or "").encode(), least.get(html or "")
        want.append((page, len(raw), hashlib.sha256(raw).hexdigest(), "response" if first in (None, page) else "revisit", None if first in (None, page) else first))
    assert got == sorted(want, key=str)
    assert warc.report(df.limit(0)).count() == 0


def test_archives_are_seekable(spark):
    rng = random.Random(1)
    pages = [(k, f"http://h/{k}", "".join(rng.choices("abcdefghij <>", k=rng.randint(0, 2000)))) for k in range(300)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(2)
    index, folder = warc.archive(df, frame=3000, size=20_000)
    files = glob.glob(folder.removeprefix("file:") + "/*.warc.zst")
    assert len(files) > 2
    records = 0
    for path in files:
        with open(path, "rb") as f:
            raw = f.read()
        plain = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw), read_across_frames=True).read()
        assert plain.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")
        at = 0
        while at < len(plain):
            _, _, at = warc.parse(memoryview(plain), at)
            records += 1
        assert int.from_bytes(raw[-4:], "little") == warc.SEEKABLE
    assert records == 300 + len(files)
    wanted = index.where("page_id in ('7', '123', '299')")
    assert sorted((int(r["page_id"]), r["payload"].decode()) for r in warc.fetch(wanted, folder).collect()) == [(p[0], p[2]) for p in pages if p[0] in (7, 123, 299)]
    assert index.where("frame > 3").count() > 0


def audit_plainly(rows, least=30, top=50):
    n, df, groups = Counter(), Counter(), defaultdict(set)
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        n.update((lang, source, t) for t in terms)
        df.update((lang, t) for t in set(terms))
    out = []
    for lang, sources in groups.items():
        kept = [t for (x, t), c in df.items() if x == lang and c >= least]
        v = len(kept)
        share = lambda counts: {t: 1 + 10**9 * (c + 5) // (sum(counts.values()) + 5 * v) for t, c in counts.items()}
        counts = {s: {t: n[lang, s, t] for t in kept} for s in sources}
        p = {s: share(c) for s, c in counts.items()}
        q = share({t: sum(counts[s][t] for s in sources) for t in kept})
        for s in sources:
            pairs = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in sources if o != s]
            terms = [(q[t] - p[s][t], t.encode()) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                out += [(lang, s, part, item.decode(), -value, k) for k, (value, item) in enumerate(sorted(found)[:most], 1)]
    return sorted(out)


@pytest.mark.parametrize(("columns", "side"), [(4096, 128), (3, 2)])
def test_audit(spark, texts, columns, side):
    rng = random.Random(3)
    many = texts + [("it", f"s{k % 7}", " ".join(f"w{chr(97 + i)}é{chr(97 + rng.randint(0, 4))}" for i in range(20) if rng.random() < 0.3), 1) for k in range(500)]
    got = sorted(tuple(r) for r in divergence.audit(frame(spark, many), top=7, columns=columns, side=side).collect())
    assert got == audit_plainly([r[:3] for r in many], top=7)
    assert {r[0] for r in got} == {"en", "fr", "", "de", "it"}


def test_audit_of_nothing(spark, texts):
    assert divergence.audit(frame(spark, texts).limit(0)).count() == 0
    assert divergence.audit(frame(spark, [("en", "s", None, 1)])).count() == 0


def test_shares_are_exact(spark):
    rows = spark.createDataFrame([(9 * 10**15, 9 * 10**16, 10**9), (0, 0, 1), (3, 7, 2)], "n long, total long, v long")
    from pyspark.sql import functions as F

    got = [r[0] for r in rows.select(divergence.share(F.col("n"), F.col("total"), F.col("v"))).collect()]
    assert got == [1 + 10**9 * (n + 5) // (t + 5 * v) for n, t, v in ((9 * 10**15, 9 * 10**16, 10**9), (0, 0, 1), (3, 7, 2))]


def test_distances_by_tree(monkeypatch):
    monkeypatch.setattr(divergence, "FRONTIER", 5)
    rng = np.random.default_rng(2)
    for rows, others, columns in ((1, 1, 1), (5, 3, 17), (8, 8, 64), (2, 9, 3)):
        a, b = (rng.integers(1, 100, (k, columns)) * (rng.random((k, columns)) < 0.2) for k in (rows, others))
        za, zb = rng.integers(1, 9, rows), rng.integers(1, 9, others)
        plain = np.abs(np.where(a == 0, za[:, None], a)[:, None, :] - np.where(b == 0, zb[:, None], b)[None, :, :]).sum(2)
        assert (divergence.distances(a, b, za, zb) == plain).all()
        assert (np.triu(divergence.distances(a, a, za, za, True)) == np.triu(divergence.distances(a, a, za, za))).all()
