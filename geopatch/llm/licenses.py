"""License scans by an exact set-similarity join with license notices.

Everything is built from DataFrame functions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geopatch.llm.common import few, kept, source, text_key

#: Phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: The wording of common notices, and their labels.
TEMPLATES = {
    "licensed under the apache license version 2 0": "apache-2.0",
    "you may not use this file except in compliance with the license you may obtain a copy of the license at": "apache-2.0",
    "this work is licensed under the gnu general public license version 3": "gpl-3.0",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation": "gpl",
    "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation": "lgpl",
    "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation": "agpl",
    "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license": "gfdl",
    "licensed under cc by 4 0": "cc-by-4.0",
    "licensed under cc by nc 4 0": "cc-by-nc-4.0",
    "licensed under cc by sa 4 0": "cc-by-sa-4.0",
    "licensed under cc by nd 4 0": "cc-by-nd-4.0",
    "licensed under cc by nc sa 4 0": "cc-by-nc-sa-4.0",
    "licensed under cc by nc nd 4 0": "cc-by-nc-nd-4.0",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc-by-4.0",
    "this work is licensed under a creative commons attribution sharealike 4 0 international license": "cc-by-sa-4.0",
    "this work is licensed under a creative commons attribution noncommercial 4 0 international license": "cc-by-nc-4.0",
    "this work is licensed under a creative commons attribution noderivatives 4 0 international license": "cc-by-nd-4.0",
    "this work is licensed under a creative commons attribution noncommercial sharealike 4 0 international license": "cc-by-nc-sa-4.0",
    "this work is licensed under a creative commons attribution noncommercial noderivatives 4 0 international license": "cc-by-nc-nd-4.0",
    "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work": "cc0-1.0",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files": "mit",
    "released under the mit license": "mit",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "isc",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software": "bsd-3-clause",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl-2.0",
    "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0": "epl-2.0",
    "distributed under the boost software license version 1 0": "bsl-1.0",
    "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software": "zlib",
    "this is free and unencumbered software released into the public domain": "unlicense",
}
#: Share of a notice's distinct words that a block must hold; a block has as many words as the notice, divided by this.
THRESHOLD = 0.8
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The Kelvin sign, which lower-casing would turn into an ASCII letter.
KELVIN = "\u212a"


def words_of(text: Column) -> Column:
    """Runs of letters, digits and non-ASCII characters, with A-Z in lower case."""
    return F.filter(F.split(F.lower(F.replace(text, F.lit(KELVIN), F.lit("Ω"))), BREAKS), lambda w: w != "")


def phrases(rows: DataFrame) -> DataFrame:
    """Adds n_words and ``places``, an array of ``at, label`` of every place where a phrase's words stand."""
    words = lambda i: F.get(F.col("words"), i)
    marks = lambda w, i: F.coalesce(*[F.when((w == p.split()[0]) & _all(words, i, p.split()[1:]), F.struct(i.alias("at"), F.lit(label).alias("label"))) for p, label in PHRASES.items()])
    last = sorted({p.split()[-1] for p in PHRASES})
    some = F.arrays_overlap("words", F.array(*map(F.lit, last)))
    rows = rows.withColumn("words", words_of(F.col("text")))
    found = F.filter(F.transform("words", marks), lambda x: x.isNotNull())
    return rows.withColumns({"n_words": F.size("words").cast("long"), "places": F.when(some, found).otherwise(F.array().cast("array<struct<at:int,label:string>>"))}).drop("words")


def _all(words, i: Column, rest: list[str]) -> Column:
    same = F.lit(True)
    for k, word in enumerate(rest, 1):
        same = same & F.coalesce(words(i + k) == word, F.lit(False))
    return same


def block_words(template: str, threshold: float = THRESHOLD) -> int:
    """Words in a block that is compared with a notice."""
    return math.ceil(len(template.split()) / threshold - 1e-9)


def needed(words: set[str], threshold: float = THRESHOLD) -> int:
    """Distinct words of a notice that a block must hold."""
    return max(1, math.ceil(threshold * len(words) - 1e-9))


def telling(template: str, templates: dict[str, str], threshold: float = THRESHOLD) -> list[str]:
    """The words that tell a notice from those of other labels that hold enough of its words to be taken for it."""
    own = set(template.split())
    others = [set(t.split()) for t, label in templates.items() if label != templates[template]]
    return sorted(set().union(*[own - o for o in others if len(own & o) >= needed(own, threshold)]))


def blocks(rows: DataFrame, templates: dict[str, str], threshold: float = THRESHOLD) -> DataFrame:
    """``k1, k2, notice, label, first, last, shared, size``: every block of a text that holds a notice to at least the threshold.

    A block is a run of ``block_words`` words, whatever the line breaks, that
    begins with a word of the notice; it and the notice are compared as sets of
    words, and it must hold all words that tell the notice from others.  last is
    the place of its last word of the notice.  Words are ordered by how many
    texts hold them, rarest first.  A block that shares enough words with a
    notice shares one of its rarest, as many as may be missing and one more.
    So the places of these words are joined with their notices; there, the runs
    around a place are pruned by how many different words of the notice they
    hold (size), then by those left from the place of each start (position),
    and the sets that remain are compared.
    """
    sets = {t: set(t.split()) for t in templates}
    need = {t: needed(s, threshold) for t, s in sets.items()}
    vocabulary, fewest = sorted({w for s in sets.values() for w in s}), min(need.values())
    number = {w: i + 1 for i, w in enumerate(vocabulary)}
    listed = F.array(*map(F.lit, vocabulary))
    own = F.transform(words_of(F.col("text")), lambda w: F.when(w.isin(vocabulary), F.array_position(listed, w).cast("int")).otherwise(0))
    texts = rows.select("k1", "k2", own.alias("own")).where(F.size(F.array_distinct("own")) >= fewest)
    texts = kept(texts)
    each = texts.select(F.explode(F.array_distinct("own")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    counts = {vocabulary[r["word"] - 1]: r["n"] for r in each.where("word > 0").collect()}
    rarest = {t: sorted(s, key=lambda w: (counts.get(w, 0), w))[: len(s) - need[t] + 1] for t, s in sets.items()}
    reach = {t: block_words(t, threshold) for t in sets}
    spark, most = rows.sparkSession, max(reach.values())
    firsts = F.broadcast(
        spark.createDataFrame(
            [(number[w], k, templates[t], [number[x] for x in sorted(s)], [number[x] for x in telling(t, templates, threshold)], need[t], reach[t]) for k, (t, s) in enumerate(sets.items()) for w in rarest[t]],
            "word int, notice int, label string, members array<int>, telling array<int>, need int, reach int",
        )
    )
    marks = sorted({number[w] for own in rarest.values() for w in own})
    at = F.filter(F.transform("own", lambda w, i: F.when(w.isin(marks), i)), lambda i: i.isNotNull())
    around = lambda i: F.slice("own", F.greatest(i - most + 2, F.lit(1)), i - F.greatest(i - most + 1, F.lit(0)) + most)
    spots = F.transform(at, lambda i: F.struct(F.get("own", i).alias("word"), i.alias("i"), F.least(i, F.lit(most - 1)).alias("place"), around(i).alias("run")))
    spots = F.filter(spots, lambda x: F.size(F.array_distinct(F.filter(x["run"], lambda w: w > 0))) >= fewest)
    met = texts.select("k1", "k2", F.inline(spots)).join(firsts, "word")
    met = met.where(F.size(F.array_intersect("run", "members")) >= F.col("need"))
    starts = F.filter(F.sequence(F.greatest(F.col("place") - F.col("reach") + 1, F.lit(0)), F.col("place")), lambda s: F.array_contains("members", F.get("run", s)))
    cut = F.transform(starts, lambda s: F.struct((F.col("i") - F.col("place") + s).alias("first"), F.slice("run", s + 1, F.col("reach")).alias("block")))
    cut = F.filter(cut, lambda x: F.size(F.array_intersect(x["block"], F.col("members"))) >= F.col("need"))
    found = met.select("k1", "k2", "notice", "label", "members", "telling", F.inline(cut)).where(F.size(F.array_except("telling", "block")) == 0)
    last = F.array_max(F.transform("block", lambda w, j: F.when(F.array_contains("members", w), j)))
    shared = F.size(F.array_intersect("block", "members"))
    return found.select("k1", "k2", "notice", "label", "first", (F.col("first") + last).alias("last"), shared.alias("shared"), F.size("members").alias("size")).distinct()


def notices(rows: DataFrame, templates: dict[str, str], threshold: float = THRESHOLD) -> DataFrame:
    """``k1, k2, label, containment``: the notices of each text, with the best block of each.

    Of blocks in one place only the best stays: a block is left out if its
    middle lies in a block of a higher containment or, of equal ones, of a
    longer notice or one that is listed earlier.
    """
    if not templates:
        return rows.select("k1", "k2", F.lit("").alias("label"), F.lit(0.0).alias("containment")).limit(0)
    rank = F.expr("(shared * 1000000000L div size) * 1000000L + size * 1000L + 999 - notice")
    found = kept(blocks(rows, templates, threshold).withColumns({"rank": rank, "middle": F.floor((F.col("first") + F.col("last")) / 2).cast("int")}))
    best = found.select("k1", "k2", "rank", F.explode(F.sequence("first", "last")).alias("middle")).groupBy("k1", "k2", "middle").agg(F.max("rank").alias("best"))
    alone = found.join(best, ["k1", "k2", "middle"]).where("rank >= best")
    return alone.groupBy("k1", "k2", "label").agg(F.max(F.col("shared") / F.col("size")).alias("containment"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, n_words, places, notices`` for every row.

    places holds ``at, label`` of every phrase found, in order; notices holds
    ``label, containment`` of the license notices found.  Null and empty texts
    have no words.  Repeated rows give repeated results.
    """
    rows = source(docs, id_col, text_col).select("doc_id", "text", *text_key(F.col("text")))
    found = notices(rows, TEMPLATES if templates is None else templates, threshold)
    held = kept(found.groupBy("k1", "k2").agg(F.array_sort(F.collect_set(F.struct("label", "containment"))).alias("notices")))
    none = F.array().cast("array<struct<label:string,containment:double>>")
    return phrases(rows).drop("text").join(few(held), ["k1", "k2"], "left").select("doc_id", "n_words", "places", F.coalesce("notices", none).alias("notices"))


def report(docs: DataFrame) -> DataFrame:
    """The scan as one flat row per document; score is the best containment, 1 where a phrase stands."""
    label = lambda c: F.transform(c, lambda x: x["label"])
    line = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    starts = F.transform("places", lambda x: x["at"].cast("long"))
    best = F.coalesce(F.array_max(F.transform("notices", lambda x: x["containment"])), F.lit(0.0))
    return scan(docs).select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        line(label("places")).alias("base_labels"),
        line(F.concat(label("places"), label("notices"))).alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(best).alias("score"),
    )
