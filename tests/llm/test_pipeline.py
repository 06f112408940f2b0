import glob
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from geopatch.llm import byte_bpe, common
from geopatch.llm.queries import vocabulary


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(9)
    path = tmp_path_factory.mktemp("corpus")
    words = "the of and to in that it was for with his they at be this from have not are but had by one all she there would their we him been".split()
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    question = "which of the seven old bridges over the river was the first to be built of stone and who paid for the work"
    rows = [(i, f"{prose(40)}\n{prose(30)}", "en") for i in range(60)]
    rows += [(100, rows[3][1], "en"), (101, rows[4][1] + "\nand one more line of words that stands nowhere else but here for all", "en"), (102, f"{prose(20)} {question} {prose(20)}", "en"), (103, None, "en"), (104, "", "en"), (105, "123 456", None)]
    copy = " ".join(rows[7][1].split("\n")).split()
    copy[20] = "there"
    rows += [(106, " ".join(copy), "en"), (107, rows[9][1] + "\n" + prose(25), "en")]
    spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, question)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    gone = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        left = stage(spark, docs, folder)
        if k < 4:
            assert left.dtypes == docs.dtypes
        before, after = ({r["doc_id"] for r in x.select("doc_id").collect()} for x in (docs, left))
        gone.append(before - after)
        docs = left
    assert gone[0] == {103, 104, 105}
    assert gone[1] == {100}
    assert gone[2] == {106}
    assert gone[3] == {102}
    assert gone[4] == set()


def test_the_run_ends_in_ids_of_the_texts(spark, folder):
    rows = corpus_pipeline.run(spark, folder).collect()
    coder = byte_bpe.encoder(vocabulary("byte_bpe_50k.tiktoken"), __import__("public_tokenizers").PATTERN)
    text = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    assert {r["doc_id"]: r["ids"] for r in rows}[7] == coder.encode_ordinary(text[7])
    assert corpus_pipeline.ORACLE_SQL is None


def test_tables_on_the_way_are_dropped(spark, folder):
    at = common.shared_dir(spark).removeprefix("file:")
    before = set(glob.glob(f"{at}/table-*"))
    rows = corpus_pipeline.run(spark, folder)
    assert len(set(glob.glob(f"{at}/table-*")) - before) == 1 and rows.count() > 50


def test_stages_leave_one_small_table(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for stage in (corpus_pipeline.without_repeated_lines, corpus_pipeline.without_near_copies, corpus_pipeline.without_benchmark):
        with common.noted() as made:
            left = stage(spark, docs, folder)
        there = [p for p in made if glob.glob(f"{p.removeprefix('file:')}/part-*")]
        assert len(there) == 1 and not {"text", "parts", "keys", "grams"} & set(spark.read.parquet(*there).columns)
        assert left.count() > 50


def test_lines_and_lines_near_them_go_once(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    after = {r["doc_id"]: r for r in corpus_pipeline.without_repeated_lines(spark, docs, folder).collect()}
    assert after[101]["text"] == before[101].split("\n")[2] and after[107]["text"] == before[107].split("\n")[2]
    assert all(r["text"] == before[i] for i, r in after.items() if i < 100)
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in after.values())


def test_empty_tables_repeated_rows_and_other_columns(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), folder).count() == 0
    odd = docs.union(docs.where("doc_id = 5")).withColumns({"k1": F.lit("a"), "hash": F.lit(1), "lang_pred": F.lit("x")})
    for _, stage in corpus_pipeline.STAGES[:4]:
        left = stage(spark, odd, folder)
        assert left.columns == corpus_pipeline.COLUMNS
        assert left.where("doc_id = 5").count() >= 1
    assert corpus_pipeline.token_ids(spark, odd, folder).where("doc_id = 5").select("ids_sha256").distinct().count() == 1


def test_fingerprints_choose_before_the_exact_join(spark, monkeypatch):
    rng = random.Random(4)
    words = [f"w{rng.randrange(5000)}" for _ in range(40)]
    # the same passage over and over with one word changed: few shingles, most of them lost, but nearly all of their weight is kept
    texts = [" ".join(words[:5] * 400), " ".join([*words[:5] * 399, *words[:3], "other", words[4]]), " ".join(words), " ".join(reversed(words))]
    docs = spark.createDataFrame([*((i, t, "en", "s", len(t)) for i, t in enumerate(texts)), (2, texts[3] + " end", "en", "s", 1), (None, texts[0], "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    assert len(corpus_pipeline.near_copies.keep_first(docs).collect()) == 5
    left = corpus_pipeline.without_near_copies(spark, docs, "").collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in left) == sorted([("0", texts[0]), ("2", texts[2]), ("2", texts[3] + " end"), ("None", texts[0])])
