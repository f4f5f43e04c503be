"""The pipeline's stages on small tables: what goes, what stays, and that whole tables pass."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as p
from voltair.llm import pieces, simhash

R = random.Random(12)


def prose(n, tag):
    return " ".join(f"{tag}{R.randrange(10_000)}" for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("sf"))
    passage, item = prose(60, "p"), prose(20, "b")
    near = prose(300, "n")
    docs = [(i, prose(200, f"d{i}x"), "en", "s", None) for i in range(30)]
    docs += [(40, near, "en", "s", 1), (41, near.replace(near.split()[100], "other"), "en", "s", 1), (42, near, None, None, 1)]
    docs += [(50, prose(200, "e") + " " + passage, "en", "s", 1), (51, passage + " " + prose(200, "f"), "en", "s", 1)]
    docs += [(60, prose(100, "g") + " " + item + " " + prose(100, "h"), "en", "s", 1), (70, None, "en", "s", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars int").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at, {d[0]: d[1] for d in docs}, passage, item


def test_planted_cases(spark, corpus):
    at, texts, passage, item = corpus
    got = {x.doc_id: x for x in p.run(spark, at).collect()}
    assert set(texts) - set(got) == {41, 42}
    assert got[50].text == texts[50] and passage not in got[51].text and texts[51].split()[-1] in got[51].text
    assert item not in got[60].text and got[60].text.split()[:100] == texts[60].split()[:100]
    for i in range(30):
        assert got[i].text == texts[i]
    v = pieces.Vocabulary.read(pieces.MODEL)
    for x in got.values():
        assert "".join(pieces.decode(__import__("numpy").array(x.ids, "i4"), v).decode()) == x.text
        assert x.n_tokens == len(x.ids) and (x.doc_id == 70 or x.n_chars == len(x.text))


def test_stages_keep_columns(spark, corpus):
    at = corpus[0]
    docs = spark.read.parquet(f"{at}/documents.parquet").withColumn("fp", F.lit(1)).withColumn("did", F.lit("x"))
    for _, stage in p.STAGES[:-1]:
        out = stage(spark, docs, at)
        assert out.columns == docs.columns
        assert stage(spark, docs.where("false"), at).count() == 0
    assert p.STAGES[-1][1](spark, docs.where("false"), at).count() == 0


def test_near_dedup_matches_its_groups(spark, corpus):
    docs = spark.read.parquet(f"{corpus[0]}/documents.parquet")
    groups = simhash.groups(docs, 5, simhash.WIDE_RADIUS, True, words=simhash.WIDE_WORDS).where("doc_id = component_id")
    assert sorted(x.doc_id for x in groups.collect()) == sorted(x.doc_id for x in simhash.keep_one(docs).collect())


def test_very_long_texts_pass_all_stages(spark, tmp_path):
    r = random.Random(13)
    long_text = " ".join(f"w{r.randrange(60_000)}" for _ in range(150_000))
    passage = " ".join(f"q{i}" for i in range(60))
    docs = [(1, long_text + " " + passage), (2, "x " + passage + " " + long_text[:500_000]), (3, passage + " end")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "some item that stands nowhere in these texts at all")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {x.doc_id: x.text for x in p.run(spark, str(tmp_path)).collect()}
    assert got[1] == docs[0][1] and len(got[2]) < 500 and len(got[3]) < len(docs[2][1])
