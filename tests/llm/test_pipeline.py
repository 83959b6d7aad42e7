"""The pipeline's stages, one after the other, on a small table with planted cases."""

import random

import corpus_pipeline
from test_operators import PASSAGE, prose


def run(spark, docs, upto):
    for _, stage in corpus_pipeline.STAGES[:upto]:
        docs = stage(spark, docs, "")
    return docs


def table(spark):
    base = prose(300, 200)
    near = base.split()
    near[100] = "changed"
    rows = [(i, prose(1000 + i, 80), "en", f"s{i % 3}", 0) for i in range(40)]
    rows += [(100, base, "en", "s0", 0), (101, base, "en", "s1", 0), (102, " ".join(near), "en", "s2", 0)]
    rows += [(200, prose(1, 60) + " " + PASSAGE, "en", "s0", 0), (201, PASSAGE + "\n" + prose(2, 60), "en", None, 0)]
    rows += [(300, None, "en", "s0", 0), (301, "12 345 ###", "en", "s0", 0), (302, "", None, "s0", 0)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), {r[0]: r[1] for r in rows}


def test_stages(spark, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "repeated_passages", "mixture", "tokens"]
    docs, texts = table(spark)
    first = run(spark, docs, 1)
    assert first.columns == docs.columns and {r["doc_id"] for r in first.collect()} == set(texts) - {300, 301, 302}
    second = {r["doc_id"]: r["text"] for r in run(spark, docs, 2).collect()}
    assert set(second) == set(texts) - {300, 301, 302, 101, 102}
    fourth = run(spark, docs, 4)
    assert fourth.columns == docs.columns
    left = {r["doc_id"]: r for r in fourth.collect()}
    assert set(left) == set(second) and all(left[i]["text"] == texts[i] for i in range(40))
    for i in (200, 201):
        assert PASSAGE[20:-20] not in left[i]["text"] and left[i]["n_chars"] == len(left[i]["text"]) > 100
    out = {r["doc_id"]: r for r in corpus_pipeline.STAGES[4][1](spark, fourth, "").collect()}
    assert set(out) == set(second) and all(r["n_tokens"] == len(r["ids"]) > 0 for r in out.values())


def test_no_rows(spark):
    docs = table(spark)[0].limit(0)
    assert run(spark, docs, 5).count() == 0
