"""The stages one after another on planted cases, and the registered queries at the smallest scale."""

import random

import corpus_pipeline
import pytest
from rippletrace.llm.registry import ORACLES, QUERIES
from tests.compare import connect, same
from tests.conftest import SMALL


def planted(spark, folder):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("bcdfghjklm") + rng.choice("aeiou") for _ in range(rng.randint(1, 3)))
    text = lambda n: " ".join(word() for _ in range(n))
    clean = [text(rng.randint(30, 90)) for _ in range(200)]
    rows = dict(enumerate(clean))
    for i in range(0, 200, 4):  # labelled toxic texts
        rows[i] = " ".join("zogwump" if k % 9 == 2 else w for k, w in enumerate(clean[i].split()))
    base, item, passage = text(120), text(30), text(60)
    rows |= {1000: base, 1001: base, 1002: base.replace(base.split()[60], "other", 1), 1010: text(30) + " " + item + " " + text(30), 1020: text(40) + " " + passage, 1021: passage + " " + text(40)}
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows.items()] + [(None, clean[1].upper(), "en", "s", 10), (2000, None, "en", "s", 0), (2000, None, "en", "s", 0), (1000, base, "en", "s", len(base)), (1030, base, "de", "t", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)], "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(7, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return rows, passage


def test_stages(spark, tmp_path):
    rows, passage = planted(spark, str(tmp_path))
    docs, ids = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k < 4:
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        ids[name] = {r.doc_id for r in docs.select("doc_id").collect()}
    clean = {i for i in range(200) if i % 4}
    assert clean <= ids["toxicity"] and len(ids["toxicity"] & set(range(0, 200, 4))) <= 1
    # Of copies, repeated rows and near copies one row stays, also of the copy without an id; rows without words all stay.
    assert ids["near_duplicates"] & {1000, 1001, 1002, 1030} == {1000} and clean <= ids["near_duplicates"] and {2000} <= ids["near_duplicates"] and None not in ids["near_duplicates"]
    rows_of = spark.read.parquet(f"{tmp_path}/near_duplicates").groupBy("doc_id").count().where("count > 1").collect()
    assert [tuple(r) for r in rows_of] == [(2000, 2)]
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{tmp_path}/repeats").collect()}
    assert ids["repeats"] == ids["near_duplicates"] and passage in texts[1020] and passage not in texts[1021] and texts[2000] is None
    assert ids["decontamination"] == ids["repeats"] - {1010}
    assert ids["packing"] == ids["decontamination"]


def test_run(spark, tmp_path):
    planted(spark, str(tmp_path))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.agg({"length": "sum"}).first()[0] > 0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    same(QUERIES[name](spark, SMALL), connect(SMALL), ORACLES[name])


def test_all_ten_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))
