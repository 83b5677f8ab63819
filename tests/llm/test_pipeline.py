from __future__ import annotations

import re

import pytest
from compare import TABLES
from helpers import documents, rows_of
from test_decontamination import similarity, words
from test_near_dedup import components, fingerprint

import __spark_entry__ as entry_points
import corpus_pipeline
from loanweave.llm import queries

SF_DIR = "/root/testdata/sf0.001"


def test_stages_follow_each_other(spark, tmp_path):
    """Each stage on what the one before kept, against plain Python."""
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns, kept = docs.columns, []
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path / str(number))
        stage(spark, docs, SF_DIR).write.parquet(path)
        before, docs = docs, spark.read.parquet(path)
        kept.append(({r["doc_id"]: r["text"] for r in before.collect()}, docs.collect()))
        assert number == 4 or docs.columns == columns, name
    quality = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").collect()}
    stays = {r["doc_id"] for r in kept[0][1]}
    assert sum((i in stays) == bool(q) for i, q in quality.items()) >= 0.9 * len(quality)
    texts, rows = kept[1]
    assert {r["doc_id"] for r in rows} == set(components([(i, fingerprint(t)) for i, t in texts.items()]))
    texts, rows = kept[2]
    items = [words(r["text"]) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    assert {r["doc_id"] for r in rows} == {i for i, t in texts.items() if all(similarity(x, words(t)) < 0.8 for x in items if set(x) & set(words(t)))}
    texts, rows = kept[3]
    data = re.compile(r"\S+@\S+\.com|\+1 \(\d{3}\) \d{3}-\d{4}|\b\d{16}\b|\b\d+\.\d+\.\d+\.\d+\b|AKIA\w{16}|password=\w+")
    was = {x for t in texts.values() for x in data.findall(t)}
    assert {r["doc_id"] for r in rows} == set(texts) and not any(x in was for r in rows for x in data.findall(r["text"]))
    assert all(data.search(texts[r["doc_id"]]) or "token" in texts[r["doc_id"]] or r["text"] == texts[r["doc_id"]] for r in rows)
    texts, rows = kept[4]
    assert all(r["taken"] == r["copies"] * r["size"] > 0 and r["size"] == len(texts[r["doc_id"]].encode().split()) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_sql(spark, name):
    import duckdb

    engine = duckdb.connect()
    for table in TABLES:
        engine.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    found = queries.QUERIES[name](spark, SF_DIR)
    wanted = engine.execute(queries.ORACLE[name])
    columns = [c[0] for c in wanted.description]
    assert sorted(columns) == sorted(found.columns)
    assert rows_of(found.select(columns)) == sorted(wanted.fetchall(), key=repr)


def test_registered():
    names = [n for n in entry_points.queries() if re.match(r"op\d+_|pipeline$", n)]
    assert sorted(int(re.match(r"op(\d+)", n)[1]) for n in names if n != "pipeline") == list(range(1, 14)) and "pipeline" in names


def test_the_mix_holds_the_texts(spark):
    texts = ["a b c", (5, "d e"), (5, "f g"), (None, "h i"), (None, "j k"), "l", "l m n o"]
    docs = documents(spark, texts)
    rows = corpus_pipeline.mixed(spark, docs, "").collect()
    wanted = {(r["doc_id"], r["text"]) for r in docs.collect()}
    assert rows and {(r["doc_id"], r["text"]) for r in rows} <= wanted and len({(r["doc_id"], r["text"]) for r in rows}) == len(rows)
    assert all(r["size"] == len(r["text"].split()) and r["taken"] == r["size"] * r["copies"] > 0 for r in rows)


@pytest.mark.parametrize("texts", [[], [None, "", (None, "a b c"), (None, "a b c"), (7, "one text of some words"), (7, "one text of some words"), (7, "another text under one id"), "x " * 30_000]])
def test_empty_and_odd_documents(spark, tmp_path, texts):
    """Every stage runs, keeps the columns, and yields no row that was not there; rows that repeat leave one."""
    docs = documents(spark, texts)
    columns, before = docs.columns, {(r["doc_id"], r["text"]) for r in docs.collect()}
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path / str(number))
        stage(spark, docs, SF_DIR).write.parquet(path)
        docs = spark.read.parquet(path)
        assert number == 4 or docs.columns == columns
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert set(rows) <= before and len(rows) == len(set(rows))
