from __future__ import annotations

import duckdb
import pytest
from helpers import DOCS, documents, prose, rows_of, with_clashing

from loanweave.llm import licenses

TEXTS = [
    "Licensed under CC BY-NC 4.0.\n" + prose(1, 30), prose(2, 30) + "\nReleased under the MIT License.", "ALL RIGHTS\nRESERVED all rights reserved, cc by cc by",
    "This work is licensed under the GNU General Public License, version 3.", "Licensed under the Apache License, Version 2.0", "licensed under an apache license 2 0 version the", "under the license",
    "a general public\tlicense 'general-public license'", "ccK by", "CC BY", "ÄCC BY", "cc byé", None, "", "\n\n", "all rights all rights reserved",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documents", prose(3, 200_000) + " all rights reserved", (3, "CC BY"), (None, "CC BY"), "mit the released license under", "licenſed under cc by nc 4 0",
]


@pytest.mark.parametrize("threshold", [0.8, 0.5])
def test_against_brute_force_sql(spark, threshold):
    docs = documents(spark, [*TEXTS, *TEXTS[:3]])
    frame = docs.toPandas()
    frame["doc_id"] = frame["doc_id"].astype("Int64")
    engine = duckdb.connect()
    engine.register("documents", frame)
    wanted = engine.execute(licenses._sql(threshold=threshold)).fetchall()
    found = licenses.scan(with_clashing(docs), threshold=threshold)
    assert found.columns == ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    assert rows_of(found) == sorted(wanted, key=repr)


def test_examples(spark):
    rows = {r["doc_id"]: r for r in licenses.scan(documents(spark, TEXTS[:14])).collect()}
    assert (rows[0]["labels"], rows[0]["n_base"], rows[0]["first_word"]) == ("cc-by,cc-by-nc-4.0", 1, 2)
    assert (rows[1]["labels"], rows[1]["base_labels"], rows[1]["first_word"], rows[1]["score"]) == ("mit", "", None, 1.0)
    assert (rows[2]["base_labels"], rows[2]["n_base"], rows[2]["first_word"], rows[2]["last_word"]) == ("cc-by,reserved", 4, 0, 8)
    assert rows[8]["n_base"] == rows[10]["n_base"] == rows[11]["n_base"] == 0 and rows[9]["n_base"] == 1
    assert (rows[12]["n_words"], rows[12]["labels"], rows[12]["score"]) == (0, "", 0.0)


def test_empty(spark):
    assert licenses.scan(spark.createDataFrame([], DOCS)).collect() == []


def wrapped(notice: str, width: int = 72) -> str:
    lines, line = [], ""
    for word in notice.split():
        if len(line) + len(word) >= width:
            lines, line = [*lines, line], ""
        line += word + " "
    return "\n".join([*lines, line])


def test_wrapped_notices_get_their_label_alone(spark):
    """Each template amid a long text, in lines of usual width, gets its own label and no neighbour's."""
    texts = [prose(n, 37 + n) + "\n" + wrapped(notice, 40) + "\n" + prose(50 + n, 60) for n, (_, notice) in enumerate(licenses.TEMPLATES)]
    rows = {r["doc_id"]: r["labels"].split(",") for r in licenses.scan(documents(spark, texts)).collect()}
    for n, (label, notice) in enumerate(licenses.TEMPLATES):
        own = [x for phrase, x in licenses.PHRASES.items() if f" {phrase} " in f" {notice} "]
        assert rows[n] == sorted([label, *own]), (notice, rows[n])


def test_neighbours_are_told_apart(spark):
    texts = ["This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU Affero General Public License, version 3", "licensed under the GNU General Public License version 2.1", "This work is licensed under a Creative Commons Attribution 4.0 International License"]
    rows = {r["doc_id"]: r["labels"] for r in licenses.scan(documents(spark, texts)).collect()}
    assert rows[0] == "gpl,gpl-3.0" and rows[1] == "agpl-3.0,gpl" and "agpl" not in rows[2] and "lgpl" not in rows[2] and rows[3] == "cc-by-4.0"
