"""Small tables for the tests of the numbered operators."""

from __future__ import annotations

import random
import zlib

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Extra columns whose names the operators use themselves.
CLASHING = "size long, target double, score double, key string, found_pieces string, leaks string, component_id long"


def documents(spark, texts, sources=None, first=0):
    rows = [(first + i if not isinstance(t, tuple) else t[0], t if not isinstance(t, tuple) else t[1], "en", (sources or ["s"])[i % len(sources or ["s"])]) for i, t in enumerate(texts)]
    return spark.createDataFrame([(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in rows], DOCS)


def with_clashing(df):
    """The rows with extra columns under names that operators use."""
    for part in CLASHING.split(","):
        name, kind = part.split()
        df = df.selectExpr("*", f"CAST(NULL AS {kind}) AS {name}")
    return df


def prose(seed: int, words: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice("anden theri oner seta lomi karu velto binda sopra quen tirel maso".split()) + rng.choice(["", "s", "ed", "ing"]) for _ in range(words))


def crc_remainder(doc_id, divisor: int) -> int:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % divisor


def rows_of(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=repr)
