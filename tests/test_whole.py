"""Queries over whole texts against brute force: long texts, other letters, NULs, nulls."""

import os

import pyarrow as pa
import pyarrow.parquet as pq

from recordloom import queries

LONG = "many words and ä \U0001f600\n" * 4000
TEXTS = [LONG, LONG + "x", LONG[:-3] + "?" + LONG, LONG[:-3] + "?" + LONG, "é", "è", "", None, "a" * 4096, "a" * 4096 + "b", "plain text that is longer than it once was", "a\x00b"]


def stored(tmp_path):
    pq.write_table(pa.table({"doc_id": pa.array(range(len(TEXTS)), pa.int64()), "text": pa.array(TEXTS, pa.string())}), os.path.join(tmp_path, "documents.parquet"))
    return str(tmp_path)


def test_first_mismatch_of_whole_texts(spark, tmp_path):
    def first(a, b):
        if a is None or b is None or a == b:
            return None
        a, b = a.encode(), b.encode()
        return next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))

    got = queries.queries()["first_mismatch_whole"](spark, stored(tmp_path)).collect()
    assert {r.doc_id: r.first_mismatch for r in got} == {i: first(*pair) for i, pair in enumerate(zip(TEXTS, TEXTS[1:]))}
    assert len(got) == len(TEXTS) - 1


def test_cstring_of_whole_texts(spark, tmp_path):
    def shown(text):
        raw = (text or "").encode().split(b"\0")[0]
        return raw.decode() if all(32 <= b < 127 for b in raw) else f"<binary data: {raw.hex(' ').upper()}>"

    got = queries.queries()["cstring_display_whole"](spark, stored(tmp_path)).collect()
    assert {r.doc_id: r.shown for r in got} == {i: shown(t) for i, t in enumerate(TEXTS)} and len(got) == len(TEXTS)
