"""Fingerprints of multisets of paragraphs: sums, order, likeness, and edits against the SQL twin."""

import random
import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[2] / "tools"))

from compare import rows_of  # noqa: E402
from tabuloom.llm import fingerprint as fp  # noqa: E402
from tabuloom.llm.queries import SQL  # noqa: E402


def codes(frame, *texts):
    docs = frame("doc_id int, text string, kind int, _at int", [(i, t, 1, 2) for i, t in enumerate(texts)])
    found = fp.fingerprints(docs).select("doc_id", "fingerprint", fp.encoded(F.col("fingerprint")).alias("code"))
    return [r.code for r in found.orderBy("doc_id").collect()], found


def test_order_does_not_matter_but_counts_and_borders_do(frame):
    (a, b, c, d, e, none, empty), _ = codes(frame, "One. Two!\nthree\nthree", "three\nOne. Two!\nthree", "One. Two!\nthree", "One.\n Two!\nthree\nthree", "one. Two!\nthree\nthree", None, "")
    assert a == b and none == empty and len({a, c, d, e, empty}) == 5
    assert len(a) == 15 * (6 + 60) and all(x in "0123456789abcdef" for x in a)


def test_sums_insert_and_delete(frame):
    draw = random.Random(1)
    lines = [" ".join(draw.choice(["alpha", "beta.", "gamma", "é!", "", "delta?"]) for _ in range(draw.randint(0, 40))) for _ in range(60)]
    first, second, both = "\n".join(lines[:25]), "\n".join(lines[25:]), "\n".join(draw.sample(lines, 60))
    _, found = codes(frame, first, second, both)
    row = found.groupBy().pivot("doc_id", [0, 1, 2]).agg(F.first("fingerprint")).toDF("a", "b", "c")
    got = row.select(fp.encoded(fp.plus(F.col("a"), F.col("b"))), fp.encoded(fp.minus(F.col("c"), F.col("b"))), fp.encoded(fp.minus(fp.plus(F.col("a"), F.col("b")), F.col("a"))),
                     fp.encoded(F.col("a")), fp.encoded(F.col("b")), fp.encoded(F.col("c"))).first()
    assert (got[0], got[1], got[2]) == (got[5], got[3], got[4])


def test_sums_of_more_rows_than_a_lane_holds(frame):
    """40,000 equal lines and 50,000 pieces in one line: lanes wrap, and groups are put together without carry."""
    docs = frame("doc_id int, text string", [(0, "same line.\n" * 40000), (1, "same line.\n" * 20000), (2, "x. " * 50000), (3, "x. " * 25000)])
    found = fp.fingerprints(docs).groupBy().pivot("doc_id", [0, 1, 2, 3]).agg(F.first("fingerprint")).toDF("a", "b", "c", "d")
    # The text of 40,000 lines ends with one empty paragraph, two of 20,000 with two.
    got = found.select(F.col("a.lanes"), fp.plus(F.col("b"), F.col("b"))["lanes"], F.col("c.lanes"), fp.plus(F.col("d"), F.col("d"))["lanes"], "a.paragraphs", "a.pieces", "c.pieces").first()
    assert got[0] == got[1] and got[2] == got[3] and tuple(got[4:]) == (40001, 40000, 50000)


def make(n, seed=2):
    draw = random.Random(seed)
    word = lambda: "".join(draw.choice("abcdeé") for _ in range(draw.randint(1, 8)))
    text = lambda: "\n".join(". ".join(" ".join(word() for _ in range(9)) for _ in range(draw.randint(0, 6))) for _ in range(draw.randint(1, 9)))
    pool = [text() for _ in range(n)] + ["", None, "x", "\n", "…", "a" * 300, "word " * 30000, "l.\n" * 3000]
    return [(draw.choice([None, 5]) if draw.random() < .1 else i, draw.choice(pool), "x", 1, "k") for i in range(n)]


SCHEMA = "doc_id long, text string, kind string, run int, next string"


@pytest.mark.parametrize("run_rows", [None, 1, 6])
def test_edits_against_sql(frame, run_rows):
    docs = frame(SCHEMA, make(70))
    con = duckdb.connect()
    con.register("documents", docs.toPandas().astype({"doc_id": "Int64"}))
    got = fp.edits(docs, run_rows=run_rows)
    assert rows_of(got.toPandas().astype({"doc_id": "Int64"})) == rows_of(con.execute(SQL["op11_fingerprint"]).df().astype({"doc_id": "Int64"}))


def test_likeness_of_edits(frame):
    got = fp.edits(frame(SCHEMA, [(i, t, "x", 1, "k") for i, (_, t, *_) in enumerate(make(80, seed=9))])).filter("n_chars > 400").collect()
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    mean = lambda xs: sum(xs) / len(xs)
    unlike = [r for r in got if r.near_next < 1]
    assert mean([r.near_edited for r in unlike]) > 0.35 and mean([r.near_next for r in unlike]) < 0.1


def test_few_rows(frame):
    docs = frame(SCHEMA, [(3, "one line of text", "x", 1, "k")])
    only = fp.edits(docs).first()
    assert only.near_next == 1 and only.n_chars == 16
    same = fp.edits(frame(SCHEMA, [(i, "a\nb", "x", 1, "k") for i in range(5)])).collect()
    assert {(r.near_edited <= 1, r.near_next) for r in same} == {(True, 1.0)} and len(same) == 5
    none = fp.edits(frame(SCHEMA, [(None, None, "x", 1, "k"), (None, "b", "x", 1, "k")])).collect()
    assert len(none) == 2 and {r.n_chars for r in none} == {0, 1}
    assert fp.edits(docs.limit(0)).count() == 0 and fp.fingerprints(docs.limit(0)).count() == 0
