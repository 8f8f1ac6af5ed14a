"""Merkle proofs against a plain tree, and against the SQL twin."""

import hashlib
import random
import sys
import zlib
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[2] / "tools"))

from compare import rows_of  # noqa: E402
from tabuloom.llm import merkle  # noqa: E402
from tabuloom.llm.queries import SQL, remainder  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _at int, held string, pos int"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(r, text):
    return h(field(r[0]), field(r[3]), field(r[2]), field(r[4]), field(text))


def now(r):
    return r[1] if r[1] is None or r[0] is None or zlib.crc32(str(r[0]).encode()) % 2 else r[1].replace("\n", "")


def tree(level):
    levels = [level]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i:i + 3]) for i in range(0, len(levels[-1]), 3)])
    return levels


def plain(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[3], []).append(r)
    names = sorted(groups, key=lambda k: (k is not None, (k or "").encode()))
    for k in names:
        groups[k].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
    trees = [tree([leaf(r, r[1]) for r in groups[k]]) for k in names]
    top = tree([t[-1][0] for t in trees])
    for number, k in enumerate(names):
        for place, r in enumerate(groups[k]):
            fold, proof = leaf(r, now(r)), ""
            for levels, at in ((trees[number], place), (top, number)):
                for level in levels[:-1]:
                    run, slot = level[at - at % 3:at - at % 3 + 3], at % 3
                    proof += "".join(run[:slot] + run[slot + 1:])
                    fold, at = h(*run[:slot], fold, *run[slot + 1:]), at // 3
            yield r[0], leaf(r, r[1]), trees[number][-1][0], top[-1][0], h(proof), fold, fold == top[-1][0]


def made(n, sources, seed=3):
    draw = random.Random(seed)
    texts = ["", "a\nb", None, "é\n" * 3, "x" * 50, "long\n" * 60000, "\n"]
    rows = [(draw.choice([None, 1, i]) if draw.random() < .2 else i, draw.choice(texts), draw.choice(["en", None]), draw.choice(sources), draw.choice([1, None]), 1, "h", 2)
            for i in range(n)]
    return rows + rows[:n // 5]


def proven(docs):
    text = F.when(remainder("doc_id", 2) == 0, F.translate("text", "\n", "")).otherwise(F.col("text"))
    return merkle.prove(docs, changed={"text": text}).select("doc_id", "leaf", "subroot", "root", F.sha2("proof", 256).alias("proof_sha256"), "folded_root", "verified")


@pytest.mark.parametrize("n, sources", [(1, [None]), (9, ["z"]), (23, ["q"]), (40, ["a", "b", None]), (260, ["hot"] * 20 + [None, "é", "", *"abcdefghijk"])])
def test_against_a_plain_tree(frame, n, sources):
    rows = made(n, sources)
    docs = frame(SCHEMA, rows)
    got = proven(docs)
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, plain(rows)))
    con = duckdb.connect()
    con.register("documents", docs.toPandas().astype({"doc_id": "Int64", "n_chars": "Int64"}))
    assert rows_of(got.toPandas().astype({"doc_id": "Int64"})) == rows_of(con.execute(SQL["op13_merkle"]).df().astype({"doc_id": "Int64"}))


def test_untouched_rows_verify_and_empty_tables(spark, frame):
    docs = frame(SCHEMA, made(50, ["a", "b"]))
    limit = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(limit, None)
    assert {r.verified for r in merkle.prove(docs).collect()} == {True}
    assert spark.conf.get(limit, None) == before
    empty = merkle.prove(docs.limit(0))
    assert empty.count() == 0 and empty.columns == merkle.prove(docs).columns


def test_nodes_name_their_parents(frame, tmp_path):
    merkle.prove(frame(SCHEMA, made(120, ["a", "a", "a", "b"])), folder=str(tmp_path))
    read = frame("x int", []).sparkSession.read.schema(f"{merkle.NODES}, height int")
    nodes = read.parquet(*[str(p) for p in tmp_path.glob("nodes-*")]).collect()
    by = {(r.tree, r.level, r.pos): r for r in nodes}
    roots = [r for r in nodes if r.up_tree is None]
    assert len(roots) == 1 and len(nodes) == len(by)
    for r in nodes:
        assert r is roots[0] or by[r.up_tree, r.up_level, r.up_pos].children[r.slot] == r.node
