"""SimHash fingerprints and components against a plain version."""

import random

import numpy as np
import pytest
import xxhash

from tabuloom.llm import simhash
from tabuloom.llm.common import word_blocks
from tabuloom.llm.graph import components


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + 4]) for i in range(len(words) - 3)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(values, near):
    group = list(range(len(values)))
    for i in range(len(values)):
        for j in range(i):
            if near(values[i], values[j]) and group[i] != group[j]:
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group = [new if g == old else g for g in group]
    return group


def texts():
    rng = random.Random(5)
    base = [" ".join(rng.choice("ab cd ef gh ij kl mn op qr st".split()) + str(rng.randrange(40)) for _ in range(60)) for _ in range(12)]
    near = [b.replace(b.split()[7], "changed", 1) for b in base for _ in range(2)]
    return [*base, *near, *base[:3], None, "", "  \t\n", "one", "one two", "One  TWO", "A b\x0bc\x0cd É e"]


@pytest.mark.parametrize("text", [t for t in texts() if t is not None])
def test_fingerprint(text):
    assert simhash.fingerprint(text.encode()) == plain_fingerprint(text)


def test_long_text_in_blocks(monkeypatch):
    text = " ".join(f"w{i % 97}" for i in range(5000)).encode()
    blocks = list(word_blocks(text, 100))
    assert len(blocks) > 50 and [w for b in blocks for w in b] == text.split()
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "word_blocks", lambda t: word_blocks(t, 64))
    assert simhash.fingerprint(text) == whole


def test_components_of_documents(spark, frame):
    rows = [(i, t, "x", 1) for i, t in enumerate(texts())]
    docs = frame("doc_id long, text string, fp string, component int", rows)
    fps = [plain_fingerprint(t) for _, t, _, _ in rows]
    want = plain_groups(fps, lambda a, b: (a ^ b).bit_count() <= 4)
    for block in (4096, 3):
        got = {r.doc_id: r for r in simhash.near_duplicates(docs, block=block).collect()}
        assert [got[i].component_id for i in range(len(rows))] == want
        assert [got[i].fingerprint for i in range(len(rows))] == [f"{f:016x}" for f in fps]
    kept = simhash.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want))


def test_links_reach_every_pair(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 5, dtype=np.uint64)
    values = set(base.tolist())
    for b in base.tolist():
        for _ in range(60):
            values.add(b ^ sum(1 << int(i) for i in rng.choice(62, rng.integers(1, 6), replace=False)))
    values = sorted(values)
    want = plain_groups(values, lambda a, b: (a ^ b).bit_count() <= 4)
    for distance, block in ((4, 4096), (4, 7)):
        links = simhash.links(spark.createDataFrame([(v,) for v in values], "fp long"), distance, block).collect()
        assert all((r.a ^ r.b).bit_count() <= 4 for r in links)
        at = {v: i for i, v in enumerate(values)}
        got = plain_groups(range(len(values)), lambda i, j, e={(at[r.a], at[r.b]) for r in links}: (i, j) in e or (j, i) in e)
        assert got == want


def test_odd_tables(frame):
    docs = frame("doc_id long, text string", [(None, "a b c d e"), (4, "a b c d e"), (4, "a b c d e"), (None, None), (7, None)])
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(None, 4), (4, 4), (4, 4), (None, 7), (7, 7)], key=str)
    assert sorted((r.doc_id or -1) for r in simhash.deduplicate(docs).collect()) == [-1, -1, 4, 7]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_graph(frame):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 200), (300, 200), (7, 7), (None, 3), (100, 200)]
    got = {r.node: r.component for r in components(frame("a long, b long", edges)).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 100: 100, 200: 100, 300: 100}
    assert components(frame("a long, b long", [])).count() == 0
