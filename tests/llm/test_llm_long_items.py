"""Benchmark items of many words, items inside and next to each other, and large benchmarks."""

import random

import numpy as np
import pytest
from test_llm_models import edited

from tabuloom.llm import decontaminate


def item_rows(rng, sizes, number):
    return [(100 * n + i, " ".join(f"v{rng.randrange(3000)}" for _ in range(n))) for n in sizes for i in range(number)]


def test_every_edited_long_item_is_found(frame):
    rng = random.Random(5)
    items = item_rows(rng, [31, 60, 120, 200, 300, 500], 20)
    rows = []
    for key, text in items:
        words = text.split()
        for part in (0.1, 0.2):
            left = [f"t{rng.randrange(3000)}" for _ in range(rng.choice([0, 90]))]
            right = [f"t{rng.randrange(3000)}" for _ in range(rng.choice([0, 90]))]
            rows.append((2 * key + (part == 0.2), " ".join(left + edited(rng, words, int(len(words) * part)) + right)))
    docs = frame("doc_id long, text string", rows)
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, frame("item_id long, text string", items)).collect()}
    assert got == {(d, d // 2) for d, _ in rows}


def finder(items, similarity=0.8):
    """A Finder of plain items, with the keys of each."""
    walk = decontaminate.Walks(decontaminate.walks())
    held, run_hashes = {}, []
    for i, item in enumerate(items):
        words = decontaminate.normal_words(item)
        start, length = decontaminate.segments(len(words))
        keys = walk.keys(words, start, length, length)
        if len(words) > decontaminate.WALKED:
            keys = decontaminate.hashing.pairs(keys, np.full(keys.shape, decontaminate.SEGMENT))
        held[i] = set(np.unique(keys).view(np.int64).tolist())
        run_hashes.append(decontaminate.runs(words, int(decontaminate.run_length(np.array([len(words)]))[0])))

    def bits(hashes):
        out = np.zeros(decontaminate.filter_bits(len(hashes)) // 64, dtype=np.uint64)
        for at in decontaminate._probes(hashes, len(out) * 64):
            np.bitwise_or.at(out, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
        return out

    keys = np.array(sorted(set().union(*held.values())), dtype=np.int64).view(np.uint64)
    sizes = sorted({len(decontaminate.normal_words(x)) for x in items})
    return decontaminate.Finder(sizes, walk, bits(np.unique(np.concatenate(run_hashes))), bits(keys), similarity), held


@pytest.mark.parametrize("n", [5, 8, 12, 16, 20, 25, 30, 31, 45, 60, 120, 300, 500])
def test_recall_through_the_finder(n):
    """From the windows of a text to the exact check, at the most edits that an item may have."""
    rng, number = random.Random(n), 200 if n < 100 else 60
    items = [" ".join(f"v{rng.randrange(3000)}" for _ in range(n)) for _ in range(number)]
    find, held = finder(items)
    found = 0
    for i, item in enumerate(items):
        around = [" ".join(f"t{rng.randrange(3000)}" for _ in range(rng.choice([0, n, 70]))) for _ in range(2)]
        passage = " ".join(edited(rng, item.split(), int(n * 0.2)))
        text = f"{around[0]} {passage} {around[1]}".encode()
        word = decontaminate.normal_words(item).tolist()
        found += any(set(keys) & held[i] and decontaminate.edit_distance(word, np.frombuffer(region, dtype=np.uint64).tolist()) <= int(n * 0.2 + 1e-9)
                     for _, keys, region in find.windows([text]))
    assert found >= 0.95 * number, found / number


def test_one_near_segment_is_enough(frame):
    """All edits allowed in one half of an item, whose other half is untouched."""
    rng = random.Random(6)
    items = item_rows(rng, [40, 100], 30)
    rows = []
    for key, text in items:
        words = text.split()
        half = len(words) // 2
        k = int(len(words) * 0.2)
        rows.append((key, " ".join(["t"] * 9 + edited(rng, words[:half], k) + words[half:] + ["u"] * 9)))
    docs = frame("doc_id long, text string", rows)
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, frame("item_id long, text string", items)).collect()}
    assert got == {(d, d) for d, _ in rows}


def test_segments_cover_an_item():
    for n in [*range(1, 200), 500, 1001]:
        start, length = decontaminate.segments(n)
        assert start[0] == 0 and (start[1:] == start[:-1] + length[:-1]).all() and length.sum() == n
        assert length.max() <= 30 and (n <= 30 or length.min() >= 15)
        assert decontaminate.edits(length, 0.8).sum() + len(length) > decontaminate.edits(n, 0.8)


def test_items_inside_others(frame):
    rng = random.Random(8)
    items = []
    for i in range(40):
        words = [f"v{rng.randrange(3000)}" for _ in range(120)]
        inner = rng.choice([15, 20, 25, 30, 50])
        at = rng.randrange(20, 60)
        items += [(10 * i, " ".join(words)), (10 * i + 1, " ".join(words[at:at + inner])), (10 * i + 2, " ".join(words[at + inner // 2:at + inner // 2 + 28]))]
    rows = [(i, "t1 t2 " + text + " t3 t4") for i, text in items if i % 10 == 0]
    docs = frame("doc_id long, text string", rows)
    got = {(r.doc_id, r.item_id): r.distance for r in decontaminate.contaminated(docs, frame("item_id long, text string", items)).collect()}
    assert got == {(i - i % 10, i): 0 for i, _ in items}


def test_filter_grows_with_what_it_holds(spark):
    assert decontaminate.filter_bits(35) == 1 << 16 and decontaminate.filter_bits(35_000_000) == 1 << 30
    hashes = spark.range(2_000_000).selectExpr("xxhash64(id) AS h")
    bits = decontaminate._filter(hashes, "h", decontaminate.filter_bits(2_000_000))
    held = np.array([r.h for r in hashes.limit(1000).collect()], dtype=np.int64).view(np.uint64)
    others = np.random.default_rng(1).integers(0, 1 << 64, 100_000, dtype=np.uint64)
    assert decontaminate._in(held, bits).all() and decontaminate._in(others, bits).mean() < 0.015


def test_items_among_many(frame):
    rng = random.Random(9)
    items = item_rows(rng, [20, 28], 3000)
    rows = [(i, " ".join(f"t{rng.randrange(3000)}" for _ in range(40)) + " " + text) for i, text in rng.sample(items, 200)]
    docs = frame("doc_id long, text string", rows)
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, frame("item_id long, text string", items)).collect()}
    assert got == {(i, i) for i, _ in rows}
