"""BPE, language model, metric join, decontamination, quality and the pipeline against plain versions."""

import collections
import math
import random
import re
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tabuloom.llm import bpe, chunks, decontaminate, language_model, metric_join, quality
from tabuloom.llm.queries import remainder

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def spec():
    return bpe.load(PATH)


ODD = [None, "", " ", "a <|endoftext|> b<|endoftext|>", "  \n\n x \U0001f600 日本 ՘ don't 've  ", "q" * 9000, "퟿\x00\x1c\x85", "\tTab  é É ß", "12 345,6 --!!", "It's we'll"]


def test_words_split_as_the_tokenizer_does(spec):
    split = Tokenizer.from_file(PATH).pre_tokenizer
    for c in [*range(0x3000), *range(0x3000, 0xD800, 61), *range(0xE000, 0x110000, 499)]:
        text = f"a{chr(c)}1{chr(c)} {chr(c)}b {chr(c)}{chr(c)}"
        assert [w for b in bpe.words(text, spec) for w in b] == [text[i:j] for _, (i, j) in split.pre_tokenize_str(text)]


@pytest.mark.parametrize("chunk", [bpe.CHUNK_CHARS, 300])
def test_bpe_round_trip(frame, spec, chunk):
    rng = random.Random(1)
    texts = ODD + [" ".join(rng.choice(["the", "Of", "straße", "x1", "—", "\n"]) for _ in range(rng.randrange(80))) for _ in range(40)]
    docs = frame("doc_id long, text string, ids string, k int", [(i, t, "x", 1) for i, t in enumerate(texts)] + [(None, "z z", "x", 1), (3, "again", "x", 1), (3, "again", "x", 1)])
    tokenizer = Tokenizer.from_file(PATH)
    got = bpe.round_trip(docs, spec, chunk=chunk).collect()
    assert len(got) == docs.count()
    for r in got:
        text = ("z z" if r.doc_id is None else "again" if r.doc_id == 3 and r.text == "again" else texts[r.doc_id]) or ""
        ids = tokenizer.encode(text, add_special_tokens=False).ids
        assert bytes(r.ids) == struct.pack(f"<{len(ids)}I", *ids) and r.n_tokens == len(ids)
        assert r.text == tokenizer.decode(ids, skip_special_tokens=False)
    assert bpe.round_trip(docs.limit(0), spec).count() == 0
    apart = bpe.decode(bpe.encode(docs, spec, chunk=chunk), spec)
    assert sorted(map(str, apart.collect())) == sorted(map(str, got))


def test_long_text_is_split_in_blocks(spec, monkeypatch):
    text = " ".join(["ab c's 12,", "\n\n x"] * 400) + "y" * 300
    whole = [w for b in bpe.words(text, spec) for w in b]
    monkeypatch.setattr(bpe, "BLOCK_CHARS", 50)
    blocks = list(bpe.words(text, spec))
    assert len(blocks) > 20 and [w for b in blocks for w in b] == whole


def test_bytes_that_are_no_text(frame, spec):
    codes = struct.pack("<3I", *[i for i, p in enumerate(bpe.pieces(spec)) if p in (b"\xc3", b"a", b"\xff")])
    rows = frame("doc_id long, ids binary", [(1, codes), (2, None)])
    got = {r.doc_id: r.text for r in bpe.decode(rows, spec).collect()}
    ids = list(struct.unpack("<3I", codes))
    assert got == {1: Tokenizer.from_file(PATH).decode(ids, skip_special_tokens=False), 2: ""}


def test_packing():
    n = np.array([0, 1, 300, 2**31, 5], dtype=np.uint32)
    assert (chunks.unpack(chunks.pack(n)) == n).all()
    s = np.sort(np.random.default_rng(0).integers(0, 2**63, 50, dtype=np.uint64))
    assert (chunks.unpack_sorted(chunks.pack_sorted(s)) == s).all()
    assert list(chunks.spread(np.array([5, 0]), np.array([2, 3]))) == [5, 6, 0, 1, 2]


def lm_rows():
    rng = random.Random(4)
    words = "a b c d e f g h".split()
    rows = [(i, " ".join(rng.choice(words[i % 3:]) for _ in range(rng.randrange(1, 40)))) for i in range(80)]
    return rows + [(100, None), (101, ""), (102, "A\tB\x0bc É é"), (103, "unseen words only"), (104, "a b"), (104, "a b")]


@pytest.mark.parametrize("size", [1 << 22, 200])
def test_language_model(frame, size):
    rows = lm_rows()
    docs = frame("doc_id long, text string, n long, held_out string", [(*r, 1, "x") for r in rows])
    tokens = [(t or "").encode().lower().split() + [None] for _, t in rows]
    held = [zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows]
    one, two = collections.Counter(), collections.Counter()
    for t, h in zip(tokens, held):
        if not h:
            one.update(t)
            two.update(zip([b"\x00begin", *t], t))
    n, v = sum(one.values()), len(one)
    documents = held.count(False)
    cells = collections.Counter()
    context = lambda t, i: one[t[i - 1]] if i else documents
    for t, h in zip(tokens, held):
        for i, w in enumerate(t if not h else []):
            c = context(t, i) - 1
            q2 = (two[(t[i - 1] if i else b"\x00begin"), w] - 1) / c if c else 0
            q1 = (one[w] - 1) / (n - 1)
            bins = [0 if not q else round(4 * math.log(q * (v + 1))) + 256 for q in (q2, q1)]
            cells[(math.frexp(c)[1], *bins)] += 1
    keys = np.array([(b * 512 + x) * 512 + y for b, x, y in cells])
    mixed = language_model.weights(keys, np.array(list(cells.values()), dtype=float))
    got = language_model.score(docs, held_out=remainder("doc_id", 10) == 0, chunk=size).collect()
    assert len(got) == len(rows)
    found = collections.defaultdict(list)
    for r in got:
        found[r.doc_id].append(r)
    for (key, _), t, h in zip(rows, tokens, held):
        r = found[key].pop()
        base = sum(math.log10((one[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t)
        score = 0.0
        for i, w in enumerate(t):
            c = context(t, i)
            m = mixed[math.frexp(c)[1]]
            q2 = two[(t[i - 1] if i else b"\x00begin"), w] / c if c else 0
            score += math.log10(m[0] * q2 + m[1] * one[w] / n + m[2] / (v + 1))
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (h, len(t), sum(one[w] > 0 for w in t), n)
        assert r.base_score == pytest.approx(base) and r.score == pytest.approx(score)
    for c in (0, 1, documents):
        m = mixed[math.frexp(c)[1]]
        assert m[0] * (c > 0) + m[1] + m[2] == pytest.approx(1)


def test_language_model_without_training(frame):
    docs = frame("doc_id long, text string", [(1, "a b"), (None, "a")])
    got = language_model.score(docs, held_out=F.lit(True)).collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 and math.isfinite(r.score) for r in got)
    assert language_model.score(docs.limit(0)).count() == 0
    assert [r.held_out for r in language_model.score(docs, held_out=F.col("doc_id") == 9).collect()] == [False, False]


def vectors():
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(6, 8))
    rows = [(i, (centres[i % 6] + rng.normal(size=8) * rng.choice([0.05, 0.25, 1.0])).tolist(), int(i % 3)) for i in range(240)]
    rows += [(300 + i, rows[0][1], 0) for i in range(20)] + [(330, [2 * x for x in rows[0][1]], 0)]
    return rows


@pytest.mark.parametrize("cell,block", [(2000, 2048), (20, 15), (3, 4)])
def test_metric_join(frame, cell, block):
    rows = vectors()
    odd = [(400, None, 1), (401, [0.0] * 8, 1), (402, [float("nan")] + [1.0] * 7, 1), (403, [None] + [1.0] * 7, 1), (404, rows[1][1], None), (405, [float("inf")] * 8, 1), (406, [], 1), (407, rows[1][1][:7], 1), (None, rows[1][1], 1)]
    table = frame("vec_id long, embedding array<double>, label int, v string, node string", [(*r, "x", "y") for r in rows + odd])
    got = {r.vec_id: r for r in metric_join.near_duplicates(table, cell=cell, block=block).collect()}
    assert len(got) == len(rows) + len(odd)
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([r[2] for r in rows])
    near = (x @ x.T >= 0.93) & (label[:, None] == label[None, :]) & ~np.eye(len(x), dtype=bool)
    group = np.arange(len(x))
    while True:
        least = np.minimum(group, np.where(near, group[None, :], len(x)).min(axis=1))
        if (least == group).all():
            break
        group = least
    for i, (key, _, _) in enumerate(rows):
        assert (got[key].n_links, got[key].component_id) == (near[i].sum(), rows[group[i]][0])
        assert got[key].kept == (got[key].component_id == key)
    assert all((got[k].n_links, got[k].component_id, got[k].kept) == (0, k, True) for k, _, _ in odd)


def test_metric_join_of_odd_tables(frame):
    table = frame("vec_id long, embedding array<float>, label string", [(1, [1.0, 0.0], "a|b"), (1, [1.0, 0.0], "a|b"), (2, [1.0, -0.0], "a|b"), (3, [1.0, 0.0], "a")])
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in metric_join.near_duplicates(table).collect())
    assert got == [(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 0, 3, True)]
    assert metric_join.near_duplicates(table.limit(0)).count() == 0


def plain_distance(item, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        last, row = row, [i]
        for j, b in enumerate(text, 1):
            row.append(min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (a != b)))
    return min(row)


def test_edit_distance():
    rng = random.Random(9)
    for _ in range(300):
        a = [rng.randrange(5) for _ in range(rng.randrange(1, 90))]
        b = [rng.randrange(5) for _ in range(rng.randrange(0, 90))]
        assert decontaminate.edit_distance(a, b) == plain_distance(a, b)


def edited(rng, words, k):
    words = list(words)
    for _ in range(k):
        at, kind = rng.randrange(len(words)), rng.randrange(3)
        if kind == 0:
            words[at] = f"zz{rng.randrange(99)}"
        elif kind == 1 and len(words) > 1:
            del words[at]
        else:
            words.insert(at, f"yy{rng.randrange(99)}")
    return words


def test_edit_distances_of_many_pairs(monkeypatch):
    rng = random.Random(4)
    for cells in (1 << 22, 3000):
        monkeypatch.setattr(decontaminate, "CELLS", cells)
        items, regions = [], []
        for n in [1, 2, 5, 17, 31, 40, 62, 63, 64, 100] * 12:
            item = [rng.randrange(1, 9) for _ in range(n)]
            region = edited(rng, item, n // 4) if rng.random() < .5 else [rng.randrange(1, 9) for _ in range(rng.randrange(0, 2 * n + 2))]
            region = [x if isinstance(x, int) else 77 for x in region]
            items.append(np.array(item, dtype=np.uint64))
            regions.append(np.array([1] * rng.choice([0, 30]) + region, dtype=np.uint64))
        want = [decontaminate.edit_distance(i.tolist(), r.tolist()) for i, r in zip(items, regions)]
        assert decontaminate.edit_distances(items, regions).tolist() == want
    assert decontaminate.edit_distances([], []).tolist() == []


def test_decontamination(frame):
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(n))) for i, n in enumerate([2, 5, 8, 12, 15, 20, 30, 45, 60, 60])] + [(50, None), (51, "..."), (52, "W1 w2, W3! w4 w5 w6 w7 w8 w9 w10 w11"), (53, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11")]
    rows = []
    for d in range(160):
        text = [f"d{rng.randrange(400)}" if rng.random() < 0.7 else rng.choice(vocabulary) for _ in range(rng.randrange(200))]
        if d % 2:
            words = items[d % 10][1].split()
            at = rng.randrange(len(text) + 1)
            text[at:at] = edited(rng, words, rng.randrange(int(len(words) * 0.2) + 1))
        rows.append((d, " ".join(text)))
    rows += [(500, None), (501, ""), (502, "x W1, W2 w3 w4-w5 w6 w7 w8 w9 w10 w11."), (503, items[7][1])]
    docs = frame("doc_id long, text string, item string, words int", [(*r, "x", 1) for r in rows])
    bench = frame("item_id long, text string, n int", [(*i, 1) for i in items])
    want = {}
    for d, t in rows:
        for i, x in items:
            word = decontaminate.normal_words(x or "").tolist()
            if word:
                distance = plain_distance(word, decontaminate.normal_words(t or "").tolist())
                if distance <= int(len(word) * 0.2 + 1e-9):
                    want[d, i] = (distance, len(word))
    got = {(r.doc_id, r.item_id): (r.distance, r.n_words) for r in decontaminate.contaminated(docs, bench).collect()}
    assert set(got) <= set(want) and all(got[k][1] == want[k][1] and got[k][0] >= want[k][0] for k in got)
    exact = {k for k, (d, n) in want.items() if d <= n * 0.1}
    assert exact <= set(got) and len(got) >= 0.95 * len(want)
    left = decontaminate.decontaminate(docs, bench)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {d for d, _ in rows} - {d for d, _ in got}
    assert decontaminate.contaminated(docs.limit(0), bench).count() == 0
    assert decontaminate.contaminated(docs, bench.limit(0)).count() == 0


def test_decontamination_of_odd_rows_and_pieces(frame):
    item = " ".join(f"k{i}" for i in range(20))
    long = " ".join(f"l{i}" for i in range(3000))
    docs = frame("doc_id long, text string", [(None, item), (None, "clean"), (1, item), (1, item), (1, "other"), (2, long + " " + item + " " + long)])
    bench = frame("item_id long, text string", [(7, item), (7, item), (None, item)])
    hits = decontaminate.contaminated(docs, bench, block=3000).collect()
    assert {(r.doc_id, r.item_id) for r in hits} == {(d, i) for d in (None, 1, 2) for i in (7, None)}
    assert sorted((r.doc_id or 0, r.text) for r in decontaminate.decontaminate(docs, bench).collect()) == [(0, "clean"), (1, "other")]
    whole = long.encode()
    pieces = list(decontaminate._pieces(whole, 100, 3000))
    assert len(pieces) > 3 and all(a[-60:] in b for a, b in zip(pieces, pieces[1:]))


def quality_rows():
    rng = random.Random(8)
    good = [" ".join(rng.choice("the of and house river walks slowly green".split()) for _ in range(rng.randrange(5, 60))) + "." for _ in range(150)]
    bad = [" ".join(rng.choice(["BUY!!", "NOW!!", "$$$", "|"]) for _ in range(rng.randrange(5, 60))) for _ in range(60)]
    return [(i, t) for i, t in enumerate(good + bad)]


def test_quality(frame):
    rows = quality_rows()
    docs = frame("doc_id long, text string, quality int, score string", [(*r, 0, "x") for r in rows] + [(900, None, 1, "x"), (901, "", 1, "x"), (None, "the of", 1, "x"), (900, None, 1, "x")])
    labels = frame("doc_id long, quality int", [(i, int(i < 150)) for i, _ in rows] + [(0, 1), (1, None), (2, 0), (None, 1), (5000, 1)])
    model = quality.fit(docs, labels, learned=remainder("doc_id", 3) != 1)
    got = quality.score(docs, model).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    right = [(r.score >= 0.5) == (r.doc_id < 150) for r in got if r.doc_id is not None and r.doc_id < 900 and zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert len(right) > 40 and sum(right) >= 0.98 * len(right)
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r.score >= 0.5 for r in got)
    few = quality.fit(docs, labels, rows=60)
    assert np.isfinite(few.weights).all()
    for none in (labels.limit(0), labels.where("quality = 1")):
        assert {r.score for r in quality.score(docs, quality.fit(docs, none)).collect()} == {0.5}
    assert quality.score(docs.limit(0), model).count() == 0


def test_ranking_threshold_is_the_quantile():
    rng = np.random.default_rng(2)
    good = rng.random(400) < 0.7
    x = np.column_stack([good + rng.normal(size=400), rng.normal(size=400), np.ones(400)])
    model = quality.learn(x, good)
    assert (x @ model.weights + model.shift >= 0).sum() == good.sum()
    assert model.weights[0] > 5 * abs(model.weights[1]) and model.weights[2] == 0


def plain_features(text):
    """The features word by word and byte by byte."""
    space = " \t\n\x0b\x0c\r"
    letter = lambda b: b > 127 or chr(b).isalpha()
    words = [w for w in re.split(f"[{space}]+".encode(), text) if w]
    m, n = max(len(words), 1), max(len(text), 1)
    shares = [text.count(bytes([i])) / n for i in range(128)] + [sum(b > 127 for b in text) / n]
    upper = lambda w: [b for b in w if 65 <= b <= 90]
    counts = [
        sum(map(len, words)), sum(x == y for x, y in zip(words, words[1:])), len(set(words)), sum(not any(map(letter, w)) for w in words),
        sum(len(upper(w)) > 1 and not any(97 <= b <= 122 for b in w) for w in words), sum(len(w) <= 2 for w in words), sum(not letter(w[-1]) for w in words)]
    return [math.sqrt(x) for x in shares] + [math.log1p(len(text)), math.log1p(len(words)), *[c / m for c in counts], len(upper(text)) / max(sum(map(letter, text)), 1)]


def plain_model(rows, good, steps=4000):
    """Weights of the same loss by gradient descent over the same pairs, and the threshold by sorting."""
    spread = rows.std(axis=0)
    used = spread >= 1e-9
    scaled = (rows[:, used] - rows[:, used].mean(axis=0)) / spread[used]
    draw = np.random.default_rng(1)
    better, worse = np.flatnonzero(good), np.flatnonzero(~good)
    x = scaled[draw.choice(better, quality.PAIRS)] - scaled[draw.choice(worse, quality.PAIRS)]
    w, moved, rate = np.zeros(x.shape[1]), np.zeros(x.shape[1]), 4 / (np.linalg.norm(x, 2) ** 2 / len(x) + 4 * quality.RIDGE)
    for i in range(steps):
        ahead = w + i / (i + 3) * moved
        new = ahead + rate * (x.T @ (1 / (1 + np.exp(np.clip(x @ ahead, -500, 500)))) / len(x) - quality.RIDGE * ahead)
        w, moved = new, new - w
    scores = scaled @ w
    ranked = sorted(scores)
    return scores - (ranked[len(worse) - 1] + ranked[len(worse)]) / 2


def test_quality_against_a_plain_version(spark):
    docs = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for text in [*list(docs.values())[:25], b"", b"A", "\u00c9A b! 12 12 \t||".encode()]:
        assert np.allclose(quality.features(text), plain_features(text), atol=1e-12)
    marks = {r.doc_id: r.quality == 1 for r in spark.read.parquet("/root/testdata/sf0.001/labels.parquet").collect() if r.doc_id in docs}
    keys = sorted(marks)
    rows, good = np.array([plain_features(docs[k]) for k in keys]), np.array([marks[k] for k in keys])
    model = quality.learn(rows, good)
    mine = rows @ model.weights + model.shift
    want = plain_model(rows, good)
    assert ((mine >= 0) == (want >= 0)).mean() > 0.98 and np.corrcoef(mine, want)[0, 1] > 0.999


def test_long_text_features_in_blocks(monkeypatch):
    text = " ".join(["Some words", "AND MORE", "12 | 3!"] * 300).encode()
    whole = quality.features(text)
    monkeypatch.setattr(quality, "BLOCK_BYTES", 200)
    blocks = quality.features(text)
    # The spaces at which blocks are cut and the words repeated across a cut are all that differs.
    same = [i for i in range(quality.FEATURES) if i not in (quality.COLUMNS + 3, quality.COLUMNS + 4)]
    assert np.allclose(whole[same], blocks[same], atol=0.03)


def test_keys_of_vectors_are_whole_numbers(frame):
    with pytest.raises(TypeError, match="whole numbers"):
        metric_join.near_duplicates(frame("vec_id string, embedding array<float>, label int", [("a", [1.0], 1)]))
