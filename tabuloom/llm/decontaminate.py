"""Benchmark decontamination by edit distance.

Texts and benchmark items are sequences of words in lower case without punctuation. An item is found
in a text where its word edit distance to a passage is at most (1 - similarity) of its words. Windows of
an item's size are mapped to Hamming space by random walks (the CGK embedding: repeat a symbol or step to
the next as a random function of symbol and step says); a few sampled positions of a walk are a key, and
repeated walks give enough keys to reach the target recall. The share of walks that agree falls with an
item's length, so items of more than WALKED words are walked in segments of at most so many: if all segments
were further from their passage than the similarity allows, so were the item, hence one is not, and is found
like an item of its length. Keys of texts and items are joined; every candidate is verified by the exact edit
distance of the whole item.

Windows are only taken where enough runs of a few words occur in some item: with so few edits an item
must keep that many runs unbroken, so this leaves out no window that could be verified.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabuloom.llm import hashing
from tabuloom.llm.bpe import _arrow
from tabuloom.llm.common import cut, parts
from tabuloom.operators.ordering import unused

SIMILARITY = 0.8
#: Positions sampled of a walk, and the part of walks of a passage and its item, at the least similarity,
#: whose samples agree (measured by simulation on items of 30 words); walks follow from the recall.
SAMPLED = 3
AGREE = 0.085
RECALL = 0.97
#: Most words that are walked at once.
WALKED = 30
#: Sets the keys of segments apart from those of items of the same length.
SEGMENT = np.uint64(1)
#: Most bits of a filter (128 MB), enough for 50 million hashes; how many one has follows from their number.
FILTER_BITS = 1 << 30
#: Words of 64 bits that come to the driver in a row.
FILTER_ROW = 1 << 14
#: Bytes of texts searched at a time; the arrays for them take some sixty times as much.
BLOCK_BYTES = 1_000_000
HISTORY = 1 << 22
#: Words of regions by words of items that are compared at a time.
CELLS = 1 << 22
PAD = np.uint64(0)

# Bytes of words: ASCII letters and digits, and whatever is not ASCII.
IS_WORD = np.array([chr(i).isalnum() or i > 127 for i in range(128)] + [True] * 128)


def walks(recall: float = RECALL) -> int:
    return ceil(log(1 - recall) / log(1 - AGREE))


def edits(n: np.ndarray | int, similarity: float):
    """Most edits of an item of n words."""
    return np.floor(np.asarray(n) * (1 - similarity) + 1e-9).astype(np.int64)


def run_length(n: np.ndarray) -> np.ndarray:
    """Words of a run: three, fewer for items so short that edits could leave no run of three."""
    return np.where(n >= 10, 3, np.where(n >= 5, 2, np.minimum(n, 4)))


def least_runs(n: np.ndarray, similarity: float) -> np.ndarray:
    """Runs that stay unbroken: each edit breaks as many as a run has words."""
    q = run_length(n)
    return np.maximum(n - q + 1 - edits(n, similarity) * q, 1)


def runs(words: np.ndarray, q: int) -> np.ndarray:
    """A hash of each run of q words."""
    if len(words) < q:
        return np.zeros(0, dtype=np.uint64)
    found = np.full(len(words) - q + 1, q, dtype=np.uint64)
    for i in range(q):
        found = hashing.pairs(found, words[i:len(words) - q + 1 + i])
    return found


def segments(n: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, length) of the segments that an item of n words is walked in, of nearly equal length."""
    number = -(-n // WALKED)
    edges = np.arange(number + 1) * n // number
    return edges[:-1], np.diff(edges)


class Walks:
    """The random walks; the same on every machine."""

    def __init__(self, number: int, seed: int = 7):
        self.number, self.seed = number, seed
        self.at = np.random.default_rng(seed).random((number, SAMPLED))

    def _steps(self, first: int, last: int) -> np.ndarray:
        step = np.arange(first, last, dtype=np.uint64)[:, None] * np.uint64(self.number) + np.arange(self.number, dtype=np.uint64)[None, :]
        return hashing.mix(step + np.uint64(self.seed << 40)) | np.uint64(1)

    def keys(self, words: np.ndarray, start: np.ndarray, limit: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Keys (window, walk) of the windows of `limit` words from `start`, for items of n words."""
        out = np.zeros((len(start), self.number), dtype=np.uint64)
        order, low = np.argsort(n, kind="stable"), 0
        padded = np.append(words, PAD)
        while low < len(order):
            size = max(1, HISTORY // (2 * int(n[order[min(len(order) - 1, low + 511)]]) * self.number))
            own = order[low:low + min(512, size)]
            out[own] = self._block(padded, start[own], limit[own], n[own])
            low += len(own)
        return out

    def _block(self, words: np.ndarray, start: np.ndarray, limit: np.ndarray, n: np.ndarray) -> np.ndarray:
        steps = 2 * int(n.max())
        history = np.empty((steps, len(start), self.number), dtype=np.uint64)
        place = np.zeros((len(start), self.number), dtype=np.int64)
        first, last, off = start[:, None], limit[:, None], len(words) - 1
        odd = self._steps(0, steps)
        for j in range(steps):
            symbol = words[np.where(place < last, first + place, off)]
            history[j] = symbol
            place += (symbol * odd[j] >> np.uint64(63)).astype(np.int64)
        sampled = np.sort((self.at[None, :, :] * 2 * n[:, None, None]).astype(np.int64), axis=2)
        window, walk = np.arange(len(start))[:, None], np.arange(self.number)[None, :]
        key = hashing.pairs(np.broadcast_to(n[:, None].astype(np.uint64), (len(start), self.number)), np.arange(self.number, dtype=np.uint64)[None, :])
        for i in range(SAMPLED):
            key = hashing.pairs(key, history[sampled[:, :, i], window, walk])
        return key


def normal_words(text: str) -> np.ndarray:
    return hashing.words(np.frombuffer(text.lower().encode(), dtype=np.uint8), IS_WORD)[0]


def prepared(items: DataFrame, key: str, text: str, walk: Walks, similarity: float) -> DataFrame:
    """(item, passage, n, words, runs, keys) per item that has words; passage is a hash of the words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = normal_words(value or "")
                if len(words):
                    n = np.array([len(words)])
                    found = runs(words, int(run_length(n)[0]))
                    start, length = segments(len(words))
                    keys = walk.keys(words, start, length, length)
                    keys = keys if len(words) <= WALKED else hashing.pairs(keys, np.full(keys.shape, SEGMENT))
                    rows.append((name, xxhash.xxh64_intdigest(words.tobytes()) - (1 << 63), len(words), words.tobytes(), np.unique(found).view(np.int64).tolist(), np.unique(keys).view(np.int64).tolist()))
            columns = list(zip(*rows)) or [()] * 6
            kinds = [batch.schema.types[0], pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["item", "passage", "n", "words", "runs", "keys"])

    kind = items.schema[key].dataType.simpleString()
    return items.select(F.col(key).alias("item"), F.col(text).cast("string").alias("t")).mapInArrow(run, f"item {kind}, passage long, n int, words binary, runs array<long>, keys array<long>")


def _probes(hashed: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64(bits - 1)
    return hashed & mask, (hashed >> np.uint64(32)) & mask


def filter_bits(n: int) -> int:
    """Bits for a filter of n hashes, of which at most a tenth is set: 1 % of others pass its two probes."""
    return min(FILTER_BITS, 1 << max(16, ceil(log(20 * max(n, 1), 2))))


def _filter(hashes: DataFrame, column: str, bits: int) -> np.ndarray:
    """A Bloom filter of so many bits; it comes to the driver in pieces of 128 KB."""
    mask, size = bits - 1, min(FILTER_ROW, bits // 64)
    h = F.col(column)
    at = hashes.select(F.explode(F.array(h.bitwiseAND(F.lit(mask)), F.shiftrightunsigned(h, 32).bitwiseAND(F.lit(mask)))).alias("at"))
    words = at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("b"))
    words = words.withColumn("piece", F.expr(f"word div {size}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces: dict[int, np.ndarray] = {}
        for batch in batches:
            word, b, piece = (batch.column(i).to_numpy() for i in range(3))
            for p in np.unique(piece).tolist():
                own = piece == p
                pieces.setdefault(p, np.zeros(size, dtype=np.int64))[word[own] - p * size] = b[own]
        yield pa.RecordBatch.from_arrays([pa.array(list(pieces), pa.int64()), pa.array([x.tobytes() for x in pieces.values()], pa.binary())], ["piece", "b"])

    found = np.zeros(bits // 64, dtype=np.uint64)
    for p, b in words.repartition(parts(hashes.sparkSession), "piece").mapInArrow(run, "piece long, b binary").collect():
        found[p * size:(p + 1) * size] = np.frombuffer(b, dtype=np.uint64)
    return found


def _in(hashed: np.ndarray, bits: np.ndarray) -> np.ndarray:
    hit = np.ones(hashed.shape, dtype=bool)
    for at in _probes(hashed, len(bits) * 64):
        hit &= (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
    return hit


class Finder:
    """Windows of texts that share a key with an item."""

    def __init__(self, sizes: list[int], walk: Walks, run_bits: np.ndarray, key_bits: np.ndarray, similarity: float):
        """`sizes`: words of the items."""
        self.walk, self.run_bits, self.key_bits, self.similarity = walk, run_bits, key_bits, similarity
        #: Words before and after a segment of each length that its item may take up.
        self.before, self.after = np.zeros(WALKED + 1, dtype=np.int64), np.zeros(WALKED + 1, dtype=np.int64)
        self.short = np.zeros(WALKED + 1, dtype=bool)
        for n in sizes:
            if n <= WALKED:
                self.short[n] = True
                continue
            slack = int(edits(n, similarity)) + 3
            for at, length in zip(*segments(n)):
                self.before[length] = max(self.before[length], at + slack)
                self.after[length] = max(self.after[length], n - at - length + slack)
        self.sizes = np.flatnonzero(self.short | (self.before > 0))

    def windows(self, texts: list[bytes]) -> Iterator[tuple[int, list[int], bytes]]:
        """(number of the text, keys, words of the region) for each window."""
        data = np.frombuffer(b"\n".join(texts), dtype=np.uint8)
        words, at, _ = hashing.words(data, IS_WORD)
        edges = np.searchsorted(at, np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]))
        text_of = np.repeat(np.arange(len(texts)), np.diff(edges))
        start, n = self._candidates(words, text_of, edges)
        if not len(start):
            return
        end = edges[text_of[start] + 1]
        limit = np.minimum(n, end - start)
        same = self._contents(words, start, limit, n)
        _, first, back = np.unique(same, return_index=True, return_inverse=True)
        keys = self.walk.keys(words, start[first], limit[first], n[first])
        hit = _in(keys, self.key_bits) & self.short[n[first]][:, None]
        slack = edits(n, self.similarity) + 3
        for i in np.flatnonzero(hit.any(axis=1)[back]):
            own = back[i]
            low, high = max(edges[text_of[start[i]]], start[i] - slack[i]), min(end[i], start[i] + n[i] + slack[i])
            yield int(text_of[start[i]]), keys[own][hit[own]].view(np.int64).tolist(), words[low:high].tobytes()
        keys = hashing.pairs(keys, np.full(keys.shape, SEGMENT))
        hit = _in(keys, self.key_bits) & (self.before > 0)[n[first]][:, None]
        at = np.flatnonzero(hit.any(axis=1)[back])
        lows = np.maximum(edges[text_of[start[at]]], start[at] - self.before[n[at]])
        highs = np.minimum(end[at], start[at] + n[at] + self.after[n[at]])
        yield from self._regions(words, text_of, at, lows, highs, lambda i: keys[back[i]][hit[back[i]]])

    @staticmethod
    def _regions(words: np.ndarray, text_of: np.ndarray, at: np.ndarray, lows: np.ndarray, highs: np.ndarray, keys_of) -> Iterator[tuple[int, list[int], bytes]]:
        """As `windows`, for segments: stretches that overlap, as those of one long item do, are one region."""
        order = np.argsort(lows, kind="stable")
        lows, highs, at = lows[order], np.maximum.accumulate(highs[order]), at[order]
        fresh = np.flatnonzero(np.append(True, lows[1:] >= highs[:-1]) if len(lows) else np.zeros(0, dtype=bool))
        for a, b in zip(fresh, np.append(fresh[1:], len(lows))):
            keys = np.unique(np.concatenate([keys_of(i) for i in at[a:b]]))
            yield int(text_of[lows[a]]), keys.view(np.int64).tolist(), words[lows[a]:highs[b - 1]].tobytes()

    def _candidates(self, words: np.ndarray, text_of: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and sizes of the windows that hold enough runs; a window starts at any run and two words before it."""
        starts, sizes = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        length = run_length(self.sizes)
        for q in np.unique(length):
            own = self.sizes[length == q]
            found = runs(words, int(q))
            if not len(found):
                continue
            hit = _in(found, self.run_bits) & (text_of[:len(found)] == text_of[q - 1:])
            total = np.zeros(len(words) + 1, dtype=np.int64)
            np.cumsum(hit, out=total[1:len(hit) + 1])
            total[len(hit) + 1:] = total[len(hit)]
            first = np.flatnonzero(hit)
            low = edges[text_of[first]]
            begin = np.unique(np.concatenate([first, np.maximum(first - 2, low)]))
            end = edges[text_of[begin] + 1] if len(begin) else begin
            for n in own:
                stop = np.minimum(begin + n, end)
                inside = total[np.maximum(stop - q + 1, begin)] - total[begin]
                good = inside >= least_runs(n, self.similarity)
                good &= stop - begin >= n - edits(n, self.similarity)
                starts.append(begin[good])
                sizes.append(np.full(int(good.sum()), n))
        return np.concatenate(starts), np.concatenate(sizes)

    @staticmethod
    def _contents(words: np.ndarray, start: np.ndarray, limit: np.ndarray, n: np.ndarray) -> np.ndarray:
        """A hash of the words of each window."""
        return hashing.pairs(hashing.spans(words, start, start + limit), n.astype(np.uint64))


def edit_distance(item: list[int], region: list[int]) -> int:
    """Least edit distance of the item to any passage of the region, a bit of an integer for each word."""
    masks: dict[int, int] = {}
    for i, w in enumerate(item):
        masks[w] = masks.get(w, 0) | 1 << i
    n = len(item)
    full, top = (1 << n) - 1, 1 << (n - 1)
    up, down, score = full, 0, n
    best = n
    for w in region:
        eq = masks.get(w, 0)
        diagonal = ((((eq & up) + up) ^ up) | eq | down) & full
        right, left = (down | ~(diagonal | up)) & full, up & diagonal
        score += bool(right & top) - bool(left & top)
        best = min(best, score)
        right, left = (right << 1) & full, (left << 1) & full
        up, down = (left | ~(diagonal | right)) & full, right & diagonal
    return best


def edit_distances(items: list[np.ndarray], regions: list[np.ndarray]) -> np.ndarray:
    """`edit_distance` of each item and its region; items of up to 63 words in blocks of pairs, a number of 64 bits each."""
    out = np.zeros(len(items), dtype=np.int32)
    sizes, widths = np.array([len(x) for x in items]), np.array([len(x) for x in regions])
    for i in np.flatnonzero(sizes > 63):
        out[i] = edit_distance(items[i].tolist(), regions[i].tolist())
    own = np.flatnonzero(sizes <= 63)
    own = own[np.argsort(widths[own], kind="stable")]
    while len(own):
        # As many pairs as CELLS words of regions by words of items allow, the longest region last.
        room = np.arange(1, len(own) + 1) * np.maximum.accumulate(widths[own]) * np.maximum.accumulate(sizes[own])
        number = max(1, int(np.searchsorted(room, CELLS, side="right")))
        block, own = own[:number], own[number:]
        out[block] = _block_distances([items[i] for i in block], [regions[i] for i in block])
    return out


def _block_distances(items: list[np.ndarray], regions: list[np.ndarray]) -> np.ndarray:
    sizes, widths = np.array([len(x) for x in items]), np.array([len(x) for x in regions])
    longest = int(sizes.max())
    item, region = np.zeros((len(items), longest), dtype=np.uint64), np.zeros((len(items), int(widths.max(initial=0))), dtype=np.uint64)
    for i, (x, y) in enumerate(zip(items, regions)):
        item[i, :len(x)], region[i, :len(y)] = x, y
    one, bit = np.uint64(1), np.uint64(1) << np.arange(longest, dtype=np.uint64)
    used = np.where(np.arange(longest) < sizes[:, None], bit, np.uint64(0))
    full, top = np.bitwise_or.reduce(used, axis=1), one << (sizes - 1).astype(np.uint64)
    up, down = full.copy(), np.zeros(len(items), dtype=np.uint64)
    score, best = sizes.copy(), sizes.copy()
    for j in range(region.shape[1]):
        eq = np.where(item == region[:, j, None], used, np.uint64(0)).sum(axis=1, dtype=np.uint64)
        diagonal = ((((eq & up) + up) ^ up) | eq | down) & full
        right, left = (down | ~(diagonal | up)) & full, up & diagonal
        score = score + ((right & top) > 0) - ((left & top) > 0)
        best = np.where(j < widths, np.minimum(best, score), best)
        right, left = (right << one) & full, (left << one) & full
        up, down = (left | ~(diagonal | right)) & full, right & diagonal
    return best


def _pieces(text: bytes, overlap: int, block: int) -> Iterator[bytes]:
    """A very long text in pieces that overlap by more than an item."""
    start = 0
    while True:
        stop = start + block + overlap
        while stop < len(text) and IS_WORD[text[stop]]:
            stop += 1
        yield text[start:stop]
        if stop >= len(text):
            return
        start = stop - overlap
        while start > 0 and IS_WORD[text[start - 1]]:
            start -= 1


def _row(docs: DataFrame, key: str, text: str):
    return F.xxhash64(F.col(key), F.col(text))


def found(docs: DataFrame, items: DataFrame, key: str, text: str, item_key: str, item_text: str, similarity: float = SIMILARITY, recall: float = RECALL, block: int = BLOCK_BYTES) -> DataFrame:
    """(k, row, item, distance, n_words) for every item found in a row of `docs`."""
    walk = Walks(walks(recall))
    kind = docs.schema[key].dataType
    listed = cut(prepared(items, item_key, item_text, walk, similarity))
    bounds = listed.agg(F.collect_set("n"), F.max(F.octet_length("words"))).first()
    longest = items.agg(F.max(F.octet_length(F.col(item_text).cast("string")))).first()[0] or 0
    overlap = 2 * longest + 4096
    context = docs.sparkSession.sparkContext
    hashes = [listed.select(F.explode(x).alias("h")).distinct() for x in ("runs", "keys")]
    finder = context.broadcast(Finder(sorted(bounds[0]), walk, *(_filter(h, "h", filter_bits(h.count())) for h in hashes), similarity))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = finder.value
        held: list[tuple] = []
        size = 0

        def done() -> pa.RecordBatch:
            seen = {}
            for i, keys, region in find.windows([t for _, _, t in held]):
                name = (held[i][0], held[i][1], xxhash.xxh64_intdigest(region) - (1 << 63))
                seen.setdefault(name, (region, set()))[1].update(keys)
            return pa.RecordBatch.from_arrays([
                pa.array([k for k, _, _ in seen], _arrow(kind)), pa.array([r for _, r, _ in seen], pa.int64()), pa.array([w for _, _, w in seen], pa.int64()),
                pa.array([sorted(x) for _, x in seen.values()], pa.list_(pa.int64())), pa.array([x for x, _ in seen.values()], pa.binary())], ["k", "row", "region", "keys", "words"])

        for batch in batches:
            for name, row, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                whole = (value.as_py() or "").lower().encode()
                for piece in _pieces(whole, overlap, block) if len(whole) > block + overlap else (whole,):
                    if size + len(piece) > block and held:
                        yield done()
                        held, size = [], 0
                    held.append((name, row, piece))
                    size += len(piece) + 1
        if held:
            yield done()

    rows = docs.select(F.col(key).alias("k"), _row(docs, key, text).alias("row"), F.col(text).cast("string").alias("t"))
    windows = cut(rows.mapInArrow(run, f"k {kind.simpleString()}, row long, region long, keys array<long>, words binary"))
    regions = windows.groupBy("region").agg(F.first("words").alias("words"))
    passages = listed.groupBy("passage").agg(F.first("n").alias("n"), F.first("words").alias("item_words"), F.first("keys").alias("keys"))
    pairs = windows.select("region", F.explode("keys").alias("key")).distinct().join(passages.select("passage", F.explode("keys").alias("key")), "key").select("region", "passage").distinct()
    pairs = pairs.join(regions, "region").join(passages.drop("keys"), "passage")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            most = edits(batch.column(2).to_numpy(), similarity)
            item, region = ([np.frombuffer(x, dtype=np.uint64) for x in batch.column(c).to_pylist()] for c in (3, 4))
            distance = edit_distances(item, region)
            good = pa.array(distance <= most)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(distance)], ["region", "passage", "n", "distance"]).filter(good)

    sure = pairs.select("region", "passage", "n", "item_words", "words").mapInArrow(verify, "region long, passage long, n int, distance int")
    hits = windows.select("k", "row", "region").join(sure, "region").groupBy("k", "row", "passage").agg(F.min("distance").alias("distance"), F.first("n").alias("n_words"))
    return hits.join(listed.select("passage", "item").distinct(), "passage").drop("passage")


def contaminated(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", similarity: float = SIMILARITY, recall: float = RECALL, block: int = BLOCK_BYTES) -> DataFrame:
    """(key, item key, distance, n_words): the items found in `docs`, a row for each document and item.

    distance is the least word edit distance to a passage of the document, at most (1 - similarity) of
    the item's n_words. Null and empty texts hold no item, and items without words are not looked for;
    items of fewer than five words must occur unchanged. Repeated items are found each; repeated rows
    give one row. Empty tables give an empty one; other columns are not read.
    """
    hits = found(docs, items, key, text, item_key, item_text, similarity, recall, block)
    rows = hits.groupBy("k", "item").agg(F.min("distance").alias("distance"), F.first("n_words").alias("n_words"))
    return rows.select(F.col("k").alias(key), F.col("item").alias(item_key), "distance", "n_words")


def decontaminate(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", similarity: float = SIMILARITY, recall: float = RECALL, block: int = BLOCK_BYTES) -> DataFrame:
    """The rows of `docs` in which no item was found (see `contaminated`), with all their columns.

    Rows with null or empty text, and with a null key, are kept or go by their text like any others;
    rows that repeat key and text share their fate. Any columns may stand beside; empty tables are kept.
    """
    k, row, own = (unused(docs.columns, c) for c in ("_k", "_row", "_own"))
    hits = found(docs, items, key, text, item_key, item_text, similarity, recall, block).select(F.col("k").alias(k), F.col("row").alias(row)).distinct()
    rows = docs.withColumn(own, _row(docs, key, text))
    return rows.join(hits, (F.col(own) == F.col(row)) & F.col(key).eqNullSafe(F.col(k)), "left_anti").drop(own)
