"""Byte-level BPE by a table of distinct words.

Texts are split into the tokenizer's words; each distinct word is encoded once for the whole corpus and
its ids are joined back to the texts by position. Decoding looks each id up in the table of pieces, which
has one entry for each id of the tokenizer and is loaded where the ids are; a join in Spark would shuffle a
row for every token.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabuloom.llm import chunks, hashing

# Fixed value: the word pattern of the byte-level tokenizer, white space spelt out as in its library.
SPACE = r"\p{White_Space}"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|{SPACE}+(?![^{SPACE}])|{SPACE}+"

WORDS = regex.compile(PATTERN)
#: A single space between two characters that are not: no word reaches across its front.
BORDER = regex.compile(rf"(?<=[^{SPACE}]) (?=[^{SPACE}])")
#: Characters that are split at a time, of the documents of a chunk, and words encoded at a time.
BLOCK_CHARS = 250_000
CHUNK_CHARS = 12 << 20
BATCH_WORDS = 4096
#: Documents decoded at a time.
BATCH_ROWS = 256


def load(path: str) -> str:
    """The tokenizer file's text; checks that it is of the kind that is split and joined here."""
    with open(path, encoding="utf-8") as file:
        text = file.read()
    spec = json.loads(text)
    split = spec["pre_tokenizer"] or {}
    plain = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
    if not plain or spec.get("normalizer") or spec["model"]["type"] != "BPE" or any(t[k] for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError("not a plain byte-level BPE tokenizer")
    return text


@lru_cache(maxsize=2)
def _tokenizer(spec: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    found = Tokenizer.from_str(spec)
    found.no_truncation()
    found.no_padding()
    return found


@lru_cache(maxsize=2)
def _special(spec: str):
    """Splits at the added tokens, the longest first, and keeps them; None if there are none."""
    added = sorted((t["content"] for t in json.loads(spec)["added_tokens"]), key=len, reverse=True)
    return regex.compile("(" + "|".join(map(regex.escape, added)) + ")") if added else None


#: Above this character libraries may disagree on nearly all.
OLD = 0x2FA20


@lru_cache(maxsize=1)
def _recent() -> re.Pattern:
    """Characters that an old Unicode version lacks: libraries may disagree on which are letters."""
    old = unicodedata.ucd_3_2_0
    lacks = [c for c in range(OLD) if old.category(chr(c)) in ("Cn", "Cs")]
    firsts = [c for i, c in enumerate(lacks) if not i or lacks[i - 1] != c - 1]
    lasts = [c for i, c in enumerate(lacks) if i + 1 == len(lacks) or lacks[i + 1] != c + 1]
    return re.compile("[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip([*firsts, OLD], [*lasts, 0x10FFFF])) + "]")


def words(text: str, spec: str) -> Iterator[list[str]]:
    """The words of a text, block by block; an added token is a word of its own.

    A block with characters on which libraries may disagree is split by the tokenizer itself.
    """
    special = _special(spec)
    pieces = special.split(text) if special and special.search(text) else [text]
    for i, piece in enumerate(pieces):
        if i % 2:
            yield [piece]
            continue
        start = 0
        while len(piece) - start > BLOCK_CHARS:
            border = BORDER.search(piece, start + BLOCK_CHARS)
            if not border:
                break
            yield _split(piece[start:border.start()], spec)
            start = border.start()
        yield _split(piece[start:] if start else piece, spec)


def _split(block: str, spec: str) -> list[str]:
    if block.isascii() or not _recent().search(block):
        return WORDS.findall(block)
    return [block[a:b] for _, (a, b) in _tokenizer(spec).pre_tokenizer.pre_tokenize_str(block)]


SPACES, LETTERS, NUMBERS, OTHERS, ENDS, RECENT = range(6)
#: Stands after each text in an array of characters.
STOP = 0x110000


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """The class of each character, RECENT where libraries may disagree on it."""
    found = np.full(STOP + 1, RECENT, dtype=np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, OLD)]))
    found[:OLD] = OTHERS
    for kind, pattern in ((LETTERS, r"\p{L}"), (NUMBERS, r"\p{N}"), (SPACES, SPACE)):
        found[[ord(c) for c in regex.findall(pattern, every)]] = kind
    found[[ord(c) for c in _recent().findall(every)]] = RECENT
    found[STOP] = ENDS
    return found


def starts(chars: np.ndarray) -> np.ndarray:
    """Whether a word of the pattern, or a STOP, begins at each character of texts with a STOP after each."""
    kind = _classes()[chars]
    change = np.append(True, kind[1:] != kind[:-1])
    space = kind == SPACES
    # A run of other characters begins a word, or its single space before it does.
    after = np.append(False, chars[:-1] == 32)
    found = change & (space | ~after | (kind == ENDS))
    # Of white space before a word all but the last character is one word.
    found |= space & np.append((kind[1:] != SPACES) & (kind[1:] != ENDS), False)
    quote = np.flatnonzero((chars == 39) & found)
    one, two = chars[np.minimum(quote + 1, len(chars) - 1)], chars[np.minimum(quote + 2, len(chars) - 1)]
    for letters in ("s", "t", "re", "ve", "m", "ll", "d"):
        own = quote[(one == ord(letters[0])) & ((two == ord(letters[1])) if len(letters) > 1 else True)]
        found[own + 1] = False
        found[own + 1 + len(letters)] = True
    return found


def _pieces_of(text: str) -> Iterator[str]:
    """A text in pieces of about BLOCK_CHARS characters, cut where a word begins."""
    start = 0
    while len(text) - start > BLOCK_CHARS:
        border = BORDER.search(text, start + BLOCK_CHARS)
        if not border:
            break
        yield text[start:border.start()]
        start = border.start()
    yield text[start:] if start else text


class _Block:
    """Distinct words of some texts and the number of each word of each text."""

    def __init__(self, texts: list[str], spec: str):
        special = _special(spec)
        stop = STOP.to_bytes(4, "little")
        data = stop.join([t.encode("utf-32-le") for t in texts]) + stop
        chars = np.frombuffer(data, dtype="<u4")
        found = starts(chars)
        low = np.cumsum([0] + [len(t) + 1 for t in texts])
        odd = set(np.searchsorted(low, np.flatnonzero(_classes()[chars] == RECENT), side="right") - 1)
        for i, text in enumerate(texts):
            if i in odd or special and special.search(text):
                sizes = [len(w) for b in words(text, spec) for w in b]
                found[low[i]:low[i + 1] - 1] = False
                found[low[i] + np.cumsum([0, *sizes[:-1]])] = True
        start = np.flatnonzero(found)
        end = np.append(start[1:], len(chars))
        real = chars[start] != STOP
        start, end = start[real], end[real]
        hashed, check = hashing.spans(chars, start, end), hashing.spans(chars, start, end, hashing.OTHER)
        self.hashes, first, codes = np.unique(hashed, return_index=True, return_inverse=True)
        if (check[first][codes] != check).any():
            raise RuntimeError("two words have the same hash")
        self.check = check[first]
        self._joined, self._spans = "\n".join([*texts, ""]), np.column_stack([start[first], end[first]])
        codes = codes.astype(np.uint32)
        edges = np.searchsorted(start, low)
        self.codes = [codes[a:b] for a, b in zip(edges[:-1], edges[1:])]

    def words(self, chosen: np.ndarray) -> list[bytes]:
        """The words at the chosen places of `hashes`."""
        joined = self._joined
        return [joined[a:b].encode() for a, b in self._spans[chosen].tolist()]


def _chunks(batches: Iterator[pa.RecordBatch], spec: str, chunk: int) -> Iterator[tuple]:
    """(name, words and their hashes by hash, keys, codes of each document) for each chunk."""
    task, number = TaskContext.get().partitionId(), 0
    keys: list = []
    codes: list[list[tuple[int, np.ndarray]]] = []
    blocks: list[np.ndarray] = []
    waiting: list[tuple[int, str]] = []
    none = np.zeros(0, dtype=np.uint64)
    hashes, check, listed = none, none, np.zeros(0, dtype=object)
    size = pending = 0

    def settle() -> None:
        """Split the waiting texts and add their new words to those of the chunk."""
        nonlocal waiting, pending, hashes, check, listed
        if waiting:
            block = _Block([t for _, t in waiting], spec)
            for (i, _), c in zip(waiting, block.codes):
                codes[i].append((len(blocks), c))
            blocks.append(block.hashes)
            place = np.searchsorted(hashes, block.hashes)
            known = np.append(hashes, np.uint64(0))[place] == block.hashes
            known &= place < len(hashes)
            if (check[place[known]] != block.check[known]).any():
                raise RuntimeError("two words have the same hash")
            new = np.flatnonzero(~known)
            fresh = np.empty(len(new), dtype=object)
            fresh[:] = block.words(new)
            hashes, check, listed = (np.insert(old, place[new], more) for old, more in ((hashes, block.hashes[new]), (check, block.check[new]), (listed, fresh)))
        waiting, pending = [], 0

    def done() -> tuple:
        settle()
        words_of = listed.tolist()
        places = [np.searchsorted(hashes, h).astype(np.uint32) for h in blocks]
        numbered = [np.concatenate([places[i][c] for i, c in own]) for own in codes]
        return chunks.name(task, number, b"\xff".join(words_of)), words_of, hashes, keys, numbered

    for batch in batches:
        for key, value in zip(batch.column(0).to_pylist(), batch.column(1)):
            text = value.as_py() or ""
            if size and size + len(text) > chunk:
                yield done()
                keys, codes, blocks, size, number = [], [], [], 0, number + 1
                hashes, check, listed = none, none, np.zeros(0, dtype=object)
            keys.append(key)
            codes.append([])
            for piece in _pieces_of(text) if len(text) > BLOCK_CHARS else (text,):
                if pending + len(piece) > BLOCK_CHARS:
                    settle()
                waiting.append((len(codes) - 1, piece))
                pending += len(piece) + 1
            size += len(text) + 1
    if keys:
        yield done()


def _encode_part(rows: pa.Table, spec: str) -> pa.Table:
    """Ids of the words of one part; each distinct word is encoded once."""
    index: dict[bytes, int] = {}
    lists = [np.array([index.setdefault(w, len(index)) for w in chunks.unpack_bytes(x).split(b"\xff")]) for x in rows.column("words").to_pylist()]
    each = iter(index)
    sizes_of, ids_of = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype="<u4")]
    while some := [w.decode() for w in islice(each, BATCH_WORDS)]:
        coded = [e.ids for e in _tokenizer(spec).encode_batch(some, add_special_tokens=False)]
        sizes_of.append(np.fromiter(map(len, coded), dtype=np.int64, count=len(coded)))
        ids_of.append(np.fromiter((i for e in coded for i in e), dtype="<u4", count=int(sizes_of[-1].sum())))
    size, ids = np.concatenate(sizes_of), np.concatenate(ids_of)
    start = np.cumsum(size) - size
    sizes = [chunks.pack(size[own]) for own in lists]
    values = [chunks.pack(ids[chunks.spread(start[own], size[own])]) for own in lists]
    return pa.table({"chunk": rows.column("chunk"), "part": rows.column("part"), "sizes": pa.array(sizes, pa.binary()), "ids": pa.array(values, pa.binary())})


def _join_by_position(found: pa.Table, docs: pa.Table, table: list[bytes] | None) -> pa.Table:
    """The ids of each document of a chunk, with the text they decode to if there is a table of pieces."""
    order = np.argsort(found.column("part").to_numpy()) if found.num_rows else []
    nothing = np.zeros(0, dtype="<u4")
    part_sizes, part_ids = found.column("sizes").to_pylist(), found.column("ids").to_pylist()
    sizes = np.concatenate([nothing, *(chunks.unpack(part_sizes[i]) for i in order)]).astype(np.int64)
    ids = np.concatenate([nothing, *(chunks.unpack(part_ids[i]) for i in order)])
    ranked = chunks.unpack(next(x for x in docs.column("ranked").to_pylist() if x is not None))
    if len(ranked) != len(sizes):
        raise RuntimeError("the documents came in another order when read again; checkpoint the table first")
    sizes, start = sizes[ranked], (np.cumsum(sizes) - sizes)[ranked]
    out = []
    for packed in docs.column("codes").to_pylist():
        codes = chunks.unpack(packed)
        blocks = [codes[i:i + chunks.BLOCK] for i in range(0, len(codes), chunks.BLOCK)]
        out.append(b"".join(ids[chunks.spread(start[b], sizes[b])].tobytes() for b in blocks))
    columns = {"k": docs.column("k"), "n_tokens": pa.array([len(x) // 4 for x in out], pa.int64()), "ids": pa.array(out, pa.binary())}
    if table is not None:
        columns["text"] = pa.array([_text(x, table) for x in out], pa.string())
    return pa.table(columns)


def encode(docs: DataFrame, spec: str, key: str = "doc_id", text: str = "text", chunk: int = CHUNK_CHARS) -> DataFrame:
    """(key, n_tokens, ids) per row of `docs`; ids are little-endian unsigned integers of 32 bits.

    `spec` is what `load` returns. `docs` must give its rows in the same order whenever it is read, as a
    table or a checkpoint does; otherwise the query fails. A null text is an empty one and has no ids; null
    and repeated keys are kept; an empty table gives an empty one; other columns are not read.
    """
    return _encoded(docs, spec, key, text, chunk, False).withColumnRenamed("k", key)


def _encoded(docs: DataFrame, spec: str, key: str, text: str, chunk: int, decoded: bool) -> DataFrame:
    n_parts = chunks.count_parts(docs, text)
    rows = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))
    kind = docs.schema[key].dataType

    def dictionary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for called, listed, hashes, _, _ in _chunks(batches, spec, chunk):
            part, edges = chunks.by_part(hashes, n_parts)
            packed = [chunks.pack_bytes(b"\xff".join(listed[a:b])) for a, b in zip(edges[:-1], edges[1:])]
            yield pa.RecordBatch.from_arrays([pa.array([called] * len(part), pa.string()), pa.array(part), pa.array(packed, pa.binary())], ["chunk", "part", "words"])

    def positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for called, listed, _, keys, codes in _chunks(batches, spec, chunk):
            # Frequent words get small numbers, which take less room.
            seen = np.zeros(len(listed), dtype=np.int64)
            for c in codes:
                np.add.at(seen, c, 1)
            ranked = np.argsort(-seen, kind="stable")
            rank = np.empty(len(ranked), dtype=np.uint32)
            rank[ranked] = np.arange(len(ranked), dtype=np.uint32)
            yield pa.RecordBatch.from_pydict({
                "chunk": [called] * len(keys), "k": pa.array(keys, _arrow(kind)), "codes": pa.array([chunks.pack(rank[c]) for c in codes], pa.binary()),
                "ranked": pa.array([chunks.pack(ranked)] + [None] * (len(keys) - 1), pa.binary())})

    found = rows.mapInArrow(dictionary, "chunk string, part int, words binary")
    found = found.repartition(n_parts, "part").groupBy("part").applyInArrow(lambda t: _encode_part(t, spec), "chunk string, part int, sizes binary, ids binary")
    coded = rows.mapInArrow(positions, f"chunk string, k {kind.simpleString()}, codes binary, ranked binary")
    joined = found.groupBy("chunk").cogroup(coded.groupBy("chunk")).applyInArrow(
        lambda a, b: _join_by_position(a, b, pieces(spec) if decoded else None),
        f"k {kind.simpleString()}, n_tokens long, ids binary" + ", text string" * decoded)
    return joined


def _arrow(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def _bytes_of() -> dict[str, int]:
    """The byte that each character of a byte-level piece stands for."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


@lru_cache(maxsize=2)
def pieces(spec: str) -> list[bytes]:
    """The bytes of each id; an id without a piece has none."""
    parsed, of = json.loads(spec), _bytes_of()
    listed = {i: bytes(of[c] for c in piece) for piece, i in parsed["model"]["vocab"].items()}
    listed |= {t["id"]: t["content"].encode() for t in parsed["added_tokens"]}
    return [listed.get(i, b"") for i in range(max(listed) + 1)]


def _text(packed: bytes, table: list[bytes]) -> str:
    """Ids joined with their pieces, block by block."""
    codes = np.frombuffer(packed, dtype="<u4")
    blocks = (codes[i:i + chunks.BLOCK].tolist() for i in range(0, len(codes), chunks.BLOCK))
    return b"".join(b"".join([table[i] for i in block]) for block in blocks).decode("utf-8", "replace")


def decode(encoded: DataFrame, spec: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """`encoded` with the text of its ids; bytes that are not UTF-8 become replacement characters.

    A null is no ids. A column called as the text is replaced. The table of pieces is bounded by the
    tokenizer's vocabulary and goes to every task.
    """
    kept = encoded.drop(text) if text != ids else encoded
    place = kept.columns.index(ids)
    schema = kept.withColumn(text, F.lit("")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pieces(spec)
        for whole in batches:
            for low in range(0, whole.num_rows, BATCH_ROWS):
                batch = whole.slice(low, BATCH_ROWS)
                out = [_text(packed.as_py() or b"", table) for packed in batch.column(place)]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], [*batch.schema.names, text])

    return kept.mapInArrow(run, schema)


def round_trip(docs: DataFrame, spec: str, key: str = "doc_id", text: str = "text", chunk: int = CHUNK_CHARS) -> DataFrame:
    """(key, n_tokens, ids, text): `encode` and `decode` in one step, which needs no second Python process a task."""
    return _encoded(docs, spec, key, text, chunk, True).select(F.col("k").alias(key), "n_tokens", "ids", "text")
