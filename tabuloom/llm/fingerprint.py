"""Fingerprints of texts as homomorphic multiset hashes of their paragraphs, in DataFrame functions only.

A paragraph (a line) is hashed into a wide vector, and a text's fingerprint is the sum of the vectors of
its paragraphs, lane by lane modulo a power of two. So the order of paragraphs does not matter, and
paragraphs are inserted or deleted by adding or subtracting the sum of their vectors. A vector counts its
paragraph and holds its SHA-256 in eight lanes of 30 bits; these tell texts apart. It also counts the
paragraph's pieces (sentences, up to 60 characters at a time) and holds, in 240 lanes of 15 bits, how
many of them have each bit of their SHA-256 set; bits of different pieces are independent, so these say
how alike two texts are: 2 a.b / (a.a + b.b) of the centred lanes is near the share of pieces in common.

Four lanes of 15 bits are summed at once in one number of 60 bits. Rows are summed in groups that no
lane can overflow in; groups are then put together lane by lane. An edited text costs its changed end
only: both texts share the sum of the paragraphs before it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Hex digits of a word, and the words that are taken of a SHA-256.
DIGITS, WORDS = 15, 4
BITS = 4 * DIGITS
#: Widths of the lanes of paragraphs and of pieces.
WIDE, NARROW = 30, 15
LANES = BITS // NARROW
PIECE = r"[^.!? ][^.!?]{0,59}"
#: Paragraphs, and pieces of each, that are summed at once: fewer than 2 ** NARROW rows.
GROUP = 128
#: Documents of a run of neighbours, and runs at most.
RUN, RUNS = 512, 10_000


def _every(width: int, value: int) -> Column:
    """`value` in all lanes of `width` bits."""
    return F.lit(sum(value << i for i in range(0, BITS, width))).cast("long")


def _added(a: Column, b: Column) -> Column:
    """The lanes of pieces added: lower bits with carry, the top bit of each lane without."""
    low, top = _every(NARROW, (1 << NARROW - 1) - 1), _every(NARROW, 1 << NARROW - 1)
    return (a.bitwiseAND(low) + b.bitwiseAND(low)).bitwiseXOR(a.bitwiseXOR(b).bitwiseAND(top))


def _negative(a: Column) -> Column:
    """Each lane of pieces with the other sign: its complement and one."""
    return _added(a.bitwiseXOR(_every(NARROW, (1 << NARROW) - 1)), _every(NARROW, 1))


HEAD = ["paragraphs", *[f"hash{i}" for i in range(2 * WORDS)], "pieces"]
#: A fingerprint: counts modulo 2 ** 60, hashes modulo 2 ** 30, and the lanes of pieces, four to a number.
FINGERPRINT = f"struct<{','.join(f'{c}:bigint' for c in HEAD)},lanes:array<bigint>>"


def _modulus(name: str) -> int:
    return 1 << (WIDE if name.startswith("hash") else BITS)


def plus(a: Column, b: Column) -> Column:
    """The fingerprint of the paragraphs of both."""
    head = [F.pmod(a[c] + b[c], F.lit(_modulus(c))).alias(c) for c in HEAD]
    return F.struct(*head, F.zip_with(a["lanes"], b["lanes"], _added).alias("lanes"))


def minus(a: Column, b: Column) -> Column:
    """The fingerprint of the paragraphs of `a` without those of `b`."""
    head = [F.pmod(a[c] - b[c], F.lit(_modulus(c))).alias(c) for c in HEAD]
    return F.struct(*head, F.zip_with(a["lanes"], b["lanes"], lambda x, y: _added(x, _negative(y))).alias("lanes"))


def encoded(a: Column) -> Column:
    """The fingerprint as hex text."""
    pairs = [F.shiftleft(a[f"hash{2 * i + 1}"], WIDE).bitwiseOR(a[f"hash{2 * i}"]) for i in range(WORDS)]
    numbers = F.concat(F.array(a["paragraphs"], *pairs, a["pieces"]), a["lanes"])
    return F.array_join(F.transform(numbers, lambda x: F.lpad(F.lower(F.hex(x)), DIGITS, "0")), "")


def centred(a: Column) -> Column:
    """Twice each count of set bits less the pieces: of expectation 0, and the squares add up to the pieces."""
    def lane(x: Column, i: int) -> Column:
        v = (F.shiftright(x, NARROW * i).bitwiseAND((1 << NARROW) - 1) * 2 - a["pieces"]).bitwiseAND((1 << NARROW) - 1)
        return F.when(v >= 1 << NARROW - 1, v - (1 << NARROW)).otherwise(v)
    return F.flatten(F.transform(a["lanes"], lambda x: F.array(*[lane(x, i) for i in range(LANES)])))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0).cast("long"), lambda s, x: s + x)


def likeness(same: Column, product: Column, left: Column, right: Column) -> Column:
    """From 0 to 1: whether the fingerprints are the same, and products of their centred lanes."""
    both = left + right
    share = F.when(both > 0, (product * 2).cast("double") / both.cast("double")).otherwise(0.0)
    return F.when(same, 1.0).otherwise(F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)))


def summed(frame: DataFrame, keys: Sequence[str], paragraphs: str) -> DataFrame:
    """`keys` and the sums of the vectors of an array of paragraphs, in one row or, of very many paragraphs or pieces, more.

    `keys` must tell the rows of `frame` apart. Head sums are not reduced yet, lanes are.
    """
    word = lambda i: F.conv(F.substring("_sha", DIGITS * i + 1, DIGITS), 16, 10).cast("long")
    lines = frame.select(*keys, F.posexplode(paragraphs).alias("_line", "_text"))
    units = lines.select(*keys, F.expr(f"_line div {GROUP}").alias("_lines"), F.posexplode(
        F.concat(F.array("_text"), F.regexp_extract_all("_text", F.lit(PIECE), F.lit(0)))).alias("_at", "_unit"))
    # The paragraph itself is number 0, its pieces follow.
    words = units.select(*keys, "_lines", F.expr(f"_at div {GROUP}").alias("_ats"), (F.col("_at") == 0).alias("_whole"), F.sha2("_unit", 256).alias("_sha")).select(
        *keys, "_lines", "_ats", "_whole", *[word(i).alias(f"_w{i}") for i in range(WORDS)])
    none = F.lit(0).cast("long")
    whole, piece = (lambda x: F.when(F.col("_whole"), x).otherwise(none)), (lambda x: F.when(F.col("_whole"), none).otherwise(x))
    split = words.select(*keys, "_lines", "_ats", whole(F.lit(1)).alias("paragraphs"), piece(F.lit(1)).alias("pieces"),
                         *[whole(F.col(f"_w{i}")).alias(f"_h{i}") for i in range(WORDS)], *[piece(F.col(f"_w{i}")).alias(f"_p{i}") for i in range(WORDS)])
    halves = [h for i in range(WORDS) for h in (F.col(f"_h{i}").bitwiseAND((1 << WIDE) - 1), F.shiftright(f"_h{i}", WIDE))]
    bits = [F.shiftright(f"_p{i}", j).bitwiseAND(_every(NARROW, 1)) for i in range(WORDS) for j in range(NARROW)]
    groups = split.groupBy(*keys, "_lines", "_ats").agg(
        F.sum("paragraphs").alias("paragraphs"), *[F.sum(h).alias(f"hash{i}") for i, h in enumerate(halves)], F.sum("pieces").alias("pieces"),
        *[F.sum(b).alias(f"_b{i}") for i, b in enumerate(bits)])
    return groups.select(*keys, *HEAD, F.array(*[f"_b{i}" for i in range(len(bits))]).alias("lanes"))


def together(parts: DataFrame, keys: Sequence[str], kinds: dict[str, Column]) -> DataFrame:
    """`keys` and a fingerprint for each name of `kinds`: of the parts that its condition holds for."""
    none = F.lit(0).cast("long")
    sums = [F.sum(F.when(held, F.col(c)).otherwise(none)).alias(f"{name}_{c}") for name, held in kinds.items() for c in HEAD]
    lists = [F.collect_list(F.when(held, F.col("lanes"))).alias(f"{name}_lanes") for name, held in kinds.items()]
    grouped = parts.groupBy(*keys).agg(*sums, *lists)

    def fingerprint(name: str) -> Column:
        held = F.col(f"{name}_lanes")
        lanes = F.aggregate(F.slice(held, 2, F.greatest(F.size(held) - 1, F.lit(0))), F.get(held, F.lit(0)), lambda a, b: F.zip_with(a, b, _added))
        return F.struct(*[F.pmod(f"{name}_{c}", F.lit(_modulus(c))).alias(c) for c in HEAD], lanes.alias("lanes"))
    return grouped.select(*keys, *[fingerprint(name).alias(name) for name in kinds])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`key` and `fingerprint` (a struct, see FINGERPRINT) of every text.

    A null text counts as empty, and an empty one is one empty paragraph; null and repeated keys keep a row
    each. Other columns are not read.
    """
    rows = docs.select(F.col(key).alias("key"), F.monotonically_increasing_id().alias("row"), F.split(F.coalesce(text, F.lit("")), "\n", -1).alias("lines"))
    found = together(summed(rows, ["key", "row"], "lines"), ["key", "row"], {"fingerprint": F.lit(True)})
    return found.select(F.col("key").alias(key), "fingerprint")


def _place(array: Callable[[list], Column], bounds: list, key: Column) -> Column:
    """How many of the sorted bounds are below the key: by the last ones of blocks first, then within a block."""
    step = max(1, isqrt(len(bounds)))
    below = lambda found: F.size(F.filter(found, lambda b: b < key))
    whole = below(array(bounds[step - 1::step])) * step
    return whole + below(F.slice(array(bounds), whole + 1, step))


def edits(docs: DataFrame, key: str = "doc_id", text: str = "text", run_rows: int | None = None) -> DataFrame:
    """Every text's fingerprint, and that of the text with its last half taken from the next document.

    The last floor(n / 2) of a text's n code points are replaced by the first as many, or all, of the next
    text by descending key; the last document's next is the first. Returns key, n_chars, edited_sha256,
    fingerprint, edited_fingerprint, near_edited and near_next (likeness to the edited and to the next text).

    Texts are shuffled once, in runs of neighbours; the document that ends a run's neighbours comes along from
    the next run. A null text is empty. Null keys come after all others, rows of one key follow each other by text
    and share a run. An empty table gives no rows, a single document is its own next. Other columns are not read.
    """
    run_rows = run_rows or max(RUN, docs.count() // RUNS)
    rows = docs.select(F.col(key).alias("key"), F.coalesce(text, F.lit("")).alias("text"))
    # Bounds of runs are keys, one for every `run_rows` or so; not more than RUNS come to the driver but by chance.
    ends = rows.select("key").filter(F.pmod(F.xxhash64("key"), F.lit(run_rows)) == 0).filter("key IS NOT NULL").distinct().collect()
    largest = rows.agg(F.max("key").alias("key")).first().key
    kind = docs.schema[key].dataType
    listed = sorted(r.key for r in ends)
    array = lambda xs: F.array(*[F.lit(x) for x in xs]).cast(f"array<{kind.simpleString()}>")
    bounds, run = array(listed), _place(array, listed, F.col("key"))
    # A run ends, by descending key, with the last bound below it; the first run with the largest key of all.
    guest = lambda at, order: F.struct(at.alias("run"), F.lit(order).alias("guest"))
    places = F.array(guest(F.col("own"), 0), F.when(F.get(bounds, F.col("own")) == F.col("key"), guest(F.col("own") + 1, 1)),
                     F.when(F.col("key").eqNullSafe(F.lit(largest).cast(kind)), guest(F.lit(0), 1)))
    dealt = rows.withColumn("own", run).select("key", "text", F.inline(F.filter(places, lambda p: p.isNotNull())))
    order = Window.partitionBy("run").orderBy("guest", F.col("key").desc_nulls_last(), "text")
    paired = dealt.select("*", F.row_number().over(order).alias("place"), F.lead("text", 1, "").over(order).alias("next"))

    n = F.length("text")
    cut = paired.select(
        "run", "place", "guest", "key", n.alias("n_chars"), F.expr("substring(text, 1, length(text) - length(text) div 2)").alias("kept"),
        F.expr("substring(text, length(text) - length(text) div 2 + 1)").alias("rest"), F.expr("substring(next, 1, length(text) div 2)").alias("more"))
    lines = F.split("kept", "\n", -1)
    last = F.element_at(lines, -1)
    keys = ["run", "place", "guest", "key", "n_chars", "edited_sha256"]
    kinds = cut.select(*keys[:-1], F.sha2(F.concat("kept", "more"), 256).alias("edited_sha256"), F.inline(F.array(*[
        F.struct(F.lit(kind).alias("kind"), part.alias("lines")) for kind, part in enumerate((
            F.slice(lines, 1, F.size(lines) - 1), F.split(F.concat(last, "rest"), "\n", -1), F.split(F.concat(last, "more"), "\n", -1)))])))
    found = together(summed(kinds, [*keys, "kind"], "lines"), keys, {"own": F.col("kind") != 2, "edited": F.col("kind") != 1})

    wide = found.withColumns({"a": centred(F.col("own")), "b": centred(F.col("edited"))}).select(
        *keys, encoded(F.col("own")).alias("fingerprint"), encoded(F.col("edited")).alias("edited_fingerprint"),
        "a", dot(F.col("a"), F.col("b")).alias("ab"), dot(F.col("a"), F.col("a")).alias("aa"), dot(F.col("b"), F.col("b")).alias("bb"))
    beside = Window.partitionBy("run").orderBy("place")
    met = wide.withColumns({f"next_{c}": F.lead(c).over(beside) for c in ("fingerprint", "a", "aa")}).filter("guest = 0")
    return met.select(
        F.col("key").alias(key), F.col("n_chars").cast("long").alias("n_chars"), "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint") == F.col("edited_fingerprint"), F.col("ab"), F.col("aa"), F.col("bb")).alias("near_edited"),
        likeness(F.col("fingerprint") == F.col("next_fingerprint"), dot(F.col("a"), F.col("next_a")), F.col("aa"), F.col("next_aa")).alias("near_next"))
