"""Quotation linking: conversations in reply order, without what they quote.

The lines of a message are parsed into nested quote levels. A passage is a run of lines of one level
without a blank one between, its line ends, marks and extra white space folded, so that it stays the same
where it is wrapped anew. Quoted passages are hashed and joined to the message that first wrote them, as a
paragraph or as a line of one; where a passage has no original, its single lines are looked up in the same
conversation. Between conversations only passages of some length are linked, since short ones say nothing
about their origin. A message is a reply to the message that it quotes least deeply; replies stand in the
thread of the message at whose end the chain of replies arrives, in the order in which they were written.

The result has a row for each message, so that a conversation of any length is spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabuloom.llm.common import cut

#: The marks at the front of a quoted line; each > is a level.
MARKS = r"^(?:[ \t]*>)+[ \t]?"
SPACE = r"[\x09-\x0D\x20]+"
MAX_ROUNDS = 64
#: Words of a passage that may be linked to another conversation.
LEAST_WORDS = 12


def parsed(text: Column) -> Column:
    """(level, line, passage) of each line: quote level, text without the marks, and that in normal form."""
    def line(x: Column) -> Column:
        marks = F.regexp_extract(x, MARKS, 0)
        rest = F.substring(x, F.length(marks) + 1, F.length(x))
        return F.struct(F.length(F.translate(marks, " \t", "")).alias("level"), rest.alias("line"), F.lower(F.trim(F.regexp_replace(rest, SPACE, " "))).alias("passage"))

    return F.transform(F.split(F.coalesce(text, F.lit("")), "\r?\n", -1), line)


def without_quotes(lines: Column) -> Column:
    """The lines written by the author, blank ones at either end removed."""
    own = F.transform(F.filter(lines, lambda x: x["level"] == 0), lambda x: x["line"])
    return F.regexp_replace(F.array_join(own, "\n"), r"\A[\x09-\x0D\x20]+|[\x09-\x0D\x20]+\z", "")


def _hash(text: Column) -> Column:
    """128 bits."""
    return F.struct(F.xxhash64(text).alias("h"), F.xxhash64(F.lit(1), text).alias("g"))


def passages(messages: DataFrame) -> DataFrame:
    """(c, t, level, lines) for every passage; lines are its normal lines in order."""
    at = lambda i: F.get("lines", i)
    fresh = lambda i: (i == 0) | (at(i - 1)["passage"] == "") | (at(i - 1)["level"] != at(i)["level"])
    starts = F.filter(F.sequence(F.lit(0), F.size("lines") - 1), lambda i: (at(i)["passage"] != "") & fresh(i))
    placed = messages.select("c", "t", "lines", starts.alias("starts"))
    ends = lambda k: F.coalesce(F.get("starts", k + 1), F.size("lines"))
    cut = F.transform("starts", lambda i, k: F.struct(at(i)["level"].alias("level"), F.transform(
        F.filter(F.slice("lines", i + 1, ends(k) - i), lambda x: x["passage"] != ""), lambda x: x["passage"]).alias("lines")))
    return placed.select("c", "t", F.inline(cut))


def links(messages: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """(c, t, quoted, linked, to_c, to_t): for each message that quotes, its lines quoted and linked, and what it replies to.

    The original of a passage is the first message of the same conversation that wrote it, if that came
    before, else, for passages of `least_words` or more, the first message of all, by conversation and
    turn, if that comes before.
    """
    whole = passages(messages).withColumn("whole", F.array_join("lines", " "))
    # Messages are parsed once; from here on there are hashes only.
    found = cut(whole.select("c", "t", "level", F.size("lines").alias("n"), (F.size(F.split("whole", " ")) >= least_words).alias("long"),
                             _hash(F.col("whole")).alias("x"), F.transform("lines", _hash).alias("lines")))
    wrote = found.where("level = 0").select("c", "t", F.explode(F.array_union(F.array("x"), "lines")).alias("x"))
    inside = wrote.groupBy("x", "c").agg(F.min("t").alias("first"))
    everywhere = inside.groupBy("x").agg(F.min(F.struct("c", F.col("first").alias("t"))).alias("origin"))
    before = F.when(F.col("first") < F.col("t"), F.struct("c", F.col("first").alias("t")))
    near = found.where("level > 0").join(inside, ["x", "c"], "left").withColumn("to", before).drop("first")
    here, rest = near.where("to is not null"), near.where("to is null").drop("to")
    far = rest.where("long").join(everywhere, "x", "left").withColumn("to", F.when(F.col("origin") < F.struct("c", "t"), F.col("origin")))
    there, rest = far.where("to is not null"), rest.where("not long").unionByName(far.where("to is null").drop("to", "origin"))
    lines = rest.select("c", "t", "level", F.explode("lines").alias("x")).groupBy("c", "t", "level", "x").agg(F.count("*").alias("n"))
    single = lines.join(inside, ["x", "c"], "left").withColumn("to", before)
    columns = ["c", "t", "level", "n", "to"]
    every = here.select(columns).unionByName(there.select(columns)).unionByName(single.select(columns))
    counted = every.groupBy("c", "t", "level", "to").agg(F.sum("n").alias("n"))
    best = F.max_by("to", F.when(F.col("to").isNotNull(), F.struct((-F.col("level")).alias("level"), "n", "to")))
    linked = F.sum(F.when(F.col("to").isNotNull(), F.col("n")).otherwise(0))
    rows = counted.groupBy("c", "t").agg(F.sum("n").alias("quoted"), linked.alias("linked"), best.alias("to"))
    return rows.select("c", "t", "quoted", "linked", F.col("to.c").alias("to_c"), F.col("to.t").alias("to_t"))


def roots(replies: DataFrame) -> DataFrame:
    """(c, t, root_c, root_t, depth) of each reply: the message at the end of its chain, by doubling steps."""
    state = cut(replies.select("c", "t", F.col("to_c").alias("root_c"), F.col("to_t").alias("root_t"), F.lit(1).alias("depth")))
    for _ in range(MAX_ROUNDS):
        above = state.select(F.col("c").alias("a_c"), F.col("t").alias("a_t"), F.col("root_c").alias("b_c"), F.col("root_t").alias("b_t"), F.col("depth").alias("more"))
        joined = state.join(above, (F.col("root_c") == F.col("a_c")) & (F.col("root_t") == F.col("a_t")), "left")
        moved = cut(joined.select(
            "c", "t", F.coalesce("b_c", "root_c").alias("root_c"), F.coalesce("b_t", "root_t").alias("root_t"),
            (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("more").isNotNull().alias("moved")))
        state = moved.drop("moved")
        if moved.where("moved").isEmpty():
            return state
    raise RuntimeError("reply chains do not end")


def reply_order(messages: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A row per message: conversation, turn, role, text without quotes, formatted, quoted, linked,
    reply_conv, reply_turn, thread_conv, thread_turn and depth, in reply order.

    Ordered by thread (the conversation and turn of the message that the chain of replies starts from),
    then by conversation and turn; a message that replies to none is its own thread at depth 0. formatted
    is the text under its role. Null and empty texts have no lines and give an empty text; a null role is
    empty; a message with a null conversation or turn is kept, links with nothing and stands first.
    Messages that repeat a conversation and turn share what they quote and what is quoted of them; a
    text of any length is one row; an empty table gives an empty one; other columns are not read.
    """
    rows = messages.select(F.col(conversation).alias("c"), F.col(turn).alias("t"), F.col(role).alias("r"), parsed(F.col(text)).alias("lines"))
    whole = rows.where("c is not null and t is not null").select("c", "t", "lines")
    found = cut(links(whole))
    ends = roots(found.where("to_c is not null"))
    placed = found.join(ends, ["c", "t"], "left")
    own = without_quotes(F.col("lines"))
    rows = rows.select("c", "t", F.coalesce("r", F.lit("")).alias("role"), own.alias("text"))
    joined = rows.join(placed, ["c", "t"], "left").select(
        F.col("c").alias(conversation), F.col("t").alias(turn), "role", "text", F.concat(F.lit("<|"), "role", F.lit("|>\n"), "text", F.lit("\n")).alias("formatted"),
        F.coalesce("quoted", F.lit(0)).alias("quoted"), F.coalesce("linked", F.lit(0)).alias("linked"), F.col("to_c").alias("reply_conv"), F.col("to_t").alias("reply_turn"),
        F.coalesce("root_c", "c").alias("thread_conv"), F.coalesce("root_t", "t").alias("thread_turn"), F.coalesce("depth", F.lit(0)).alias("depth"))
    return joined.orderBy("thread_conv", "thread_turn", conversation, turn)
