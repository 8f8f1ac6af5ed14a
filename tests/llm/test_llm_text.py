"""URL filter, line dedup, quotations and WARC: SQL twins, small cases and odd tables."""

import hashlib
import random
import re
import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2] / "tools"))

from compare import rows_of  # noqa: E402
from tabuloom.llm import line_dedup, quotes, url_filter, warc  # noqa: E402
from tabuloom.llm.queries import SQL, URL_RULES  # noqa: E402


def whole(rows):
    """Whole numbers beside nulls may come as floats."""
    return sorted(tuple(v.removesuffix(".0") for v in row) for row in rows)


def twin(name, **tables):
    con = duckdb.connect()
    for key, value in tables.items():
        con.register(key, value)
    return whole(rows_of(con.execute(SQL[name]).df()))


def rows(frame):
    return whole(rows_of(frame.toPandas()))


URLS = [
    "http://a.example.com/en/x?y#z", "https://WWW.Example.com/en/", "http://example.com/en", "http://example.com/fr/", "x://b.net/es/a/b", "x://net/fr/",
    "x://b.net", "x://b.net/esp/", "http://com/", "http://com", "no scheme", "", None, "://", "a://b://c.net/fr/", "x://u@h.com:80/es/", "x://notcom/", "x://a..net/fr/?", "x://É.NET/fr/",
    "x://" + "a." * 2000 + "net/es/", "x://b.org/" + "z" * 5000, "x://b.net/es/", "x://b.net/es/"]


def test_url_filter(spark, frame):
    pages = frame("page_id long, url string, host int, rule int", [(i, u, 1, 2) for i, u in enumerate(URLS)])
    rules = frame("host string, path string, action string", URL_RULES)
    got = url_filter.judge(pages, rules)
    assert rows(got) == twin("op2_url_filter", pages=pages.toPandas())
    by = {r.page_id: (r.rule, r.verdict) for r in got.collect()}
    assert by[0] == ("example.com/en/", "block") and by[1] == ("www.example.com/en/", "allow") and by[2] == ("com/", "allow")
    assert by[6] == (None, "allow") and by[19] == ("net/es/", "block") and by[17] == ("net/fr/", "block")
    assert rows(url_filter.judge(pages, rules.unionAll(rules))) == rows(got)
    full = url_filter.judge(pages, rules, blocks=1)
    assert rows(full) == rows(got)
    none = url_filter.judge(pages, rules.limit(0), default="block").collect()
    assert {r.verdict for r in none} == {"block"} and len(none) == len(URLS)
    assert got.columns == url_filter.judge(pages.limit(0), rules).columns and url_filter.judge(pages.limit(0), rules).count() == 0


def test_url_rows_without_key_or_twice(frame):
    pages = frame("page_id long, url string", [(None, "x://a.net/fr/"), (1, "x://a.net/fr/"), (1, "x://a.net/fr/"), (None, None)])
    got = url_filter.judge(pages, frame("host string, path string, action string", [*URL_RULES, (None, "/", "block"), ("net", "/fr/", "allow")])).collect()
    assert sorted((r.page_id or -1, r.verdict) for r in got) == [(-1, "allow"), (-1, "block"), (1, "block"), (1, "block")]


def document_rows():
    rng = random.Random(2)
    lines = [f"line {i}" for i in range(25)]
    out = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randrange(1, 14)))) for i in range(60)]
    shared = "\n".join(f"shared {i} of a passage" for i in range(8))
    out += [(100 + i, f"own {i}\n{shared}\nlast {i}") for i in range(20)]
    return out + [(200, None), (201, ""), (202, "\n\n\n"), (203, "a\na\na\na\na\na"), (204, " x  y\n\n z\nw "), (205, "x y\nz\n\n\nw\nend"), (206, "only"), (207, "only"), (208, "p\nq"), (209, "p\nq\nr")]


def test_line_dedup(spark, frame):
    docs = frame("doc_id long, text string, n_lines string, first int", [(i, t, "k", 1) for i, t in document_rows()])
    got = line_dedup.line_dedup(docs)
    assert rows(got.select("doc_id", "text", "n_lines", "n_removed")) == twin("op3_line_dedup", documents=docs.select("doc_id", "text").toPandas().astype({"text": object}))
    by = {r.doc_id: r.text for r in got.collect()}
    assert by[100].count("shared") == 8 and by[105] == "own 5\nlast 5"
    assert by[203] == "a\na\na" and by[205] == "end" and by[207] == "" and by[208] == "p\nq" and by[209] == "p\nq\nr" and by[200] is None
    assert line_dedup.line_dedup(docs.limit(0)).count() == 0


def test_line_dedup_rows_without_key_or_twice(frame):
    text = "a\nb\nc\nd"
    docs = frame("doc_id long, text string", [(None, text), (1, text), (1, text), (2, text + "\ne"), (None, None), (1, "other")])
    got = sorted(((r.doc_id or -1, r.text) for r in line_dedup.line_dedup(docs).collect()), key=str)
    assert got == sorted([(-1, text), (1, ""), (1, ""), (2, "e"), (-1, None), (1, "other")], key=str)


MESSAGES = [
    (1, 0, "user", "Hello there\nHow are  you?"), (1, 1, "bot", "> How are you?\nFine."), (1, 2, "user", "Other topic"), (1, 3, "bot", "> > how ARE you?\n> Fine.\nGood."),
    (1, 4, "user", ">> Other topic\n> unknown\nyes"), (2, 0, "user", "> Fine.\n> Good.\nfrom afar"), (2, 1, "bot", ">\n>  \nno quote text"), (2, 2, "bot", "Fine."),
    (3, 0, None, None), (3, 1, "user", ""), (3, 2, "user", "> Fine."), (4, 0, "user", "> later\nx"), (4, 1, "user", "later"), (4, 2, "user", "> later\n> from afar\r\n> x"), (5, 0, "a", "tab\n\t> Hello there\n >not > own\nz >")]


def test_quotations(spark, frame):
    messages = frame("conv_id long, turn long, role string, text string, depth string, c int", [(*m, "d", 1) for m in MESSAGES])
    got = quotes.reply_order(messages)
    assert rows(got) == twin("op5_quotations", conversations=messages.toPandas().astype({"text": object, "role": object}))
    listed = got.collect()
    by = {(r.conv_id, r.turn): r for r in listed}
    assert by[1, 3].text == "Good." and (by[1, 3].reply_turn, by[1, 3].thread_turn, by[1, 3].depth) == (1, 0, 2)
    assert (by[1, 4].quoted, by[1, 4].linked, by[1, 4].reply_turn) == (2, 1, 2)
    assert by[2, 0].reply_conv is None and by[3, 2].reply_conv is None
    assert by[4, 0].reply_conv is None and by[4, 2].reply_turn in (0, 1)
    order = [(r.thread_conv, r.thread_turn, r.conv_id, r.turn) for r in listed]
    assert order == sorted(order)
    assert all((r.reply_conv, r.reply_turn) < (r.conv_id, r.turn) for r in listed if r.reply_conv is not None)


LONG = "a sentence of more than twelve words that nobody would write twice by chance at all"


def plain_links(messages):
    """(conv, turn) to (quoted, linked, reply) by looking through all messages for each passage."""
    def passages(text):
        out, last = [], None
        for line in re.split(r"\r?\n", text or ""):
            marks = re.match(r"(?:[ \t]*>)+[ \t]?|", line).group()
            level, words = marks.count(">"), line[len(marks):].lower().split()
            if not words:
                last = None
                continue
            if last != level:
                out.append((level, []))
            out[-1][1].append(" ".join(words))
            last = level
        return out

    wrote = {}
    for c, t, _, text in messages:
        for level, lines in passages(text):
            if level == 0:
                for x in {" ".join(lines), *lines}:
                    wrote.setdefault(x, []).append((c, t))
    result = {}
    for c, t, _, text in messages:
        votes, quoted = {}, 0
        for level, lines in passages(text):
            if not level:
                continue
            quoted += len(lines)

            def here(x):
                before = min((o for o in wrote.get(x, []) if o[0] == c), default=None)
                return before if before and before < (c, t) else None

            whole = " ".join(lines)
            to = here(whole)
            if to is None and len(whole.split()) >= 12 and min(wrote.get(whole, [(9e9, 0)])) < (c, t):
                to = min(wrote[whole])
            for target, n in [(to, len(lines))] if to else [(here(x), 1) for x in lines]:
                if target:
                    votes[level, target] = votes.get((level, target), 0) + n
        best = max(((-level, n, target) for (level, target), n in votes.items()), default=(0, 0, None))[2]
        result[c, t] = (quoted, sum(votes.values()), best)
    return result


def talk(n, seed=1):
    draw = random.Random(seed)
    paragraphs = [" ".join(draw.choice(["alpha", "beta", "gamma", "delta", "Epsilon"]) for _ in range(draw.randint(1, 30))) for _ in range(12)] + ["ok", "Thanks.", LONG]
    wrap = lambda text, marks: "\n".join(marks + " ".join(text.split()[i:i + w]) for w in [draw.randint(3, 9)] for i in range(0, len(text.split()), w))
    out = []
    for c in range(n):
        for t in range(draw.randint(1, 6)):
            parts = [wrap(draw.choice(paragraphs), draw.choice(["> ", ">> ", "", "", "> > "])) for _ in range(draw.randint(0, 4))]
            out.append((c, t, draw.choice(["user", "bot"]), draw.choice(["\n", "\n\n"]).join(parts)))
    return out


def test_passages_against_plain_search(spark, frame):
    messages = talk(40)
    got = quotes.reply_order(frame("conv_id long, turn long, role string, text string", messages)).collect()
    found = {(r.conv_id, r.turn): (r.quoted, r.linked, None if r.reply_conv is None else (r.reply_conv, r.reply_turn)) for r in got}
    want = plain_links(messages)
    assert found == want
    assert any(to and to[0] != c for (c, _), (_, _, to) in want.items()) and sum(to is not None for _, _, to in want.values()) > 20
    docs = frame("conv_id long, turn long, role string, text string", messages)
    assert rows(quotes.reply_order(docs)) == twin("op5_quotations", conversations=docs.toPandas())


def test_short_lines_link_no_conversations_and_new_wrapping_does_not_matter(frame):
    messages = [(1, 1, "a", "ok"), (1, 2, "a", LONG), (9, 1, "b", "> ok\nreally"), (9, 2, "b", "> " + LONG[:30].strip() + "\n>" + LONG[30:]), (9, 3, "b", "ok"), (9, 4, "a", "> ok"),
                (9, 5, "b", "long\n> " + "word\n> " * 3000 + "\nend")]
    messages[3] = (9, 2, "b", "> " + LONG.replace(" words", "\n> words"))
    got = {(r.conv_id, r.turn): (r.reply_conv, r.reply_turn) for r in quotes.reply_order(frame("conv_id long, turn long, role string, text string", messages)).collect()}
    assert got[9, 1] == (None, None) and got[9, 2] == (1, 2) and got[9, 4] == (9, 3) and got[9, 5] == (None, None)


def test_quotations_of_odd_tables(frame):
    messages = frame("conv_id long, turn long, role string, text string", [(None, 1, "a", "> x"), (1, None, "a", "x"), (1, 1, "a", "x"), (1, 1, "a", "x"), (1, 2, "b", "> x\ny")])
    got = quotes.reply_order(messages).collect()
    assert len(got) == 5 and [r.reply_turn for r in got if r.turn == 2] == [1]
    assert quotes.reply_order(messages.limit(0)).count() == 0


def test_long_chain_of_replies(frame):
    messages = frame("conv_id long, turn long, role string, text string", [(1, i, "a", (f"> m{i - 1}\n" if i else "") + f"m{i}") for i in range(40)])
    got = {r.turn: (r.thread_turn, r.depth) for r in quotes.reply_order(messages).collect()}
    assert got == {i: (0, i) for i in range(40)}


def page_rows():
    long = "é<p>" * 60
    marker = "head WARC/1.1\r\nWARC-Type: response\r\n\r\nbody\r\n\r\nWARC/1.1"
    return [
        (1, "http://a/", long), (2, "http://b/", long), (3, "http://c/", "x" * 99), (4, "http://d/", "x" * 99), (5, None, None), (6, "http://e/\r\nX: y", ""),
        (7, "http://f/WARC/1.1", marker * 3), (8, "u", "WARC/1.1" * 20), (9, "u", "y" * 100), (0, "u", "y" * 100), (10, "u", "\r\n" * 80), (11, "u", "z" * 1000), (12, "u", "a\x00b" * 50)]


@pytest.mark.parametrize("size", [1 << 20, 7])
def test_warc(spark, frame, tmp_path, size):
    pages = frame("page_id long, url string, html string, digest int, record_type string", [(*p, 1, "x") for p in page_rows()])
    got = warc.round_trip(pages, path=str(tmp_path / "a"), size=size)
    assert rows(got) == twin("op10_warc", pages=pages.toPandas().astype({"html": object, "url": object}))
    by = {r.page_id: r for r in got.collect()}
    assert by[2].refers_to == 1 and by[9].refers_to == 0 and by[4].record_type == "response"
    assert by[5].payload_digest == hashlib.sha256(b"").hexdigest()
    chunks = warc.read(spark, str(tmp_path / "a"))
    assert chunks.where("length(data) > %d" % size).count() == 0 and chunks.where("chunks > 1").isEmpty() == (size > 1000 and not chunks.where("page_id in (7, 8)").count())
    assert (tmp_path / "a").exists()


def parse_records(data):
    """(fields, block) of every record, by the lengths that their heads state."""
    while data:
        head, rest = data.split(b"\r\n\r\n", 1)
        first, *lines = head.decode().split("\r\n")
        assert first == "WARC/1.1"
        fields = dict(line.split(": ", 1) for line in lines)
        n = int(fields["Content-Length"])
        assert rest[n:n + 4] == b"\r\n\r\n"
        yield fields, rest[:n]
        data = rest[n + 4:]


@pytest.mark.parametrize("size", [1 << 20, 50])
def test_every_record_has_the_fields_of_the_standard(spark, frame, tmp_path, size):
    import gzip
    import uuid

    pages = frame("page_id long, url string, html string", page_rows())
    warc.write(pages, str(tmp_path / "a"), size=size)
    found = [r for f in sorted((tmp_path / "a").glob("*.gz")) for r in parse_records(gzip.open(f).read())]
    names, bodies = {}, {}
    for fields, block in found:
        identity = uuid.UUID(fields["WARC-Record-ID"].removeprefix("<urn:uuid:").removesuffix(">"))
        assert identity not in names and re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ", fields["WARC-Date"]) and fields["WARC-Target-URI"]
        names[identity] = fields
        if fields["WARC-Type"] == "continuation":
            assert int(fields["WARC-Segment-Number"]) > 1 and "Content-Type" not in fields
        else:
            assert fields["Content-Type"] == "application/http; msgtype=response" and block.startswith(b"HTTP/1.1 200 OK\r\n")
        if fields["WARC-Type"] == "revisit":
            assert fields["WARC-Profile"].endswith("/identical-payload-digest") and block.endswith(b"\r\n\r\n")
    for fields, block in sorted(found, key=lambda r: int(r[0].get("WARC-Segment-Number", 1))):
        origin = fields.get("WARC-Segment-Origin-ID", fields["WARC-Record-ID"])
        bodies[origin] = bodies.get(origin, b"") + block
        if "WARC-Segment-Total-Length" in fields:
            assert len(bodies[origin]) == int(fields["WARC-Segment-Total-Length"])
    wanted = {i: (html or "").encode() for i, _, html in page_rows()}
    for origin, whole in bodies.items():
        fields = names[uuid.UUID(origin.removeprefix("<urn:uuid:").removesuffix(">"))]
        http, body = whole.split(b"\r\n\r\n", 1)
        assert f"Content-Length: {len(wanted[int(fields['X-Page-ID'])])}".encode() in http
        assert body == (b"" if fields["WARC-Type"] == "revisit" else wanted[int(fields["X-Page-ID"])])
    assert len(bodies) == len(wanted)


def test_hot_payload_is_dealt_over_tasks(frame):
    """Bodies meet what was found of their own key, not all copies in one task."""
    pages = frame("page_id long, url string, html string", [(i, "u", "p" * 500) for i in range(400)])
    typed = warc.typed(pages.selectExpr("page_id AS k", "url AS u", "CAST(html AS binary) AS body"), "k", "body").repartition(4, "k", "digest")
    assert max(len(p) for p in typed.select("k").rdd.glom().collect()) < 200
    assert typed.where("refers_to = 0").count() == 399


def test_warc_of_odd_tables(spark, frame, tmp_path):
    body = "q" * 200
    pages = frame("page_id long, url string, html string", [(None, "u", body), (3, "u", body), (3, "u", body), (4, "u", body), (None, None, None)])
    got = sorted(((r.page_id or -1, r.record_type, r.refers_to) for r in warc.round_trip(pages, path=str(tmp_path / "a")).collect()), key=str)
    assert got == sorted([(-1, "revisit", 3), (3, "response", None), (3, "response", None), (4, "revisit", 3), (-1, "response", None)], key=str)
    assert warc.round_trip(pages.limit(0), path=str(tmp_path / "b")).count() == 0


def test_changed_archive_is_noticed(spark, frame, tmp_path):
    warc.write(frame("page_id long, url string, html string", [(1, "u", "abc")]), str(tmp_path / "a"), compression="none")
    file = next((tmp_path / "a").glob("*.txt"))
    changed = file.read_bytes().replace(b"abc", b"abd")
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "x.txt").write_bytes(changed)
    with pytest.raises(Exception, match="archive differs"):
        warc.summary(warc.read(spark, str(tmp_path / "b"))).collect()
