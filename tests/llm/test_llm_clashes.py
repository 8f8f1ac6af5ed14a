"""Every operator on a table whose other columns are called as anything in the operator's own code."""

import re
from pathlib import Path

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tabuloom.llm import bpe, decontaminate, fingerprint, language_model, line_dedup, merkle, metric_join, minhash, quality, quotes, simhash, url_filter, warc, whitening
from tabuloom.llm.queries import URL_RULES

ROOT = Path(line_dedup.__file__).parent
REAL = {"doc_id", "text", "lang", "source", "n_chars", "page_id", "url", "html", "conv_id", "turn", "role", "vec_id", "embedding", "label", "n_lines", "n_removed"}
NAMES = sorted({n.lower() for p in ROOT.glob("*.py") for n in re.findall(r"[\"'](_?[A-Za-z][A-Za-z0-9_]*)[\"']", p.read_text())} - REAL)


def crowded(frame):
    """`frame` with all those columns, each holding its own name."""
    return frame.select("*", *[F.lit(n).alias(n) for n in NAMES])


TEXTS = ["one two three four five six\nseven eight\nnine ten\neleven", "one two three four five six\nseven eight\nnine ten\neleven", "", None, "a b c d e f g h i j " * 3000, "x\ny\nz\nw\n" * 40]


@pytest.fixture()
def docs(frame):
    return crowded(frame("doc_id long, text string, lang string, source string, n_chars long", [
        (None if i == 7 else i % 9, TEXTS[i % len(TEXTS)], "en", "s" if i % 3 else None, 1) for i in range(12)]))


@pytest.fixture()
def items(frame):
    return crowded(frame("item_id long, text string", [(1, "seven eight nine ten eleven twelve"), (2, None)]).withColumnRenamed("item_id", "number")).drop("item_id").withColumnRenamed("number", "item_id")


def test_names_are_many():
    assert len(NAMES) > 200


RULES = "host string, path string, action string"
MODELS = {
    "op1": lambda d, f: simhash.near_duplicates(d), "minhash": lambda d, f: minhash.near_duplicates(d), "op3": lambda d, f: line_dedup.line_dedup(d).select("doc_id", "n_removed"),
    "op4": lambda d, f: language_model.score(d, held_out=F.col("doc_id") == 1), "op9": lambda d, f: bpe.round_trip(d, bpe.load(public_tokenizers.path("byte_bpe_50k.json"))).select("doc_id", "n_tokens"),
    "op11": lambda d, f: fingerprint.edits(d), "op13": lambda d, f: merkle.prove(d)}


@pytest.mark.parametrize("name", MODELS)
def test_documents(frame, docs, name):
    assert len(MODELS[name](docs, frame).collect()) == 12


def test_benchmark(docs, items):
    assert {r.item_id for r in decontaminate.contaminated(docs, items).collect()} <= {1}
    left = decontaminate.decontaminate(docs, items)
    assert left.columns == docs.columns and left.count() < 12


def test_quality(frame, docs):
    labels = crowded(frame("doc_id long, quality int", [(i, i % 2) for i in range(9)]).withColumnRenamed("quality", "mark")).drop("quality").withColumnRenamed("mark", "quality")
    model = quality.fit(docs, labels)
    assert quality.score(docs, model).count() == 12 and quality.keep_good(docs, model).columns == docs.columns


def test_stages_keep_every_column(spark, docs):
    for stage in (corpus_pipeline.line_stage, corpus_pipeline.near_stage):
        left = stage(spark, docs, "")
        assert left.columns == docs.columns and 0 < left.count() <= 12
        row = left.first()
        assert all(row[n] == n for n in NAMES)


def test_other_tables(frame):
    pages = crowded(frame("page_id long, url string, html string", [(i, "x://net/es/" if i % 2 else None, "p" * (90 * i)) for i in range(5)]))
    assert url_filter.judge(pages, frame(RULES, URL_RULES)).count() == 5 and warc.round_trip(pages).count() == 5
    talk = crowded(frame("conv_id long, turn int, role string, text string", [(1, 1, "u", "hello there all of you today"), (1, 2, "a", "> hello there all of you today\nyes"), (2, 1, None, None)]))
    assert quotes.reply_order(talk).count() == 3
    vectors = crowded(frame("vec_id long, embedding array<float>, label int", [(i, [1.0, i / 9], 1) for i in range(6)]))
    assert metric_join.near_duplicates(vectors).count() == 6 and whitening.whiten(vectors, whitening.fit(vectors)).count() == 12
