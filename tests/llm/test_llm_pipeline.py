"""The pipeline's stages one after the other against plain versions of their decisions."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as driver
import corpus_pipeline
from tabuloom.llm import decontaminate, quality
from tabuloom.llm.common import table
from tabuloom.llm.queries import remainder
from test_llm_minhash import plain_components

DATA = "/root/testdata/sf0.001"


def plain_lines(rows):
    """Three-line windows seen before, in order of documents, are cut."""
    seen, out = {}, {}
    for key in sorted(rows):
        lines = rows[key].split("\n")
        full = [i for i, x in enumerate(lines) if x.strip()]
        width = min(3, len(full))
        gone = set()
        for at in range(len(full) - width + 1 if full else 0):
            window = tuple(" ".join(lines[i].split()) for i in full[at:at + width])
            first, last = full[at], full[at + width - 1]
            if window not in seen:
                seen[window] = (key, last)
            else:
                origin, end = seen[window]
                gone |= set(range(max(first, end + 1) if origin == key else first, last + 1))
        out[key] = "\n".join(x for i, x in enumerate(lines) if i not in gone)
    return out


def test_pipeline(spark, tmp_path):
    docs = table(spark, DATA, "documents")
    start = {r.doc_id: r for r in docs.collect()}
    items = [(r.item_id, decontaminate.normal_words(r.text).tolist()) for r in table(spark, DATA, "benchmark").collect()]
    outputs = []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, DATA).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        outputs.append({r.doc_id: r for r in docs.collect()})
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    good, lines, first, clean, coded = outputs
    model = quality.fit(table(spark, DATA, "documents"), table(spark, DATA, "labels"), learned=remainder("doc_id", 3) != 1)
    assert set(good) == {i for i, r in start.items() if model.scores([(r.text or "").encode()])[0] >= 0.5}
    assert {i: r.text for i, r in lines.items()} == plain_lines({i: r.text for i, r in good.items()})
    group = plain_components([(i, r.text) for i, r in lines.items()])
    assert set(first) == set(group.values())
    leaks = {i for i, r in first.items() if any(decontaminate.edit_distance(w, decontaminate.normal_words(r.text).tolist()) <= int(len(w) * 0.2 + 1e-9) for _, w in items)}
    assert set(clean) == set(first) - leaks and leaks
    assert set(coded) == set(clean)
    final = {r.doc_id: (r.n_tokens, bytes(r.ids), r.decoded_sha256) for r in corpus_pipeline.run(spark, DATA).collect()}
    assert final == {i: (r.n_tokens, bytes(r.ids), r.decoded_sha256) for i, r in coded.items()}
    digests = {r.doc_id: r.d for r in spark.read.parquet(str(tmp_path / "decontamination")).select("doc_id", F.sha2("text", 256).alias("d")).collect()}
    assert digests == {i: r.decoded_sha256 for i, r in coded.items()}


def test_empty_documents(spark):
    docs = table(spark, DATA, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, DATA).count() == 0


@pytest.mark.parametrize("number", range(1, 14))
def test_every_operator_has_a_query(number):
    assert len([q for q in driver.queries() if q.startswith(f"op{number}_")]) == 1
    assert "pipeline" in driver.queries()
