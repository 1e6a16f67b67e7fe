"""The pipeline against its stages' rules on a small table, and the registered queries."""

from __future__ import annotations

import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from stratum.llm import queries  # noqa: E402

from .test_operators import base_counts, brute_groups, near_copies, prose  # noqa: E402


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(21)
    texts = [prose(rng) for _ in range(60)]
    texts += [t + " tail" for t in texts[:10]] + texts[:5] + [t.upper() for t in texts[:3]] + [None, "", "short"] + near_copies(groups=3)
    rows = [(i, t, "en", f"s{i % 4}", len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[3], (None, texts[1], "en", None, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").cache()


def test_stages_take_effect(spark, docs):
    (_, rules), (_, dedup), (_, mix), (_, encode) = corpus_pipeline.STAGES
    kept = rules(spark, docs, "")
    assert kept.columns == docs.columns
    texts = {r.doc_id: r.text for r in docs.collect() if r.doc_id is not None}
    ids = {r.doc_id for r in kept.collect()}
    assert all(not base_counts(texts[i])[5] for i in ids if i is not None) and set(range(60)) < ids
    assert not {i for i, t in texts.items() if t and t.isupper()} & ids
    one = dedup(spark, kept, "")
    groups = brute_groups([(i, texts[i]) for i in ids if i is not None], 5, 80)
    assert one.columns == docs.columns
    assert sorted(r.doc_id for r in one.collect() if r.doc_id is not None) == sorted(i for i, g in groups.items() if g[2])
    assert one.where("doc_id is null").count() == 1
    drawn = mix(spark, one, "")
    n = sum(len(r.text.split()) for r in one.collect())
    assert drawn.columns == docs.columns and abs(sum(len(r.text.split()) for r in drawn.collect()) - n) < 4 * 130
    tokens = encode(spark, drawn, "").collect()
    assert len(tokens) == drawn.count() and all(len(r.ids) == r.n_tokens > 0 for r in tokens)


def test_rows_that_share_an_id_are_judged_by_their_texts(spark):
    a, b = (prose(random.Random(k)) for k in (1, 2))
    docs = spark.createDataFrame([(3, a, "en", "s", 1), (7, a, "en", "s", 1), (7, b, "en", "s", 1), (7, b, "en", "s", 1), (None, a, None, None, None), (9, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.near_duplicates(spark, docs, "").collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted([(3, a), (7, b), (None, a), (9, None)], key=str)


def test_run_equals_its_stages(spark, docs, tmp_path):
    path = str(tmp_path)
    docs.write.parquet(f"{path}/documents.parquet")
    frame = spark.read.parquet(f"{path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        frame = stage(spark, frame, path)
    key = lambda df: sorted(((r.doc_id, r.n_tokens, r.ids_sha256) for r in df.collect()), key=str)
    assert key(corpus_pipeline.run(spark, path)) == key(frame)


def test_stages_of_no_rows(spark, docs):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), "").count() == 0


def test_every_operator_has_a_query():
    numbers = sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES)
    assert numbers == list(range(1, 11)) and len(corpus_pipeline.STAGES) == 4
