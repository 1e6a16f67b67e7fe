"""The opN_ queries against their SQL, and all of them on the driver's smallest tables."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

from stratum.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in os.listdir(SF):
        con.execute(f"CREATE VIEW {table.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{table}'")
    cursor = con.execute(queries.ORACLES[name])
    columns = [d[0] for d in cursor.description]
    got = queries.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(repr, map(tuple, got.select(columns).collect()))) == sorted(map(repr, cursor.fetchall()))


@pytest.mark.parametrize(("name", "table"), [("op1_token_counts", "documents"), ("op2_url_filter", "pages"), ("op4_mixing", "documents"), ("op6_bpe_codec", "documents"), ("op10_lm_score", "documents")])
def test_query_gives_a_row_for_each_row(spark, name, table):
    assert queries.QUERIES[name](spark, SF).count() == spark.read.parquet(f"{SF}/{table}.parquet").count()


def test_url_parts_and_rules_equal_sql(spark):
    """The columns of op2_url_filter that SQL can give: all but the trees' score and verdict."""
    rest = "CASE WHEN strpos(url, '://') > 0 THEN substring(url, strpos(url, '://') + 3) ELSE '' END"
    rules = ", ".join(f"('{r.text}', '{r.host}', '{r.path}', '{r.verdict}')" for r in queries.RULES)
    sql = f"""WITH p AS (SELECT page_id, {rest} AS rest FROM '{SF}/pages.parquet'),
    h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substring(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM p),
    f AS (SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict FROM h JOIN (VALUES {rules}) r(rule, rh, rp, verdict) ON ('.' || host) LIKE ('%.' || rh) AND starts_with(path, rp) GROUP BY page_id)
    SELECT h.page_id, host, path, rule, verdict FROM h LEFT JOIN f USING (page_id)"""
    expected = {r[0]: r[1:] for r in duckdb.sql(sql).fetchall()}
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in queries.op2_url_filter(spark, SF).collect()}
    assert got.keys() == expected.keys() and {r[2] for r in expected.values()} >= {None, "net/"}
    for i, (host, path, rule, verdict) in expected.items():
        assert got[i][:3] == (host, path, rule) and (rule is None or got[i][3] == verdict)


def test_mix_sizes_and_targets_equal_plain_ones(spark):
    from .test_operators import WORD, plain_targets

    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    size = {r.doc_id: len(WORD.findall(r.text or "")) for r in docs}
    source = {r.doc_id: r.source for r in docs}
    sources = sorted(set(source.values()), key=lambda s: (s is None, (s or "").encode()))
    sizes = [sum(size[i] for i in size if source[i] == s) for s in sources]
    targets = dict(zip(sources, plain_targets(sizes, [(5, 2, 1)[i % 3] for i in range(len(sources))], sum(sizes), 3), strict=True))
    rows = queries.op4_mixing(spark, SF).collect()
    for r in rows:
        assert (r["size"], r.source_size, r.target) == (size[r.doc_id], sizes[sources.index(source[r.doc_id])], pytest.approx(targets[source[r.doc_id]]))
        assert r.taken == r.copies * r["size"] and len(r.shards) == r.copies <= 3
    for s in sources:
        assert abs(sum(r.taken for r in rows if source[r.doc_id] == s) - targets[s]) <= max(size[i] for i in size if source[i] == s)


def test_token_counts_of_the_public_vocabulary_equal_plain_dynamic_programming(spark):
    from stratum.llm import token_count

    vocabulary = token_count.Vocabulary.from_file(queries.tokenizer("piece_bpe_32k.model"))
    assert sum(math.exp(s / 1e6) for s in vocabulary.pieces.values()) == pytest.approx(1, abs=1e-4)
    score = {p.replace("▁", " "): s for p, s in vocabulary.pieces.items()}
    longest = max(map(len, score))

    def plain(text):
        """The fewest pieces of the best segmentation of a whole text, without borders of pre-tokens."""
        text = " " + text.replace("▁", " ")
        best = [(0, 0)]
        for i in range(len(text)):
            n = len(text[i].encode())
            ways = [(best[i][0] + score[text[i]], best[i][1] - 1)] if text[i] in score else [(best[i][0] + n * vocabulary.byte_score, best[i][1] - n)]
            ways += [(best[j][0] + score[text[j : i + 1]], best[j][1] - 1) for j in range(max(0, i + 1 - longest), i) if text[j : i + 1] in score]
            best.append(max(ways))
        return -best[-1][1]

    rows = {r.doc_id: r.text[:1500] for r in spark.read.parquet(f"{SF}/documents.parquet").where("text is not null").orderBy("doc_id").limit(25).collect()}
    docs = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    assert {r.doc_id: r.n_tokens for r in token_count.count_tokens(docs, vocabulary).collect()} == {i: plain(t) if t else 0 for i, t in rows.items()}
