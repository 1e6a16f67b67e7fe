"""Each operator against brute force on small tables: nulls, empty and long texts, ties, repeated rows, no rows, clashing names."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratum.llm import bpe_codec, chat, common, lm_score, mixing, near_dup, quality, token_count, url_filter, vector_dedup, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id long, row string, size int, p_source string, epoch int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def documents(spark, texts, sources=None):
    """Texts as documents, with columns whose names operators use themselves."""
    rows = [(i, t, ("en", "de", None)[i % 3], sources[i] if sources else f"s{i % 3}", len(t or ""), -i, "r", 1, "x", 2) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def odd_texts():
    rng = random.Random(5)
    vocabulary = ["the", "of", "and", "Ünï", "naïve", "x1", "###", "don't", "a,b", "der", "12.5", "word|word", "THE", "e\u0301t"]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randint(1, 60))) for _ in range(40)]
    texts += [None, "", " \t\n ", "one", "x" * 30_000, " ".join(["same"] * 3000), texts[0], texts[0], "\u3000\x1c\x85\xa0", "<|endoftext|>mid<|startoftext|>", "a\n\na\nb\n a", "\u2581 under\u2581bar", "😀 \u0000 nul"]
    return texts


@pytest.fixture(scope="module")
def docs(spark):
    return documents(spark, odd_texts()).cache()


@pytest.fixture(scope="module")
def no_docs(spark):
    return documents(spark, [])


# Token counts


def test_token_counts_equal_plain_dynamic_programming(spark, docs, no_docs):
    vocabulary = token_count.Vocabulary.of({"\u2581": -5_000_000, "\u2581the": -1_000_000, "the": -2_000_000, "t": -6_000_000, "h": -6_000_000, "e": -5_500_000, "he": -4_000_000, "\u2581a": -2_000_000, "an": -3_000_000, "and": -2_500_000, "d": -6_000_000, "a": -6_000_000, "o": -6_000_000, "of": -3_000_000, "\u2581\u2581": -4_000_000, "same": -3_000_000, "am": -3_000_000})

    def count(text):
        if not text:
            return 0
        text = "\u2581" + text.replace(" ", "\u2581")
        best = [(0, 0)] + [None] * len(text)
        for i in range(1, len(text) + 1):
            n = len(text[i - 1].encode())
            options = [] if text[i - 1] in vocabulary.pieces else [(best[i - 1][0] + n * vocabulary.byte_score, -(-best[i - 1][1] + n))]
            for k in range(max(0, i - 6), i):
                if (s := vocabulary.pieces.get(text[k:i])) is not None:
                    options.append((best[k][0] + s, best[k][1] - 1))
            best[i] = max(options)
        return -best[-1][1]

    got = {r.doc_id: r.n_tokens for r in token_count.count_tokens(docs, vocabulary).collect()}
    assert got == {r.doc_id: count(r.text) for r in docs.collect()}
    assert token_count.count_tokens(no_docs, vocabulary).count() == 0


def test_a_small_memory_changes_no_count():
    vocabulary = token_count.Vocabulary.of({"\u2581a": -1, "b": -2, "ab": -2, "ba": -3})
    texts = ["ab ba abba", "b a b", "ab"] * 5
    once, again = token_count.Counter(vocabulary), token_count.Counter(vocabulary, max_chars=0)
    assert once.counts(texts) == [x for t in texts for x in again.counts([t])]
    with pytest.raises(ValueError, match="border"):
        token_count.Vocabulary.of({"a\u2581b": -1})


# URL filter


RULES = (url_filter.Rule("net/", "block"), url_filter.Rule("example.net/en/", "allow"), url_filter.Rule("example.com/de/", "block"), url_filter.Rule("org/fr/", "allow"))


def test_url_parts_and_rules(spark):
    urls = [None, "", "no scheme", "HTTP://A.Example.NET/en/x?q=1#f", "https://example.net/EN/", "http://net", "http://x.net?y", "http://badexample.com/de/", "http://b.example.com/de/1", "http://a.org/fr/", "http://a.org/en/", "http://h#f/x", "http://h://z/p"]
    pages = spark.createDataFrame([(i, u, "h", 1.0) for i, u in enumerate(urls)], "page_id long, url string, host string, score double")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages, RULES, url_filter.fit([], [])).collect()}
    none = lambda h, p: (h, p, None, got[0][3])
    assert got == {
        0: none("", ""), 1: none("", ""), 2: none("", ""), 3: ("a.example.net", "/en/x", "example.net/en/", "allow"), 4: ("example.net", "/EN/", "net/", "block"), 5: none("net", ""), 6: none("x.net", ""), 7: none("badexample.com", "/de/"),
        8: ("b.example.com", "/de/1", "example.com/de/", "block"), 9: ("a.org", "/fr/", "org/fr/", "allow"), 10: none("a.org", "/en/"), 11: none("h", ""), 12: none("h:", "//z/p"),
    }


def test_trees_learn_from_labelled_urls(spark):
    rng = random.Random(1)
    bad = [f"http://win-{rng.randint(100, 999)}.spam{rng.randint(10, 99)}.biz/a/b/c?id={rng.randint(1, 9999)}&ref=x" for _ in range(300)]
    good = [f"https://{rng.choice(['news', 'docs', 'www'])}.site.org/{rng.choice(['about', 'story', 'help'])}" for _ in range(300)]
    rows = spark.createDataFrame([(u, y) for us, y in ((bad, 1), (good, 0)) for u in us[:200]] + [(None, 1), ("x", None)], "url string, label int")
    model = url_filter.train(rows)
    held = model.block_probability(bad[200:] + good[200:]) >= 0.5
    assert np.mean(held == ([True] * 100 + [False] * 100)) > 0.95
    assert model.block_probability(good) == pytest.approx(url_filter.train(rows.repartition(7)).block_probability(good))
    every = bad + [u.replace("site", f"site{k % 40}") for k, u in enumerate(good)]
    assert url_filter.held_out_auc(every, [1] * 300 + [0] * 300) > 0.9 and url_filter.held_out_auc([], []) == 0.5 and url_filter.held_out_auc(["http://a.b/"], [1]) == 0.5
    # A domain whose URLs are all alike but for random letters says nothing of other domains.
    noise = [f"http://{rng.choice('abcdefgh')}{rng.randrange(9)}.org/{rng.randrange(10**6)}" for _ in range(400)]
    assert abs(url_filter.held_out_auc(noise, [crc32(url_filter.parts(u)[0].encode()) % 2 for u in noise]) - 0.5) < 0.25
    labels = url_filter.rule_labels(rows.select("url"), RULES)
    assert {r.label for r in labels.collect()} == set() and url_filter.train(labels).block_probability(["http://a.b/"])[0] == pytest.approx(0.5)
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string"), RULES, model).count() == 0


# Near-duplicates


def brute_groups(texts, size, percent):
    sets, parent = {}, {}
    for i, t in texts:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} or ({tuple(w)} if w else set())

    def root(x):
        while parent.get(x, x) != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: (len(s), root(i), root(i) == i) for i, s in sets.items()}


def near_copies(seed=3, groups=6, each=12):
    """Texts with groups of copies of which words were changed, around the threshold, and passages that many texts share."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    passage = [word() for _ in range(25)]
    out = []
    for _ in range(groups):
        base = [word() for _ in range(rng.randint(6, 120))]
        for _ in range(each):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = word()
            out.append(" ".join(copy))
        out += [" ".join(base).upper(), " ".join(base + passage), " ".join(passage + [word() for _ in range(20)])]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize(("size", "percent"), [(4, 80), (5, 80), (2, 90)])
def test_near_duplicates_equal_brute_force(spark, no_docs, size, percent):
    texts = near_copies() + odd_texts()
    got = {r.doc_id: tuple(r)[1:] for r in near_dup.near_duplicates(documents(spark, texts), size, percent).collect()}
    assert got == brute_groups(list(enumerate(texts)), size, percent)
    assert near_dup.near_duplicates(no_docs, size, percent).count() == 0


def test_near_duplicates_without_ids_and_repeated_rows(spark):
    rows = [(None, "a b c d e"), (None, "a b c d e"), (7, "a b c d e"), (7, "a b c d e"), (9, "A B C D E"), (3, None)]
    got = Counter(tuple(r) for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect())
    assert got == {(None, 2, None, True): 2, (7, 2, 7, True): 2, (9, 2, 7, False): 1, (3, 0, 3, True): 1}


def test_blocks_of_a_bucket_find_the_same_links(spark, monkeypatch):
    texts = near_copies(seed=8, groups=2, each=30)
    whole = near_dup.near_duplicates(documents(spark, texts), 4).collect()
    monkeypatch.setattr(near_dup, "BLOCK_ROWS", 3)
    monkeypatch.setattr(near_dup, "BROADCAST_IDS", 0)
    assert sorted(near_dup.near_duplicates(documents(spark, texts), 4).collect()) == sorted(whole)


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(100)] + [(200, 300), (5, 5), (None, 1), (300, 200)], "a long, b long")
    got = {r.node: r.component for r in common.components(edges).collect()}
    assert got == {i: 0 for i in range(101)} | {200: 200, 300: 200}


# Mixing


def plain_targets(sizes, weights, total, most):
    out, free, rest = [0.0] * len(sizes), set(range(len(sizes))), total
    while full := {i for i in free if rest / sum(weights[i] for i in free) * weights[i] > most * sizes[i]}:
        for i in full:
            out[i] = most * sizes[i]
        rest, free = rest - sum(out[i] for i in full), free - full
    for i in free:
        out[i] = rest / sum(weights[i] for i in free) * weights[i]
    return out


def test_mix_meets_targets(spark):
    rng = random.Random(2)
    texts = [" ".join(["w"] * rng.choice([0, 1, 5, 40, 300])) for _ in range(4000)] + [None]
    sources = [rng.choice(["a", "a", "a", "a", "b", "c", "d", None, "\u00e9"]) for _ in texts]
    docs = documents(spark, texts, sources)
    mixed = mixing.mix(docs, shards=5)
    rows = mixed.select("doc_id", "source", "mix_size", "mix_source_size", "mix_target", "mix_draws").collect()
    assert len(rows) == len(texts) and set(docs.columns) < set(mixed.columns)
    size, taken, target = Counter(), Counter(), {}
    for r in rows:
        assert r.mix_size == len((texts[r.doc_id] or "").split()) and len(r.mix_draws) <= 3
        assert sorted({d.epoch for d in r.mix_draws}) == list(range(len(r.mix_draws)))
        size[r.source] += r.mix_size
        taken[r.source] += r.mix_size * len(r.mix_draws)
        target[r.source] = r.mix_target
    order = sorted(size, key=lambda s: (s is None, s or ""))
    aims = plain_targets([size[s] for s in order], [(5, 2, 1)[i % 3] for i in range(len(order))], sum(size.values()), 3)
    assert [target[s] for s in order] == pytest.approx(aims) and sum(aims) == pytest.approx(sum(size.values()))
    assert all(abs(taken[s] - target[s]) <= 1 for s in order)
    again = mixing.mix(docs.repartition(9), shards=5).select("doc_id", "mix_draws").collect()
    assert {r.doc_id: r.mix_draws for r in again} == {r.doc_id: r.mix_draws for r in rows}
    every = mixing.shuffled(mixing.drawn(mixed))
    assert every.count() == sum(len(r.mix_draws) for r in rows) and {r[0] for r in every.select("mix_shard").distinct().collect()} == set(range(5))


def test_targets_and_quotas(spark):
    def targets(sizes, weights, share, most):
        frame = spark.createDataFrame(list(zip(range(len(sizes)), sizes, weights, strict=True)), "i int, size long, weight double")
        return [r.target for r in mixing.with_targets(frame, weights, share, most).orderBy("i").collect()]

    assert targets([10, 100, 100], [5.0, 2.0, 1.0], 1.0, 3) == pytest.approx([30, 120, 60])
    assert targets([0, 0], [5.0, 2.0], 1.0, 3) == [0, 0] and targets([], [], 1.0, 3) == []
    assert targets([10, 20], [5.0, 2.0], 9.0, 3) == [30, 60]
    rng = random.Random(31)
    sizes, weights = [rng.choice([0, 1, 10, 1000, 50_000]) for _ in range(60)], [rng.choice([1.0, 2.0, 5.0]) for _ in range(60)]
    assert targets(sizes, weights, 2.0, 3) == pytest.approx(plain_targets(sizes, weights, 2 * sum(sizes), 3))
    got = mixing.split_quotas([1000, 10, 0, 1], [200, 0, 400, 411], [3])
    assert got.sum(axis=0).tolist() == [1000, 10, 0, 1] and got.sum(axis=1).tolist() == [200, 0, 400, 411] and got.min() >= 0


def test_shards_take_what_the_tree_gives_them(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_DOCS", 4)
    monkeypatch.setattr(mixing, "GROUP_SOURCES", 2)
    texts = [" ".join(["w"] * (1 + i % 7)) for i in range(900)]
    docs = documents(spark, texts, [f"s{i % 7}" for i in range(900)])
    rows = mixing.mix(docs, shards=6).select("doc_id", "source", "mix_draws").collect()
    draws = defaultdict(set)
    for r in rows:
        block = [(d.epoch, d.shard) for d in r.mix_draws]
        assert [e for e, _ in block] == list(range(len(block)))
        for e, s in block:
            draws[r.source, e].add(s)
    assert {s for found in draws.values() for s in found} == set(range(6))
    # An epoch of a source is drawn before the next one, so its shards never come after those of the next.
    assert all(max(draws[s, e]) <= min(draws[s, e + 1]) for s, e in draws if (s, e + 1) in draws)
    # Shards have the same number of block draws, which have about as many words: none is far from the mean.
    size = Counter()
    for r in rows:
        for d in r.mix_draws:
            size[d.shard] += 1
    assert max(size.values()) < 1.3 * min(size.values())


def test_rows_that_repeat_a_document_are_drawn_by_themselves(spark):
    docs = documents(spark, ["a b c"] * 10 + ["d e f"] * 30, ["a"] * 10 + ["b"] * 30).withColumn("doc_id", F.lit(1)).repartition(3)
    rows = mixing.mix(docs, weights=(5, 9)).collect()
    taken = {s: sum(r.mix_size * len(r.mix_draws) for r in rows if r.source == s) for s in "ab"}
    target = {r.source: r.mix_target for r in rows}
    assert target["a"] == pytest.approx(120 * 5 / 14) and all(abs(taken[s] - target[s]) <= 1.5 for s in "ab")


def test_mix_of_more_sources_than_fit_a_group_and_of_clashing_names(spark):
    many = spark.range(100_001).selectExpr("id AS doc_id", "'a b c d' AS text", "concat('host', id) AS source")
    got = mixing.mix(many).agg(F.count("*"), F.sum(F.size("mix_draws") * F.col("mix_size")), F.sum("mix_target")).first()
    assert got[0] == 100_001 and got[2] == pytest.approx(400_004)
    names = ["mix_draws", "mix_shard", "mix_size", "places", "h", "key", "block", "part", "again", "size", "f_h", "draw"]
    docs = documents(spark, ["a b", "c", None]).select("doc_id", "text", "source", *(F.lit(5).alias(n) for n in names))
    mixed = mixing.mix(docs)
    assert set(names) <= set(mixed.columns) and mixed.count() == 3
    rows = mixing.shuffled(mixing.drawn(mixed)).collect()
    assert rows and all(r.h == r.draw == r.part == 5 and r.mix_epoch in (0, 1, 2) for r in rows)


def test_mix_of_nothing(spark, no_docs):
    assert mixing.mix(no_docs).count() == 0
    empty = mixing.mix(documents(spark, [None, "", " "])).collect()
    assert [(r.mix_size, r.mix_target) for r in empty] == [(0, 0.0)] * 3


# Embeddings


def test_vector_links_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = []
    for _ in range(30):
        v = rng.standard_normal(16)
        for _ in range(rng.integers(1, 12)):
            rows.append((v + rng.standard_normal(16) * rng.choice([0, 0.05, 0.15, 0.2]), int(rng.integers(0, 2))))
    vectors = [(i, v.astype(np.float32).tolist(), y) for i, (v, y) in enumerate(rows)]
    n = len(vectors)
    vectors += [(n, None, 0), (n + 1, [0.0] * 16, 0), (n + 2, [float("nan")] + [1.0] * 15, 0), (n + 3, [None] + [1.0] * 15, 0), (n + 4, vectors[0][1], None), (n + 5, [], 0), (n + 6, [1e30, 1.0], 0), (n + 7, [1e30, 0.0], 0), (n + 8, [float("inf"), 0.0], 0), (n + 9, [2.0, 0.0], 0)]
    df = spark.createDataFrame([(*v, "x", 0) for v in vectors], "vec_id long, embedding array<float>, label int, id string, links int")
    linked, parent = defaultdict(set), {}

    def root(x):
        while parent.get(x, x) != x:
            x = parent[x]
        return x

    real = [(i, np.array(v, float), y) for i, v, y in vectors if v and None not in v and np.isfinite(v).all() and any(v) and y is not None]
    for i, v, y in real:
        for j, w, z in real:
            if i < j and y == z and len(v) == len(w) and v @ w / (np.linalg.norm(v) * np.linalg.norm(w)) >= 0.98:
                linked[i].add(j)
                linked[j].add(i)
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    got = {r.vec_id: tuple(r)[1:] for r in vector_dedup.near_duplicates(df).collect()}
    assert got == {i: (len(linked[i]), root(i), root(i) == i) for i, _, _ in vectors}
    assert sum(map(len, linked.values())) > 100
    assert vector_dedup.near_duplicates(df.limit(0)).count() == 0


def test_vector_blocks_and_copies(spark, monkeypatch):
    monkeypatch.setattr(vector_dedup, "BLOCK", 4)
    rng = np.random.default_rng(6)
    base = rng.standard_normal(8)
    rows = [(i, (base + rng.standard_normal(8) * 0.01).tolist(), 1) for i in range(30)] + [(i, base.tolist(), 1) for i in range(30, 40)] + [(None, base.tolist(), 1)]
    got = {r.vec_id: tuple(r)[1:] for r in vector_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {i: (39, 0, i == 0) for i in range(40)} | {None: (0, None, True)}


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(9)
    a = rng.standard_normal((200, 32))
    b = a + rng.standard_normal((200, 32)) * rng.uniform(0, 2, (200, 1))
    a, b = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (a, b))
    estimate, bound = vector_dedup.estimated(a, *vector_dedup.coded(b))
    error = estimate - a @ b.T
    assert abs(error.mean()) < 0.002 and (np.abs(error) < bound).all()


# BPE


def test_bpe_round_trip_equals_the_library(spark, docs, no_docs):
    tokenizers = pytest.importorskip("tokenizers")
    from pathlib import Path

    from stratum.llm.queries import tokenizer

    spec = Path(tokenizer("word_bpe_49k.json")).read_text(encoding="utf-8")
    own = tokenizers.Tokenizer.from_str(spec)
    digests = {r.doc_id: tuple(r)[1:] for r in bpe_codec.digests(docs, spec).collect()}
    for r in bpe_codec.encode(docs, spec).join(docs.select("doc_id", "text"), "doc_id").collect():
        ids = own.encode(r.text or "", add_special_tokens=False).ids
        decoded = own.decode(ids, skip_special_tokens=False)
        assert (r.ids, r.decoded) == (ids, decoded)
        assert digests[r.doc_id] == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
    assert bpe_codec.digests(no_docs, spec, with_ids=True).count() == 0


def test_bpe_words_equal_plain_merging():
    from pathlib import Path

    from stratum.llm.queries import tokenizer

    codec = bpe_codec.Codec(Path(tokenizer("word_bpe_49k.json")).read_text(encoding="utf-8"))
    rng = random.Random(3)
    for _ in range(500):
        piece = "".join(rng.choices("aeinorst", k=rng.randint(1, 25)))
        text = piece[:-1] + chr(ord(piece[-1]) + bpe_codec.LAST)
        assert [codec.symbols[i] for i in codec.encode_piece(piece)] == codec.merged(text)


# WARC


def test_warc_round_trip(spark):
    fake = "WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nabcde\r\n\r\n"
    rows = [(1, "u", None), (2, None, ""), (3, "a\r\nb", "x" * 999 + "\u00e9"), (4, "q", "x" * 999 + "\u00e9"), (5, "q", "\u00e9" * 499), (6, "q", "\u00e9" * 499), (7, "f", fake * 3), (8, "f", "z" + fake + "WARC/1.0\r\n" * 7 + "tail"), (9, "f", "z" + fake * 40), (10, "f", "z" + fake * 40), (11, "f", "WARC/1.0\r\nContent-Length: 3\r\n\r\nabc"), (12, "f", "y" * 400_000), (13, "f", "\r\n\r\n"), (None, "f", "z" + fake * 40)]
    pages = spark.createDataFrame([(*r, "c", 0) for r in rows], "page_id long, url string, html string, key string, body int").repartition(3)
    got = sorted((tuple(r) for r in warc.round_trip(pages).collect()), key=str)
    groups = defaultdict(list)
    for i, _, h in rows:
        if len((h or "").encode()) >= 1000 and i is not None:
            groups[h].append(i)
    expected = []
    for i, _, h in rows:
        body = (h or "").encode()
        keeper = max(groups[h]) if groups.get(h) else i
        revisit = keeper != i
        expected.append((i, len(body), hashlib.sha1(body).hexdigest(), "revisit" if revisit else "response", keeper if revisit else None))
    assert got == sorted(expected, key=str)
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_warc_rows_that_share_an_id(spark, monkeypatch):
    a, b = "a" * 1200, "b" * 1300
    pages = spark.createDataFrame([(5, "u", a), (5, "u", b), (3, "u", a), (4, "u", b), (4, "u", a)], "page_id long, url string, html string")
    sha = lambda t: hashlib.sha1(t.encode()).hexdigest()
    expected = sorted([(5, 1200, sha(a), "response", None), (5, 1300, sha(b), "response", None), (3, 1200, sha(a), "revisit", 5), (4, 1300, sha(b), "revisit", 5), (4, 1200, sha(a), "revisit", 5)], key=str)
    assert sorted(map(tuple, warc.round_trip(pages).collect()), key=str) == expected
    monkeypatch.setattr(warc, "BROADCAST_KEEPERS", 0)
    assert sorted(map(tuple, warc.round_trip(pages.union(pages.limit(0))).collect()), key=str) == expected


def test_warc_files_are_split_anywhere(spark):
    body = "".join(f"line {i} WARC/1.0\r\nContent-Length: {i}\r\n\r\n" for i in range(300))
    pages = spark.createDataFrame([(i, f"http://h/{i}", body[: i * 37]) for i in range(60)], "page_id long, url string, html string").coalesce(2)
    path = f"{common.scratch_dir(spark)}/warc-test-{random.random()}"
    warc.write_archive(pages, path)
    whole = sorted((r.record_id, r.offset, r.payload_digest) for r in warc.read_archive(spark, path).collect())
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        split = sorted((r.record_id, r.offset, r.payload_digest) for r in warc.read_archive(spark, path).collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(whole) == 60 and split == whole
    claimed = warc.read_archive(spark, path).where("type = 'response'").collect()
    assert all(r.claimed == r.payload_digest for r in claimed)


# Chat


def test_chat_reads_back_what_it_wrote(spark):
    rows = [(1, 0, "us\ner<|nl|>", r"a<|b<\|c<\\|d<<||\|<"), (1, 1, None, None), (1, None, "assistant", "$1 \\ <|image:0.0|>"), (None, 0, "", ""), (2, 0, "assistant", "<|nl|>\n<|"), (2, 0, "assistant", "<|nl|>\n<|"), (3, 1, "user", "b"), (3, 1, "user", "a"), (3, 0, "assistant", "x" * 50_000)]
    turns = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").withColumn("parts", chat.text_parts(F.col("text"))).withColumn("conv", F.lit(1))
    chats = chat.format_chat(turns)
    read = {r.conv_id: r for r in chats.select("conv_id", "formatted", chat.read_turns(F.col("formatted")).alias("turns"), chat.trained_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()}
    by = defaultdict(list)
    for c, turn, role, text in rows:
        by[c].append((turn if turn is not None else -1, role or "", text or ""))
    assert set(read) == set(by)
    for c, own in by.items():
        own.sort()
        assert [(t.role, t.text) for t in read[c].turns] == [(r, t) for _, r, t in own]
        assert read[c].loss == "".join(t for _, r, t in own if r == "assistant")
        assert read[c].formatted.count("<|im_start|>") == read[c].formatted.count("<|im_end|>") == len(own)
    assert chat.format_chat(turns.limit(0)).count() == 0


def test_chat_parts_become_placeholders(spark):
    part = lambda kind, text=None, ref=None, units=None: (kind, text, ref, units)
    rows = [(1, 0, "user", [part("text", "look <|"), part("image", ref="a.png", units=4), part("audio", ref="b")]), (1, 1, "assistant", [part("text", "a<"), part("text", "|x<"), part(None, "\\|<|"), part("document", ref="d", units=2)]), (1, 2, "user", None)]
    turns = spark.createDataFrame(rows, f"conv_id long, turn int, role string, parts array<{chat.PART}>")
    r = chat.format_chat(turns).select("*", chat.trained_text(F.col("formatted"), F.col("loss_spans")).alias("loss"), chat.read_turns(F.col("formatted")).alias("turns")).first()
    assert [(a.turn, a.part, a.kind, a.ref, a.tokens) for a in r.attachments] == [(0, 1, "image", "a.png", 1024), (0, 2, "audio", "b", 25), (1, 3, "document", "d", 1024)]
    assert r.expanded_tokens == 2073
    assert r.loss == "a<|x<\\|<|<|document:1.3|>" and [t.text for t in r.turns] == ["look <|<|image:0.1|><|audio:0.2|>", r.loss, ""]


# Quality


def base_counts(text):
    t = text or ""
    w = WORD.findall(t)
    windows = defaultdict(list)
    for i in range(len(w) - 7):
        windows[tuple(w[i : i + 8])].append(i)
    covered = {j for at in windows.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered), len(w) < 20 or 100 * len(covered) > 30 * len(w)


def test_quality_counts_equal_brute_force(spark, docs, no_docs):
    rng = random.Random(7)
    texts = odd_texts() + [" ".join(rng.choices("abc", k=rng.randint(5, 60))) for _ in range(60)] + ["a b c d e f g h " * 3 + "i j k l m n o p"]
    rows = quality.with_quality(documents(spark, texts)).select("doc_id", "quality.*").collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert {r.doc_id: tuple(r[n] for n in names) for r in rows} == {i: base_counts(t) for i, t in enumerate(texts)}
    assert quality.with_quality(no_docs).count() == 0


COMMON = ["the", "of", "and", "to", "in", "a", "is", "that"]


def prose(rng, n=120):
    return " ".join(rng.choice(COMMON) if rng.random() < 0.25 else "".join(rng.choices("etaoinshrdlu", k=rng.randint(2, 9))) for _ in range(n)) + "."


def test_quality_rejects_junk_and_keeps_prose(spark):
    rng = random.Random(11)
    clean = [prose(rng) for _ in range(60)]
    junk = [prose(rng).upper() for _ in range(5)] + [prose(rng).replace(" ", "%%% ") for _ in range(5)] + [" | ".join("".join(rng.choices("etaoinshr", k=7)) for _ in range(100)) for _ in range(5)]
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate(clean + junk)], "doc_id long, text string, lang string")
    got = {r.doc_id: r.quality.kept for r in quality.with_quality(df).collect()}
    assert [got[i] for i in range(75)] == [True] * 60 + [False] * 15


def test_references_of_few_documents_and_clashing_names(spark):
    rng = random.Random(12)
    texts = [(prose(rng), "en") for _ in range(60)] + [(prose(rng), "nl") for _ in range(19)] + [(prose(rng).upper(), "nl"), (prose(rng).replace(" ", "%%% "), "fi"), (prose(rng), "fi"), (prose(rng), None), (None, None), ("", "en")]
    names = ["row", "text_", "common", "quality", "classes", "counts", "trust"]
    docs = spark.createDataFrame([(i, t, g, *range(7)) for i, (t, g) in enumerate(texts)], "doc_id long, text string, lang string, " + ", ".join(f"{n} int" for n in names))
    kept = quality.kept_documents(docs)
    assert kept.columns == docs.columns
    rows = kept.collect()
    # A language of 20 documents, or of two, is judged like one of many: junk goes and prose stays.
    assert sorted(r.doc_id for r in rows) == [*range(79), 81, 82] and all(tuple(r)[3:] == tuple(range(7)) for r in rows)
    replaced = quality.with_quality(docs, ["quality", "row"])
    assert replaced.columns == ["row", "quality"] and replaced.schema["quality"].dataType.fieldNames()[0] == "n_words"


def test_common_words_equal_plain_counts(spark):
    rng = random.Random(14)
    rows = [(i, " ".join(rng.choices(["the", "THE", "of", "|", "é", "12"] + [f"w{k}" for k in range(400)], weights=[30, 10, 30, 50, 20, 20] + [1] * 400, k=50)), rng.choice(["a", "b", None])) for i in range(200)]
    found = {r.of_lang: r.common for r in quality.common_words(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    for lang in ("a", "b", None):
        counts = Counter(w for _, t, g in rows if g == lang for w in t.lower().split())
        most = sorted((w for w, c in counts.items() if re.search(r"[^\W\d_]", w) and quality.COMMON_PART * c >= sum(counts.values())), key=lambda w: (-counts[w], w))
        assert found[lang] == most[: quality.N_COMMON]


def test_distance_equals_the_formula(spark):
    def js(p, q):
        p, q = np.array(p) / sum(p), np.array(q) / sum(q)
        m = (p + q) / 2
        kl = lambda a: sum(x * math.log2(x / y) for x, y in zip(a, m) if x)
        return math.sqrt((kl(p) + kl(q)) / 2)

    rows = [([1.0, 2.0, 0.0], [0.0, 2.0, 5.0]), ([1.0, 1.0, 1.0], [1.0, 1.0, 1.0]), ([1.0, 0.0, 0.0], [0.0, 0.0, 1.0])]
    got = [r.d for r in spark.createDataFrame(rows, "p array<double>, q array<double>").select(quality.distance(F.col("p"), F.col("q")).alias("d")).collect()]
    assert got == pytest.approx([js(p, q) for p, q in rows])
    none = spark.createDataFrame([([0.0], [1.0]), (None, [1.0])], "p array<double>, q array<double>")
    assert [r.d for r in none.select(quality.distance(F.col("p"), F.col("q")).alias("d")).collect()] == [None, None]


# LM scoring


def plain_scores(texts):
    tokens = {i: (t or "").encode().lower().split() + [b""] for i, t in texts}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in tokens}
    c = Counter(w for i, ws in tokens.items() if not held[i] for w in ws)
    n, v = sum(c.values()), len(c)
    return {i: (held[i], len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)) for i, ws in tokens.items()}, c


@pytest.mark.parametrize("chunk", [100, 32_000_000])
def test_base_scores_equal_brute_force(spark, docs, no_docs, monkeypatch, chunk):
    monkeypatch.setattr(lm_score, "CHUNK_BYTES", chunk)
    got = {r.doc_id: tuple(r) for r in lm_score.score_documents(docs).collect()}
    expected, _ = plain_scores([(r.doc_id, r.text) for r in docs.collect()])
    for i, e in expected.items():
        assert got[i][1:5] == e[:4]
        assert got[i][5] == pytest.approx(e[4]) and got[i][6] < 0
    assert lm_score.score_documents(no_docs).count() == 0


def plain_spelling(vocabulary, asked):
    """The natural logarithms of asked words' probabilities by a byte tree of dictionaries, and the distribution after a context."""
    symbols = lambda w: [((b"\0" * (lm_score.DEPTH - 1) + b" " + w)[: lm_score.DEPTH + k][-lm_score.DEPTH :], s) for k, s in enumerate(w + b" " if w else b"\n")]
    levels = [defaultdict(Counter) for _ in range(lm_score.DEPTH + 1)]
    for w in vocabulary:
        for context, s in symbols(w):
            for k, level in enumerate(levels):
                level[context[len(context) - k :]][s] += 1

    def kept(context):
        own = levels[len(context)].get(context)
        if not own or not context:
            return own
        n, shorter = sum(own.values()), levels[len(context) - 1][context[1:]]
        gain = sum(c * math.log(c / n * sum(shorter.values()) / shorter[s]) for s, c in own.items())
        return own if n >= lm_score.LEAST_COUNT and gain >= lm_score.LEAST_BYTE_GAIN else None

    def p(context, s):
        out = 1 / 256
        for k in range(lm_score.DEPTH + 1):
            if own := kept(context[len(context) - k :]):
                out = (own[s] + len(own) * out) / (sum(own.values()) + len(own))
        return out

    return {w: sum(math.log(p(*x)) for x in symbols(w)) for w in asked}, p


def plain_model(texts, trained):
    """Each text's log10 probability by token contexts in dictionaries; texts and trained are lists of words and booleans."""
    rows = [[b"", b"", *t, b""] for t in texts]
    grams = [Counter(tuple(t[k - d : k + 1]) for t, own in zip(rows, trained) if own for k in range(2, len(t))) for d in range(3)]
    total, distinct = sum(grams[0].values()), len(grams[0])
    spelled, _ = plain_spelling([w for (w,) in grams[0]], {w for t in rows for w in t})
    root = lambda w: grams[0][(w,)] / (total + distinct) if (w,) in grams[0] else math.exp(spelled[w]) * (distinct / (total + distinct) if total else 1)

    def contexts(t, k):
        """Of the token k by length: the context and how often training has it."""
        return [(d, tuple(t[k - d : k]), (grams[0][(t[k - 1],)], grams[1][tuple(t[k - 2 : k])] if k > 2 else 0)[d - 1]) for d in (1, 2)]

    gains = Counter()
    for t, own in zip(rows, trained):
        for k in range(2, len(t) if own else 0):
            p = root(t[k])
            for d, context, n in contexts(t, k):
                if n >= lm_score.LEAST_CONTEXT:
                    q = (grams[d][(*context, t[k])] - 1 + lm_score.PRIOR[d - 1] * p) / (n - 1 + lm_score.PRIOR[d - 1])
                    gains[context] += round(lm_score.UNIT * math.log(q / p))
                    p = q
    out = []
    for t in rows:
        score = 0.0
        for k in range(2, len(t)):
            state = p = root(t[k])
            for d, context, n in contexts(t, k):
                if n >= lm_score.LEAST_CONTEXT:
                    p = (grams[d][(*context, t[k])] + lm_score.PRIOR[d - 1] * p) / (n + lm_score.PRIOR[d - 1])
                    state = p if gains[context] >= lm_score.UNIT * lm_score.LEAST_GAIN else state
            score += math.log10(state)
        out.append(score)
    return out, gains


def test_spelling_is_a_distribution_and_equals_a_plain_tree(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "GROUP_CODES", 300)
    rng = random.Random(13)
    words = {"".join(rng.choice(["ba", "na", "ki", "é"]) for _ in range(rng.randint(1, 6))).encode() for _ in range(3000)}
    asked = {b"bana", b"abna", b"zz", b"", "éba".encode(), b"x" * 700, *list(words)[:5]}
    frame = lambda ws: spark.createDataFrame([(bytearray(w),) for w in ws], "word binary").repartition(3)
    got = {bytes(r.word): r.tree for r in lm_score.spelling(frame(words), frame(asked)).collect()}
    expected, p = plain_spelling(words, asked)
    assert got.keys() == expected.keys() and all(got[w] == pytest.approx(expected[w]) for w in asked)
    assert got[b"bana"] > got[b"abna"] + 3
    for context in (b"\0\0\0\0 ", b"\0\0 ba", b" bana", b"qqqqq"):
        assert sum(p(context, s) for s in range(256)) == pytest.approx(1)
    nothing = {bytes(r.word): r.tree for r in lm_score.spelling(frame([]), frame([b"a"])).collect()}
    assert nothing[b"a"] == pytest.approx(2 * math.log(1 / 256))


def test_model_beats_even_letters_on_held_out_texts(spark):
    rng = random.Random(17)
    docs = documents(spark, [" ".join(rng.choice(["red", "green", "blue", "dark"]) + rng.choice(["ish", "ly", "er"]) for _ in range(50)) for _ in range(200)])
    held = lm_score.score_documents(docs).where("held_out").collect()
    assert held and all(r.score > -1.4 * r.n_tokens for r in held)


@pytest.mark.parametrize("chunk", [100, 32_000_000])
def test_score_equals_a_plain_suffix_tree(spark, monkeypatch, chunk):
    monkeypatch.setattr(lm_score, "CHUNK_BYTES", chunk)
    rng, ring = random.Random(19), ["ant", "bee", "cow", "dog", "elk", "fox", "gnu", "hen"]
    held = [i for i in range(400) if lm_score.held_out(i)]
    texts = [[ring[(s + k) % 8] if rng.random() < 0.9 else rng.choice([*ring, f"w{rng.randrange(500)}"]) for k in range(24)] for s in (rng.randrange(8) for _ in range(400))]
    texts[held[0]] = [ring[k % 8] for k in range(24)]
    texts[held[1]] = rng.sample(texts[held[0]], 24)
    texts[held[2]], texts[held[3]] = [], ["zebra", "x" * 40]
    got = {r.doc_id: r for r in lm_score.score_documents(documents(spark, [" ".join(t) for t in texts]).repartition(3)).collect()}
    expected, gains = plain_model([[w.encode() for w in t] for t in texts], [i not in held for i in range(400)])
    assert [got[i].score for i in range(400)] == pytest.approx(expected)
    of_two = [g for context, g in gains.items() if len(context) == 2]
    assert min(of_two) < 0 < lm_score.UNIT * lm_score.LEAST_GAIN < max(of_two)  # some are retained and some not
    fluent, salad = got[held[0]], got[held[1]]
    assert fluent.base_score == pytest.approx(salad.base_score) and fluent.score > salad.score + 10


def test_documents_that_occur_twice_score_apart(spark):
    rng = random.Random(29)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    texts = [" ".join(word() for _ in range(40)) for _ in range(120)]
    ids = [i for i in range(120) if not lm_score.held_out(i)]
    texts[ids[1]] = texts[ids[0]]
    got = {r.doc_id: r.score / r.n_tokens for r in lm_score.score_documents(documents(spark, texts)).collect()}
    assert min(got[ids[0]], got[ids[1]]) > max(got[i] for i in range(120) if i not in ids[:2]) + 1


# All operators: nulls in every column, and rows that repeat


def test_nulls_in_every_column_and_repeated_rows(spark):
    from pathlib import Path

    from stratum.llm.queries import tokenizer

    rows = [(None, None, None, None, None)] * 3 + [(1, "a b c", None, None, 3)] * 2 + [(None, "a b c", "en", "s", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    spec = Path(tokenizer("word_bpe_49k.json")).read_text(encoding="utf-8")
    for out in (token_count.count_tokens(docs, token_count.Vocabulary.of({"a": -1})), near_dup.near_duplicates(docs), mixing.mix(docs), bpe_codec.digests(docs, spec), quality.with_quality(docs), lm_score.score_documents(docs)):
        got = Counter(r.doc_id for r in out.collect())
        assert got == {None: 4, 1: 2}
    pages = spark.createDataFrame([(None, None, None)] * 2 + [(1, "u", None)] * 2, "page_id long, url string, html string")
    assert url_filter.judge(pages, RULES, url_filter.fit([None], [1])).count() == 4
    assert Counter((r.page_id, r.record_type) for r in warc.round_trip(pages).collect()) == {(None, "response"): 2, (1, "response"): 2}
    vectors = spark.createDataFrame([(None, None, None)] * 2 + [(1, [1.0, 0.0], 0)] * 2, "vec_id long, embedding array<double>, label int")
    assert Counter(tuple(r) for r in vector_dedup.near_duplicates(vectors).collect()) == {(None, 0, None, True): 2, (1, 1, 1, True): 2}
    turns = spark.createDataFrame([(None, None, None, None)] * 2, "conv_id long, turn int, role string, text string").withColumn("parts", chat.text_parts(F.col("text")))
    assert [len(r.turns) for r in chat.format_chat(turns).select(chat.read_turns(F.col("formatted")).alias("turns")).collect()] == [2]
