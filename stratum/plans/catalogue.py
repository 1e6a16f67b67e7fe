"""The registered queries over the ledger kept in events, and SQL for the same rows, by name.

The ledger view: 100 events make a block, the user is the address, the event's type the slot, and the value, in
hundredths, is what the slot holds.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratum.functions import bloom, chunked_tree, hashing, learned
from stratum.operators import contracts, lookup, lsm, merkle, metrics, provenance, reorg, run_proofs, state, trie
from stratum.plans.scratch import folder, positions, stored
from stratum.sources import traces
from stratum.sources.store import Store
from stratum.streaming import blocks as streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

BLOCK_SIZE, CAPACITY, RATIO, FANOUT, EPSILON = 100, 500, 3, 4, 8
#: Ledger tables for the SQL side: writes w, changes c, latest state l, and rows with their flush f.
CTE = f"""WITH w AS (SELECT user_id AS addr, event_type AS slot, CAST(floor(event_id / {BLOCK_SIZE}) AS BIGINT) + 1 AS block, event_id AS seq, CAST(round(value * 100) AS BIGINT) AS value FROM events),
c AS (SELECT addr, slot, block, arg_max(value, seq) AS value FROM w GROUP BY addr, slot, block),
l AS (SELECT addr, slot, max(block) AS block, arg_max(value, block) AS value FROM c GROUP BY addr, slot),
f AS (SELECT *, CAST(floor((row_number() OVER (ORDER BY block, addr, slot) - 1) / {CAPACITY}) AS BIGINT) AS flush FROM c),
n AS (SELECT CAST(floor(count(*) / {CAPACITY}) AS BIGINT) AS flushes FROM c),
p AS (SELECT f.*, (SELECT coalesce(max(i), -1) FROM range(0, 13) r(i) WHERE f.flush < n.flushes - n.flushes % CAST(pow({RATIO}, i) AS BIGINT) AND n.flushes >= pow({RATIO}, i)) AS level, n.flushes FROM f, n),
r AS (SELECT addr, slot, block, value, flush, level, CASE WHEN level < 0 THEN -1 ELSE CAST(floor((flush - (flushes - flushes % CAST(pow({RATIO}, level + 1) AS BIGINT))) / pow({RATIO}, level)) AS BIGINT) END AS run FROM p)
"""


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function (spark, sf_dir) -> DataFrame, with SQL that follows CTE."""

    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = CTE + sql
        return fn

    return register


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select(F.col("user_id").alias("addr"), F.col("event_type").alias("slot"), (F.floor(F.col("event_id") / BLOCK_SIZE) + 1).alias("block"), F.col("event_id").alias("seq"), F.round(F.col("value") * 100).cast("long").alias("value"))


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.block_writes(writes(spark, sf_dir))


def head_block(c: DataFrame) -> int:
    return c.agg(F.coalesce(F.max("block"), F.lit(1))).first()[0]


def rows_in_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lsm.with_runs(changes(spark, sf_dir), CAPACITY, RATIO)


def joined_versions(versions):  # noqa: ANN001, ANN201
    return F.array_join(F.transform(versions, lambda v: F.concat_ws(":", v["block"].cast("string"), v["value"].cast("string"))), ",")


VERSIONS_SQL = "string_agg(CAST(block AS VARCHAR) || ':' || CAST(value AS VARCHAR), ',' ORDER BY block)"


@query("state_changes", "SELECT * FROM c")
def state_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes(spark, sf_dir)


@query("latest_state", "SELECT * FROM l")
def latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.latest(changes(spark, sf_dir))


@query("latest_with_default", "SELECT k.addr, k.slot, coalesce(l.value, 0) AS value FROM (SELECT DISTINCT addr + 40 AS addr, 'click' AS slot FROM c) k LEFT JOIN l USING (addr, slot)")
def latest_with_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = changes(spark, sf_dir)
    return state.values_of(c.select((F.col("addr") + 40).alias("addr"), F.lit("click").alias("slot")), c, F.lit(0))


@query("asof_state", "SELECT addr, slot, max(block) AS block, arg_max(value, block) AS value FROM c WHERE block <= 50 GROUP BY addr, slot")
def asof_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.as_of(changes(spark, sf_dir), 50)


@query("live_state", "SELECT * FROM l WHERE value % 100 <> 0")
def live_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = changes(spark, sf_dir).withColumn("value", F.when(F.col("value") % 100 != 0, F.col("value")))
    order = state.block_writes(marked.withColumn("seq", F.lit(0)))
    newest = order.groupBy("addr", "slot").agg(F.max("block").alias("block"), F.max(F.struct("block", "value"))["value"].alias("value"))
    return state.without_tombstones(newest, F.lit(None).cast("long"))


@query("provenance_range", "SELECT * FROM c WHERE block BETWEEN 30 AND 60 AND slot IN ('click', 'view')")
def provenance_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.provenance(changes(spark, sf_dir).where(F.col("slot").isin("click", "view")), 30, 60)


@query("provenance_boundary", "SELECT addr, slot, block, value, inside FROM (SELECT *, block >= 30 AS inside, lead(block) OVER (PARTITION BY addr, slot ORDER BY block) AS nx FROM c WHERE block <= 60) WHERE block >= 30 OR nx > 30 OR nx IS NULL")
def provenance_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.provenance_with_boundary(changes(spark, sf_dir), 30, 60)


@query("history_array", f"SELECT addr, slot, count(*) AS n_versions, {VERSIONS_SQL} AS versions FROM c GROUP BY addr, slot")
def history_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.history(changes(spark, sf_dir)).withColumn("versions", joined_versions(F.col("versions")))


@query("state_diff", """SELECT addr, slot, a.value AS old_value, b.value AS new_value FROM (SELECT addr, slot, arg_max(value, block) AS value FROM c WHERE block <= 30 GROUP BY addr, slot) a
FULL OUTER JOIN (SELECT addr, slot, arg_max(value, block) AS value FROM c WHERE block <= 70 GROUP BY addr, slot) b USING (addr, slot) WHERE a.value IS DISTINCT FROM b.value""")  # fmt: skip
def state_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.diff(changes(spark, sf_dir), 30, 70)


@query("prune_before", "SELECT c.* FROM c LEFT JOIN (SELECT addr, slot, max(block) AS held FROM c WHERE block <= 50 GROUP BY addr, slot) h USING (addr, slot) WHERE c.block >= 50 OR c.block = h.held")
def prune_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.prune_before(changes(spark, sf_dir), 50)


@query("key_neighbours", """SELECT addr, slot, e AS "exists", before, after FROM (SELECT addr, slot, e, asked, max(CASE WHEN e THEN k END) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before,
min(CASE WHEN e THEN k END) OVER (ORDER BY k ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS after FROM (SELECT addr, slot, bool_or(e) AS e, bool_or(a) AS asked, lpad(CAST(addr AS VARCHAR), 12, '0') || '|' || slot AS k
FROM (SELECT DISTINCT addr, slot, true AS e, false AS a FROM c UNION ALL SELECT DISTINCT addr, CASE WHEN addr % 2 = 0 THEN 'purchase' ELSE 'm' END, false, true FROM c) GROUP BY addr, slot)) WHERE asked""")  # fmt: skip
def key_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = changes(spark, sf_dir)
    probes = c.select("addr", F.when(F.col("addr") % 2 == 0, "purchase").otherwise("m").alias("slot"))
    shown = lambda k: F.when(F.col(k).isNotNull(), F.concat(F.lpad(F.col(k)["addr"].cast("string"), 12, "0"), F.lit("|"), F.col(k)["slot"])).alias(k)
    return state.neighbours(c, probes).select("addr", "slot", "exists", shown("before"), shown("after"))


@query("recent_keys", "SELECT addr, slot, max(block) AS block FROM c WHERE block > (SELECT max(block) FROM c) - 3 GROUP BY addr, slot")
def recent_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.recent_keys(changes(spark, sf_dir), 3)


@query("stale_writes", "SELECT addr, slot, block, value, seq, newest FROM (SELECT *, max(block) OVER (PARTITION BY addr, slot ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest FROM (SELECT addr, slot, block * 7 % 11 AS block, value, seq FROM w)) WHERE block < newest")
def stale_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.checked_versions(writes(spark, sf_dir).withColumn("block", F.col("block") * 7 % 11), "seq")


@query("run_assignment", "SELECT * FROM f")
def run_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lsm.with_flush(changes(spark, sf_dir), CAPACITY)


@query("level_placement", "SELECT DISTINCT flush, CAST(level AS BIGINT) AS level, run FROM r")
def level_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows_in_runs(spark, sf_dir).select("flush", F.col("level").cast("long").alias("level"), F.col("run").cast("long").alias("run")).distinct()


@query("run_block_ranges", "SELECT CAST(level AS BIGINT) AS level, run, count(*) AS n_rows, min(block) AS block_lo, max(block) AS block_hi FROM r GROUP BY level, run")
def run_block_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lsm.runs(rows_in_runs(spark, sf_dir)).withColumns({"level": F.col("level").cast("long"), "run": F.col("run").cast("long")})


@query("runs_probed", "SELECT addr, slot, (SELECT max(flush) FROM f) - max(flush) + 1 AS probed FROM f GROUP BY addr, slot")
def runs_probed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lsm.runs_probed(lsm.with_flush(changes(spark, sf_dir), CAPACITY))


@query("page_layout", "SELECT flush, addr, slot, block, CAST(floor((row_number() OVER (PARTITION BY flush ORDER BY addr, slot, block) - 1) / 46) AS BIGINT) AS page FROM f")
def page_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lsm.pages(lsm.with_flush(changes(spark, sf_dir), CAPACITY))


@query("filter_budget", """SELECT level, run, filter_bytes, sum(filter_bytes) OVER (ORDER BY level, run DESC) <= 2000 AS has_filter FROM
(SELECT CAST(level AS BIGINT) AS level, run, CAST(ceil(ceil(count(*) * (-ln(0.1) / (ln(2) * ln(2)))) / 8) AS BIGINT) AS filter_bytes FROM r GROUP BY level, run)""")  # fmt: skip
def filter_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lsm.with_filter_budget(run_block_ranges(spark, sf_dir), budget_bytes=2000).select("level", "run", "filter_bytes", "has_filter")


@query("short_rewind", "SELECT * FROM c WHERE block <= (SELECT max(block) FROM c) - 10")
def short_rewind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reorg.rewound(changes(spark, sf_dir), 10)


def leaf_sql(*columns: str) -> str:
    """merkle.leaf() of columns."""
    return "sha256(" + " || ".join(f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in columns) + ")"


LEAF_SQL, PATH_SQL = leaf_sql("addr", "slot", "block", "value"), leaf_sql("addr", "slot")


@query("leaf_digest", f"SELECT addr, slot, {LEAF_SQL} AS digest FROM l")
def leaf_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest_state(spark, sf_dir).select("addr", "slot", merkle.leaf("addr", "slot", "block", "value").alias("digest"))


def run_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves of a tree for each run, in the order of keys and blocks."""
    rows = positions(rows_in_runs(spark, sf_dir), ["level", "run", "addr", "slot", "block"])
    first = rows.groupBy("level", "run").agg(F.min("pos").alias("first"))
    own = rows.join(F.broadcast(first), ["level", "run"])  # a row for each run: levels times ratio
    return own.select(F.concat_ws("/", "level", "run").alias("tree"), (F.col("pos") - F.col("first")).alias("pos"), merkle.leaf("addr", "slot", "block", "value").alias("hash"))


def run_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    roots = merkle.roots(run_leaves(spark, sf_dir), FANOUT)
    part = lambda i: F.split("tree", "/")[i].cast("long")
    return roots.select(part(0).alias("level"), part(1).alias("run"), F.col("root").alias("digest"))


def level_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over the runs of each level, the newest first."""
    return merkle.ordered_digest(run_digests(spark, sf_dir), -F.col("run"), "digest", ["level"], "digest")


def root_sql(leaves: str, fanout: int = FANOUT) -> str:
    """Roots of all trees of leaves (tree, pos, hash); short trees are hashed above their root until the longest has one."""
    return f"""SELECT tree, hash AS root FROM (WITH RECURSIVE t(tree, lev, pos, hash) AS (SELECT tree, 0, pos, hash FROM ({leaves}) UNION ALL
SELECT tree, lev + 1, CAST(floor(pos / {fanout}) AS BIGINT), sha256(string_agg(hash, '' ORDER BY pos)) FROM t GROUP BY 1, 2, 3 HAVING (SELECT max(pos) FROM t) > 0) SELECT *, max(lev) OVER () AS top FROM t) WHERE lev = top"""


RUN_SQL = f"""SELECT CAST(split_part(tree, '/', 1) AS BIGINT) AS level, CAST(split_part(tree, '/', 2) AS BIGINT) AS run, root AS digest FROM
({root_sql(f"SELECT CAST(level AS BIGINT) || '/' || run AS tree, row_number() OVER (PARTITION BY level, run ORDER BY addr, slot, block) - 1 AS pos, {LEAF_SQL} AS hash FROM r")})"""
LEVEL_SQL = f"SELECT level, sha256(string_agg(digest, '' ORDER BY run DESC)) AS digest FROM ({RUN_SQL}) GROUP BY level"


@query("run_digest", RUN_SQL)
def run_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each run's Merkle root."""
    return run_digests(spark, sf_dir)


@query("level_digest", LEVEL_SQL)
def level_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return level_digests(spark, sf_dir)


@query("store_digest", f"SELECT sha256(string_agg(digest, '' ORDER BY level)) AS digest FROM ({LEVEL_SQL})")
def store_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over what is not flushed yet and the levels, the top first."""
    return merkle.ordered_digest(level_digests(spark, sf_dir), F.col("level"), "digest", [], "digest")


def latest_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves of the tree of all keys in their order."""
    rows = positions(latest_state(spark, sf_dir), ["addr", "slot"])
    return rows.select(F.lit(0).alias("tree"), "pos", merkle.leaf("addr", "slot", "block", "value").alias("hash"))


LEAVES_SQL = f"SELECT 0 AS tree, row_number() OVER (ORDER BY addr, slot) - 1 AS pos, {LEAF_SQL} AS hash FROM l"


def fold_sql(levels: int) -> str:
    """Some levels above the leaves, by repeated grouping."""
    inner = LEAVES_SQL
    for _ in range(levels):
        inner = f"SELECT tree, CAST(floor(pos / {FANOUT}) AS BIGINT) AS pos, sha256(string_agg(hash, '' ORDER BY pos)) AS hash FROM ({inner}) GROUP BY 1, 2"
    return inner


@query("merkle_level2", fold_sql(2))
def merkle_level2(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaves = latest_leaves(spark, sf_dir)
    return merkle.parents(merkle.parents(leaves, FANOUT), FANOUT)


@query("merkle_proofs_ok", "SELECT 0 AS tree, row_number() OVER (ORDER BY addr, slot) - 1 AS pos, true AS ok FROM l")
def merkle_proofs_ok(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = merkle.levels(latest_leaves(spark, sf_dir), FANOUT)
    return merkle.verified(merkle.proofs(made[0], FANOUT, made=made), merkle.roots(made[0], FANOUT, made=made)).select("tree", "pos", "ok")


#: Leaves of a proved range.
RANGE = 10


@query("range_proofs_ok", f"SELECT 0 AS tree, low, least(low + {RANGE}, n) - low AS n_leaves, true AS ok FROM (SELECT {RANGE} * unnest(range(0, CAST(ceil(count(*) / {RANGE}) AS BIGINT))) AS low, count(*) AS n FROM l)")
def range_proofs_ok(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proofs of stretches of keys, which cover all of them."""
    made = merkle.levels(latest_leaves(spark, sf_dir), FANOUT)
    ranges = made[0].where(F.col("pos") % RANGE == 0).select("tree", F.col("pos").alias("low"), (F.col("pos") + RANGE - 1).alias("high"))
    proven = merkle.range_proofs(made, ranges, FANOUT).join(F.broadcast(merkle.roots(made[0], FANOUT, made=made)), "tree")  # one tree
    return proven.select("tree", "low", F.size("hashes").cast("long").alias("n_leaves"), (merkle.range_root(F.col("hashes"), F.col("path"), FANOUT) == F.col("root")).alias("ok"))


@query("merkle_root", f"""SELECT tree, hash AS root FROM (WITH RECURSIVE t(tree, lev, pos, hash) AS (SELECT tree, 0, pos, hash FROM ({LEAVES_SQL}) UNION ALL
SELECT tree, lev + 1, CAST(floor(pos / {FANOUT}) AS BIGINT), sha256(string_agg(hash, '' ORDER BY pos)) FROM t GROUP BY 1, 2, 3 HAVING (SELECT count(*) FROM t) > 1) SELECT * FROM t) ORDER BY lev DESC LIMIT 1""")  # fmt: skip
def merkle_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.roots(latest_leaves(spark, sf_dir), FANOUT)


@query("ledger_digest")
def ledger_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaves = provenance.key_leaves(provenance.version_roots(changes(spark, sf_dir)))
    return merkle.roots(leaves.select("tree", "pos", "hash"), FANOUT, hashing.blake2b)


@query("version_tree_roots")
def version_tree_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return provenance.version_roots(changes(spark, sf_dir))


#: Levels that hold the longest history in the SQL below: nodes of four members, and a key's tree ends where one node is left.
VERSION_LEVELS = 8


def version_roots_sql() -> str:
    hexkey = "lower(printf('%016x', block))"
    folds = [f"v0 AS (SELECT addr, slot, row_number() OVER (PARTITION BY addr, slot ORDER BY block) - 1 AS pos, {hexkey} AS k, sha256(unhex({hexkey} || hex(encode(CAST(value AS VARCHAR))))) AS d, count(*) OVER (PARTITION BY addr, slot) AS n, false AS done FROM c)"]
    for i in range(VERSION_LEVELS):
        folds.append(f"""v{i + 1} AS (SELECT addr, slot, pos // {FANOUT} AS pos, min(k) AS k, CASE WHEN any_value(done) THEN min(d) ELSE sha256(unhex(string_agg(k || d, '' ORDER BY pos))) END AS d,
(any_value(n) + {FANOUT - 1}) // {FANOUT} AS n, any_value(n) <= {FANOUT} AS done FROM v{i} GROUP BY addr, slot, pos // {FANOUT})""")
    return ", " + ", ".join(folds) + f", roots AS (SELECT v.addr, v.slot, v.d AS root, x.n AS n_versions FROM v{VERSION_LEVELS} v JOIN (SELECT addr, slot, count(*) AS n FROM c GROUP BY addr, slot) x USING (addr, slot)) "


@query("version_tree_roots_fixed", version_roots_sql() + "SELECT * FROM roots")
def version_tree_roots_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return provenance.version_roots(changes(spark, sf_dir), "fixed", FANOUT, chunked_tree.sha256).drop("height")


@query("key_leaf_digests", version_roots_sql() + f"SELECT row_number() OVER (ORDER BY addr, slot) - 1 AS pos, {leaf_sql('addr', 'slot', 'root')} AS hash, addr, slot FROM roots")
def key_leaf_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leaves of the ledger's digest: keys with the roots of their versions."""
    return provenance.key_leaves(version_tree_roots_fixed(spark, sf_dir)).drop("tree")


@query("ledger_digest_sha256", version_roots_sql() + ", leaves AS MATERIALIZED (SELECT 0 AS tree, row_number() OVER (ORDER BY addr, slot) - 1 AS pos, " + leaf_sql("addr", "slot", "root") + " AS hash FROM roots) " + root_sql("SELECT * FROM leaves"))
def ledger_digest_sha256(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The root over all keys' version roots."""
    return merkle.roots(provenance.key_leaves(version_tree_roots_fixed(spark, sf_dir)).drop("addr", "slot"), FANOUT)


def proofs_ok(cut: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        c = changes(spark, sf_dir)
        return provenance.verify(provenance.prove(c, 20, 60, cut), None, 20, 60)

    return run


for _cut in provenance.CUTS:
    query(f"provenance_proofs_{_cut}", "SELECT addr, slot, true AS ok, count(*) FILTER (WHERE block BETWEEN 20 AND 60) AS n_found FROM c GROUP BY addr, slot")(proofs_ok(_cut))


@query("absent_keys", "SELECT DISTINCT addr, 'm' AS slot, false AS \"exists\" FROM c")
def absent_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = changes(spark, sf_dir)
    return provenance.absence(c, c.select("addr", F.lit("m").alias("slot"))).select("addr", "slot", "exists")


@query("content_chunks", "SELECT addr, slot, block, coalesce(sum(cut) OVER (PARTITION BY addr, slot ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS chunk FROM (SELECT *, CASE WHEN " + leaf_sql("block", "value") + "[1] IN ('0', '1', '2', '3') THEN 1 ELSE 0 END AS cut FROM c)")
def content_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = F.substring(merkle.leaf("block", "value"), 1, 1).isin("0", "1", "2", "3").cast("long")
    before = F.sum(cut).over(Window.partitionBy("addr", "slot").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    return changes(spark, sf_dir).select("addr", "slot", "block", F.coalesce(before, F.lit(0)).alias("chunk"))


BLOOM_ERROR = 0.1


@query("bloom_answers", "SELECT flush, count(*) AS n_probes, CAST(0 AS BIGINT) AS misses, true AS few_false FROM f GROUP BY flush")
def bloom_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filters that begin small and grow: keys that they hold, and as many others, of which no more than twice the error rate may pass (and ten, where there are few)."""
    rows = lsm.with_flush(changes(spark, sf_dir), CAPACITY)
    key = lambda shift: F.concat_ws("|", (F.col("addr") + shift).cast("string"), "slot")
    built = bloom.filters(rows, "flush", key(0), BLOOM_ERROR, capacity=32)
    count = lambda probes, name, what: bloom.might_contain(rows, built, "flush", probes).groupBy("flush").agg(F.count("*").alias(f"n_{name}"), F.sum(what.cast("long")).alias(name))
    both = count(key(0), "misses", ~F.col("hit")).join(count(key(10**9), "false", F.col("hit")), "flush")
    return both.select("flush", F.col("n_misses").alias("n_probes"), "misses", (F.col("false") <= 2 * BLOOM_ERROR * F.col("n_false") + 10).alias("few_false"))


@query("model_error_bound", "SELECT flush, true AS bounded FROM f GROUP BY flush")
def model_error_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = (F.col("addr") * 1_000_000 + F.col("block")) * 1000 + F.ascii("slot")
    rows = lsm.with_flush(changes(spark, sf_dir), CAPACITY).withColumn("key", key).withColumn("at", F.row_number().over(Window.partitionBy("flush").orderBy("key")) - 1)
    return learned.models(rows, "flush", "key", "at", EPSILON).groupBy("flush").agg((F.max("max_error") <= EPSILON).alias("bounded"))


@query("trie_prefix_fanout", """SELECT depth, substring(p, 1, depth) AS prefix, count(DISTINCT substring(p, depth + 1, 1)) AS children, count(*) AS leaves
FROM (SELECT """ + PATH_SQL + """ AS p FROM l), (SELECT CAST(unnest(range(0, 4)) AS INTEGER) AS depth) GROUP BY 1, 2""")  # fmt: skip
def trie_prefix_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.fanout(latest_state(spark, sf_dir), 3)


@query("trie_proofs_ok", f"SELECT {PATH_SQL} AS path, true AS ok FROM l")
def trie_proofs_ok(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.proved(latest_state(spark, sf_dir))


#: Nibbles that tell apart all keys' paths in the SQL below.
TRIE_DEPTH = 12


def trie_sql() -> str:
    """The trie's root, folded from prefixes of TRIE_DEPTH nibbles, one key below each, to none."""
    folds = [f"t{TRIE_DEPTH} AS (SELECT substring(p, 1, {TRIE_DEPTH}) AS p, 'leaf' AS kind, substring(p, {TRIE_DEPTH + 1}) AS path, v AS below FROM (SELECT {PATH_SQL} AS p, {leaf_sql('value')} AS v FROM l))"]
    slots = " || '|' || ".join(f"coalesce(max(h) FILTER (nib = '{n}'), '')" for n in "0123456789abcdef")
    for d in range(TRIE_DEPTH - 1, -1, -1):
        rows = f"SELECT substring(p, 1, {d}) AS p, substring(p, {d + 1}, 1) AS nib, kind, path, below, sha256(kind || '|' || path || '|' || below) AS h FROM t{d + 1}"
        folds.append(f"""t{d} AS (SELECT p, CASE WHEN count(*) > 1 THEN 'branch' WHEN min(kind) = 'branch' THEN 'extension' ELSE min(kind) END AS kind,
CASE WHEN count(*) > 1 THEN '' WHEN min(kind) = 'branch' THEN min(nib) ELSE min(nib) || min(path) END AS path,
CASE WHEN count(*) > 1 THEN {slots} WHEN min(kind) = 'branch' THEN min(h) ELSE min(below) END AS below FROM ({rows}) GROUP BY p)""")
    return ", " + ", ".join(folds) + " SELECT sha256(kind || '|' || path || '|' || below) AS root FROM t0"


@query("trie_root", trie_sql())
def trie_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.root(latest_state(spark, sf_dir))


#: Keys of a page on average, at most.
PAGE_KEYS = 64
PAGES_SQL = f"""(SELECT 0 AS tree, CAST('0x' || page AS BIGINT) AS pos, sha256(page || string_agg(h, '' ORDER BY p)) AS hash, page, count(*) AS n_keys FROM
(SELECT substring({PATH_SQL}, 1, (SELECT min(n) FROM range(1, 12) r(n) WHERE (SELECT count(*) FROM l) <= {PAGE_KEYS} * pow(16, n))::INTEGER) AS page, {PATH_SQL} AS p, {leaf_sql('addr', 'slot', 'value')} AS h FROM l) GROUP BY page)"""


def state_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = latest_state(spark, sf_dir)
    return trie.page_leaves(rows, trie.nibbles_for(rows, PAGE_KEYS))


@query("page_digests", "SELECT page, n_keys, hash FROM " + PAGES_SQL)
def page_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state_pages(spark, sf_dir).select("page", "n_keys", "hash")


@query("page_root", ", pages AS MATERIALIZED (SELECT tree, pos, hash FROM " + PAGES_SQL + ") " + root_sql("SELECT * FROM pages", 16))
def page_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.roots(state_pages(spark, sf_dir), 16)


@query("page_proofs_ok", "SELECT pos, true AS ok FROM " + PAGES_SQL)
def page_proofs_ok(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's proof by the digests beside it on every level."""
    made = merkle.levels(state_pages(spark, sf_dir), 16)
    return merkle.verified(merkle.proofs(made[0], 16, made=made), merkle.roots(made[0], 16, made=made)).select("pos", "ok")


@query("trie_node_kinds", f""", paths AS (SELECT {PATH_SQL} AS p FROM l), pre AS (SELECT depth, substring(p, 1, depth) AS prefix FROM paths, (SELECT unnest(range(2, {TRIE_DEPTH})) AS depth) GROUP BY 1, 2 HAVING count(DISTINCT substring(p, depth + 1, 1)) > 1)
SELECT kind, count(*) AS n FROM (SELECT 'leaf' AS kind FROM l UNION ALL SELECT 'branch' FROM pre UNION ALL SELECT 'extension' FROM pre x WHERE x.depth > 2 AND NOT EXISTS (SELECT 1 FROM pre y WHERE y.depth = x.depth - 1 AND y.prefix = substring(x.prefix, 1, x.depth - 1))) GROUP BY kind""")  # fmt: skip
def trie_node_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many nodes of each kind the shards' tries of the latest state have."""
    return trie.nodes(latest_state(spark, sf_dir), 2).groupBy("kind").agg(F.count("*").alias("n"))


@query("trie_nodes_read", f"SELECT addr, slot, {leaf_sql('value')} AS hash FROM l UNION ALL SELECT DISTINCT addr + 1000000000, slot, NULL FROM l")
def trie_nodes_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie's nodes written as a table, and what all keys and as many others find in them."""
    rows = latest_state(spark, sf_dir)
    nibbles = trie.nibbles_for(rows)
    held = stored(trie.nodes(rows, nibbles), "trie")
    return trie.read(held, rows.select("addr", "slot").unionByName(rows.select((F.col("addr") + 10**9).alias("addr"), "slot")), nibbles)


@query("trie_pruned_nodes")
def trie_pruned_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of four snapshots spread over all blocks, the last at the head, the nodes that only the first two use."""
    c = changes(spark, sf_dir)
    head = head_block(c)
    blocks = sorted({max(1, head * i // 4) for i in range(1, 5)})
    return trie.pruned(trie.node_versions(c, blocks), blocks[len(blocks) // 2])


def kv_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.concat(F.lit("user"), F.col("addr").cast("string"))
    line = F.when(F.col("seq") % 7 == 0, F.lit("# comment")).when(F.col("seq") % 2 == 0, F.concat(F.lit("UPDATE usertable "), key, F.lit(" [ field0="), F.col("value").cast("string"), F.lit(" ]"))).otherwise(F.concat(F.lit("READ usertable "), key, F.lit(" [ ]")))
    return writes(spark, sf_dir).select(line.alias("value"))


KV_SQL = "SELECT CASE WHEN seq % 2 = 0 THEN 'UPDATE' ELSE 'READ' END AS op, 'user' || CAST(addr AS VARCHAR) AS key, CASE WHEN seq % 2 = 0 THEN CAST(value AS VARCHAR) END AS value FROM w WHERE seq % 7 <> 0"


@query("kv_parse", KV_SQL)
def kv_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces.kv_operations(kv_lines(spark, sf_dir))


@query("workload_mix", f"SELECT op, count(*) AS n, count(DISTINCT key) AS keys FROM ({KV_SQL}) GROUP BY op")
def workload_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kv_parse(spark, sf_dir).groupBy("op").agg(F.count("*").alias("n"), F.count_distinct("key").alias("keys"))


@query("transfer_parse", "SELECT 'a' || CAST(addr AS VARCHAR) AS sender, 'b' || slot AS receiver FROM w")
def transfer_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces.transfers(writes(spark, sf_dir).select(F.concat(F.lit("a"), F.col("addr").cast("string"), F.lit(" b"), F.col("slot")).alias("value")))


def drawn_sql(salt: int, most: int) -> str:
    return f"CAST(CAST('0x' || substring(sha256('1|{salt}|' || CAST(id AS VARCHAR)), 1, 15) AS BIGINT) % {most} + 1 AS INTEGER)"


@query("smallbank_trace", f"SELECT CAST(id // 100 + 1 AS BIGINT) AS block, id AS seq, {drawn_sql(1, 6)} AS op, {drawn_sql(2, 49)} AS a, {drawn_sql(3, 49)} AS b, {drawn_sql(4, 99)} AS amount FROM (SELECT unnest(range(0, 1000)) AS id)")
def smallbank_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces.smallbank(spark, 1000, 50, 1)


@query("touch_count", "SELECT account, count(DISTINCT block) AS n FROM (SELECT block, addr AS account FROM w UNION ALL SELECT block, (addr * 7 + 3) % 50 FROM w) GROUP BY account")
def touch_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = writes(spark, sf_dir)
    return contracts.touches(w.select("block", F.col("addr").alias("sender"), ((F.col("addr") * 7 + 3) % 50).alias("receiver")))


@query("touch_count_serial", "SELECT account, count(*) AS n FROM (SELECT block, addr AS account FROM w UNION ALL SELECT block, (addr * 7 + 3) % 50 FROM w) GROUP BY account")
def touch_count_serial(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = writes(spark, sf_dir)
    return contracts.touches(w.select("block", F.col("addr").alias("sender"), ((F.col("addr") * 7 + 3) % 50).alias("receiver")), serial=True)


@query("smallbank_balance", "SELECT addr AS account, coalesce(sum(value) FILTER (WHERE slot = 'click'), 0)::BIGINT AS checking, coalesce(sum(value) FILTER (WHERE slot = 'view'), 0)::BIGINT AS saving, coalesce(sum(value) FILTER (WHERE slot IN ('click', 'view')), 0)::BIGINT AS total FROM w GROUP BY addr")
def smallbank_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("slot") == "click", "checking").when(F.col("slot") == "view", "saving")
    return contracts.balances(writes(spark, sf_dir).select(F.col("addr").alias("account"), kind.alias("kind"), F.col("value").alias("amount")))


@query("smallbank_blocks", "SELECT addr % 8 AS shard, 'checking' AS name, addr AS account, CAST(sum(v) AS VARCHAR) AS value FROM (SELECT addr, block, arg_max(value % 1000, seq) AS v FROM w GROUP BY addr, block) GROUP BY addr")
def smallbank_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = writes(spark, sf_dir)
    return contracts.execute(w.select((F.col("addr") % 8).alias("shard"), "block", "seq", F.lit(contracts.UPDATE_BALANCE).alias("op"), F.col("addr").alias("a"), F.lit(0).alias("b"), (F.col("value") % 1000).alias("amount")))


@query("write_set_merge", "SELECT addr, slot, arg_max(value, seq) AS value FROM w LEFT JOIN (SELECT addr AS ra, max(seq) AS cleared FROM w WHERE slot = 'error' GROUP BY addr) ON addr = ra WHERE slot <> 'error' AND (cleared IS NULL OR seq > cleared) GROUP BY addr, slot")
def write_set_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contracts.write_sets(writes(spark, sf_dir).withColumn("reset", F.col("slot") == "error"))


@query("slot_scan", "SELECT * FROM l WHERE slot BETWEEN 'e' AND 'q'")
def slot_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contracts.scanned(latest_state(spark, sf_dir), F.lit("e"), F.lit("q"), descending=True)


@query("sorted_values", "SELECT addr, string_agg(CAST(value AS VARCHAR), ',' ORDER BY value) AS sorted FROM l GROUP BY addr")
def sorted_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = latest_state(spark, sf_dir).groupBy("addr").agg(F.collect_list("value").alias("v"))
    return rows.select("addr", F.array_join(contracts.sorted_numbers(F.col("v")).cast("array<string>"), ",").alias("sorted"))


@query("contract_addresses", "SELECT addr, slot, substring(sha256(CAST(addr AS VARCHAR) || '|' || CAST(block AS VARCHAR)), 25, 40) AS contract FROM l")
def contract_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest_state(spark, sf_dir).select("addr", "slot", contracts.contract_address(F.col("addr"), F.col("block")).alias("contract"))


@query("uint256_sums", "SELECT addr, slot, printf('%064X', 2 * value) AS doubled, CASE WHEN value > 0 THEN repeat('F', 48) || printf('%016X', -value) ELSE repeat('0', 64) END AS negated FROM l")
def uint256_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = hashing.uint256(F.col("value"))
    return latest_state(spark, sf_dir).select("addr", "slot", F.hex(hashing.uint256_add(v, v)).alias("doubled"), F.hex(hashing.uint256_sub(hashing.uint256(F.lit(0)), v)).alias("negated"))


@query("blake2b_digest")
def blake2b_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest_state(spark, sf_dir).select("addr", "slot", merkle.leaf("addr", "slot", "block", "value", hashed=hashing.blake2b).alias("digest"))


@query("block_metrics", 'SELECT count(*) AS n_blocks, avg(e - s) AS mean, max(e - s) AS longest FROM (SELECT floor(event_id / 100) AS b, epoch_us(min(ts)) AS s, epoch_us(max(ts)) AS e FROM events GROUP BY 1)')
def block_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = events(spark, sf_dir).groupBy(F.floor(F.col("event_id") / BLOCK_SIZE).alias("b")).agg(F.unix_micros(F.min(F.col("ts").cast("timestamp"))).alias("start"), F.unix_micros(F.max(F.col("ts").cast("timestamp"))).alias("end"))
    return metrics.block_latency(ts).select("n_blocks", "mean", "longest")


@query("storage_sampling", "SELECT b.block, (SELECT count(*) FROM c WHERE c.block <= b.block) AS n_changes FROM (SELECT unnest(range(5, 100000, 5)) AS block) b WHERE b.block <= (SELECT max(block) FROM c)")
def storage_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.sampled_storage(changes(spark, sf_dir), 5)


@query("delta_pages", """SELECT addr, slot, block, page, CAST(floor(n / 256) AS BIGINT) AS base, n % 256 AS delta FROM
(SELECT addr, slot, block, page, row_number() OVER (PARTITION BY page ORDER BY block, addr, slot) - 1 AS n FROM (SELECT *, substring(""" + PATH_SQL + """, 1, 2) AS page FROM c))""")  # fmt: skip
def delta_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.delta_pages(changes(spark, sf_dir))


@query("merged_trees_equal_bulk", "SELECT addr, slot, true AS equal FROM c GROUP BY addr, slot HAVING count(*) > 1")
def merged_trees_equal_bulk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return provenance.merge_check(changes(spark, sf_dir), 40).where("n_versions > 1").select("addr", "slot", "equal")


@query("proof_sizes")
def proof_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return provenance.prove(changes(spark, sf_dir), 20, 60).select("addr", "slot", "proof_bytes")


#: Trees with nodes of four members: on each level, the members beside those shown, 40 bytes each, from the key's neighbours of the range up.
@query("proof_sizes_fixed", """, k AS (SELECT addr, slot, count(*) AS n, count(*) FILTER (WHERE block <= 19) AS below, count(*) FILTER (WHERE block <= 60) AS upto FROM c GROUP BY addr, slot),
s AS (SELECT *, greatest(0, below - 1) AS a, least(n, upto + 1) AS b FROM k),
t AS (WITH RECURSIVE up AS (SELECT addr, slot, a, b, n, 40 * (b - a) AS bytes, false AS done FROM s
UNION ALL SELECT addr, slot, a // 4, (b - 1) // 4 + 1, (n + 3) // 4, bytes + 40 * (a - a // 4 * 4 + least(n, ((b - 1) // 4 + 1) * 4) - b), (n + 3) // 4 = 1 FROM up WHERE NOT done) SELECT * FROM up WHERE done)
SELECT addr, slot, CAST(bytes + 2 AS BIGINT) AS proof_bytes FROM t""")
def proof_sizes_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return provenance.prove(changes(spark, sf_dir), 20, 60, "fixed", FANOUT).select("addr", "slot", "proof_bytes")


@query("tree_shape_fixed", "SELECT CAST(height AS INTEGER) AS height, count(*) AS n_keys, min(n) AS least, max(n) AS most FROM (SELECT n, (SELECT min(h) FROM range(1, 20) r(h) WHERE pow(4, h) >= n) AS height FROM (SELECT count(*) AS n FROM c GROUP BY addr, slot)) GROUP BY 1")
def tree_shape_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    roots = provenance.version_roots(changes(spark, sf_dir), "fixed", FANOUT)
    return roots.groupBy("height").agg(F.count("*").alias("n_keys"), F.min("n_versions").alias("least"), F.max("n_versions").alias("most"))


@query("tree_shape")
def tree_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    roots = provenance.version_roots(changes(spark, sf_dir))
    return roots.groupBy("height").agg(F.count("*").alias("n_keys"), F.min("n_versions").alias("least"), F.max("n_versions").alias("most"))


#: One filter of each flush: its bits by the number of rows and the error rate of the first slice, in bytes.
@query("filter_memory", "SELECT CAST(sum(greatest(64, CAST(ceil(-greatest(64, n) * ln(0.1 * (1 - 0.85)) / ln(2) ** 2) AS BIGINT)) // 8 + 1) AS BIGINT) AS bytes FROM (SELECT count(*) AS n FROM f GROUP BY flush)")
def filter_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lsm.with_flush(changes(spark, sf_dir), CAPACITY)
    return metrics.memory(bloom.filters(rows, "flush", F.concat_ws("|", F.col("addr").cast("string"), "slot")))


@query("streamed_latest", "SELECT * FROM l")
def streamed_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest state of changes that came in as a stream, block by block."""
    path = f"{folder(spark)}/stream-{uuid.uuid4().hex}"
    kinds = events(spark, sf_dir).schema
    source = spark.readStream.schema(kinds).parquet(f"{sf_dir}/events.parque[t]")
    rows = source.select(F.col("user_id").alias("addr"), F.col("event_type").alias("slot"), (F.floor(F.col("event_id") / BLOCK_SIZE) + 1).alias("block"), F.col("event_id").alias("seq"), F.round(F.col("value") * 100).cast("long").alias("value"))
    streams.append_blocks(rows, f"{path}/rows", f"{path}/checkpoint").awaitTermination()
    return state.latest(spark.read.parquet(f"{path}/rows").drop("batch"))


@query("merged_runs", f"SELECT CAST(level AS BIGINT) AS level, run, addr, slot, max(block) AS block, arg_max(value, block) AS value, {VERSIONS_SQL} AS versions FROM r GROUP BY level, run, addr, slot")
def merged_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each run of each level, merged from all its flushes; what is not flushed yet is run -1 of level -1."""
    rows = rows_in_runs(spark, sf_dir).withColumns({"level": F.col("level").cast("long"), "run": F.col("run").cast("long")})
    return lsm.merged_each(rows, ["level", "run"]).withColumn("versions", joined_versions(F.col("versions")))


WINDOWS = [2, 4, 8, 16, 32, 64, 128]
HEAD_SQL = "(SELECT max(block) FROM c)"


@query("window_sweep", f"SELECT CAST(s AS INTEGER) AS \"window\", count(DISTINCT CAST(addr AS VARCHAR) || '|' || slot) AS n_keys, count(*) AS n_versions FROM c, (SELECT unnest({WINDOWS}) AS s) WHERE block > {HEAD_SQL} - s GROUP BY 1")
def window_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of all sizes of the reference that end at the table's head."""
    c = changes(spark, sf_dir)
    return metrics.window_versions(c, c.select("addr", "slot").distinct(), head_block(c), WINDOWS)


@query("dense_provenance", f"SELECT k.addr, k.slot, b.block, (SELECT arg_max(value, c.block) FROM c WHERE c.addr = k.addr AND c.slot = k.slot AND c.block <= b.block) AS value FROM (SELECT DISTINCT addr, slot FROM c) k, (SELECT DISTINCT block FROM c WHERE block > {HEAD_SQL} - {WINDOWS[-1]}) b")
def dense_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All keys at each block of the longest window that ends at the head; a key's value may be from any earlier block."""
    c = changes(spark, sf_dir)
    head = head_block(c)
    return state.dense(c, max(1, head - WINDOWS[-1] + 1), head)


@query("dense_proofs", f"SELECT k.addr, k.slot, b.block, CAST((SELECT arg_max(value, c.block) FROM c WHERE c.addr = k.addr AND c.slot = k.slot AND c.block <= b.block) AS VARCHAR) AS value, true AS ok FROM (SELECT DISTINCT addr, slot FROM c) k, (SELECT DISTINCT block FROM c WHERE block > {HEAD_SQL} - {WINDOWS[-1]}) b")
def dense_proofs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dense_provenance, each value as its proof shows it."""
    c = changes(spark, sf_dir)
    head = head_block(c)
    return provenance.dense_shown(provenance.dense_prove(c, max(1, head - WINDOWS[-1] + 1), head))


def level_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs of all levels as a checkpoint."""
    return reorg.checkpoint(run_block_ranges(spark, sf_dir), 0)


SAVED_SQL = ", s AS (SELECT CAST(level AS BIGINT) AS level, run, min(block) AS lo, max(block) AS hi FROM r GROUP BY level, run)"


@query("rewind_plan", SAVED_SQL + """, x AS (SELECT flush, min(block) AS lo, max(block) AS hi FROM f GROUP BY flush)
SELECT s.level, s.run, s.lo AS block_lo, s.hi AS block_hi, CASE WHEN bool_or(x.lo = s.lo AND x.hi = s.hi) THEN 'keep' ELSE 'rebuild' END AS action,
CASE WHEN bool_or(x.lo = s.lo AND x.hi = s.hi) THEN 1 ELSE count(x.lo) END AS n_sources FROM s LEFT JOIN x ON x.lo <= s.hi AND x.hi >= s.lo GROUP BY s.level, s.run, s.lo, s.hi""")  # fmt: skip
def rewind_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From all flushes back to the runs of all levels."""
    rows = lsm.with_flush(changes(spark, sf_dir), CAPACITY).withColumn("level", F.lit(0).cast("long"))
    return reorg.plan(lsm.runs(rows.withColumn("run", F.col("flush"))), level_runs(spark, sf_dir))


@query("rebuilt_rows", SAVED_SQL + " SELECT s.level AS to_level, s.run AS to_run, addr, slot, block, value FROM c JOIN s ON c.block BETWEEN s.lo AND s.hi")
def rebuilt_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of each run of all levels."""
    return reorg.rebuilt(changes(spark, sf_dir), level_runs(spark, sf_dir)).select("to_level", "to_run", "addr", "slot", "block", "value")


@query("sampled_keys", f"SELECT DISTINCT addr, slot FROM l QUALIFY row_number() OVER (ORDER BY sha256('1|' || {PATH_SQL})) <= 200")
def sampled_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.sample_keys(changes(spark, sf_dir), 200, 1)


@query("compacted_runs", """, c0 AS (SELECT *, CASE WHEN level = 0 THEN 1 ELSE level END AS l1, CASE WHEN level = 0 THEN coalesce((SELECT max(run) + 1 FROM r WHERE level = 1), 0) ELSE run END AS r1 FROM r),
c1 AS (SELECT *, CASE WHEN l1 = 1 THEN 2 ELSE l1 END AS l2, CASE WHEN l1 = 1 THEN coalesce((SELECT max(r1) + 1 FROM c0 WHERE l1 = 2), 0) ELSE r1 END AS r2 FROM c0)
SELECT CAST(l2 AS BIGINT) AS level, CAST(r2 AS BIGINT) AS run, count(*) AS n_rows, count(DISTINCT CAST(addr AS VARCHAR) || '|' || slot) AS n_keys, min(block) AS block_lo, max(block) AS block_hi FROM c1 GROUP BY 1, 2""")  # fmt: skip
def compacted_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs after the first two levels were merged downwards, whether full or not."""
    rows = lsm.compacted(lsm.compacted(rows_in_runs(spark, sf_dir), 0), 1)
    merged = lsm.merged_each(rows.withColumns({"level": F.col("level").cast("long"), "run": F.col("run").cast("long")}), ["level", "run"])
    return merged.groupBy("level", "run").agg(F.sum(F.size("versions")).alias("n_rows"), F.count("*").alias("n_keys"), F.min(F.col("versions")[0]["block"]).alias("block_lo"), F.max("block").alias("block_hi"))


AGES_SQL = ", g AS (SELECT level, run, row_number() OVER (ORDER BY level, run DESC) AS age FROM (SELECT DISTINCT level, run FROM r)), a AS (SELECT r.*, age FROM r JOIN g USING (level, run))"


@query("read_amplification", AGES_SQL + " SELECT addr, slot, min(age) AS probed FROM a GROUP BY addr, slot")
def read_amplification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs that a search for each key visits without filters."""
    return lsm.runs_visited(rows_in_runs(spark, sf_dir))


def probed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lookups of all keys, and of as many that are not there."""
    rows = rows_in_runs(spark, sf_dir)
    parted = stored(lookup.dealt(rows), "pages")
    keys = rows.select("addr", "slot").distinct()
    return lookup.lookup(parted, stored(lookup.index(parted, BLOOM_ERROR, EPSILON), "index"), keys.unionByName(keys.withColumn("addr", F.col("addr") + 10**9)))


@query("run_lookup", AGES_SQL + """ SELECT addr, slot, CAST(arg_min(level, age * 1000000000 - block) AS BIGINT) AS level, arg_min(run, age * 1000000000 - block) AS run, arg_min(block, age * 1000000000 - block) AS block,
arg_min(value, age * 1000000000 - block) AS value FROM a GROUP BY addr, slot UNION ALL SELECT DISTINCT addr + 1000000000, slot, NULL, NULL, NULL, NULL FROM c""")  # fmt: skip
def run_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest row of each key by filters, models and pages; null for keys that are not there."""
    return probed(spark, sf_dir).select("addr", "slot", F.col("level").cast("long").alias("level"), F.col("run").cast("long").alias("run"), "block", "value")


@query("filter_savings", AGES_SQL + " SELECT count(*) AS n_keys, sum(age) AS visited, true AS saves, true AS few_wasted FROM (SELECT addr, slot, min(age) AS age FROM a GROUP BY addr, slot)")
def filter_savings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many runs all lookups of keys visit without filters; with them they search fewer, and of the runs without the key not more than twice the error rate."""
    kept = probed(spark, sf_dir).where("block is not null").join(read_amplification(spark, sf_dir), ["addr", "slot"])
    sums = kept.agg(F.count("*").alias("n_keys"), F.sum("probed").alias("visited"), F.sum("searched").alias("searched"), F.sum("wasted").alias("wasted"))
    return sums.select("n_keys", "visited", (F.col("searched") < F.col("visited")).alias("saves"), (F.col("wasted") <= 2 * BLOOM_ERROR * (F.col("visited") - F.col("n_keys"))).alias("few_wasted"))


def new_store(spark: SparkSession) -> Store:
    return Store(spark, f"{folder(spark)}/store-{uuid.uuid4().hex}", CAPACITY, RATIO)


def appended_store(spark: SparkSession, sf_dir: str, parts: int = 4) -> tuple[Store, int]:
    """A store that took all blocks in some appends, and the last block."""
    store, c = new_store(spark), changes(spark, sf_dir)
    head = head_block(c)
    for i in range(parts):
        store.append(c.where((F.col("block") > head * i // parts) & (F.col("block") <= head * (i + 1) // parts)))
    return store, head


@query("store_round_trip", "SELECT * FROM c")
def store_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All changes, read back from a store that was written by appends."""
    return appended_store(spark, sf_dir)[0].changes()


@query("store_runs", "SELECT CAST(level AS BIGINT) AS level, count(DISTINCT run) AS n_runs, count(*) AS n_rows, min(block) AS block_lo, max(block) AS block_hi FROM r GROUP BY level")
def store_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The levels that compaction made of the appended flushes."""
    runs = appended_store(spark, sf_dir)[0].runs()
    return runs.groupBy(F.col("level").cast("long").alias("level")).agg(F.count("*").alias("n_runs"), F.sum("n_rows").alias("n_rows"), F.min("block_lo").alias("block_lo"), F.max("block_hi").alias("block_hi"))


@query("store_rewind", f"SELECT addr, slot, max(block) AS block, arg_max(value, block) AS value FROM c WHERE block <= {HEAD_SQL} * 3 // 5 GROUP BY addr, slot")
def store_rewind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest state after a rewind to three fifths of the blocks: from the checkpoint of the second append and the runs of the third."""
    store, head = appended_store(spark, sf_dir)
    store.rewind(head * 3 // 5)
    return state.latest(store.changes())


@query("latest_layout", "SELECT * FROM l")
def latest_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest state from the table that the store keeps beside its history."""
    return appended_store(spark, sf_dir)[0].write_latest()


@query("storage_breakdown")
def storage_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files and bytes of a store by what they hold."""
    store, _ = appended_store(spark, sf_dir, 2)
    store.index()
    data = store.files().where(F.col("name").endswith(".parquet") | F.col("name").endswith(".json"))
    kinds = {"v-": "state", "index-": "filters and models", "manifest": "manifests"}
    return metrics.storage_by_kind(data.select(F.col("path").alias("name"), "bytes"), kinds)


@query("lower_bound", "SELECT p.addr, p.slot, least((SELECT count(*) FROM l WHERE (l.addr, l.slot) < (p.addr, p.slot)), (SELECT count(*) - 1 FROM l)) AS pos FROM (SELECT DISTINCT addr * 2 AS addr, 'm' AS slot FROM l) p")
def lower_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = changes(spark, sf_dir)
    return state.lower_bounds(c, c.select((F.col("addr") * 2).alias("addr"), F.lit("m").alias("slot")))


@query("rightmost_key", "SELECT * FROM l ORDER BY addr DESC, slot DESC LIMIT 1")
def rightmost_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.rightmost(changes(spark, sf_dir))


@query("version_count", "SELECT n_versions, count(*) AS n_keys FROM (SELECT count(*) AS n_versions FROM c GROUP BY addr, slot) GROUP BY n_versions")
def version_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes(spark, sf_dir).groupBy("addr", "slot").agg(F.count("*").alias("n_versions")).groupBy("n_versions").agg(F.count("*").alias("n_keys"))


@query("state_except", f"SELECT addr, slot, value FROM l EXCEPT ALL SELECT addr, slot, arg_max(value, block) FROM c WHERE block <= {HEAD_SQL} // 2 GROUP BY addr, slot")
def state_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the latest state has that the state at half of the blocks had not."""
    c = changes(spark, sf_dir)
    columns = ["addr", "slot", "value"]
    return state.latest(c).select(columns).exceptAll(state.as_of(c, head_block(c) // 2).select(columns))


@query("above_average", "SELECT * FROM l WHERE value > (SELECT avg(value) FROM l x WHERE x.slot = l.slot)")
def above_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys above the average of their slot, by a correlated subquery over a view."""
    latest_state(spark, sf_dir).createOrReplaceTempView("stratum_latest")
    return spark.sql("SELECT * FROM stratum_latest l WHERE value > (SELECT avg(value) FROM stratum_latest x WHERE x.slot = l.slot)")


@query("provenance_averages", f"SELECT CAST(s AS INTEGER) AS \"window\", count(*) AS n_proofs, avg(n) AS mean_versions, true AS ok FROM (SELECT s, addr, slot, count(*) FILTER (WHERE block > {HEAD_SQL} - s) AS n FROM c, (SELECT unnest({WINDOWS}) AS s) GROUP BY s, addr, slot) GROUP BY s")
def provenance_averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For windows that end at the head, all keys' proofs: how many versions one shows on average."""
    c = changes(spark, sf_dir)
    proofs = provenance.window_proofs(c, head_block(c), WINDOWS)
    means = metrics.window_proofs(proofs, spark.createDataFrame([(w,) for w in WINDOWS], "window int"))
    return means.join(proofs.groupBy("window").agg(F.min("ok").alias("ok")), "window").select("window", "n_proofs", "mean_versions", "ok")


@query("shown_versions", "SELECT addr, slot, block, CAST(value AS VARCHAR) AS value FROM c WHERE block BETWEEN 20 AND 60")
def shown_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The versions that proofs show once they hold."""
    return provenance.shown(provenance.prove(changes(spark, sf_dir), 20, 60), 20, 60)


def bank(spark: SparkSession, sf_dir: str, op: int) -> DataFrame:
    """Deposits of a billion into both balances of each account in block 0, then an operation for each write; its partner is in the shard of the account."""
    w = writes(spark, sf_dir)
    accounts = w.select("addr").distinct()
    columns = [(F.col("addr") % 8).alias("shard"), F.col("addr").alias("a")]
    rest = lambda block, seq, op, b, amount: [F.lit(block).cast("long").alias("block") if isinstance(block, int) else block, seq.cast("long").alias("seq"), F.lit(op).alias("op"), b.cast("long").alias("b"), amount.cast("long").alias("amount")]
    deposit = lambda kind: accounts.select(*columns, *rest(0, F.lit(kind), kind, F.lit(0), F.lit(10**9)))
    return deposit(contracts.UPDATE_BALANCE).unionByName(deposit(contracts.UPDATE_SAVING)).unionByName(w.select(*columns, *rest(F.col("block"), F.col("seq"), op, F.col("addr") + 8 * (1 + F.col("seq") % 5), F.col("value") % 1000)))


#: Of several writes of an account in a block, the last counts; both sides of an operation have its number.
LAST_SQL = "SELECT account, sum(d) AS d FROM (SELECT account, block, arg_max(d, seq) AS d FROM ({}) GROUP BY account, block) GROUP BY account"
BOTH_SQL = "SELECT addr AS account, block, seq, -(value % 1000) AS d FROM w UNION ALL SELECT addr + 8 * (1 + seq % 5), block, seq, value % 1000 FROM w"
SAVED_BANK_SQL = "SELECT addr % 8 AS shard, 'saving' AS name, addr AS account, '1000000000' AS value FROM (SELECT DISTINCT addr FROM w)"
CHECKING_SQL = "SELECT account % 8 AS shard, 'checking' AS name, account, CAST(CAST(coalesce(m.d, 0) + CASE WHEN o.addr IS NULL THEN 0 ELSE 1000000000 END AS BIGINT) AS VARCHAR) AS value FROM ({}) m FULL JOIN (SELECT DISTINCT addr FROM w) o ON o.addr = m.account"


@query("smallbank_payments", CHECKING_SQL.format(LAST_SQL.format(BOTH_SQL)) + " UNION ALL " + SAVED_BANK_SQL)
def smallbank_payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payments between accounts; those that never had a deposit begin at 0."""
    return contracts.execute(bank(spark, sf_dir, contracts.SEND_PAYMENT))


@query("smallbank_checks", CHECKING_SQL.format(LAST_SQL.format("SELECT addr AS account, block, seq, -(value % 1000) - 1 AS d FROM w")) + " UNION ALL " + SAVED_BANK_SQL)
def smallbank_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks, each with a fee of 1, as every account has more than it draws."""
    return contracts.execute(bank(spark, sf_dir, contracts.WRITE_CHECK))


@query("smallbank_savings", "SELECT addr % 8 AS shard, 'saving' AS name, addr AS account, CAST(CAST(sum(v) + 1000000000 AS BIGINT) AS VARCHAR) AS value FROM (SELECT addr, block, arg_max(value % 1000, seq) AS v FROM w GROUP BY addr, block) GROUP BY addr UNION ALL " + SAVED_BANK_SQL.replace("saving", "checking"))
def smallbank_savings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contracts.execute(bank(spark, sf_dir, contracts.UPDATE_SAVING))


@query("smallbank_merges", "SELECT addr % 8 AS shard, name, addr AS account, value FROM (SELECT DISTINCT addr FROM w), (VALUES ('checking', '0'), ('saving', '2000000000')) v(name, value)")
def smallbank_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each account's checking balance goes to its saving balance, over and over: only the first time moves anything."""
    rows = bank(spark, sf_dir, contracts.ALMAGATE)
    return contracts.execute(rows.withColumn("b", F.col("a")))


@query("transfer_balances", "SELECT account % 8 AS shard, account, CAST(CAST(coalesce(m.d, 0) + CASE WHEN o.addr IS NULL THEN 0 ELSE 1000000000 END AS BIGINT) AS VARCHAR) AS value FROM (" + LAST_SQL.format("SELECT x.* FROM (" + BOTH_SQL + ") x") + ") m FULL JOIN (SELECT DISTINCT addr FROM w) o ON o.addr = m.account WHERE account IN (SELECT DISTINCT addr FROM w) OR m.d IS NOT NULL")
def transfer_balances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The transfer contract: a deposit for each account, then transfers, which are all covered."""
    rows = bank(spark, sf_dir, 2)
    deposits = rows.where("block = 0 and op = 3").withColumn("op", F.lit(1))
    return contracts.deposit_transfers(deposits.unionByName(rows.where("block > 0")))


@query("doc_chunk_dedup", r"""SELECT digest, count(*) AS copies, count(DISTINCT doc_id) AS docs, max(words) AS words FROM (SELECT doc_id, chunk, sha256(string_agg(word, ' ' ORDER BY i)) AS digest, count(*) AS words FROM
(SELECT doc_id, i, word, coalesce(sum(CASE WHEN substring(sha256(word), 1, 1) = '0' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS chunk FROM
(SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM (SELECT doc_id, list_filter(string_split(coalesce(text, ''), ' '), lambda x: x <> '') AS w FROM documents))) GROUP BY doc_id, chunk) GROUP BY digest""")  # fmt: skip
def doc_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents cut where a word's digest says so: how often each chunk occurs. Equal passages give equal chunks, wherever they stand."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.posexplode(F.array_remove(F.split(F.coalesce("text", F.lit("")), " "), "")).alias("i", "word"))
    cut = (F.substring(merkle.sha256(F.col("word")), 1, 1) == "0").cast("long")
    before = F.sum(cut).over(Window.partitionBy("doc_id").orderBy("i").rowsBetween(Window.unboundedPreceding, -1))
    placed = docs.withColumn("chunk", F.coalesce(before, F.lit(0)))
    chunks = placed.groupBy("doc_id", "chunk").agg(F.array_sort(F.collect_list(F.struct("i", "word"))).alias("w"))
    digests = chunks.select("doc_id", F.size("w").cast("long").alias("words"), merkle.sha256(F.array_join(F.transform("w", lambda x: x["word"]), " ")).alias("digest"))
    return digests.groupBy("digest").agg(F.count("*").alias("copies"), F.count_distinct("doc_id").alias("docs"), F.max("words").alias("words"))


@query("streamed_windows", "SELECT CAST(floor(event_id * 60 / 3600) * 3600 AS BIGINT) AS start, count(*) AS n_writes FROM events GROUP BY 1")
def streamed_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes for each hour of a stream in which an event takes a minute."""
    source = spark.readStream.schema(events(spark, sf_dir).schema).parquet(f"{sf_dir}/events.parque[t]")
    rows = source.select(F.col("user_id").alias("addr"), F.col("event_type").alias("slot"), F.timestamp_seconds(F.col("event_id") * 60).alias("time"))
    name = f"windows_{uuid.uuid4().hex}"
    path = f"{folder(spark)}/{name}"
    counts = streams.block_counts(rows, "time", "1 hour", "1 hour")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows")

    counts.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/rows").select(F.unix_seconds("start").alias("start"), "n_writes")


@query("run_proofs_ok", "SELECT k.addr, k.slot, CAST(g.level AS BIGINT) AS level, g.run, true AS ok, count(x.block) AS n_found FROM (SELECT DISTINCT addr, slot FROM c UNION ALL SELECT DISTINCT addr + 1000000000, slot FROM c) k CROSS JOIN (SELECT DISTINCT level, run FROM r) g LEFT JOIN (SELECT * FROM r WHERE block BETWEEN 20 AND 60) x ON x.addr = k.addr AND x.slot = k.slot AND x.level = g.level AND x.run = g.run GROUP BY 1, 2, 3, 4")
def run_proofs_ok(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each run, proofs of what it holds of all keys, and of as many that it does not have."""
    rows = rows_in_runs(spark, sf_dir)
    keys = rows.select("addr", "slot").distinct()
    runs = run_proofs.Runs(rows, FANOUT, BLOOM_ERROR)
    proofs = runs.prove(keys.unionByName(keys.withColumn("addr", F.col("addr") + 10**9)), 20, 60, shared=True)
    return run_proofs.Runs.verify(proofs, runs.digests(), 20, 60, FANOUT, runs.index).withColumn("level", F.col("level").cast("long"))


@query("kv_reads", "SELECT seq, key, found AS value FROM (SELECT seq, op, key, last_value(value IGNORE NULLS) OVER (PARTITION BY key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS found FROM (SELECT seq, CASE WHEN seq % 2 = 0 THEN 'UPDATE' ELSE 'READ' END AS op, 'user' || CAST(addr AS VARCHAR) AS key, CASE WHEN seq % 2 = 0 THEN CAST(value AS VARCHAR) END AS value FROM w)) WHERE op = 'READ'")
def kv_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the reads of a key-value workload find."""
    w, key = writes(spark, sf_dir), F.concat(F.lit("user"), F.col("addr").cast("string"))
    write = F.col("seq") % 2 == 0
    return contracts.kv_results(w.select("seq", F.when(write, "UPDATE").otherwise("READ").alias("op"), key.alias("key"), F.when(write, F.col("value").cast("string")).alias("value")))


@query("stored_numbers", "SELECT addr AS contract, arg_max(value, seq) AS value FROM w GROUP BY addr")
def stored_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contracts.stored_numbers(writes(spark, sf_dir).select(F.col("addr").alias("contract"), "seq", "value"))
