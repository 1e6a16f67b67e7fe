"""The engine's interface: a ledger over a table of changes."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratum.operators import lookup, lsm, merkle, provenance, reorg, state, trie
from stratum.plans.scratch import stored
from stratum.schema import KEY
from stratum.sources.store import Store


class Ledger:
    """Reads, proofs and rewinds of changes (addr, slot, block, value). Everything returns DataFrames. Plans that rank rows or build trees (digest, index_size) write intermediate tables when they are made; all else runs when its result does.

    Accounts' nonces and code are slots like others, by name.
    """

    NONCE, CODE = "nonce", "code"

    def __init__(self, changes: DataFrame, fanout: int = 4, cut: str = "gear") -> None:
        self.changes, self.fanout, self.cut = changes, fanout, cut
        #: The first block of which the history is whole, if the ledger was pruned; None if it has no history.
        self.horizon: int | None = 0

    def _whole_from(self, block: int) -> None:
        if self.horizon is None or block < self.horizon:
            raise ValueError(f"the history of block {block} was pruned")

    # Writes give a new ledger.
    def batch_write(self, writes: DataFrame, block: int) -> Ledger:
        """The ledger with a block's writes (addr, slot, seq, value); the last of a key counts."""
        new = state.block_writes(writes.withColumn("block", F.lit(block).cast("long")))
        return type(self)(self.changes.unionByName(new.select(self.changes.columns)), self.fanout, self.cut)

    def single_write(self, addr, slot, value, block: int) -> Ledger:  # noqa: ANN001
        kinds = {f.name: f.dataType for f in self.changes.schema}
        row = self.changes.sparkSession.range(1).select(F.lit(addr).cast(kinds["addr"]).alias("addr"), F.lit(slot).cast(kinds["slot"]).alias("slot"), F.lit(value).cast(kinds["value"]).alias("value"), F.lit(0).alias("seq"))
        return self.batch_write(row, block)

    # Reads.
    def latest(self) -> DataFrame:
        return state.latest(self.changes)

    def as_of(self, block: int) -> DataFrame:
        self._whole_from(block)
        return state.as_of(self.changes, block)

    def values(self, keys: DataFrame, default: Column) -> DataFrame:
        return state.values_of(keys, self.changes, default)

    def accounts(self, slot: str, default: Column) -> DataFrame:
        """A slot of all addresses, such as NONCE or CODE."""
        addresses = self.changes.select("addr").distinct().withColumn("slot", F.lit(slot))
        return state.values_of(addresses, self.changes.where(F.col("slot") == slot), default)

    def provenance(self, low: int, high: int) -> DataFrame:
        self._whole_from(low)
        return state.provenance(self.changes, low, high)

    def dense(self, low: int, high: int) -> DataFrame:
        return state.dense(self.changes, low, high)

    # Digests and proofs.
    def roots(self) -> DataFrame:
        return provenance.version_roots(self.changes, self.cut, self.fanout)

    def digest(self) -> DataFrame:
        """One row: the root over all keys' version roots."""
        return merkle.roots(provenance.key_leaves(self.roots()).drop(*KEY), self.fanout)

    def prove(self, low: int, high: int) -> DataFrame:
        self._whole_from(low)
        return provenance.prove(self.changes, low, high, self.cut, self.fanout)

    def verify(self, proofs: DataFrame, low: int, high: int) -> DataFrame:
        return provenance.verify(proofs, self.roots(), low, high)

    def prove_dense(self, low: int, high: int) -> DataFrame:
        """Proofs of the value of each key at each block, for dense_shown()."""
        self._whole_from(low)
        return provenance.dense_prove(self.changes, low, high, self.cut, self.fanout)

    # Going back, and the shape on disk.
    def rewind(self, blocks: int) -> Ledger:
        return type(self)(reorg.rewound(self.changes, blocks), self.fanout, self.cut)

    def pruned(self, block: int | None = None) -> Ledger:
        """Without history: the latest versions only, or those from a block on and what held at it. Reads and proofs of what was dropped raise an error."""
        kept = state.prune_to_latest(self.changes) if block is None else state.prune_before(self.changes, block)
        out = type(self)(kept.select(self.changes.columns), self.fanout, self.cut)
        out.horizon = block
        return out

    def index_size(self, capacity: int, ratio: int) -> DataFrame:
        return lsm.runs(lsm.with_runs(self.changes, capacity, ratio))

    def memory_cost(self, capacity: int, ratio: int) -> DataFrame:
        """One row: the bytes of all runs' filters and models."""
        built = lookup.index(lookup.dealt(lsm.with_runs(self.changes, capacity, ratio)))
        return built.agg(F.coalesce(F.sum(F.octet_length("filter")), F.lit(0)).alias("filters"), F.coalesce(F.sum(F.octet_length("model")), F.lit(0)).alias("models"))

    def commit(self, store: Store) -> dict:
        """Writes the ledger to a store in place of what it held; the commit's manifest."""
        return store.commit(self.changes)

    @classmethod
    def opened(cls, store: Store) -> Ledger:
        """The ledger that a store holds."""
        return cls(store.changes())


class TrieLedger(Ledger):
    """A ledger whose digest is that of a Patricia trie over the latest state, and whose proofs are paths in it."""

    def digest(self) -> DataFrame:
        return trie.root(self.latest())

    def prove(self, low: int, high: int) -> DataFrame:
        """For each key, its path and whether the trie of the state at high proves its value. A trie holds one version, so low does not count."""
        return trie.proved(self.as_of(high))

    def verify(self, proofs: DataFrame, low: int, high: int) -> DataFrame:
        return proofs


class DeltaLedger(Ledger):
    """A ledger in pages of a trie that keep their updates as deltas: a read takes a page's base and the deltas up to the block."""

    def pages(self) -> DataFrame:
        return trie.delta_pages(self.changes)

    def digest(self) -> DataFrame:
        """One row: the root over the pages of the latest state."""
        state = self.latest()
        return merkle.roots(trie.page_leaves(state, trie.nibbles_for(state, 64)), 16)

    def index_size(self, capacity: int, ratio: int) -> DataFrame:
        """Pages in place of runs: the updates, full pages and deltas of each."""
        return self.pages().groupBy("page").agg(F.count("*").alias("n_rows"), F.count_distinct("base").alias("bases"), F.min("block").alias("block_lo"), F.max("block").alias("block_hi"))


class LatestLedger(Ledger):
    """A ledger that keeps the latest state as a table of its own beside the history, for reads that want no older version."""

    def __init__(self, changes: DataFrame, fanout: int = 4, cut: str = "gear") -> None:
        super().__init__(changes, fanout, cut)
        self._latest: DataFrame | None = None

    def latest(self) -> DataFrame:
        if self._latest is None:
            self._latest = stored(state.latest(self.changes), "latest")
        return self._latest


class MemoryLedger(Ledger):
    """A ledger in a dictionary of the driver, to test others against. Only for changes that fit there."""

    def __init__(self, changes: DataFrame, fanout: int = 4, cut: str = "gear") -> None:
        super().__init__(changes, fanout, cut)
        self.versions: dict[tuple, dict[int, object]] = {}
        for r in changes.select(*KEY, "block", "value").collect():
            self.versions.setdefault((r[0], r[1]), {})[r[2]] = r[3]

    def _table(self, rows: list[tuple], columns: list[str]) -> DataFrame:
        return self.changes.sparkSession.createDataFrame(rows, self.changes.select(columns).schema)

    def latest(self) -> DataFrame:
        return self.as_of(1 << 62)

    def as_of(self, block: int) -> DataFrame:
        held = [(*k, max(b for b in v if b <= block), v) for k, v in self.versions.items() if min(v) <= block]
        return self._table([(a, s, b, v[b]) for a, s, b, v in held], [*KEY, "block", "value"])

    def provenance(self, low: int, high: int) -> DataFrame:
        return self._table([(*k, b, x) for k, v in self.versions.items() for b, x in v.items() if low <= b <= high], [*KEY, "block", "value"])


#: Ledgers by name: the same reads, with other trees, digests or layouts.
BACKENDS = {
    "gear": Ledger,
    "polynomial": partial(Ledger, cut="polynomial"),
    "fixed": partial(Ledger, cut="fixed"),
    "trie": TrieLedger,
    "delta": DeltaLedger,
    "latest": LatestLedger,
    "memory": MemoryLedger,
}
