"""A ledger on disk: changes by level and run, a buffer of those not flushed yet, and manifests, as Parquet and JSON.

A commit writes new folders beside the old ones and then the manifest that names them, so a reader sees one version
or the other, and a job that is lost half-way leaves the last commit as it was. A manifest's name is its version
and is claimed exclusively: of two writers one fails. Appending writes the buffer and the runs that become new; all
other runs stay where they are. Manifests are the checkpoints that a store can go back to.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratum.operators import lookup, lsm
from stratum.operators.state import latest


class Store:
    def __init__(self, spark: SparkSession, path: str, capacity: int = 10_000, ratio: int = 10, checkpoint_every: int = 0) -> None:
        """checkpoint_every: each so many versions, one stays when old ones are dropped; with 0, none does."""
        self.spark, self.path, self.capacity, self.ratio, self.checkpoint_every = spark, path.rstrip("/"), capacity, ratio, checkpoint_every

    def _hadoop(self, name: str) -> tuple:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _manifests(self) -> DataFrame | None:
        fs, path = self._hadoop("manifest")
        return self.spark.read.text(f"{self.path}/manifest") if fs.exists(path) else None

    def manifests(self) -> list[dict]:
        """All commits that are kept, in order."""
        every = self._manifests()
        return sorted((json.loads(r[0]) for r in every.collect()), key=lambda m: m["version"]) if every is not None else []

    def manifest(self) -> dict | None:
        """The last commit: version, latest_block, capacity, ratio, overlaps, since, rewinds, and runs: folder, level, run, n_rows, block_lo and block_hi of each; the buffer has level -1.

        Commits from version since on hold all that the store has up to their latest block, but for those that a
        rewind (version, block) after them left behind.
        """
        every = self.manifests()
        return every[-1] if every else None

    def checkpoints(self) -> DataFrame:
        """(version, latest_block, level, run, block_lo, block_hi) of the runs of all commits that are kept."""
        rows = [(m["version"], m["latest_block"], r["level"], r["run"], r["block_lo"], r["block_hi"]) for m in self.manifests() for r in m["runs"]]
        return self.spark.createDataFrame(rows, "version long, latest_block long, level int, run long, block_lo long, block_hi long")

    def _claimed(self, runs: list[dict], overlaps: bool, since: int | None = None, rewound: int | None = None) -> dict:
        last = self.manifest()
        heads = [r["block_hi"] for r in runs if r["block_hi"] is not None]
        version = last["version"] + 1 if last else 1
        rewinds = last.get("rewinds", []) if last and since is not None else []
        if rewound is not None:
            rewinds = [r for r in rewinds if r[1] < rewound] + [[version, rewound]]
        entry = {"version": version, "latest_block": max(heads, default=None), "capacity": self.capacity, "ratio": self.ratio, "overlaps": overlaps, "since": version if since is None else since, "rewinds": rewinds, "runs": runs}
        fs, path = self._hadoop(f"manifest/{entry['version']:012d}.json")
        out = fs.create(path, False)  # fails if another writer has claimed the version
        out.write(bytearray(json.dumps(entry).encode()))
        out.close()
        return entry

    def _written(self, rows: DataFrame) -> list[dict]:
        """Writes rows (addr, slot, block, value, level, run), a folder for each run in key order; the runs written. Runs are few: levels times ratio."""
        folder = f"v-{uuid.uuid4().hex}"
        rows.repartition("level", "run", F.pmod(F.xxhash64("addr"), F.lit(64))).sortWithinPartitions("level", "run", "addr", "slot", "block").write.partitionBy("level", "run").parquet(f"{self.path}/{folder}")
        fs, path = self._hadoop(folder)
        if not fs.globStatus(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}/level=*")):
            return []
        found = lsm.runs(self.spark.read.parquet(f"{self.path}/{folder}")).collect()
        return [{**r.asDict(), "folder": f"{folder}/level={r.level}/run={r.run}"} for r in found]

    def commit(self, changes: DataFrame) -> dict:
        """Writes changes (addr, slot, block, value) as runs of all levels. They replace what the store held."""
        rows = lsm.with_runs(changes, self.capacity, self.ratio)
        return self._claimed(self._written(rows.select("addr", "slot", "block", "value", "level", "run")), False)

    def append(self, changes: DataFrame) -> dict:
        """Adds changes to those that the store holds; of a key's writes in a block, the new one counts.

        The buffer and the new changes are flushed in the order of blocks. A level with ratio runs becomes one run
        of the next. Only runs that change are written.
        """
        last = self.manifest()
        if last is None:
            return self.commit(changes)
        return self._added(last, changes)

    def _added(self, base: dict, changes: DataFrame, rewound: int | None = None) -> dict:
        """Claims the runs of a commit with changes added; rewound is the block that the store goes back to."""
        old, overlaps, since = base["runs"], base["overlaps"], self.manifest().get("since")
        flushed = [r for r in old if r["level"] >= 0]
        new = changes.select("addr", "slot", "block", "value").withColumn("seq", F.lit(1))
        for r in (r for r in old if r["level"] < 0):
            new = new.unionByName(self._read([r]).select("addr", "slot", "block", "value").withColumn("seq", F.lit(0)))
        rows = lsm.with_flush(new.groupBy("addr", "slot", "block").agg(F.max_by("value", "seq").alias("value"), F.max("seq").alias("seq")), self.capacity)
        count, low, first = rows.agg(F.count("*"), F.min("block"), F.min(F.when(F.col("seq") == 1, F.col("block")))).first()
        flushes = count // self.capacity
        head = max((r["block_hi"] for r in flushed), default=None)
        overlaps = overlaps or head is not None and low is not None and low <= head
        if first is not None and base["latest_block"] is not None and first <= base["latest_block"]:
            since = None  # older commits lack what comes late

        # Which runs there will be: each is a list of runs that stay or flushes that come, oldest first.
        levels: dict[int, list[tuple[int, list]]] = {}
        for r in sorted(flushed, key=lambda r: r["run"]):
            levels.setdefault(r["level"], []).append((r["run"], [r]))
        for f in range(flushes):
            level, parts = 0, [f]
            while True:
                here = levels.setdefault(level, [])
                here.append((here[-1][0] + 1 if here else 0, parts))
                if len(here) < self.ratio:
                    break
                level, parts = level + 1, [p for _, run in here for p in run]
                levels[level - 1] = []
        stays = lambda run: len(run) == 1 and isinstance(run[0], dict)
        kept = [run[0] for runs in levels.values() for _, run in runs if stays(run)]
        made = rows.where(F.col("flush") >= flushes).select("addr", "slot", "block", "value", F.lit(-1).alias("level"), F.lit(-1).cast("long").alias("run"))
        place = {}
        for level, runs in levels.items():
            for n, run in runs:
                if stays(run):
                    continue
                for p in run:
                    if isinstance(p, dict):
                        made = made.unionByName(self._read([p]).select("addr", "slot", "block", "value", F.lit(level).alias("level"), F.lit(n).cast("long").alias("run")))
                    else:
                        place[p] = (level, n)
        if place:
            spots = self.spark.createDataFrame([(f, *to) for f, to in place.items()], "flush long, level int, run long")
            made = made.unionByName(rows.join(F.broadcast(spots), "flush").select("addr", "slot", "block", "value", "level", "run"))  # a row for each flush of this append
        return self._claimed(kept + self._written(made), overlaps, since, rewound)

    def rewind(self, block: int) -> dict:
        """Goes back to a block, whatever came after it: a new commit of the runs of the newest checkpoint that is not beyond it, and of the changes between that and the block, which are taken from the runs of now. Without such a checkpoint, or if it lacks blocks that came late, everything up to the block is written anew."""
        last = self.manifest()
        since, rewinds = last.get("since", last["version"]), last.get("rewinds", [])
        upto = lambda m, b: m["latest_block"] is None or m["latest_block"] <= b
        usable = [m for m in self.manifests() if m["version"] >= since and upto(m, block) and all(m["version"] >= v or upto(m, b) for v, b in rewinds)]
        held = self.changes().where(F.col("block") <= block)
        if not usable:
            return self.commit(held)
        base = max(usable, key=lambda m: m["version"])
        return self._added(base, held if base["latest_block"] is None else held.where(F.col("block") > base["latest_block"]), block)

    def _read(self, runs: list[dict]) -> DataFrame:
        """Rows (addr, slot, block, value, level, run) of runs."""
        if not runs:
            raise ValueError("an empty store has no rows")
        read = self.spark.read.parquet(*(f"{self.path}/{r['folder']}" for r in runs))
        part = lambda name: F.regexp_extract(F.col("_metadata.file_path"), f"/{name}=(-?[0-9]+)/", 1)
        return read.select("addr", "slot", "block", "value", part("level").cast("int").alias("level"), part("run").cast("long").alias("run"))

    def rows(self) -> DataFrame:
        """All changes with their level and run. If later appends wrote blocks that were flushed before, a key's newest write of a block counts."""
        entry = self.manifest()
        every = self._read(entry["runs"])
        if not entry["overlaps"]:
            return every
        newest = F.struct(-F.col("level"), F.col("run"))
        return every.groupBy("addr", "slot", "block").agg(*(F.max_by(c, newest).alias(c) for c in ("value", "level", "run")))

    def changes(self) -> DataFrame:
        return self.rows().select("addr", "slot", "block", "value")

    def runs(self) -> DataFrame:
        return lsm.runs(self.rows())

    def index(self, error: float = 0.1, epsilon: int = 8) -> tuple[DataFrame, DataFrame]:
        """The last commit's rows by page, and their filters and models, both written once to the store."""
        name = f"index-{self.manifest()['version']}-{error}-{epsilon}"
        fs, path = self._hadoop(f"{name}/built/_SUCCESS")
        if not fs.exists(path):
            lookup.dealt(self.rows()).write.mode("overwrite").parquet(f"{self.path}/{name}/pages")
            lookup.index(self.spark.read.parquet(f"{self.path}/{name}/pages"), error, epsilon).write.mode("overwrite").parquet(f"{self.path}/{name}/built")
        return self.spark.read.parquet(f"{self.path}/{name}/pages"), self.spark.read.parquet(f"{self.path}/{name}/built")

    def lookup(self, probes: DataFrame) -> DataFrame:
        """lookup() of probed keys by the store's filters and models."""
        return lookup.lookup(*self.index(), probes)

    def write_latest(self) -> DataFrame:
        """The latest state beside the history, for reads that want no older version; written once for each commit."""
        name = f"latest-{self.manifest()['version']}"
        fs, path = self._hadoop(f"{name}/_SUCCESS")
        if not fs.exists(path):
            latest(self.changes()).sortWithinPartitions("addr", "slot").write.mode("overwrite").parquet(f"{self.path}/{name}")
        return self.spark.read.parquet(f"{self.path}/{name}")

    def files(self) -> DataFrame:
        """(path, name, bytes) of all files below the store."""
        found = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(self.path)
        return found.select(F.substring_index("path", f"{self.path.split(':')[-1]}/", -1).alias("path"), F.substring_index("path", "/", -1).alias("name"), F.col("length").alias("bytes"))

    def drop_old(self) -> int:
        """Deletes the runs that no kept commit names: the last one, and each checkpoint_every-th; gives their number."""
        every = self.manifests()
        keep = [m for m in every if m is every[-1] or self.checkpoint_every > 0 and m["version"] % self.checkpoint_every == 0]
        named = {r["folder"] for m in keep for r in m["runs"]}
        gone = {r["folder"] for m in every for r in m["runs"]} - named
        for m in every:
            if m not in keep:
                fs, path = self._hadoop(f"manifest/{m['version']:012d}.json")
                fs.delete(path, False)
        n = 0
        for folder in gone:
            fs, path = self._hadoop(folder)
            n += bool(fs.delete(path, True))
        return n


def write_metrics(rows: DataFrame, path: str) -> None:
    """Measures as JSON lines."""
    rows.write.mode("append").json(path)
