"""Parameters of a ledger and its workload, from a JSON file."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, fields

from pyspark.sql import SparkSession

from stratum.sources.store import Store


@dataclass(frozen=True)
class Parameters:
    """Rows of a flush, runs of a level, children of a node, the error of models and of filters, transactions of a block, and the versions between checkpoints (0: none)."""

    capacity: int = 10_000
    ratio: int = 10
    fanout: int = 4
    epsilon: int = 23
    filter_error: float = 0.1
    block_size: int = 100
    checkpoint_every: int = 0

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> Parameters:
        """Of a JSON object in a file that Spark can read; what it does not name keeps its default, and a name that is no parameter is refused."""
        given = json.loads("\n".join(r[0] for r in spark.read.option("wholetext", True).text(path).collect()))
        unknown = set(given) - {f.name for f in fields(cls)}
        if unknown:
            raise ValueError(f"no parameters: {', '.join(sorted(unknown))}")
        return cls(**given)

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    def store(self, spark: SparkSession, path: str) -> Store:
        return Store(spark, path, self.capacity, self.ratio, self.checkpoint_every)
