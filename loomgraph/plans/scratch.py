"""Lineage cuts for iterative plans.

A cut is a Parquet table in the folder that ``spark.checkpoint.dir`` names, which every executor
can reach, so a lost executor costs a re-read and not a recomputation of the loop. Unlike
``DataFrame.checkpoint`` the plan runs once: an eager checkpoint runs its last stage twice.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the session; a temporary one only where none is configured and driver and executors are one process."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not (spark.sparkContext.master or "").split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="loomgraph-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


class Scratch:
    """A folder of intermediate tables for one query, removed when the driver ends."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/loomgraph-{uuid.uuid4().hex}"
        self._n = 0
        self._kept: dict[object, object] = {}
        atexit.register(self.clear)

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n:03d}-{name}"

    def save(self, df: DataFrame, name: str = "cut") -> DataFrame:
        """Write ``df`` and return it as read back, with its schema and no lineage."""
        path = self.path(name)
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._loom_path = path
        return out

    def save_seen(self, df: DataFrame, name: str, *measures: Column) -> tuple[DataFrame, tuple]:
        """``save``, and the values of ``measures`` over what was written, taken on the way without a second job."""
        seen = Observation()
        named = [m.alias(f"m{i}") for i, m in enumerate(measures)]
        out = self.save(df.observe(seen, *named), name)
        got = seen.get
        return out, tuple(got[f"m{i}"] for i in range(len(measures)))

    def once(self, key: object, build: Callable[[], DataFrame]) -> DataFrame:
        """The table saved under ``key``, built at first use."""
        if key not in self._kept:
            self._kept[key] = self.save(build(), "once")
        return self._kept[key]

    def held(self, key: object, build: Callable[[], object]) -> object:
        """What ``build`` gives, called at first use of ``key``."""
        if key not in self._kept:
            self._kept[key] = build()
        return self._kept[key]

    def drop(self, df: DataFrame) -> None:
        """Remove a table that nothing reads any more."""
        if path := getattr(df, "_loom_path", None):
            self._delete(path)

    def clear(self) -> None:
        self._delete(self.root)

    def _delete(self, path: str) -> None:
        sc = self.spark.sparkContext
        if sc._jsc is None or sc._jvm is None:
            return
        try:
            target = sc._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(sc._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the session may be gone; the folder is the cluster's scratch space
            return


def fixpoint(
    scratch: Scratch,
    state: DataFrame,
    step: Callable[[DataFrame], DataFrame],
    measures: tuple[Column, ...],
) -> DataFrame:
    """Apply ``step`` until ``measures`` of the state stop changing: one lineage cut and one job a round, no bound on rounds."""
    state, seen = scratch.save_seen(state, "state", *measures)
    while True:
        after, now = scratch.save_seen(step(state), "state", *measures)
        scratch.drop(state)
        state = after
        if now == seen:
            return state
        seen = now
