"""Power iteration over a transition table, with two interchangeable strategies.

"local" runs the loop in NumPy on one machine and is taken only for tables of at most
LOCAL_EDGES rows (counted first); "distributed" runs it as joins and partial sums, and
writes the vector each round, so lineage stays short and one pass gives norm and delta. Both follow the same rules:

  v = (1 - alpha) * spread(state) * receiver + alpha * teleport;  delta = sum |v - state|
  state = v / sum |v|;  stop when delta < tolerance

State starts at zero, so the first round gives the teleport itself. Mass of rows without
links is not passed on. delta compares an unnormalised with a normalised vector, so open
graphs use all their rounds.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import bucketed, drop, materialize
from .adjacency import row_factors, seed_teleport, transitions

#: Rows of a transition table that one machine takes (24 bytes each).
LOCAL_EDGES = 5_000_000


@dataclass
class Params:
    alpha: float = 0.15
    max_iterations: int = 100
    tolerance: float = 1e-6


class Transitions:
    """A transition table (src, dst, p) over the ids of `nodes`, and how it is iterated.

    It is written in buckets by src where it is large, so that rounds move the vector and
    not the table. `rows` is its number of rows where that is known, so that a large one is
    written once. With `factors` (src, f) the table is one of weights (src, dst, weight)
    that lies in such buckets already, and p is weight * f.
    """

    def __init__(self, p: DataFrame, nodes: DataFrame, engine: str = "auto", rows: int | None = None, factors: DataFrame | None = None):
        self.table, self.ids, self.factors = p, nodes.select("id"), factors
        self._arrays: tuple | None = None
        if factors is not None:
            self.engine = "distributed"
            return
        if engine == "auto" and (rows is None or rows <= LOCAL_EDGES):
            self.table = materialize(p, "transitions")
            engine = "local" if self.table.count() <= LOCAL_EDGES else "distributed"
        elif engine == "auto":
            engine = "distributed"
        if engine == "distributed":
            self.table = bucketed([self.table], "src", "transitions")
        self.engine = engine

    @classmethod
    def over(cls, nodes: DataFrame, adj: DataFrame, rows: int) -> "Transitions":
        """Those of an adjacency as stored_adjacency(.., LOCAL_EDGES) gives it: of a large one only the factors are written."""
        if rows <= LOCAL_EDGES:
            return cls(transitions(nodes, adj), nodes)
        return cls(adj, nodes, factors=bucketed([row_factors(nodes, adj)], "src", "factors"))

    def _sent(self, s: DataFrame) -> DataFrame:
        """(dst, v) of a vector (src, m): what goes over each link. Buckets of the vector are hashed, so the table is not sorted in each round."""
        if self.factors is None:
            return self.table.join(s, "src").select("dst", (F.col("m") * F.col("p")).alias("v"))
        s = self.factors.join(s.hint("shuffle_hash"), "src")
        return self.table.join(s.hint("shuffle_hash"), "src").select("dst", (F.col("m") * (F.col("weight") * F.col("f"))).alias("v"))

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """ids ascending, and src, dst (as places among them) and p."""
        if self._arrays is None:
            ids = np.sort(self.ids.toArrow()["id"].to_numpy())
            t = self.table.toArrow()
            src, dst = (np.searchsorted(ids, t[c].to_numpy()) for c in ("src", "dst"))
            order = np.lexsort((dst, src))
            self._arrays = ids, src[order], dst[order], t["p"].to_numpy()[order]
        return self._arrays

    def release(self) -> None:
        """Delete the bucketed table that was written here, once all vectors that are wanted have been made and written."""
        if self.engine == "distributed":
            drop(self.table if self.factors is None else self.factors)

    def dense(self, vector: DataFrame) -> np.ndarray:
        ids = self.arrays()[0]
        t = vector.select("id", "value").toArrow()
        out = np.zeros(len(ids))
        np.add.at(out, np.searchsorted(ids, t["id"].to_numpy()), t["value"].to_numpy())
        return out

    def frame(self, values: np.ndarray) -> DataFrame:
        at = np.flatnonzero(values)
        return self.table.sparkSession.createDataFrame(pa.table({"id": self.arrays()[0][at], "value": values[at]}))

    def run(self, teleport: DataFrame, params: Params, receiver: DataFrame | None = None) -> tuple[DataFrame, int]:
        """The vector (id, value; absent is 0) and the rounds it took."""
        return (self._local if self.engine == "local" else self._distributed)(teleport, params, receiver)

    def _local(self, teleport: DataFrame, params: Params, receiver: DataFrame | None) -> tuple[DataFrame, int]:
        ids, src, dst, p = self.arrays()
        start = self.dense(teleport)
        weight = None if receiver is None else self.dense(receiver)
        state, rounds = iterate(src, dst, p, start, params, weight)
        return self.frame(state), rounds

    def _distributed(self, teleport: DataFrame, params: Params, receiver: DataFrame | None) -> tuple[DataFrame, int]:
        teleport = teleport.groupBy("id").agg(F.sum("value").alias("value"))
        base = materialize(teleport.select("id", (F.col("value") * params.alpha).alias("value")), "teleport")
        receiver = None if receiver is None else materialize(receiver.select("id", "value"), "receiver")
        state, rounds = None, 0
        while rounds < params.max_iterations:
            rounds += 1
            parts = base.select("id", F.col("value").alias("v"), F.lit(0.0).alias("s"))
            if state is not None:
                s = state.select(F.col("id").alias("src"), F.col("value").alias("m"))
                spread = self._sent(s).groupBy(F.col("dst").alias("id")).agg((F.sum("v") * (1 - params.alpha)).alias("v"))
                if receiver is not None:
                    r = receiver.select("id", F.col("value").alias("w"))
                    spread = spread.join(r, "id").select("id", (F.col("v") * F.col("w")).alias("v"))
                parts = parts.unionByName(spread.select("id", "v", F.lit(0.0).alias("s"))).unionByName(state.select("id", F.lit(0.0).alias("v"), F.col("value").alias("s")))
            new = parts.groupBy("id").agg(F.sum("v").alias("v"), F.sum("s").alias("s"))
            new = materialize(new, "vector")
            got = new.agg(F.coalesce(F.sum(F.abs("v")), F.lit(0.0)).alias("norm"), F.coalesce(F.sum(F.abs(F.col("v") - F.col("s"))), F.lit(0.0)).alias("delta")).first()
            state = new.select("id", (F.col("v") / F.lit(got["norm"] or 1.0)).alias("value")).filter("value <> 0")
            if got["delta"] < params.tolerance:
                break
        return state if state is not None else base.limit(0), rounds


#: Signals by name: what each starts from, given resolved seeds.
SIGNALS: dict[str, Callable[[DataFrame], DataFrame]] = {"relevance": seed_teleport}


def run_signals(t: Transitions, names: list[str], seeds: DataFrame, params: Params) -> DataFrame:
    """(signal, id, value) of each named signal; a name that is not registered is an error."""
    out = None
    for name in names:
        if name not in SIGNALS:
            raise ValueError(f"no signal is called {name!r}")
        one = t.run(SIGNALS[name](seeds), params)[0].select(F.lit(name).alias("signal"), "id", "value")
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no signal is asked for")
    return out


def l1_distance(a: DataFrame, b: DataFrame) -> DataFrame:
    """(delta): the sum of differences' sizes between two vectors (id, value); absent is 0."""
    both = a.select("id", "value").unionByName(b.select("id", (-F.col("value")).alias("value"))).groupBy("id").agg(F.sum("value").alias("d"))
    return both.agg(F.coalesce(F.sum(F.abs("d")), F.lit(0.0)).alias("delta"))


def iterate(src: np.ndarray, dst: np.ndarray, p: np.ndarray, teleport: np.ndarray, params: Params, receiver: np.ndarray | None = None) -> tuple[np.ndarray, int]:
    """The loop on arrays."""
    n = len(teleport)
    state, rounds = np.zeros(n), 0
    for rounds in range(1, params.max_iterations + 1):
        v = np.bincount(dst, state[src] * p, n)
        if receiver is not None:
            v = v * receiver
        v = (1 - params.alpha) * v + params.alpha * teleport
        delta = np.abs(v - state).sum()
        norm = np.abs(v).sum()
        state = v / norm if norm > 0 else v
        if delta < params.tolerance:
            break
    return state, rounds
