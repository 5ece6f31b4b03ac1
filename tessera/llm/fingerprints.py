"""Document fingerprints: one-permutation MinHash with optimal densification and packed low-order bits."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PIECE_BYTES, tidy
from .shingles import mix, shingle_hashes

BINS, BITS = 512, 4
NONE = np.uint64(2**64 - 1)
#: Rows of a run, on average, rows that are drawn for each run to find its bounds, and runs at most (bounds of 16 bytes each).
RUN_ROWS, DRAWN, MOST_RUNS = 2_000, 8, 1 << 20


def _probes(bins: int) -> np.ndarray:
    """[j, a]: the bin from which empty bin j borrows at attempt a, the same for every document."""
    return np.argsort(np.random.default_rng(5).random((bins, bins)), axis=1).astype(np.int32)


_PROBE = _probes(BINS)
_RANK = np.argsort(_PROBE, axis=1).astype(np.int32)


def fingerprints(texts: list[str], bits: int = BITS) -> list[bytes]:
    """Packed fingerprints; b"" for a text without words.

    A text's distinct shingles are hashed once; the hash's high bits choose one of
    BINS bins, where the least hash stays. An empty bin takes what the first full bin
    on its own random route has. The low bits of every bin are packed.
    """
    raw = [t.encode() for t in texts]
    offs = np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
    h, at = shingle_hashes(np.frombuffer(b"".join(raw), np.uint8), offs)
    n = len(texts)
    table = np.full(n * BINS, NONE, np.uint64)
    owner = np.repeat(np.arange(n), np.diff(at))
    np.minimum.at(table, owner * BINS + (h >> np.uint64(64 - BINS.bit_length() + 1)).astype(np.int64), h)
    table = table.reshape(n, BINS)
    full = table != NONE
    have = full.sum(1)
    source = np.tile(np.arange(BINS, dtype=np.int32), (n, 1))
    few = np.flatnonzero((have > 0) & (have <= 32))
    for i in few.tolist():
        t = np.flatnonzero(full[i])
        source[i] = np.where(full[i], source[i], t[np.argmin(_RANK[:, t], axis=1)])
    rows, cols = np.nonzero(~full & (have > 32)[:, None])
    a = 0
    while len(rows):
        to = _PROBE[cols, a]
        hit = full[rows, to]
        source[rows[hit], cols[hit]] = to[hit]
        rows, cols, a = rows[~hit], cols[~hit], a + 1
    # Bins that share a value must not be equal by chance all at once: the bin goes into the bits that are stored.
    value = mix(np.take_along_axis(table, source, 1) + np.arange(BINS, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
    low = (value & np.uint64((1 << bits) - 1)).astype(np.uint8)
    packed = np.packbits(np.unpackbits(low[:, :, None], axis=2)[:, :, 8 - bits :].reshape(n, -1), axis=1)
    return [packed[i].tobytes() if have[i] else b"" for i in range(n)]


def likeness(a: bytes, b: bytes, bits: int = BITS) -> float:
    """The Jaccard similarity that the share of equal bins tells, less what chance makes equal (1 / 2 ** bits).

    Texts without words are like each other (1) and like nothing else (0).
    """
    if not a or not b:
        return float(a == b)
    x = np.unpackbits(np.frombuffer(a, np.uint8) ^ np.frombuffer(b, np.uint8)).reshape(-1, bits)
    chance = 0.5**bits
    return float(min(1.0, max(0.0, ((~x.any(1)).mean() - chance) / (1 - chance))))


def edited(text: str, following: str) -> str:
    """The last quarter of the code points replaced by the first as many of the next text."""
    q = len(text) // 4
    return text[: len(text) - q] + following[:q]


def _run_of(bounds: np.ndarray, k: np.ndarray, tie: np.ndarray) -> np.ndarray:
    """How many bounds (rows of k, tie, ascending) are not above each pair."""
    bk, bt = bounds
    out, upto = np.searchsorted(bk, k, "left"), np.searchsorted(bk, k, "right")
    for value in np.unique(k[upto > out]):  # a k that is a bound, as a null or repeated one may be more than once
        rows, (lo, hi) = np.flatnonzero(k == value), (int(np.searchsorted(bk, value, side)) for side in ("left", "right"))
        out[rows] = lo + np.searchsorted(bt[lo:hi], tie[rows], "right")
    return out


def compare_with_next(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The next document is that of the next doc_id, after the last the first; a single one
    is its own next, an empty table gives no rows. Null texts are empty; null doc_ids come
    first; rows of equal doc_id go by a hash of their texts. Texts are read whole. Rows are
    cut into runs by bounds of doc_id and hash, drawn by a hash of the rows; the first row
    of each run is also sent to the run before, so one exchange suffices, no run depends
    on another, and rows of one doc_id need not meet.
    """
    low = F.lit(-(2**63)).cast("long")
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), low).alias("k"), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("tie"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    total = keyed.count()
    runs = max(1, min(MOST_RUNS, -(-total // RUN_ROWS)))
    drawn = keyed.filter(F.pmod(F.xxhash64(F.lit(9), "k", "tie"), F.lit(1 << 40)) <= F.lit(min(1.0, DRAWN * runs / max(total, 1)) * (1 << 40))).select("k", "tie").toArrow() if runs > 1 else None
    bounds = np.zeros((2, 0), np.int64)
    if drawn is not None and drawn.num_rows:
        pairs = np.stack([drawn["k"].to_numpy(), drawn["tie"].to_numpy()])
        pairs = pairs[:, np.lexsort((pairs[1], pairs[0]))]
        bounds = np.unique(pairs[:, np.arange(1, runs) * pairs.shape[1] // runs], axis=1)

    @F.arrow_udf("int")
    def run_of(k: pa.Array, tie: pa.Array) -> pa.Array:
        return pa.array(_run_of(bounds, k.to_numpy(), tie.to_numpy()).astype(np.int32))

    first = keyed.select(run_of("k", "tie").alias("run"), F.struct("k", "tie").alias("pair")).groupBy("run").agg(F.min("pair").alias("pair")).select("run", "pair.k", "pair.tie").toArrow()  # a row for each run
    order = np.argsort(first["run"].to_numpy())
    numbers, heads = first["run"].to_numpy()[order], np.stack([first[c].to_numpy()[order] for c in ("k", "tie")])
    before = np.roll(numbers, 1)

    @F.arrow_udf("array<int>")
    def places(k: pa.Array, tie: pa.Array) -> pa.Array:
        k, tie = k.to_numpy(), tie.to_numpy()
        own = _run_of(bounds, k, tie)
        at = np.searchsorted(numbers, own)
        head = (heads[0][at] == k) & (heads[1][at] == tie) if len(k) else np.zeros(0, bool)
        flat = np.repeat(own, 1 + head)
        ends = np.cumsum(1 + head)
        flat[ends[head] - 1] = before[at[head]]
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(flat.astype(np.int32)))

    dealt = keyed.select("doc_id", "k", "tie", "text", F.posexplode(places("k", "tie")).alias("extra", "run"))
    dealt = dealt.repartitionById(runs, F.col("run")).sortWithinPartitions("run", "extra", "k", "tie").select("doc_id", "run", "extra", "text")
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    @tidy
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple] = []  # doc_id, text, following
        size = 0
        last: tuple | None = None  # run, doc_id, text of a row whose next is to come

        def flush() -> pa.RecordBatch:
            texts = [w[1] for w in waiting]
            edits = [edited(w[1], w[2]) for w in waiting]
            # A document's own fingerprint is made where it is the next one too: consecutive rows share it.
            need = list(dict.fromkeys([*texts, *(w[2] for w in waiting)]))
            own = dict(zip(need, fingerprints(need)))
            changed = fingerprints(edits)
            cols = [
                [w[0] for w in waiting], [len(t) for t in texts], [hashlib.sha256(e.encode()).hexdigest() for e in edits], [own[t].hex() for t in texts], [c.hex() for c in changed],
                [likeness(own[t], c) for t, c in zip(texts, changed)], [likeness(own[w[1]], own[w[2]]) for w in waiting],
            ]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)

        for batch in batches:
            for doc_id, run, extra, text in zip(*(c.to_pylist() for c in batch.columns)):
                if last is not None and last[0] == run:
                    waiting.append((last[1], last[2], text))
                    size += len(last[2])
                last = None if extra else (run, doc_id, text)
                if size > PIECE_BYTES // 2:
                    yield flush()
                    waiting, size = [], 0
        if waiting:
            yield flush()

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return dealt.mapInArrow(compare, schema)
