"""Token-ID output as a content-addressed store.

Layout under one folder, all Parquet:
  chunks/    hash (16 bytes, blake2b of the ids as little-endian 32-bit), n_ids, width (bytes an id takes here), ids; other columns are those of the writer's loose recipes
  recipes/   doc_id, uid, part, n_tokens, hashes (16 bytes a chunk), lengths (ids a chunk), root (Merkle root of the document); files and rows in ascending doc_id
  manifest/  level, place, n, root: at level 0 a part's documents in order, above it FAN places of the level below, up to one root
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, pieces, running_total, settle, tidy
from .shingles import mix

#: A cut falls after an id in about so many; a chunk holds MOST ids at most.
MEAN, MOST = 256, 4096
#: Ids that the rolling hash sees.
SPAN = 4
HASH = 16
#: Documents of a part of the recipes, on average; roots that one root of the next level covers; chunk addresses that a task remembers.
PART_DOCS, FAN, SEEN = 50_000, 4096, 200_000
_CHUNK = "hash binary, n_ids int, width int, ids binary"
_BOTH = f"doc_id long, n_tokens long, hashes binary, lengths binary, root binary, {_CHUNK}"
_RECIPE = "doc_id long, n_tokens long, hashes binary, lengths binary, root binary, part int, uid long"
_PLACE = np.random.default_rng(77).integers(0, 2**64, SPAN, dtype=np.uint64) | np.uint64(1)
_EMPTY = hashlib.blake2b(b"", digest_size=HASH).digest()


def merkle(leaves: list[bytes]) -> bytes:
    """Root over the leaves; an odd node rises as it is."""
    level = [hashlib.blake2b(b"\0" + x, digest_size=HASH).digest() for x in leaves]
    while len(level) > 1:
        up = [hashlib.blake2b(b"\1" + a + b, digest_size=HASH).digest() for a, b in zip(level[::2], level[1::2])]
        level = up + level[len(up) * 2 :]
    return level[0] if level else _EMPTY


def cuts(ids: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Where chunks end: content-defined, at every document's end, and MOST after the last cut."""
    n = len(ids)
    h = np.zeros(n, np.uint64)
    spread = mix(ids.astype(np.uint64) + np.uint64(1))
    for k in range(SPAN):
        h[k:] += spread[: n - k] * _PLACE[k]
    found = (h >> np.uint64(40)) % np.uint64(MEAN) == 0
    # A window that reaches into the document before must not move cuts: equal documents are cut alike.
    heads = offs[:-1]
    for k in range(SPAN - 1):
        near = heads + k
        found[near[near < n]] = False
    ends = np.union1d(np.flatnonzero(found) + 1, offs[1:])
    begins = np.concatenate([[0], ends[:-1]])
    long = np.flatnonzero(ends - begins > MOST)
    more = [np.arange(begins[i] + MOST, ends[i], MOST) for i in long.tolist()]
    return np.union1d(ends, np.concatenate(more)) if more else ends


def _shift_table() -> np.ndarray:
    """[k, bit]: what bit of a CRC-32 becomes when 2 ** k zero bytes follow."""
    def times(m: np.ndarray, v: int) -> int:
        out, k = 0, 0
        while v:
            if v & 1:
                out ^= int(m[k])
            v >>= 1
            k += 1
        return out

    one = np.array([0xEDB88320] + [1 << k for k in range(31)], np.uint64)  # one zero bit
    square = lambda m: np.array([times(m, int(x)) for x in m], np.uint64)
    byte = square(square(square(one)))
    table = [byte]
    for _ in range(39):
        table.append(square(table[-1]))
    return np.array(table, np.uint64)


def shift_crc(crc: np.ndarray, after: np.ndarray) -> np.ndarray:
    """The part that each chunk's CRC-32 has in the CRC of a text where `after` bytes follow it."""
    table, out = _shift_table(), crc.astype(np.uint64)
    after = after.astype(np.uint64)
    for k in range(table.shape[0]):
        on = np.flatnonzero((after >> np.uint64(k)) & np.uint64(1))
        if len(on):
            v, r = out[on], np.zeros(len(on), np.uint64)
            for bit in range(32):
                r ^= np.where((v >> np.uint64(bit)) & np.uint64(1), table[k, bit], np.uint64(0))
            out[on] = r
        elif not (after >> np.uint64(k)).any():
            break
    return out


def write_store(docs: DataFrame, tokenizer: str, path: str, end: int = 2, text: str = "text", key: str = "doc_id") -> None:
    """Encode every whole text, append `end`, and write chunks, recipes and manifest under path.

    Null texts are empty and hold the end id alone; an empty table gives an empty store; a
    very long text is encoded in blocks between safe cuts and its ids are held by one task;
    rows that repeat get recipes of their own and share their chunks; a null key sorts
    first, equal keys go by their roots. Other columns, whatever their names, are left out.
    """
    slim = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))

    @tidy
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .encoding import encoder

        enc, seen = encoder(tokenizer), set()
        for batch in batches:
            for part in pieces(batch, limit=1 << 20):
                ids, offs = enc.encode(part.column(1))
                n = np.diff(offs) + 1
                ids = np.insert(ids, offs[1:], np.uint32(end))
                offs = np.concatenate([[0], np.cumsum(n)])
                ends = cuts(ids, offs)
                begins = np.concatenate([[0], ends[:-1]])
                wide = ids.astype("<u4").tobytes()
                small = ids.astype("<u2").tobytes() if ids.max() < 65536 else None
                names, at = [], np.searchsorted(ends, offs)  # ends holds every offs but 0
                rows: dict[str, list] = {c: [] for c in ("hash", "n_ids", "width", "ids")}
                for a, b in zip(begins.tolist(), ends.tolist()):
                    h = hashlib.blake2b(wide[4 * a : 4 * b], digest_size=HASH).digest()
                    names.append(h)
                    if h not in seen:
                        seen.add(h)
                        rows["hash"].append(h)
                        rows["n_ids"].append(b - a)
                        rows["width"].append(2 if small else 4)
                        rows["ids"].append(small[2 * a : 2 * b] if small else wide[4 * a : 4 * b])
                if len(seen) > SEEN:
                    seen.clear()
                lengths = (ends - begins).astype(np.int32)
                at = at + 1
                at[0] = 0
                doc = [(b"".join(names[a:b]), lengths[a:b].astype("<i4").tobytes(), merkle(names[a:b])) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
                k, m = part.num_rows, len(rows["hash"])
                recipe = [(part.column(0).to_pylist(), pa.int64()), (n.tolist(), pa.int64()), *[([x[j] for x in doc], pa.binary()) for j in range(3)]]
                chunk = [(rows["hash"], pa.binary()), (rows["n_ids"], pa.int32()), (rows["width"], pa.int32()), (rows["ids"], pa.binary())]
                yield pa.RecordBatch.from_arrays([*[pa.array(v + [None] * m, t) for v, t in recipe], *[pa.array([None] * k + v, t) for v, t in chunk]], names=[x.split(" ")[0] for x in _BOTH.split(", ")])

    @tidy
    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Equal chunks meet in one partition; the first stays."""
        seen: set[bytes] = set()
        for batch in batches:
            keep = [h is None or h not in seen and not seen.add(h) for h in batch.column(5).to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    # One exchange and one file for both, as columns of their own: a chunk goes by its address, a
    # recipe by its document too, so copies of one text do not meet.
    dealt = slim.mapInArrow(encode, _BOTH).repartition(F.xxhash64("hash", "doc_id", "hashes")).mapInArrow(once, _BOTH)
    dealt.write.option("compression", "zstd").parquet(f"{path}/chunks")
    spark = docs.sparkSession
    loose = spark.read.schema(_BOTH).parquet(f"{path}/chunks").filter("root is not null").select("doc_id", "n_tokens", "hashes", "lengths", "root")
    recipes = (
        loose.repartitionByRange(max(1, -(-loose.count() // PART_DOCS)), "doc_id", "root").withColumn("part", F.spark_partition_id())
        .sortWithinPartitions("doc_id", "root").withColumn("uid", F.monotonically_increasing_id())
    )
    recipes.write.option("compression", "zstd").parquet(f"{path}/recipes")
    written = spark.read.schema(_RECIPE).parquet(f"{path}/recipes").select(F.col("part").cast("long").alias("place"), F.col("uid").alias("at"), "root")
    level, height = settle(_roots(written), "roots"), 0
    level.withColumn("level", F.lit(0)).write.parquet(f"{path}/manifest")
    while level.limit(2).count() > 1:
        height += 1
        level = settle(_roots(level.select(F.floor(F.col("place") / FAN).alias("place"), F.col("place").alias("at"), "root")), "roots")
        level.withColumn("level", F.lit(height)).write.mode("append").parquet(f"{path}/manifest")


def _roots(rows: DataFrame) -> DataFrame:
    """(place, at, root) -> place, n, root: the Merkle root of each place's roots in order of `at`.

    A place holds about PART_DOCS roots, or FAN of the level below.
    """

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, held = None, []
        out: list[list] = [[], [], []]

        def close() -> None:
            if held:
                for col, v in zip(out, (place, len(held), merkle(held))):
                    col.append(v)

        for batch in batches:
            for p, root in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if p != place:
                    close()
                    place, held = p, []
                held.append(root)
        close()
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary())], names=["place", "n", "root"])

    return rows.repartition("place").sortWithinPartitions("place", "at").select("place", "root").mapInArrow(run, "place long, n long, root binary")


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_CHUNK).parquet(f"{path}/chunks").filter("hash is not null")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the store: doc_id, start, n_tokens, ids_crc32, all from its files; none for an empty store.

    Every chunk is hashed again and must match its address; every document's, part's and
    the whole store's Merkle roots must match recipes and manifest; else the read fails.
    A text's CRC is put together from those of its chunks, so ids are not moved.
    """

    @tidy
    def facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, n, width, ids = (batch.column(i).to_pylist() for i in range(4))
            crcs = []
            for h, k, w, raw in zip(hashes, n, width, ids):
                wide = raw if w == 4 else np.frombuffer(raw, "<u2").astype("<u4").tobytes()
                if hashlib.blake2b(wide, digest_size=HASH).digest() != h or len(wide) != 4 * k:
                    raise ValueError(f"chunk {h.hex()} does not match its address")
                crcs.append(zlib.crc32(wide))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(crcs, pa.int64())], names=["hash", "n_ids", "crc"])

    chunk = read_chunks(spark, path).mapInArrow(facts, "hash binary, n_ids int, crc long")
    recipes = spark.read.schema(_RECIPE).parquet(f"{path}/recipes")

    @tidy
    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uid, hashes, lengths, root = (batch.column(i).to_pylist() for i in range(4))
            out: list[list] = [[], [], [], []]
            for u, hs, ls, r in zip(uid, hashes, lengths, root):
                names = [hs[i : i + HASH] for i in range(0, len(hs), HASH)]
                if merkle(names) != r:
                    raise ValueError(f"recipe {u} does not match its root")
                n = np.frombuffer(ls, "<i4").astype(np.int64)
                after = (n.sum() - np.cumsum(n)) * 4
                out[0] += [u] * len(names)
                out[1] += names
                out[2] += n.tolist()
                out[3] += after.tolist()
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.int64())], names=["uid", "h", "n", "after"])

    links = recipes.select("uid", "hashes", "lengths", "root").mapInArrow(spread, "uid long, h binary, n int, after long")
    joined = links.join(chunk, links["h"] == chunk["hash"], "left").select("uid", "n", "after", "n_ids", "crc")

    @tidy
    def shifted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.column(3).null_count or not batch.column(1).equals(batch.column(3)):
                raise ValueError("a recipe names a chunk that is missing or of another length")
            crc = shift_crc(batch.column(4).to_numpy(), batch.column(2).to_numpy())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(crc.astype(np.int64))], names=["uid", "n", "crc"])

    per = joined.mapInArrow(shifted, "uid long, n int, crc long").groupBy("uid").agg(F.sum("n").alias("__n"), F.expr("bit_xor(crc)").alias("ids_crc32"))

    _check_manifest(spark, path, recipes)
    heads = running_total(recipes.select("doc_id", "uid", "part", "n_tokens"), [], F.col("part"), [F.col("uid")], "n_tokens", "start")
    whole = F.when(F.col("__n") == F.col("n_tokens"), F.col("n_tokens")).otherwise(F.raise_error(F.lit("a recipe's chunks do not add up to its length")).cast("long"))
    return heads.join(per, "uid", "left").select("doc_id", "start", whole.alias("n_tokens"), "ids_crc32")


def _check_manifest(spark: SparkSession, path: str, recipes: DataFrame) -> None:
    """Fail unless every level of the manifest is made of the one below, the lowest of the recipes, and the highest is one root."""
    told = spark.read.schema("place long, n long, root binary, level int").parquet(f"{path}/manifest")
    below = recipes.select(F.col("part").cast("long").alias("place"), F.col("uid").alias("at"), "root")
    top = told.agg(F.max("level").alias("top"), F.max_by(F.col("place"), "level").alias("place")).first()
    for height in range((top["top"] if top["top"] is not None else -1) + 1):
        level = told.filter(F.col("level") == height)
        made = _roots(below).select(F.col("place").alias("p"), F.col("n").alias("m"), F.col("root").alias("r"))
        same = (F.col("place") == F.col("p")) & (F.col("n") == F.col("m")) & (F.col("root") == F.col("r"))
        if level.join(made, same, "full_outer").filter("p is null or place is null").limit(1).count():
            raise ValueError(f"level {height} of the manifest does not match what lies below")
        below = level.select(F.floor(F.col("place") / FAN).alias("place"), F.col("place").alias("at"), "root")
    if (top["top"] is None and recipes.limit(1).count()) or (top["top"] is not None and below.limit(2).count() != 1):
        raise ValueError("the manifest has no one root")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, ids (array of int): whole documents put together again."""
    recipes, chunk = spark.read.schema(_RECIPE).parquet(f"{path}/recipes"), read_chunks(spark, path)
    names = recipes.select("doc_id", "uid", F.posexplode(F.expr("transform(sequence(0, cast(octet_length(hashes) / 16 as int) - 1), i -> substring(hashes, i * 16 + 1, 16))")).alias("seq", "h"))
    rows = names.join(chunk, names["h"] == chunk["hash"]).select("doc_id", "uid", "seq", "width", "ids")

    def whole(key, table):
        table = table.sort_by("seq")
        ids = [np.frombuffer(x, "<u2" if w == 2 else "<u4").astype(np.int32) for x, w in zip(table["ids"].to_pylist(), table["width"].to_pylist())]
        return pa.table({"doc_id": table["doc_id"].slice(0, 1), "ids": pa.array([np.concatenate(ids)], pa.list_(pa.int32()))})

    return rows.groupBy("uid").applyInArrow(whole, "doc_id long, ids array<int>")


def new_store(spark: SparkSession) -> str:
    return fresh_path(spark, "ids")
