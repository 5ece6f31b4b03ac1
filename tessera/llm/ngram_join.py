"""N-gram Jaccard join with adaptive multi-match prefixes.

A text is the set of its distinct 5-word shingles, ordered by how many texts hold them
(rarest first). If two sets overlap by O, the first n - O + l shingles of each (its
l-prefix) share l at least. Every text chooses its own l: a longer prefix costs more
postings, but asks for more shared shingles before two texts are compared.

Stages, each written to the shared folder:
  1. sets: size and identity of every text's set. Equal sets are one class.
  2. counts: the shingles that many classes hold, from all texts, as a table of bounded size.
  3. postings: prefixes, dealt in packed arrays by shingle. Short lists give pairs at once;
     long ones give stars around the text with the fewest rarer shingles.
  4. the pairs are verified on whole texts; links give preliminary components.
  5. long lists again: only pairs across components, within the prefixes that the two
     sizes require, where l shingles can have been shared, in blocks of bounded size;
     verified likewise.
No link between components is lost, and none within a component is needed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import pieces, settle, tidy, utf8
from ..operators.components import label_components
from .shingles import mix, shingle_sets

#: Shingles whose counts are kept (the most frequent), and those a task offers.
KNOWN, OFFERED = 1 << 18, 1 << 16
#: Largest l, and what comparing a candidate costs in postings.
LONGEST, COMPARE = 4, 2.0
#: Classes that a task remembers not to repeat.
REMEMBERED = 200_000
#: Postings of a list that is paired at once.
SHORT = 16
#: Estimated postings from which a list is dealt to several tasks; also the side of a block.
HEAVY = 20_000
#: Bytes of packed postings for a task.
BUCKET_BYTES = 8 << 20
#: Bits of the filter that tells which texts are compared (its size does not depend on the input).
FILTER_BITS = 1 << 25
_POSTING = np.dtype([("token", "<u8"), ("cls", "<i8"), ("n", "<i4"), ("at", "<i4"), ("l", "<i4")])


def needed(n: int | np.ndarray, percent: int) -> int | np.ndarray:
    """The least overlap of a set of n with any set at least `percent` like it."""
    return (n * percent + 99) // 100


def needed_pair(na, nb, percent: int):
    """The least overlap of sets of these sizes that makes them `percent` alike: 100 o >= percent (na + nb - o)."""
    return -(-percent * (na + nb) // (100 + percent))


def set_id(s: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def _sets_of(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for part in pieces(batch):
        yield part, shingle_sets(*utf8(part.column(part.schema.get_field_index("text"))))


def class_sizes(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, n_shingles, cls (null without words), and the long columns `keep`."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, sets in _sets_of(batch):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([set_id(s) if len(s) else None for s in sets], pa.int64()), *part.columns[2:]], names=["doc_id", "n_shingles", "cls", *keep])

    schema = ", ".join(f"{c} long" for c in ("doc_id", "n_shingles", "cls", *keep))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *keep).mapInArrow(run, schema)


def frequent_shingles(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (ascending) and rank, floor(4 log2 count), of the shingles most held.

    Every task counts all its shingles, each class once, and offers its most frequent
    repeated ones; sums over the tasks are lower bounds of the counts. They only order
    prefixes, so a count that is too low costs time and no result. KNOWN entries are
    the most that is broadcast.
    """

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held: list[np.ndarray] = []
        size = 0

        def offer() -> pa.RecordBatch:
            h, c = np.unique(np.concatenate(held), return_counts=True)
            h, c = h[c > 1], c[c > 1]
            if len(h) > OFFERED:
                top = np.argpartition(c, -OFFERED)[-OFFERED:]
                h, c = h[top], c[top]
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c.astype(np.int64))], names=["h", "c"])

        for batch in batches:
            for _, sets in _sets_of(batch):
                for s in sets:
                    if len(s) and (k := set_id(s)) not in seen:
                        seen.add(k)
                        held.append(s)
                        size += len(s)
                if size > 2_000_000:
                    yield offer()
                    held, size = [], 0
                if len(seen) > REMEMBERED:
                    seen.clear()
        if size:
            yield offer()

    counts = docs.select("text").mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")).filter("c >= 4")
    counts = settle(counts.withColumn("rank", F.floor(F.log2("c") * 4).cast("int")), "counts")
    total, low = 0, 0
    for r in sorted(counts.groupBy("rank").count().collect(), key=lambda r: -r["rank"]):  # some 200 ranks at most
        total += r["count"]
        if total > KNOWN:
            low = r["rank"] + 1
            break
    top = counts.filter(F.col("rank") >= low).select("h", "rank").toArrow()
    h, rank = top["h"].to_numpy().view(np.uint64), top["rank"].to_numpy()
    order = np.argsort(h)
    return h[order], rank[order].astype(np.uint8)


def prefix_length(n: int, need: int, ranks: np.ndarray) -> int:
    """The l of least estimated cost: postings read, and candidates, of which sum(counts) / l can share l."""
    base = n - need
    if not ranks[min(base, n - 1)]:
        return 1
    most = min(LONGEST, need)
    cost = np.cumsum(np.exp2(ranks[: base + most] / 4.0))[base:]
    return int(np.argmin(cost * (1 + COMPARE / np.arange(1, len(cost) + 1)))) + 1


def _pack_postings(docs: DataFrame, known: tuple[np.ndarray, np.ndarray], percent: int, buckets: int) -> DataFrame:
    """Prefix postings of every class a task sees, as (bucket, postings) with packed rows of _POSTING."""
    told = docs.sparkSession.sparkContext.broadcast(known)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, ranks = told.value
        seen: set[int] = set()
        held: list[np.ndarray] = []
        size = 0

        def deal() -> pa.RecordBatch:
            rows = np.concatenate(held)
            count = np.exp2((rows["token"] >> np.uint64(56)).astype(np.float64) / 4)
            ways = np.maximum(1, np.ceil(count / HEAVY)).astype(np.uint64)
            way = mix(rows["cls"].astype(np.uint64)) % ways
            bucket = (mix(rows["token"] + way * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            rows, bucket = rows[order], bucket[order]
            names, first = np.unique(bucket, return_index=True)
            ends = [*first[1:].tolist(), len(rows)]
            return pa.RecordBatch.from_arrays([pa.array(names), pa.array([rows[a:b].tobytes() for a, b in zip(first.tolist(), ends)], pa.binary())], names=["bucket", "postings"])

        for batch in batches:
            for _, sets in _sets_of(batch):
                for s in sets:
                    n = len(s)
                    if not n or (k := set_id(s)) in seen:
                        continue
                    seen.add(k)
                    rank = np.zeros(n, np.uint8)
                    if len(hashes):
                        near = np.minimum(np.searchsorted(hashes, s), len(hashes) - 1)
                        rank = np.where(hashes[near] == s, ranks[near], 0)
                    token = np.sort((rank.astype(np.uint64) << np.uint64(56)) | (s >> np.uint64(8)))
                    need = int(needed(n, percent))
                    l = prefix_length(n, need, (token >> np.uint64(56)).astype(np.uint8))
                    m = n - need + l
                    rows = np.empty(m, _POSTING)
                    rows["token"], rows["cls"], rows["n"], rows["at"], rows["l"] = token[:m], k, n, np.arange(1, m + 1), l
                    held.append(rows)
                    size += m
                if size > 500_000:
                    yield deal()
                    held, size = [], 0
                if len(seen) > REMEMBERED:
                    seen.clear()
        if size:
            yield deal()

    return docs.select("text").mapInArrow(run, "bucket int, postings binary")


def _runs(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal tokens in sorted rows."""
    first = np.flatnonzero(np.concatenate([[True], rows["token"][1:] != rows["token"][:-1]]))
    return first, np.diff(np.concatenate([first, [len(rows)]]))


def _fit(x: np.ndarray, y: np.ndarray, percent: int) -> np.ndarray:
    """Whether postings can belong to a link: both places lie in the prefixes that the two sizes require."""
    need = needed_pair(x["n"].astype(np.int64), y["n"].astype(np.int64), percent)
    l = np.minimum(x["l"], y["l"])
    return (need <= np.minimum(x["n"], y["n"])) & (x["at"] <= x["n"] - need + l) & (y["at"] <= y["n"] - need + l) & (x["cls"] != y["cls"])


def _count_pairs(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, ...]:
    """Distinct pairs (a < b), their l, and how often each was found."""
    x, y = (np.concatenate(z) for z in zip(*found)) if found else (np.empty(0, _POSTING), np.empty(0, _POSTING))
    a, b, l = np.minimum(x["cls"], y["cls"]), np.maximum(x["cls"], y["cls"]), np.minimum(x["l"], y["l"])
    order = np.lexsort((b, a))
    a, b, l = a[order], b[order], l[order]
    first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) if len(a) else np.empty(0, np.int64)
    return a[first], b[first], l[first], np.diff(np.concatenate([first, [len(a)]])) if len(a) else first


_PAIRS = "kind int, a long, b long, l int, c int, postings binary"


def _pairs(packed: DataFrame, percent: int) -> DataFrame:
    """kind 0: pairs of short lists with the shared shingles counted; 1: pairs of stars; 2: long lists as they are."""

    def run(key, table):
        rows = np.concatenate([np.frombuffer(x, _POSTING) for x in table["postings"].to_pylist()])
        rows = rows[np.lexsort((rows["cls"], rows["at"], rows["token"]))]
        # A class may come from several tasks: its copies have the same postings.
        twin = np.zeros(len(rows), bool)
        twin[1:] = (rows["token"][1:] == rows["token"][:-1]) & (rows["cls"][1:] == rows["cls"][:-1])
        rows = rows[~twin]
        first, count = _runs(rows)
        count_told = np.exp2((rows["token"][first] >> np.uint64(56)).astype(np.float64) / 4)
        long = (count > SHORT) | (count_told > HEAVY)
        found, stars = [], []
        small = np.flatnonzero(~long & (count > 1))
        for step in range(1, SHORT):
            at = small[count[small] > step]
            if not len(at):
                break
            left = np.concatenate([first[at] + i for i in range(SHORT)])
            ok = np.concatenate([count[at] > i + step for i in range(SHORT)])
            x, y = rows[left[ok]], rows[left[ok] + step]
            good = _fit(x, y, percent)
            found.append((x[good], y[good]))
        keep = []
        for f, c in zip(first[long].tolist(), count[long].tolist()):
            x, y = np.repeat(rows[f], c - 1), rows[f + 1 : f + c]
            good = _fit(x, y, percent)
            stars.append((x[good], y[good]))
            keep.append(rows[f : f + c])
        out: list[list] = [[], [], [], [], [], []]
        for kind, pairs in ((0, found), (1, stars)):
            a, b, l, c = _count_pairs(pairs)
            for col, v in zip(out, (np.full(len(a), kind), a, b, l, c, [None] * len(a))):
                col += v if isinstance(v, list) else v.tolist()
        for block in keep:
            for col, v in zip(out, (2, None, None, None, None, block.tobytes())):
                col.append(v)
        return pa.Table.from_arrays([pa.array(v, t) for v, t in zip(out, (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()))], names=["kind", "a", "b", "l", "c", "postings"])

    return packed.groupBy("bucket").applyInArrow(run, _PAIRS)


def _hashes(ids: np.ndarray) -> np.ndarray:
    return mix(ids.astype(np.int64).view(np.uint64)) % np.uint64(FILTER_BITS)


def _filter_of(ids: DataFrame) -> np.ndarray:
    """A bit for each id (one long column); FILTER_BITS / 8 bytes, however many there are."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(_hashes(batch.column(0).to_numpy()))
            yield pa.RecordBatch.from_arrays([pa.array((at // np.uint64(64)).astype(np.int32)), pa.array((np.uint64(1) << (at % np.uint64(64))).view(np.int64))], names=["w", "bits"])

    words = ids.mapInArrow(run, "w int, bits long").groupBy("w").agg(F.expr("bit_or(bits)").alias("bits")).toArrow()
    out = np.zeros(FILTER_BITS // 64, np.uint64)
    out[words["w"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    return out


def verify(docs: DataFrame, pairs: DataFrame, holders: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of classes that are at least `percent` alike, by the whole texts of their holders (cls, low).

    Only texts that a filter of fixed size lets pass are moved; a class has one holder.
    """
    need = settle(pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct().join(holders, "cls").select("cls", "low"), "need")
    told = docs.sparkSession.sparkContext.broadcast(_filter_of(need.select("low")))

    @tidy
    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, seen = told.value, set()
        for batch in batches:
            at = _hashes(batch.column(0).to_numpy())
            hit = (bits[(at // np.uint64(64)).astype(np.int64)] >> (at % np.uint64(64))) & np.uint64(1)
            for part, sets in _sets_of(batch.take(pa.array(np.flatnonzero(hit)))):
                ids, low = [set_id(s) if len(s) else None for s in sets], part.column(0).to_pylist()
                keep = [i for i, k in enumerate(zip(ids, low)) if k[0] is not None and k not in seen and not seen.add(k)]
                if keep:
                    yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in keep], pa.int64()), *[c.take(pa.array(keep)) for c in part.columns]], names=["cls", "low", "text"])

    @tidy
    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "ta", 1 << 20):
                cols = {n: part.column(i) for i, n in enumerate(part.schema.names)}
                known: dict[str, np.ndarray] = {}
                texts = list(dict.fromkeys([*cols["ta"].to_pylist(), *cols["tb"].to_pylist()]))
                known = dict(zip(texts, shingle_sets(*utf8(pa.array(texts, pa.large_string())))))
                good = []
                for x, y in zip(cols["ta"].to_pylist(), cols["tb"].to_pylist()):
                    s, t = known[x], known[y]
                    o = len(s) + len(t) - len(np.union1d(s, t))
                    good.append(100 * o >= percent * (len(s) + len(t) - o))
                yield part.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    texts = docs.select("low", "text").mapInArrow(pick, "cls long, low long, text string")
    held = pairs.select("a", "b").join(need.select(F.col("cls").alias("a"), F.col("low").alias("la")), "a").join(need.select(F.col("cls").alias("b"), F.col("low").alias("lb")), "b")
    one = held.join(texts.select(F.col("cls").alias("a"), F.col("low").alias("la"), F.col("text").alias("ta")), ["a", "la"])
    two = one.join(texts.select(F.col("cls").alias("b"), F.col("low").alias("lb"), F.col("text").alias("tb")), ["b", "lb"]).select("a", "b", "ta", "tb")
    return two.mapInArrow(alike, "a long, b long")


def _cross(long: DataFrame, short: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) across components from long lists, in blocks of HEAVY postings a side at most.

    Texts that share l shingles of their prefixes share one before which each has l - 1
    others that it can share at all: only there is a pair made. What a text may share
    is told by its place (`nth`) among its postings in lists of several components, and
    by the shingles its short lists share.
    """

    @tidy
    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                rows = np.frombuffer(raw, _POSTING)
                yield pa.RecordBatch.from_arrays([pa.array(rows["token"].view(np.int64)), *[pa.array(rows[c].copy()) for c in ("cls", "n", "at", "l")]], names=["token", "cls", "n", "at", "l"])

    rows = long.select("postings").mapInArrow(unpack, "token long, cls long, n int, at int, l int")
    rows = rows.join(labels, rows["cls"] == labels["node"], "left").select("token", "cls", "n", "at", "l", F.coalesce("label", "cls").alias("label"))
    rows = settle(rows, "long")
    lists = rows.groupBy("token").agg(F.count("*").alias("size"), F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select(F.col("token").alias("t"), F.ceil(F.col("size") / HEAVY).cast("int").alias("ways"))
    mixed = rows.join(lists, rows["token"] == lists["t"])
    shared = short.select(F.explode(F.array("a", "b")).alias("s_cls"), "c").groupBy("s_cls").agg(F.sum("c").alias("s"))
    mixed = mixed.join(shared, mixed["cls"] == shared["s_cls"], "left")
    nth = F.row_number().over(Window.partitionBy("cls").orderBy("at")) + F.least(F.coalesce("s", F.lit(0)), F.lit(LONGEST))
    # Blocks (i, j), i <= j, of a list cut in `ways`: row i of the square, or column i.
    way = F.pmod(F.xxhash64("cls"), F.col("ways")).cast("int")
    mixed = mixed.withColumns({"nth": nth.cast("int"), "way": way}).filter("nth >= 1").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("ways") - 1)))
    mixed = mixed.select("token", "cls", "n", "at", "l", "label", "nth", F.least("way", "other").alias("i"), F.greatest("way", "other").alias("j"), "way")

    def run(key, table):
        rows = np.empty(table.num_rows, _POSTING)
        for c in ("cls", "n", "at", "l"):
            rows[c] = table[c].to_numpy()
        label, way, nth = (table[c].to_numpy() for c in ("label", "way", "nth"))
        diagonal = key[1].as_py() == key[2].as_py()
        order = np.argsort(rows["n"], kind="stable")
        rows, label, way, nth = rows[order], label[order], way[order], nth[order]
        found, n = [], rows["n"]
        for i in range(len(rows)):
            # Sizes ascend: partners after i up to n / 0.8.
            stop = int(np.searchsorted(n, n[i] * 100 // percent, "right"))
            y = np.flatnonzero((label[i + 1 : stop] != label[i]) & (diagonal | (way[i + 1 : stop] != way[i]))) + i + 1
            y = y[np.minimum(nth[i], nth[y]) >= np.minimum(rows["l"][i], rows["l"][y])]
            if len(y):
                x = np.repeat(rows[i], len(y))
                good = _fit(x, rows[y], percent)
                found.append((x[good], rows[y[good]]))
        a, b, _, _ = _count_pairs(found)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return mixed.groupBy("token", "i", "j").applyInArrow(run, "a long, b long")


def near_groups(docs: DataFrame, percent: int = 80) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, n_shingles, component_id (the least doc_id reachable by links).

    A null or wordless text has no shingles and is linked with nothing: its component
    is its own doc_id. Rows of equal texts are one class, so repeats cost no pairs.
    A null doc_id stays null in the result but its row takes part. Extra columns are ignored.
    """
    return linked_rows(docs, percent).select("doc_id", "n_shingles", "component_id")


def linked_rows(docs: DataFrame, percent: int = 80, keep: tuple[str, ...] = ()) -> DataFrame:
    """near_groups with `label`, which tells groups apart whatever their doc_ids (null without words), and the long columns `keep`."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *keep, F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)).cast("long")).alias("low"))
    base = settle(class_sizes(docs, keep), "sets")
    total = base.agg(F.coalesce(F.sum("n_shingles"), F.lit(0))).first()[0]
    known = frequent_shingles(docs)
    holders = base.filter("cls is not null").groupBy("cls").agg(F.min(F.coalesce("doc_id", F.lit(-(2**63)).cast("long"))).alias("low"))
    buckets = max(32, int(total * (1 - percent / 100 + 0.02) * _POSTING.itemsize) // BUCKET_BYTES)
    step = settle(_pairs(_pack_postings(docs, known, percent, buckets), percent), "pairs")
    short = settle(step.filter("kind = 0").groupBy("a", "b").agg(F.max("l").alias("l"), F.sum("c").alias("c")), "short")
    first = short.filter("c >= l").select("a", "b").union(step.filter("kind = 1").select("a", "b")).distinct()
    first = settle(first, "first")
    links = settle(verify(docs, first, holders, percent), "links")
    labels = settle(label_components(links), "labels")
    more = settle(_cross(step.filter("kind = 2"), short, labels, percent).distinct(), "more")
    if more.limit(1).count():
        side = lambda c: labels.select(F.col("node").alias(f"__{c}"), F.col("label").alias(f"l{c}"))
        every = more.join(first, ["a", "b"], "left_anti")
        every = every.join(side("a"), every["a"] == F.col("__a"), "left").join(side("b"), F.col("b") == F.col("__b"), "left")
        second = settle(every.filter(F.coalesce("la", "a") != F.coalesce("lb", "b")).select("a", "b"), "second")
        if second.limit(1).count():
            links = settle(links.union(verify(docs, second, holders, percent)), "links")
            labels = settle(label_components(links), "labels")
    # Classes have copies too: a component's least doc_id is over all rows of its classes.
    low = base.filter("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("low"))
    named = low.join(labels, low["cls"] == labels["node"], "left").select("cls", "low", F.coalesce("label", "cls").alias("label"))
    named = settle(named, "classes")
    least = named.groupBy("label").agg(F.min("low").alias("component_id")).withColumnRenamed("label", "__l")
    by_class = named.join(least, named["label"] == least["__l"]).select(F.col("cls").alias("__c"), "component_id", "label")
    joined = base.join(by_class, base["cls"] == by_class["__c"], "left")
    return joined.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), "label", *keep)
