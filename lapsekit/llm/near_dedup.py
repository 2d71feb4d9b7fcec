"""Near duplicates by BagMinHash: weighted Jaccard similarity of the multisets of word windows.

A window's weight is how often it stands in the text. Points fall on the
weights (0, w] of every window as a Poisson process; a signature holds, for
each of its components, the earliest point that the text's weights cover, so
that two signatures agree in a component with the probability of the weighted
similarity. Weights are cut into shells (0, 1], (1, 2], (2, 4], ...; a shell's
points are drawn from its own process until they come too late for any
component, and a point beyond the weight is left out.

Signatures are cut into bands; texts that share a band's values are compared
by their multisets. No bucket is expanded into pairs: its members are compared
with the one that meets most texts in all its buckets. Members still apart then
meet in blocks of bounded size, inside a task, which hands on similar pairs only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from lapsekit.llm.buffers import tidy
from lapsekit.llm.components import components
from lapsekit.llm.words import WordHashes, mixed, windows
from lapsekit.session import stage

WIDTH, SIMILAR = 5, 0.8
#: 24 bands of 5 components: a pair of similarity 0.8 shares none in 7 cases of 100,000.
BANDS, ROWS = 24, 5
COMPONENTS = BANDS * ROWS
#: Pairs whose signatures agree in less than this share are not compared; at similarity 0.8 that is
#: five standard deviations away.
LEAST_AGREEMENT = 0.62
#: Windows that are drawn for at once.
CHUNK = 200_000
#: Members of a bucket that meet as many others in one task.
BLOCK = 256
#: Keys up to this number are sent to all executors to find their texts; more are joined.
BROADCAST_KEYS = 500_000
_ONE = np.uint64(1)


def _uniform(x: np.ndarray) -> np.ndarray:
    """In (0, 1], from the upper 53 bits."""
    return ((x >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53


def signatures(items: list[tuple[np.ndarray, np.ndarray]], m: int = COMPONENTS) -> np.ndarray:
    """Signature (row of ``m`` times) of each (distinct hashes, counts)."""
    times = np.full((len(items), m), np.inf)
    flat = times.ravel()
    if not items:
        return times
    doc = np.repeat(np.arange(len(items)), [len(h) for h, _ in items])
    hashes = np.concatenate([h for h, _ in items])
    counts = np.concatenate([c for _, c in items]).astype(np.int64)
    for begin in range(0, len(hashes), CHUNK):
        d, h, w = (x[begin : begin + CHUNK] for x in (doc, hashes, counts))
        shell = 0
        while len(d):
            low, high = (1 << shell) >> 1, 1 << shell
            _draw(flat, times, d, mixed(h + np.uint64(shell * 0xD1342543DE82EF95 % (1 << 64))), w, low, high - low, m)
            more = w > high
            d, h, w, shell = d[more], h[more], w[more], shell + 1
    return times


def _draw(flat: np.ndarray, times: np.ndarray, d: np.ndarray, seed: np.ndarray, w: np.ndarray, low: int, span: int, m: int) -> None:
    """Points of one shell (low, low + span] of the given elements, each until it is too late for its text."""
    t = np.zeros(len(d))
    step = np.uint64(0x9E3779B97F4A7C15)
    while len(d):
        seed = seed + step
        draw = mixed(seed)
        t = t - np.log(_uniform(draw)) / (m * span)
        latest = np.full(len(times), -np.inf)
        present = np.unique(d)
        latest[present] = times[present].max(axis=1)
        open_ = t < latest[d]
        d, seed, w, t, draw = d[open_], seed[open_], w[open_], t[open_], draw[open_]
        where = mixed(draw ^ step)
        component = ((where >> np.uint64(32)) % np.uint64(m)).astype(np.int64)
        level = low + 1 + (where & np.uint64(0xFFFFFFFF)).astype(np.int64) * span // (1 << 32)
        covered = level <= w
        np.minimum.at(flat, d[covered] * m + component[covered], t[covered])


def band_keys(times: np.ndarray) -> np.ndarray:
    """One 64-bit key per band; the band's number is part of it."""
    bits = times.view(np.uint64).reshape(len(times), BANDS, ROWS)
    key = np.tile(mixed(np.arange(BANDS, dtype=np.uint64) + _ONE), (len(times), 1))
    for i in range(ROWS):
        key = mixed(key + bits[:, :, i])
    return key.view(np.int64)


def text_words(text: str | None) -> list[str]:
    """Words by which texts are compared: lower case, split at white space."""
    return (text or "").lower().split()


def multiset(words: list[str], hashes: WordHashes) -> np.ndarray:
    """Sorted 64-bit names of the windows, the n-th copy of one named apart, so that set and multiset overlap agree."""
    own = np.sort(windows(hashes(words), WIDTH))
    if not len(own):
        return own
    first = np.r_[0, np.flatnonzero(own[1:] != own[:-1]) + 1]
    copy = np.arange(len(own)) - np.repeat(first, np.diff(np.r_[first, len(own)]))
    return np.sort(np.where(copy > 0, mixed(own + copy.astype(np.uint64)), own))


_SKETCH = "key {0}, h1 bigint, h2 bigint, bands array<bigint>, sketch binary"


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Number of common elements of two ascending arrays without repeats."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    return int((b[np.minimum(at, len(b) - 1)] == a).sum())


def _unsigned(windows_list: pa.ListScalar) -> np.ndarray:
    return windows_list.values.to_numpy(zero_copy_only=False).view(np.uint64)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()

    def out(keys, digests, items) -> pa.RecordBatch:
        times = signatures(items)
        bands, some = band_keys(times), np.array([len(h) > 0 for h, _ in items])
        sketch = (mixed(times.view(np.uint64)) & np.uint64(255)).astype(np.uint8)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(keys, key_type),
                pa.array([int.from_bytes(x[:8], "big", signed=True) for x in digests], pa.int64()),
                pa.array([int.from_bytes(x[8:], "big", signed=True) for x in digests], pa.int64()),
                pa.array([b if s else [] for b, s in zip(bands, some)], pa.list_(pa.int64())),
                pa.array([s.tobytes() for s in sketch], pa.binary()),
            ],
            names=["key", "h1", "h2", "bands", "sketch"],
        )

    for batch in batches:
        key_type = batch.schema.field(0).type
        keys, digests, items, size = [], [], [], 0
        for key, text in zip(batch.column(0), batch.column(1)):
            words = text_words(text.as_py())
            item = np.unique(windows(hashes(words), WIDTH), return_counts=True)
            keys.append(key.as_py())
            digests.append(xxhash.xxh128_digest(" ".join(words).encode("utf-8", "surrogatepass")))
            items.append(item)
            size += len(item[0])
            if size >= CHUNK:
                yield out(keys, digests, items)
                keys, digests, items, size = [], [], [], 0
        if keys:
            yield out(keys, digests, items)


def _multisets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for batch in batches:
        for i in range(0, batch.num_rows, 256):
            part = batch.slice(i, 256)
            sets = [multiset(text_words(t.as_py()), hashes).view(np.int64) for t in part.column(1)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["v", "windows"])


def _agreement(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, COMPONENTS) for i in (2, 3))
            yield batch.filter(pa.array((a == b).mean(axis=1) >= LEAST_AGREEMENT)).select([0, 1])


def _similarity(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        similar = []
        for x, y in zip(batch.column(2), batch.column(3)):
            a, b = _unsigned(x), _unsigned(y)
            common = _common(a, b)
            similar.append(common / (len(a) + len(b) - common))
        out = batch.select([0, 1]).append_column("similarity", pa.array(similar, pa.float64()))
        yield out.filter(pa.array(np.array(similar) >= SIMILAR, pa.bool_()))


class _Comparison:
    """Compares pairs of texts exactly."""

    def __init__(self, texts: DataFrame, sketches: DataFrame) -> None:
        self.texts, self.sketches = texts, sketches
        self.key_type = texts.schema["key"].dataType.simpleString()

    def links(self, pairs: DataFrame) -> DataFrame:
        """(a, b, similarity) of the similar ones of ``pairs`` (a, b), a < b."""
        pairs = stage(pairs.distinct(), "pairs")
        named = f"a {self.key_type}, b {self.key_type}"
        of = lambda table, column, v, name: table.select(F.col("v").alias(v), F.col(column).alias(name))
        both = pairs.join(of(self.sketches, "sketch", "a", "sa"), "a").join(of(self.sketches, "sketch", "b", "sb"), "b")
        likely = stage(both.select("a", "b", "sa", "sb").mapInArrow(tidy(_agreement), named), "likely-pairs")
        sets = self.multisets(likely.select(F.col("a").alias("key")).unionByName(likely.select(F.col("b").alias("key"))).distinct())
        both = likely.join(of(sets, "windows", "b", "wb"), "b").join(of(sets, "windows", "a", "wa"), "a")
        return stage(both.select("a", "b", "wa", "wb").mapInArrow(tidy(_similarity), f"{named}, similarity double"), "links")

    def multisets(self, keys: DataFrame) -> DataFrame:
        """(v, windows) of the texts of these keys."""
        keys = stage(keys, "compared")
        wanted = F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys
        rows = self.texts.join(wanted, "key", "left_semi").select("key", "text")
        return stage(rows.mapInArrow(tidy(_multisets), f"v {self.key_type}, windows array<bigint>"), "multisets").dropDuplicates(["v"])


def _ordered(left: str, right: str) -> list:
    return [F.least(left, right).alias("a"), F.greatest(left, right).alias("b")]


def _meet(key: tuple, rows: pa.Table) -> pa.Table:
    """Similar pairs of different labels between two blocks of a bucket, or within one.

    A pair is looked at in its first common band only. Windows that no other
    text apart has can't be common, which bounds the similarity; then the
    sketches are compared, then the multisets.
    """
    band, first, second = (k.as_py() for k in key)
    blocks = rows["block"].to_numpy()
    v, labels = rows["v"].to_pylist(), np.unique(np.array(rows["label"].to_pylist()), return_inverse=True)[1]
    n, shared = rows["n"].to_numpy(), rows["shared"].to_numpy()
    bands = np.stack(rows["bands"].to_pylist())
    sketch = np.frombuffer(b"".join(rows["sketch"].to_pylist()), np.uint8).reshape(-1, COMPONENTS)
    sets = [_unsigned(w) for w in rows["windows"]]
    at = int(np.flatnonzero(bands[0] == band)[0])
    found = []
    others = np.flatnonzero(blocks == second)
    for i in np.flatnonzero(blocks == first):
        j = others[others > i] if first == second else others
        most = np.minimum(shared[i], shared[j])
        j = j[(labels[j] != labels[i]) & (most >= SIMILAR * (n[i] + n[j] - most))]
        j = j[~(bands[j, :at] == bands[i, :at]).any(axis=1)]
        for k in j[(sketch[j] == sketch[i]).mean(axis=1) >= LEAST_AGREEMENT]:
            common = _common(sets[i], sets[k])
            similarity = common / (n[i] + n[k] - common)
            if similarity >= SIMILAR:
                found.append((min(v[i], v[k]), max(v[i], v[k]), similarity))
    a, b, similar = zip(*found) if found else ((), (), ())
    kind = rows.schema.field("v").type
    return pa.table({"a": pa.array(a, kind), "b": pa.array(b, kind), "similarity": pa.array(similar, pa.float64())})


def _links_apart(apart: DataFrame, signed: DataFrame, compare: _Comparison) -> DataFrame:
    """Links (a, b, similarity) between members (band, v, label) of a bucket with different labels."""
    sets = compare.multisets(apart.select(F.col("v").alias("key")).distinct())
    alone = (
        sets.select("v", F.explode("windows").alias("window")).groupBy("window")
        .agg(F.min("v").alias("v"), F.max("v").alias("other")).filter("v = other")
        .groupBy("v").agg(F.count(F.lit(1)).alias("alone"))
    )
    n = F.size("windows").cast("bigint")
    members = sets.join(alone, "v", "left").withColumn("n", n).withColumn("shared", n - F.coalesce("alone", F.lit(0)))
    members = members.filter(F.col("shared") >= SIMILAR * F.col("n")).join(signed, "v")
    members = stage(members.select("v", "n", "shared", "windows", "bands", "sketch"), "members")
    here = stage(apart.join(members.select("v"), "v"), "still-apart")
    several = here.groupBy("band").agg(
        F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"), F.min("label").alias("lo"), F.max("label").alias("hi")
    ).filter("lo <> hi")
    placed = here.join(several.select("band", "blocks"), "band").withColumn("block", F.pmod(F.xxhash64("v"), F.col("blocks")).cast("int"))
    other = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    meeting = other.select(
        "band", "v", "label", "block", F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second")
    ).join(members, "v")
    return meeting.groupBy("band", "first", "second").applyInArrow(_meet, f"a {compare.key_type}, b {compare.key_type}, similarity double")


def near_duplicate_classes(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``df``: key, class_id (the least key of its class), class_size, kept.

    Texts are linked if the weighted Jaccard similarity of their windows of
    five words is 0.8 or more (a shorter text is one window); classes are the
    connected components. Texts of the same words are in one class anyway, so
    all texts without words are, null ones included. A row without a key has
    the class of a keyed row of the same words, else none, and is kept then.
    A key stands for one text. Repeated rows stay repeated; an empty table
    gives no row; other columns are left out.
    """
    slim = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    sketched = stage(slim.mapInArrow(tidy(_sketch), _SKETCH.format(slim.schema["key"].dataType.simpleString())), "sketches")
    first = sketched.groupBy("h1", "h2").agg(F.min("key").alias("v"))
    rows = stage(sketched.join(first, ["h1", "h2"]).select("key", "v", "bands", "sketch"), "sketched-rows")
    own = rows.filter("key = v")
    banded = own.select("v", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count(F.lit(1)).alias("met"))
    buckets = stage(banded.join(shared.filter("lo <> hi").select("band", "met"), "band"), "buckets")
    met = buckets.groupBy("v").agg(F.sum("met").alias("met"))
    buckets = stage(buckets.select("band", "v").join(met, "v").select("band", "v", "met"), "met-buckets")

    signed = own.select("v", "bands", "sketch").dropDuplicates(["v"])
    compare = _Comparison(slim, signed)
    centres = buckets.groupBy("band").agg(F.max(F.struct("met", "v"))["v"].alias("centre"))
    links = compare.links(buckets.join(centres, "band").filter("v <> centre").select(*_ordered("v", "centre")))
    labels = components(links)
    labelled = buckets.select("band", "v").join(labels, "v", "left").select("band", "v", F.coalesce("label", "v").alias("label"))
    split = labelled.groupBy("band").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi")
    apart = stage(labelled.join(split.select("band"), "band"), "apart")
    more = stage(_links_apart(apart, signed, compare), "more-links")
    labels = components(links.unionByName(more))
    classed = rows.select("key", "v").join(labels, "v", "left").select("key", F.coalesce("label", "v").alias("class_id"))
    sizes = classed.groupBy("class_id").count().withColumnRenamed("count", "class_size")
    return classed.join(sizes, "class_id", "left").select(
        F.col("key").alias(key), "class_id", F.coalesce("class_size", F.lit(1)).cast("bigint").alias("class_size"),
        (F.col("class_id").isNull() | (F.col("key") == F.col("class_id"))).alias("kept"),
    )


def keep_one(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``df`` without those that another of their class stands for, its columns unchanged."""
    dropped = near_duplicate_classes(df, key, text).filter("NOT kept").select(F.col(key).alias("_dropped")).distinct()
    dropped = stage(dropped, "near-duplicates")
    if dropped.count() <= BROADCAST_KEYS:
        dropped = F.broadcast(dropped)
    return df.join(dropped, F.col(key) == F.col("_dropped"), "left_anti")
