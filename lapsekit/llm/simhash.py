"""Near duplicates by SimHash: fingerprints at a small Hamming distance, found by deletion variants.

Fingerprints link at ``DISTANCE`` differing bits or fewer. Cut into three
segments, one of them differs by one bit at most, so two linked fingerprints
share a segment with the same one bit left out: every fingerprint is indexed
under all its segments with each bit left out in turn, an equality join brings
candidates together, and their distance decides. A key that too many
fingerprints share is cut in the same way once more, over the bits it has not
fixed yet, until a key's fingerprints are few or their number is bounded by
the bits that are left.

Equal fingerprints are one from the start. Within a key, no pairs are formed:
a task walks from fingerprint to fingerprint and hands on links that span
what is connected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from lapsekit.llm.buffers import parts, text_bytes, tidy
from lapsekit.llm.components import components
from lapsekit.llm.skew import look_up
from lapsekit.llm.words import mixed
from lapsekit.session import stage

WIDTH, SEED, DISTANCE = 4, 42, 4
BITS = 64
SEGMENTS = DISTANCE // 2 + 1
#: Fingerprints of one key that a task compares; more are cut further, in at most so many levels.
LIMIT, LEVELS = 4_096, 4
#: Windows hashed and counted at once.
CHUNK = 1 << 16
#: Groups up to this size are compared side by side, larger ones by a walk.
SMALL = 8


def fingerprint(text: bytes) -> int:
    """SimHash of the windows of ``WIDTH`` words, repeats included; zero without words."""
    words = text.lower().split()
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    width = min(WIDTH, n)
    starts, ends = starts[: n - width + 1].tolist(), ends[width - 1 :].tolist()
    set_bits, digest = np.zeros(BITS, np.int64), xxhash.xxh64_intdigest
    for i in range(0, len(starts), CHUNK):
        own = [digest(joined[a:b], SEED) for a, b in zip(starts[i : i + CHUNK], ends[i : i + CHUNK])]
        rows = np.array(own, "<u8").view(np.uint8).reshape(-1, 8)
        set_bits += np.unpackbits(rows, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int((2 * set_bits > len(starts)) @ (1 << np.arange(BITS, dtype=object)))


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in parts(batch, 1):
            data, bounds = text_bytes(part.column(1))
            own = np.array([fingerprint(data[a:b].tobytes()) for a, b in zip(bounds[:-1], bounds[1:])], np.uint64)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(own.view(np.int64))], names=["key", "fp"])


def variants(fixed: int) -> list[tuple[int, int]]:
    """(bit left out, bits fixed then) of every variant over the bits that ``fixed`` leaves free."""
    free = [b for b in range(BITS) if not fixed >> b & 1]
    size = -(-len(free) // SEGMENTS)
    out = []
    for i in range(0, len(free), size):
        segment = sum(1 << b for b in free[i : i + size])
        out += [(b, fixed | segment & ~(1 << b)) for b in free[i : i + size]]
    return out


def _refined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, fixed, fp) to a row per variant: its own path and fixed bits."""
    for batch in batches:
        path, fixed, fp = (batch.column(i).to_numpy(zero_copy_only=False).view(np.uint64) for i in range(3))
        for mask in np.unique(fixed):
            own = fixed == mask
            for bit, more in variants(int(mask)):
                step = mixed(path[own] + mixed(np.array([bit + 1], np.uint64)))
                masks = np.full(len(step), more, np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x.view(np.int64)) for x in (step, masks, fp[own])], names=["path", "fixed", "fp"]
                )


def spanning_links(members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links between ``members`` (distinct uint64) that connect what is connected by links, one less than there are members at most."""
    rest, queue, a, b = members, [], [], []
    while len(rest) or queue:
        if not queue:
            queue, rest = [rest[0]], rest[1:]
        here = queue.pop()
        near = np.bitwise_count(rest ^ here) <= DISTANCE
        found = rest[near]
        if len(found):
            a.append(np.full(len(found), here))
            b.append(found)
            queue.extend(found)
            rest = rest[~near]
        if not len(rest):
            break
    none = np.zeros(0, np.uint64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of rows (key, fp) sorted by key; only one key's rows are kept from batch to batch."""

    def links(keys: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        sizes = np.diff(np.r_[starts, len(keys)])
        found = []
        in_small = np.repeat(sizes <= SMALL, sizes)
        for apart in range(1, min(SMALL, len(keys))):
            i = np.flatnonzero((keys[apart:] == keys[:-apart]) & in_small[apart:])
            if not len(i):
                break
            i = i[np.bitwise_count(fps[i] ^ fps[i + apart]) <= DISTANCE]
            found.append((fps[i], fps[i + apart]))
        for start, size in zip(starts[sizes > SMALL], sizes[sizes > SMALL]):
            found.append(spanning_links(np.unique(fps[start : start + size])))
        if found:
            a, b = (np.concatenate([pair[i] for pair in found]).view(np.int64) for i in (0, 1))
            differ = a != b
            a, b = a[differ], b[differ]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    keys, fps = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.concatenate([keys, batch.column(0).to_numpy()])
        fps = np.concatenate([fps, batch.column(1).to_numpy().view(np.uint64)])
        whole = int(np.searchsorted(keys, keys[-1])) if keys[0] != keys[-1] else 0
        if whole:
            yield from links(keys[:whole], fps[:whole])
            keys, fps = keys[whole:], fps[whole:]
    if len(keys):
        yield from links(keys, fps)


def _first_keys(fps: DataFrame) -> DataFrame:
    """(key, fp) of the variants of all fingerprints; the bit left out stands in the key's upper bits."""
    keys = []
    for bit, fixed in variants(0):
        low = (fixed & -fixed).bit_length() - 1 if fixed else 0
        low = min(low, bit)
        value = F.shiftrightunsigned("fp", low).bitwiseAND(F.lit(fixed >> low))
        keys.append(F.lit(bit << 32).bitwiseOR(value))
    return fps.select("fp", F.explode(F.array(*keys)).alias("key")).select("key", "fp")


def fingerprint_links(fps: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Links (a, b), a < b, that connect the fingerprints ``fp`` (distinct, stored) as all links do."""

    def compared(keyed: DataFrame) -> DataFrame:
        placed = keyed.select("key", "fp").repartition("key").sortWithinPartitions("key")
        return placed.mapInArrow(tidy(_compared), "a bigint, b bigint").distinct()

    keyed = _first_keys(fps)
    masks = {bit: fixed for bit, fixed in variants(0)}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    found = []
    for level in range(1, LEVELS + 1):
        # More than ``limit`` fingerprints have such a key, so there are at most 64 in ``limit`` of the first level's rows.
        crowded = None
        if level < LEVELS:
            crowded = stage(keyed.groupBy("key").count().filter(F.col("count") > limit).select("key"), "crowded-keys")
            crowded = None if crowded.isEmpty() else crowded
        if crowded is None:
            found.append(stage(compared(keyed), "simhash-links"))
            break
        found.append(stage(compared(keyed.join(crowded, "key", "left_anti")), "simhash-links"))
        again = keyed.join(crowded, "key", "left_semi")
        if level == 1:
            of_bit = F.element_at(
                F.create_map(*(x for bit, fixed in masks.items() for x in (F.lit(bit), F.lit(signed(fixed))))), F.shiftright("key", 32).cast("int")
            )
            again = again.select(F.col("key").alias("path"), of_bit.alias("fixed"), "fp")
        else:
            again = again.select(F.col("key").alias("path"), "fixed", "fp")
        refined = again.mapInArrow(tidy(_refined), "path bigint, fixed bigint, fp bigint")
        rest = F.col("fp").bitwiseAND(F.col("fixed"))
        keyed = stage(refined.select(F.xxhash64("path", rest).alias("key"), "fixed", "fp"), "simhash-keys")
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return every


def simhash_components(df: DataFrame, key: str = "doc_id", text: str = "text", limit: int = LIMIT) -> DataFrame:
    """One row per row of ``df``: key, fp (bigint), component_id (the least key reachable over links).

    Words are split at ASCII white space after lower-casing A-Z. A null or
    empty text has fingerprint 0 and links like any other. Rows without a key
    take part; a component without any key has a null id. Repeated rows stay
    repeated; an empty table gives no row; other columns are left out.
    """
    slim = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = slim.schema["key"].dataType.simpleString()
    rows = stage(slim.mapInArrow(tidy(_fingerprints), f"key {kind}, fp bigint"), "fingerprints")
    fps = stage(rows.groupBy("fp").agg(F.min("key").alias("least"), F.count(F.lit(1)).alias("n")), "distinct-fingerprints")
    labels = components(fingerprint_links(fps.select("fp"), limit)).withColumnRenamed("v", "fp")
    of_label = labels.join(fps, "fp").groupBy("label").agg(F.min("least").alias("component"))
    linked = labels.join(of_label, "label").select("fp", "component")
    answers = stage(
        fps.join(linked, "fp", "left").select("fp", "n", F.least("component", "least").alias("component_id")), "simhash-answers"
    )
    return look_up(rows, answers, "fp", "n").select(F.col("key").alias(key), "fp", "component_id")


def simhash_digest(df: DataFrame) -> DataFrame:
    """Per row: the fingerprint as 16 hex digits, and its component."""
    return simhash_components(df).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
