"""Fill-in-the-middle texts: cut a text at two unit ends and put the middle last.

A unit is a word with the white space before it; white space at the end of a
text is a unit too. Where unit ``k`` ends is found in a Fenwick tree over the
text's blocks of a fixed number of bytes, whose nodes count unit ends and code
points: a descent by halving steps finds the block, and only that block is
looked through. Work on a text is linear in its bytes, whatever its length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lapsekit.llm.buffers import parts, text_bytes, tidy

SEED = 42
#: Per cent of the texts that are rearranged, and per cent of those with the suffix first.
RATE, SUFFIX_FIRST = 50, 80
#: Bytes of a block.
BLOCK = 1024
# What stands before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

_MARKS = tuple(mark.encode() for mark in (PREFIX, SUFFIX, MIDDLE))
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True


class UnitIndex:
    """Fenwick trees of one text: unit ends and code points by block."""

    def __init__(self, ends: np.ndarray, leads: np.ndarray, counts: np.ndarray) -> None:
        """``ends``, ``leads``: per byte, whether a unit ends and whether a code point starts; ``counts``: their sums per block."""
        self.ends, self.leads = ends, leads
        n = len(counts)
        upto = np.zeros((n + 1, 2), np.int64)
        np.cumsum(counts, axis=0, out=upto[1:])
        node = np.arange(n + 1)
        # Node i holds the sums of the blocks from i - lowest set bit of i to i - 1.
        self.tree = upto - upto[node - (node & -node)]
        self.n = n
        self.units, self.points = (int(x) for x in upto[-1])

    def cut(self, k: int) -> tuple[int, int]:
        """(byte, code point) after the first ``k`` units."""
        if k <= 0:
            return 0, 0
        block, before, points = 0, 0, 0
        step = 1 << (self.n.bit_length() - 1)
        while step:
            after = block + step
            if after <= self.n and before + self.tree[after, 0] < k:
                block, before, points = after, before + int(self.tree[after, 0]), points + int(self.tree[after, 1])
            step >>= 1
        low = block * BLOCK
        inside = np.flatnonzero(self.ends[low : low + BLOCK])[k - before - 1] + 1
        return low + int(inside), points + int(np.count_nonzero(self.leads[low : low + inside]))


def unit_indexes(data: np.ndarray, bounds: np.ndarray) -> Iterator[UnitIndex | None]:
    """The index of every text of ``data``; None for an empty one."""
    if not len(data):
        yield from (None for _ in range(len(bounds) - 1))
        return
    white = _WHITE[data]
    ends = ~white
    ends[:-1] &= white[1:]
    filled = np.flatnonzero(np.diff(bounds) > 0)
    # Every text ends with a unit, and no unit goes on into the next text.
    last = bounds[1:][filled] - 1
    ends[last] = True
    leads = (data & 0xC0) != 0x80
    blocks = -(-np.diff(bounds)[filled] // BLOCK)
    first = np.cumsum(blocks) - blocks
    starts = np.repeat(bounds[:-1][filled], blocks) + (np.arange(blocks.sum()) - np.repeat(first, blocks)) * BLOCK
    counts = np.stack([np.add.reduceat(x, starts, dtype=np.int64) for x in (ends, leads)], axis=1)
    at = 0
    for start, end in zip(bounds[:-1], bounds[1:]):
        if start == end:
            yield None
            continue
        n = -(-int(end - start) // BLOCK)
        yield UnitIndex(ends[start:end], leads[start:end], counts[at : at + n])
        at += n


def draws(seed: int, key: object) -> list[int]:
    """Four 32-bit numbers that follow from seed and key; a null key is an empty one."""
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).digest()
    return [int.from_bytes(digest[i : i + 4], "big") for i in range(0, 16, 4)]


def _rearranged(seed: int, rate: int, suffix_first: int):
    fields = [("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64())]

    def one(key: object, raw: bytes, index: UnitIndex | None) -> tuple:
        n = index.units if index else 0
        if index is None or any(mark in raw for mark in _MARKS):
            return n, "plain", None, None, raw
        h1, h2, h3, h4 = draws(seed, key)
        if h3 % 100 >= rate:
            return n, "plain", None, None, raw
        low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
        (a, a_points), (b, b_points) = index.cut(low), index.cut(high)
        prefix, middle, suffix = raw[:a], raw[a:b], raw[b:]
        p, s, m = _MARKS
        if h4 % 100 < suffix_first:
            return n, "spm", a_points, b_points - a_points, b"".join((s, suffix, p, prefix, m, middle))
        return n, "psm", a_points, b_points - a_points, b"".join((p, prefix, s, suffix, m, middle))

    def rearrange(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, 1):
                data, bounds = text_bytes(part.column(1))
                rows = [
                    one(key, data[start:end].tobytes(), index)
                    for key, start, end, index in zip(part.column(0).to_pylist(), bounds[:-1], bounds[1:], unit_indexes(data, bounds))
                ]
                columns = [pa.array([row[i] for row in rows], kind) for i, (_, kind) in enumerate(fields)]
                output = pa.array([row[-1] for row in rows], pa.binary()).view(pa.string())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *columns, output], names=["key", *(name for name, _ in fields), "output"]
                )

    return rearrange


def fill_in_middle(
    df: DataFrame, key: str = "doc_id", text: str = "text", seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST
) -> DataFrame:
    """One row per row of ``df``: key, n (units), form, prefix_chars, middle_chars, output.

    ``form`` is ``plain`` (the text as it is), ``psm`` or ``spm``, by the order
    of prefix, suffix and middle in ``output``. A null text is empty; an empty
    one, and one that holds a mark, is plain. Cuts follow from seed and key
    alone, so repeated rows have equal results; rows without a key are cut
    alike. An empty table gives no row; other columns are left out.
    """
    slim = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = slim.schema["key"].dataType.simpleString()
    fields = f"key {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"
    return slim.mapInArrow(tidy(_rearranged(seed, rate, suffix_first)), fields).withColumnRenamed("key", key)


def restored(output: Column, form: Column) -> Column:
    """The text that ``output`` was made of."""
    # The marks of a rearranged text are the only ones in it: nothing, then the three parts in their order.
    part = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    return (
        F.when(form == "psm", F.concat(part[1], part[3], part[2]))
        .when(form == "spm", F.concat(part[2], part[3], part[1]))
        .otherwise(output)
    )


def fill_in_middle_digest(df: DataFrame) -> DataFrame:
    """Per row: units, form, lengths, and digests of the output and of the text rebuilt from it."""
    return fill_in_middle(df).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )
