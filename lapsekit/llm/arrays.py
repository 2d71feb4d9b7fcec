"""SQL of array expressions whose cost grows with the length of the array, not its square.

They are texts, for ``F.expr``: deep expressions are put together far faster so
than column by column.
"""

from __future__ import annotations

#: Elements that are added up by one fold; appending to an array copies it, so folds are kept short.
FOLD = 64


def let(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` for a value that is worked out once, however often the body, or a function in it, names it."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def _running(values: str, start: str) -> str:
    return (
        f"aggregate({values}, named_struct('at', {start}, 'sums', CAST(array() AS array<bigint>)),"
        " (s, x) -> named_struct('at', s.at + x, 'sums', concat(s.sums, array(s.at))), s -> s.sums)"
    )


def sums_before(values: str) -> str:
    """For every element of an array of bigint the sum of those before it."""
    blocks = f"sequence(0, CAST(floor(greatest(size(all_values) - 1, 0) / {FOLD}) AS int))"
    block = f"slice(all_values, b * {FOLD} + 1, {FOLD})"
    totals = f"transform({blocks}, b -> aggregate({block}, 0L, (t, x) -> t + x))"
    parts = f"flatten(transform({blocks}, b -> {_running(block, 'get(starts, b)')}))"
    return let(values, "all_values", let(_running(totals, "0L"), "starts", parts))
