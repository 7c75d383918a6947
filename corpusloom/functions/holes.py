"""Holes in sequences of ids: non-overlapping spans, each replaced by one id, at any places or at given ones."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Ids of a part of a batch.
PART_IDS = 500_000

HOLED = "input array<int>, starts array<int>, positions array<int>, labels array<int>, lengths array<int>"


def place_holes(seq: np.ndarray, allowed: list[int] | None, rng: np.random.Generator, ids: dict[str, int], share: float, most: int, longest: int) -> tuple[list[int], list[tuple[int, int]]]:
    """The sequence with holes, of its length, and the holes (start, length) from left to right.

    Places are tried in a random order until the holes hide min(most, max(1, share of the ids)) ids, where an empty hole
    counts as one. A hole begins at its place (or ends there, for a whole sequence at once by a coin) and is as long as
    drawn (0 to ``longest``), less what other holes, start and end ids and the sequence's ends leave. A hole that
    would push ids over the end isn't made."""
    pad = np.flatnonzero(seq == ids["pad"])
    n = int(pad[0]) if len(pad) else len(seq)
    inner = [k for k in range(n) if seq[k] not in (ids["start"], ids["end"])]
    free = np.zeros(n, bool)
    free[inner] = True
    target = min(most, max(1, round(n * share)))
    left = bool(rng.integers(2))
    wanted = inner if allowed is None else sorted({k for k in allowed if 0 <= k < n and free[k]})
    holes: list[tuple[int, int]] = []
    hidden, size = 0, n
    for k in (wanted[i] for i in rng.permutation(len(wanted))):
        if hidden >= target:
            break
        length = int(rng.integers(longest + 1))
        if not free[k]:
            continue
        reach = 0
        while reach < length and 0 <= (j := k - reach if left else k + reach) < n and free[j]:
            reach += 1
        if size + 1 - reach > len(seq):
            continue
        start = k - reach + 1 if left and reach else k
        free[start : start + reach] = False
        free[k] = False  # no second hole at one place
        holes.append((start, reach))
        hidden, size = hidden + max(1, reach), size + 1 - reach
    out: list[int] = []
    at = 0
    for start, length in sorted(holes):
        out += [*seq[at:start].tolist(), ids["hole"]]
        at = start + length
    out += seq[at:n].tolist()
    return out + [ids["pad"]] * (len(seq) - len(out)), sorted(holes)


def pooled_holes(df: DataFrame, key: str, ids: str, seed: Column, special: dict[str, int], share: float = 0.15, most: int = 20, longest: int = 5, places: str | None = None) -> DataFrame:
    """(key, input, starts, positions, labels, lengths) of every row: the sequence with holes, and of each hole where it
    begins in ``ids`` and stands in ``input``, the first id it hides (of an empty hole the "endhole" id) and how many.

    special: ids of pad, start, end, hole and endhole. ``places``: a column of the starts that holes are restricted to (such
    as places to repair), else any. All follows from the row's seed, so a row that is computed again is the same. A null or
    empty sequence, and one without a place, has no holes."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows with PART_IDS ids together, or a row with more: what a task holds as Python numbers."""
        for batch in batches:
            sizes = np.array(batch.column(1).value_lengths().fill_null(0).to_pylist(), np.int64)
            part = np.concatenate([[0], np.cumsum(sizes)[:-1]]) // PART_IDS if len(sizes) else sizes
            cuts = [*np.flatnonzero(np.append(True, part[1:] != part[:-1])), len(sizes)] if len(sizes) else [0]
            yield from (batch.slice(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False))

    def holed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            columns: list[list] = [[] for _ in range(5)]
            for whole, where, s in zip(batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                seq = whole.values.to_numpy(zero_copy_only=False).astype(np.int64) if whole.is_valid else np.empty(0, np.int64)
                out, holes = place_holes(seq, where if places else None, np.random.default_rng((s or 0) & (1 << 64) - 1), special, share, most, longest) if len(seq) else ([], [])
                shift = np.cumsum([0, *(1 - n for _, n in holes)])
                row = (out, [k for k, _ in holes], [int(k + d) for (k, _), d in zip(holes, shift, strict=False)], [int(seq[k]) if n else special["endhole"] for k, n in holes], [n for _, n in holes])
                for c, x in zip(columns, row, strict=True):
                    c.append(pa.array(x, pa.int32()))
            names = ["input", "starts", "positions", "labels", "lengths"]
            lists = (pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, c)]), pa.int32()), pa.concat_arrays(c)) for c in columns)
            yield pa.RecordBatch.from_arrays([batch.column(0), *lists], names=[key, *names])

    where = F.coalesce(places, F.array().cast("array<int>")) if places else F.array().cast("array<int>")
    return df.select(key, ids, where.alias("_places"), seed.cast("long").alias("_seed")).mapInArrow(holed, f"{key} {dict(df.dtypes)[key]}, {HOLED}")
