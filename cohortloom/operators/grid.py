"""Dense work on one scan (or one region of a scan) inside a task: components by runs, component trees, co-occurrence.

Spark sorts the voxels by scan inside its partitions and gives them to a function as Arrow tables of whole scans; the grid of a
scan is bounded by the reader. Scans with the same layout are stacked, so many small ones cost no more than their voxels.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

POS = ("z", "y_", "x")

#: Rows of a step through a partition; a step holds one whole scan at least.
STEP_ROWS = 1 << 17


def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole scans from a partition that is sorted by uid."""
    held, rows = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows >= STEP_ROWS:
            table = pa.Table.from_batches(held)
            uid = table.column("uid")
            last = pa.compute.index(uid, uid[-1]).as_py() if uid[-1].is_valid else 0
            if last:
                yield table.slice(0, last)
            held, rows = table.slice(last).to_batches(), table.num_rows - last
    if held:
        yield pa.Table.from_batches(held)


def codes(column: pa.ChunkedArray) -> tuple[np.ndarray, list]:
    """Numbers that stand for the values of a column, and the values."""
    column = pa.concat_arrays(column.chunks).dictionary_encode(null_encoding="encode")
    return column.indices.to_numpy().astype(np.int64), column.dictionary.to_pylist()


def stacks(groups: Sequence[np.ndarray], layout: Sequence[np.ndarray]) -> Iterator[np.ndarray]:
    """Groups of rows that agree in ``layout`` cell by cell, as matrices of row numbers: groups x cells, cells in the order of
    the layout. What depends on the layout alone is found once for a stack."""
    order = np.lexsort((*layout[::-1], *groups[::-1]))
    new = np.zeros(len(order), dtype=bool)
    new[:1] = True
    for g in groups:
        new[1:] |= g[order[1:]] != g[order[:-1]]
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(order)))
    for n in np.unique(size):
        at = order[first[size == n][:, None] + np.arange(n)]
        flat = np.ascontiguousarray(np.concatenate([c[at] for c in layout], axis=1, dtype=np.int64))
        whole = flat.view(np.dtype((np.void, flat.itemsize * flat.shape[1]))).ravel()
        _, kind, times = np.unique(whole, return_inverse=True, return_counts=True)
        yield from np.split(at[np.argsort(kind, kind="stable")], np.cumsum(times)[:-1])


def quantiles(values: np.ndarray, ps: Sequence[float]) -> np.ndarray:
    """Linear-interpolated quantiles of each row: rows x ``ps``."""
    ordered = np.sort(values, axis=1)
    place = np.array(ps) * (values.shape[1] - 1)
    low = np.floor(place).astype(int)
    below, above = ordered[:, low], ordered[:, np.ceil(place).astype(int)]
    return below + (above - below) * (place - low)


def mean_ranks(values: np.ndarray) -> np.ndarray:
    """Rank of every value in its row, ties averaged."""
    order = np.argsort(values, axis=1, kind="stable")
    ordered, n = np.take_along_axis(values, order, axis=1), values.shape[1]
    new = np.ones(values.shape, dtype=bool)
    new[:, 1:] = ordered[:, 1:] != ordered[:, :-1]
    end = np.ones(values.shape, dtype=bool)
    end[:, :-1] = new[:, 1:]
    number = np.arange(n)
    first = np.maximum.accumulate(np.where(new, number, 0), axis=1)
    last = np.minimum.accumulate(np.where(end, number, n)[:, ::-1], axis=1)[:, ::-1]
    out = np.empty(values.shape)
    np.put_along_axis(out, order, (last + 1) - (last - first) / 2, axis=1)
    return out


def places(table: pa.Table) -> tuple[tuple[np.ndarray, ...], tuple[int, ...]]:
    """Positions of the rows inside their bounding box, and its shape."""
    at = [np.asarray(table.column(c)).astype(np.int64) for c in POS]
    low = [int(a.min()) for a in at]
    at = tuple(a - b for a, b in zip(at, low, strict=True))
    return at, tuple(int(a.max()) + 1 for a in at)


def find(parent: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """Roots of the nodes."""
    root = parent[nodes]
    while True:
        up = parent[root]
        if (up == root).all():
            return root
        root = up


def unite(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Joins the trees of each pair under the smallest root; returns the roots that were touched and what became of them."""
    a, b = find(parent, a), find(parent, b)
    touched = np.unique(np.concatenate([a, b]))
    while True:
        apart = a != b
        if not apart.any():
            break
        a, b = a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        a, b = find(parent, a), find(parent, b)
    roots = find(parent, touched)
    parent[touched] = roots
    return touched, roots


def runs(active: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of active voxels along x in raster order: line (z, y), first x and the x behind the last."""
    lines = active.reshape(-1, active.shape[2])
    edge = np.zeros((len(lines), active.shape[2] + 1), dtype=np.int8)
    edge[:, 1:] -= lines
    edge[:, :-1] += lines
    line, first = np.nonzero(edge == 1)
    return line, first, np.nonzero(edge == -1)[1]


def touching(line: np.ndarray, first: np.ndarray, last: np.ndarray, width: int, step: int, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of runs that overlap, one in an ``allowed`` line and one ``step`` lines behind it."""
    starts, ends = line * (width + 1) + first, line * (width + 1) + last
    mine = np.flatnonzero(allowed)
    there = (line[mine] + step) * (width + 1)
    low = np.searchsorted(ends, there + first[mine], side="right")
    high = np.maximum(np.searchsorted(starts, there + last[mine], side="left"), low)
    n = high - low
    other = np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
    return np.repeat(mine, n), other


def label(active: np.ndarray) -> np.ndarray:
    """Numbers 1.. of the 6-neighbour components in raster order of their first voxels, 0 outside."""
    out = np.zeros(active.shape, dtype=np.int32)
    line, first, last = runs(active)
    if not len(line):
        return out
    ny, nx = active.shape[1:]
    parent = np.arange(len(line))
    inside = touching(line, first, last, nx, 1, line % ny != ny - 1)
    across = touching(line, first, last, nx, ny, np.ones(len(line), dtype=bool))
    unite(parent, *(np.concatenate(pair) for pair in zip(inside, across, strict=True)))
    heads, number = np.unique(find(parent, np.arange(len(line))), return_inverse=True)
    out[active] = np.repeat(number + 1, last - first)
    return out


def component_trees(level: np.ndarray, levels: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(components, size of the largest, active voxels) of every scan of a stack (the first axis) for every threshold
    1 .. ``levels``; a voxel is active up to its level.

    Edges enter in falling order of their lower level, so each is met once for all thresholds and the trees only grow.
    """
    flat, number = level.ravel(), np.arange(level.size).reshape(level.shape)
    a, b = [], []
    for axis in range(1, 4):
        one, two = np.moveaxis(number, axis, 0)[:-1].ravel(), np.moveaxis(number, axis, 0)[1:].ravel()
        both = (flat[one] > 0) & (flat[two] > 0)
        a.append(one[both])
        b.append(two[both])
    a, b = np.concatenate(a), np.concatenate(b)
    met = np.minimum(flat[a], flat[b])
    parent, scans = np.arange(level.size), len(level)
    cells = level.size // scans
    out = []
    for k in range(levels, 0, -1):
        here = met == k
        if here.any():
            unite(parent, a[here], b[here])
        active = np.flatnonzero(flat >= k)
        size = np.bincount(find(parent, active), minlength=level.size)
        roots = np.flatnonzero(size)
        largest = np.zeros(scans, dtype=np.int64)
        np.maximum.at(largest, roots // cells, size[roots])
        out.append((np.bincount(roots // cells, minlength=scans), largest, np.bincount(active // cells, minlength=scans)))
    return out[::-1]


def component_tree(level: np.ndarray, levels: int) -> list[tuple[int, int, int]]:
    """:func:`component_trees` of one scan."""
    return [tuple(int(v[0]) for v in found) for found in component_trees(level[None], levels)]


def cooccurrence(grey: np.ndarray, levels: int, offsets: Sequence[tuple[int, int, int]]) -> np.ndarray:
    """Symmetric counts of grey levels at every offset; negative levels lie outside."""
    counts = np.zeros(levels * levels, dtype=np.int64)
    for offset in offsets:
        here = tuple(slice(max(0, -d), n - max(0, d)) for d, n in zip(offset, grey.shape, strict=True))
        there = tuple(slice(max(0, d), n - max(0, -d)) for d, n in zip(offset, grey.shape, strict=True))
        one, two = grey[here].ravel(), grey[there].ravel()
        both = (one >= 0) & (two >= 0)
        counts += np.bincount(one[both] * levels + two[both], minlength=levels * levels)
    square = counts.reshape(levels, levels)
    return square + square.T


def pairs(cell: Sequence[np.ndarray], offsets: Sequence[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the listed cells that lie at one of the offsets from each other."""
    low = [int(c.min()) for c in cell]
    shape = [int(c.max()) - b + 1 for c, b in zip(cell, low, strict=True)]
    number = np.full(shape, -1, dtype=np.int64)
    number[tuple(c - b for c, b in zip(cell, low, strict=True))] = np.arange(len(cell[0]))
    first, second = [], []
    for offset in offsets:
        here = tuple(slice(max(0, -d), max(0, n - max(0, d))) for d, n in zip(offset, shape, strict=True))
        there = tuple(slice(max(0, d), max(0, n - max(0, -d))) for d, n in zip(offset, shape, strict=True))
        one, two = number[here].ravel(), number[there].ravel()
        both = (one >= 0) & (two >= 0)
        first.append(one[both])
        second.append(two[both])
    return np.concatenate(first), np.concatenate(second)


def grey_rows(values: np.ndarray, levels: int, rounding: str, eps: float) -> np.ndarray:
    """The values of each row scaled between their 1st and 99th percentile to ``levels`` grey levels."""
    low, high = np.percentile(values, [1, 99], axis=1)[:, :, None]
    t = np.clip((values - low) / np.maximum(high - low, eps), 0.0, 1.0)
    return np.rint(t * (levels - 1)).astype(np.int64) if rounding == "rint" else np.minimum(np.floor(t * levels).astype(np.int64), levels - 1)


def pair_counts(grey: np.ndarray, levels: int, pairs: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Symmetric co-occurrence counts of each row of grey levels over the same pairs of cells: rows x levels x levels."""
    row = np.arange(len(grey))[:, None] * (levels * levels)
    place = row + grey[:, pairs[0]] * levels + grey[:, pairs[1]]
    square = np.bincount(place.ravel(), minlength=len(grey) * levels * levels).reshape(len(grey), levels, levels)
    return square + square.transpose(0, 2, 1)


def textures(counts: np.ndarray) -> np.ndarray:
    """Contrast, dissimilarity, homogeneity, energy, entropy and correlation of each co-occurrence matrix: rows x metrics."""
    n = len(counts)
    p = counts / counts.sum(axis=(1, 2), keepdims=True)
    i, j = np.indices(counts.shape[1:])
    gap, total = i - j, lambda x: x.reshape(n, -1).sum(axis=1)
    mean = total(p * i)[:, None, None]
    bits = p * np.log2(np.where(p > 0, p, 1.0))
    spread = total(p * (i - mean) ** 2)
    return np.stack([
        total(p * gap**2), total(p * np.abs(gap)), total(p / (1.0 + gap**2)), np.sqrt(total(p * p)),
        -total(bits), total(p * (i - mean) * (j - mean)) / np.maximum(spread, 1e-8),
    ], axis=1)
