"""Task-side arithmetic of the nearest-record search: numpy on one Arrow batch or cell.

The functions travel to the workers by value, so a cluster needs no installed
copy of the package.

A box holds the least and greatest number and category text of some rows, column
by column. A row is at least as far from all of them as from the box: by its
gaps to the numbers, and by 1 for each category outside the texts.
"""

from __future__ import annotations

import heapq
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

#: Rows that tell where a box is cut; cells of a matrix of cell bounds; rows that walk a tree together.
_SEEN, _CELLS, _TOGETHER = 256, 1 << 22, 16384
#: Cells of a matrix of distances, and of box bounds, that stays in a core's cache; rows that are packed together.
_NEAR, _BOUNDS, _PACKED = 1 << 18, 1 << 16, 1 << 17


def _flat(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    return (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten()


def _matrix(column: pa.Array | pa.ChunkedArray, rows: int) -> np.ndarray:
    """A column of equally long lists as a matrix."""
    values = _flat(column).to_numpy(zero_copy_only=False)
    return values.reshape(rows, -1) if rows else values.reshape(0, 0)


def _codes(*tables: pa.Table | pa.RecordBatch) -> tuple[list[np.ndarray], np.ndarray]:
    """The texts ``k`` of some tables as matrices of numbers in text order, and the sorted texts."""
    flat = [_flat(t["k"]) for t in tables]
    coded = pa.concat_arrays(flat).dictionary_encode()
    words = np.array(coded.dictionary.to_pylist(), dtype=object)
    order = np.argsort(words)
    rank = np.empty(len(words), np.int32)
    rank[order] = np.arange(len(words))
    codes = rank[coded.indices.to_numpy(zero_copy_only=False)] if len(words) else np.empty(0, np.int32)
    codes = codes.astype(np.int16) if len(words) < 32768 else codes
    cut = np.cumsum([0] + [len(f) for f in flat])
    return [codes[a:b].reshape(t.num_rows, -1) for a, b, t in zip(cut, cut[1:], tables)], words[order]


class _Part:
    """Some rows, and once they are cut in two, the column, the last value on the left and both sides."""

    def __init__(self, rows: np.ndarray):
        self.rows, self.cut, self.sides = rows, None, None

    def halve(self, x: np.ndarray, k: np.ndarray) -> bool:
        """Cut the rows where both sides are farthest from each other's boxes; False if all rows are equal."""
        for seen in (self.rows[:: -(-len(self.rows) // _SEEN)], self.rows):
            score, last = _cuts(x[seen], k[seen])
            column = int(score.argmax())
            if score[column] > 0:
                values = x[:, column] if column < x.shape[1] else k[:, column - x.shape[1]]
                left = values[self.rows] <= last[column]
                self.cut, self.sides = (column, last[column]), (_Part(self.rows[left]), _Part(self.rows[~left]))
                return True
        return False


def _cuts(x: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, list]:
    """The gain of each column's best cut, and the last value on its left.

    The gain is the mean squared gap between a row and the other side, which is what its bound grows by; less if a side
    has under a quarter of the rows. Texts differ by 1.
    """
    both, n, wide = np.column_stack([x, k]), len(x), x.shape[1]
    both.sort(axis=0)
    left, right = both[:-1], both[1:]
    gain = (right > left).astype(float)
    ones, squares = np.cumsum(left[:, :wide], axis=0), np.cumsum(left[:, :wide] ** 2, axis=0)
    upto = np.arange(1.0, n)[:, None]
    low, high = left[:, :wide], right[:, :wide]
    all_ones, all_squares = ones[-1:] + high[-1:], squares[-1:] + high[-1:] ** 2
    gaps = squares - 2 * high * ones + upto * high**2
    gaps += all_squares - squares - 2 * low * (all_ones - ones) + (n - upto) * low**2
    gain[:, :wide] *= np.fmax(gaps / n, np.finfo(float).tiny)
    gain *= np.minimum(1.0, 4.0 * np.minimum(upto, n - upto) / n)
    best, columns = gain.argmax(axis=0), np.arange(both.shape[1])
    last = left[best, columns]
    return gain[best, columns], [*last[:wide], *last[wide:].astype(k.dtype)]


def _divide(x: np.ndarray, k: np.ndarray, rows: np.ndarray, most: int, bound: int) -> tuple[_Part, list[_Part]]:
    """The largest parts are cut until there are ``most`` or none is above ``bound``; the first part and all final ones."""
    first = _Part(rows)
    large, done, turn = [(-len(rows), 0, first)], [], 0
    while large and len(large) + len(done) < most and -large[0][0] > bound:
        part = heapq.heappop(large)[2]
        if part.halve(x, k):
            for side in part.sides:
                turn += 1
                heapq.heappush(large, (-len(side.rows), turn, side))
        else:
            done.append(part)
    return first, done + [part for _, _, part in large]


class Boxes:
    """The boxes of one node's children: a row of each matrix per child."""

    def __init__(self, low: np.ndarray, high: np.ndarray, first: np.ndarray, last: np.ndarray):
        self.low, self.high, self.first, self.last = low, high, first, last

    @classmethod
    def around(cls, x: np.ndarray, k: np.ndarray) -> Boxes:
        return cls(*(f(m, axis=0, keepdims=True) for m in (x, k) for f in (np.min, np.max)))

    @classmethod
    def stacked(cls, boxes: list[Boxes]) -> Boxes:
        return cls(*(np.concatenate([getattr(b, n) for b in boxes]) for n in ("low", "high", "first", "last")))

    def whole(self) -> Boxes:
        return Boxes(*(f(m, axis=0, keepdims=True) for m, f in zip((self.low, self.high, self.first, self.last), (np.min, np.max) * 2)))

    def distances(self, x: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The least squared distance of each row to anything in each box."""
        total = np.zeros((len(self.low), len(x)))  # rows lie side by side, as there are more of them than boxes
        step = max(1, _BOUNDS // len(self.low))
        for start in range(0, len(x), step):
            part = slice(start, start + step)
            self._add(x[part], k[part], total[:, part])
        return total.T

    def _add(self, x: np.ndarray, k: np.ndarray, total: np.ndarray) -> None:
        x, k = np.ascontiguousarray(x.T), np.ascontiguousarray(k.T)
        inside = (self.low.max(axis=0) <= x.min(axis=1)) & (x.max(axis=1) <= self.high.min(axis=0))  # of all boxes
        for i in np.flatnonzero(~inside):
            col, low, high = x[i], self.low[:, i], self.high[:, i]
            gap = low[:, None] - col[None, :]
            np.maximum(gap, col[None, :] - high[:, None], out=gap)
            np.maximum(gap, 0.0, out=gap)
            gap *= gap
            total += gap
        for col, first, last in zip(k, self.first.T, self.last.T):
            total += (col[None, :] < first[:, None]) | (col[None, :] > last[:, None])


class _Tile:
    """Rows that are compared with others one by one."""

    def __init__(self, x: np.ndarray, k: np.ndarray, number: int):
        self.x, self.k, self.number = x, k, number
        self.box = Boxes.around(x, k)
        self.squares = (x * x).sum(1)
        # One product gives -2ab + b*b + a*a: the rows carry their squares along.
        self.wide = np.vstack([x.T * -2.0, self.squares, np.ones(len(x))])
        self.thin = self.wide.astype(np.float32)
        self.columns = np.ascontiguousarray(k.T)

    def compare(self, x: np.ndarray, k: np.ndarray, best: np.ndarray, rows: np.ndarray) -> None:
        """Lower ``best`` of ``rows`` to their least squared distance to the tile.

        A fast rounded distance, taken in pieces that stay in the cache, tells which few pairs are worth the exact one.
        """
        step = max(1, _NEAR // len(self.x))
        most = self.squares.max()
        for start in range(0, len(rows), step):
            part = rows[start : start + step]
            a = x[part]
            squares = (a * a).sum(1)
            near = max(squares.max(), most) < 1e4
            kind = np.float32 if near else np.float64
            rough = np.column_stack([a, np.ones(len(a)), squares]).astype(kind) @ (self.thin if near else self.wide)
            if len(self.columns):
                # Mismatches are counted in small integers over contiguous columns, several times faster than in doubles.
                different = np.zeros(rough.shape, np.uint8 if len(self.columns) < 256 else np.uint16)
                for left, right in zip(k[part].T, self.columns):
                    different += (left[:, None] != right[None, :]).view(np.uint8)
                rough += different
            # The sum has a term per column and two more, each rounded.
            slack = (32 + 2 * x.shape[1]) * float(np.finfo(kind).eps) * (squares + most + x.shape[1] + k.shape[1])
            least = rough[np.arange(len(part)), rough.argmin(axis=1)]
            lower = np.flatnonzero(least - slack < best[part])
            if not len(lower):
                continue
            i, j = np.nonzero(rough[lower] <= (least + 2 * slack)[lower, None])
            i = lower[i]
            exact = ((a[i] - self.x[j]) ** 2).sum(1) + (k[part][i] != self.k[j]).sum(1)
            np.minimum.at(best, part[i], exact)


class _Node:
    def __init__(self, children: list):
        self.children = children
        self.boxes = Boxes.stacked([child.box for child in children])
        self.box = self.boxes.whole()


class Cell:
    """The real rows of one cell in a tree: nodes have up to ``fanout`` children, the last ones are tiles."""

    def __init__(self, x: np.ndarray, k: np.ndarray, tile_rows: int, fanout: int):
        self.x, self.k, self.tile_rows, self.fanout, self.tiles = x, k, tile_rows, max(2, fanout), 0
        self.root = self._node(np.arange(len(x)))

    def _node(self, rows: np.ndarray) -> _Node | _Tile:
        if len(rows) > self.tile_rows:
            _, parts = _divide(self.x, self.k, rows, self.fanout, self.tile_rows)
            if len(parts) > 1:
                return _Node([self._node(part.rows) for part in parts])
        self.tiles += 1
        return _Tile(self.x[rows], self.k[rows], self.tiles)

    def nearest(self, x: np.ndarray, k: np.ndarray, best: np.ndarray) -> np.ndarray:
        """Lower ``best``, the bound of each row; returns with how many rows each was compared.

        Each row goes down to its nearest tile first. Rows of near tiles then visit the others together.
        """
        own, compared = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)

        def meet(tile: _Tile, rows: np.ndarray) -> None:
            tile.compare(x, k, best, rows)
            compared[rows] += len(tile.x)

        def down(node: _Node | _Tile, rows: np.ndarray) -> None:
            if isinstance(node, _Tile):
                own[rows] = node.number
                meet(node, rows)
                return
            low = node.boxes.distances(x[rows], k[rows])
            child = low.argmin(axis=1)
            child[low[np.arange(len(rows)), child] >= best[rows]] = -1
            for i, below in enumerate(node.children):
                if (child == i).any():
                    down(below, rows[child == i])

        def others(node: _Node | _Tile, rows: np.ndarray) -> None:
            if isinstance(node, _Tile):
                rows = rows[own[rows] != node.number]
                if len(rows):
                    meet(node, rows)
                return
            low = node.boxes.distances(x[rows], k[rows])
            for i, below in enumerate(node.children):
                left = rows[low[:, i] < best[rows]]
                if len(left):
                    others(below, left)

        for walk in (down, others):
            order = np.argsort(own, kind="stable")
            together = max(1, min(_TOGETHER, _CELLS // self.fanout))
            for start in range(0, len(x), together):
                walk(self.root, order[start : start + together])
        return compared


class Cuts:
    """The cuts of some nodes into cells, learnt from a sample of each node's rows; texts are kept as texts."""

    def __init__(self, sample: pa.Table, wanted: dict[int, int], fanout: int):
        """``sample``: x, k, cell, the node; ``wanted``: children of each node, at most."""
        (k,), self.words = _codes(sample)
        x, nodes = _matrix(sample["x"], sample.num_rows), np.asarray(sample["cell"])
        self.numbers, self.roots, self.cells = x.shape[1], {}, {}
        for node, children in wanted.items():
            first, parts = _divide(x, k, np.flatnonzero(nodes == node), children, 1)
            self.roots[node] = first
            for slot, part in enumerate(parts):
                part.cell = node * (fanout + 1) + slot + 1
        for part in self._all(list(self.roots.values())):
            part.rows = None
            if part.cut and part.cut[0] >= self.numbers:
                part.cut = (part.cut[0], self.words[part.cut[1]])

    @staticmethod
    def _all(parts: list[_Part]) -> Iterator[_Part]:
        while parts:
            part = parts.pop()
            yield part
            parts.extend(part.sides or ())

    def children(self, rows: pa.Table | pa.RecordBatch) -> np.ndarray:
        """The child that each row (x, k, cell) belongs to."""
        (k,), words = _codes(rows)
        x, nodes = _matrix(rows["x"], rows.num_rows), np.asarray(rows["cell"])
        out = np.empty(rows.num_rows, np.int64)
        work = [(first, np.flatnonzero(nodes == node)) for node, first in self.roots.items()]
        while work:
            part, own = work.pop()
            if not len(own):
                continue
            if part.cut is None:
                out[own] = part.cell
                continue
            column, last = part.cut
            if column < self.numbers:
                left = x[own, column] <= last
            else:
                left = k[own, column - self.numbers] < np.searchsorted(words, last, side="right")
            work += [(part.sides[0], own[left]), (part.sides[1], own[~left])]
        return out


def to_children(cuts: Cuts):
    """For mapInArrow: rows (x, k, cell) with the child of their cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_pydict({"x": batch["x"], "k": batch["k"], "cell": pa.array(cuts.children(batch))})

    return run


def _lists(m: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.array(m.tolist(), pa.list_(kind))


def _facts(cells: np.ndarray, counts: np.ndarray, sides: list[np.ndarray]) -> pa.RecordBatch:
    kinds = [pa.float64(), pa.float64(), pa.string(), pa.string()]
    named = zip(("low", "high", "first", "last"), sides, kinds)
    return pa.RecordBatch.from_pydict({"cell": pa.array(cells), "n": pa.array(counts)} | {n: _lists(m, t) for n, m, t in named})


def _by_cell(rows: pa.Table | pa.RecordBatch, counts: np.ndarray, names: tuple[str, str, str, str]) -> pa.RecordBatch:
    """Counts and boxes of the cells in ``rows``; ``names``: columns of least and greatest numbers and texts."""
    tables = [pa.table({"k": rows[n]}) for n in names[2:]]
    codes, words = _codes(*tables)
    sides = [*(_matrix(rows[n], rows.num_rows) for n in names[:2]), *codes]
    cells = np.asarray(rows["cell"])
    order = np.argsort(cells, kind="stable")
    own, starts = np.unique(cells[order], return_index=True)
    sides = [f.reduceat(m[order], starts, axis=0) for m, f in zip(sides, (np.minimum, np.maximum) * 2)]
    return _facts(own, np.add.reduceat(counts[order], starts), [*sides[:2], *(words[m] if m.size else m for m in sides[2:])])


def cell_facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow over (x, k, cell): the rows and the box of each cell, ``cell, n, low, high, first, last``."""
    found = []
    for batch in batches:
        if batch.num_rows:
            found.append(_by_cell(batch, np.ones(batch.num_rows, np.int64), ("x", "x", "k", "k")))
            if len(found) == 64:
                found = [_merged(pa.Table.from_batches(found))]
    if found:
        yield _merged(pa.Table.from_batches(found))


def _merged(facts: pa.Table) -> pa.RecordBatch:
    return _by_cell(facts, np.asarray(facts["n"]), ("low", "high", "first", "last"))


def merged_facts(facts: pa.Table) -> pa.Table:
    """For applyInArrow: the facts of the same cell as one row."""
    return pa.Table.from_batches([_merged(facts)])


def _visits(cells: pa.Table, passes: tuple[int, int | None], batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The places of probes (x, k, d) in ``batch`` and of ``cells`` that may hold something nearer than ``d``."""
    (k, first, last), _ = _codes(batch, *(pa.table({"k": cells[n]}) for n in ("first", "last")))
    low, high = (_matrix(cells[n], cells.num_rows) for n in ("low", "high"))
    far = np.ascontiguousarray(Boxes(low, high, first, last).distances(_matrix(batch["x"], batch.num_rows), k))
    near, rows = far < np.asarray(batch["d"], dtype=float)[:, None], np.arange(len(far))
    first, end = passes
    chosen = np.zeros_like(near)
    # A few places are found one by one, which costs far less than sorting all cells.
    for place in range(min(cells.num_rows, first if end is None else end)):
        own = far.argmin(axis=1)
        chosen[rows, own] = place >= first or end is None
        far[rows, own] = np.inf
    return np.nonzero(near & (~chosen if end is None else chosen))


def _pieces(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        yield from (whole.slice(at, rows) for at in range(0, whole.num_rows, rows))


def cells_to_visit(cells: pa.Table, passes: tuple[int, int | None]):
    """For mapInArrow: how many of the probes (x, k, d) visit each cell, as ``cell, asked``.

    A cell is visited if it may hold something nearer than ``d``. A probe's cells are ordered by their distance;
    ``passes`` gives the first and the last place that count.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = np.zeros(cells.num_rows, np.int64)
        for batch in _pieces(batches, max(1, _CELLS // cells.num_rows)):
            asked += np.bincount(_visits(cells, passes, batch)[1], minlength=cells.num_rows)
        seen = np.flatnonzero(asked)
        yield pa.RecordBatch.from_pydict({"cell": pa.array(np.asarray(cells["cell"])[seen]), "asked": pa.array(asked[seen])})

    return run


def open_probes(cells: pa.Table, place: int):
    """For mapInArrow over probes (id, x, k, d): those whose cells from ``place`` on may hold something nearer than ``d``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches, max(1, _CELLS // cells.num_rows)):
            yield batch.take(pa.array(np.unique(_visits(cells, (place, None), batch)[0])))

    return run


def _packed(rows: pa.RecordBatch | pa.Table) -> bytes:
    """Rows (x, k and more) as one compressed text of bytes, column by column: a fraction of their size as rows."""
    x, width = _matrix(rows["x"], rows.num_rows), len(rows["k"][0])
    words = _flat(rows["k"])
    cells = {n: rows[n] for n in rows.schema.names if n not in ("x", "k")}
    cells |= {f"x{i}": pa.array(np.ascontiguousarray(col)) for i, col in enumerate(x.T)}
    cells |= {f"k{i}": words.take(pa.array(np.arange(i, len(words), width))) for i in range(width)}
    table, sink = pa.table(cells), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(blocks: pa.ChunkedArray) -> pa.Table:
    return pa.concat_tables([pa.ipc.open_stream(block.as_buffer()).read_all() for chunk in blocks.chunks for block in chunk])


def _numbers(rows: pa.Table) -> np.ndarray:
    names = [n for n in rows.schema.names if n[0] == "x"]
    return np.column_stack([np.asarray(rows[n]) for n in names]) if names else np.zeros((rows.num_rows, 0))


def _ranks(*tables: pa.Table) -> list[np.ndarray]:
    """The texts of some unpacked tables as matrices of numbers, in text order within each column."""
    names = [n for n in tables[0].schema.names if n[0] == "k"]
    if not names:
        return [np.zeros((t.num_rows, 0), np.int16) for t in tables]
    out = []
    for name in names:
        one = lambda t: pa.ListArray.from_arrays(np.arange(t.num_rows + 1, dtype=np.int32), t[name].combine_chunks())  # noqa: B023, E731
        out.append(_codes(*(pa.table({"k": one(t)}) for t in tables))[0])
    return [np.column_stack([column[i] for column in out]) for i in range(len(tables))]


def probe_blocks(cells: pa.Table | None, passes: tuple[int, int | None], parts: dict[int, tuple[int, int]]):
    """For mapInArrow over probes (id, x, k, d, h): packed rows ``cell, a, b, block`` for all parts of the cells they visit.

    ``parts``: per cell, into how many parts its real rows and its probes are dealt; probes by their hash ``h``. Without
    ``cells`` there is one, number 0, and all probes visit it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wide = 1 if cells is None else cells.num_rows
        numbers = np.zeros(1, np.int64) if cells is None else np.asarray(cells["cell"])
        n_probe = np.array([parts.get(cell, (1, 1))[1] for cell in numbers.tolist()], np.int64)
        for whole in _gathered(batches):
            place = [np.arange(whole.num_rows), np.zeros(whole.num_rows, np.int64)]
            if cells is not None:
                found, start = [], 0
                for piece in _pieces([whole], max(1, _CELLS // wide)):
                    i, cell = _visits(cells, passes, piece)
                    found.append((i + start, cell))
                    start += piece.num_rows
                place = [np.concatenate(x) for x in zip(*found)]
            yield from _dealt(whole, *place, np.asarray(whole["h"])[place[0]] % n_probe[place[1]], numbers, ("id", "x", "k", "d"),
                              lambda cell, b: [(cell, a, b) for a in range(parts.get(cell, (1, 1))[0])])

    return run


def real_blocks(parts: dict[int, int]):
    """For mapInArrow over real rows (x, k, cell, h): packed rows ``cell, a, block``, each cell in so many parts by hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in _gathered(batches):
            numbers, place = np.unique(np.asarray(whole["cell"]), return_inverse=True)
            n_real = np.array([parts.get(cell, 1) for cell in numbers.tolist()], np.int64)
            yield from _dealt(whole, np.arange(whole.num_rows), place, np.asarray(whole["h"]) % n_real[place], numbers, ("x", "k"),
                              lambda cell, a: [(cell, a)])

    return run


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches put together up to ``_PACKED`` rows, so that blocks are not tiny."""
    held = []
    for batch in batches:
        held += [batch] * (batch.num_rows > 0)
        if sum(b.num_rows for b in held) >= _PACKED:
            yield pa.Table.from_batches(held).combine_chunks()
            held = []
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _dealt(rows: pa.Table, i: np.ndarray, place: np.ndarray, part: np.ndarray, numbers: np.ndarray, names: tuple[str, ...], keys) -> Iterator[pa.RecordBatch]:
    """One block for the rows ``i`` of each cell and part, under every key that ``keys`` gives for them."""
    rows = rows.select(names)
    order = np.lexsort((part, place))
    i, place, part = i[order], place[order], part[order]
    cuts = np.flatnonzero(np.diff(place, prepend=-1) | np.diff(part, prepend=-1)) if len(i) else np.empty(0, int)
    for a, b in zip(cuts, [*cuts[1:], len(i)]):
        for at in range(a, b, _PACKED):
            block = _packed(rows.take(pa.array(i[at : min(b, at + _PACKED)])))
            under = keys(int(numbers[place[a]]), int(part[a]))
            columns = {n: pa.array(v, pa.int64() if n == "cell" else pa.int32()) for n, v in zip(("cell", "a", "b"), zip(*under))}
            yield pa.RecordBatch.from_pydict(columns | {"block": pa.array([block] * len(under), pa.binary())})


def cell_minima(tile_rows: int, fanout: int, key: pa.DataType | None = None) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """For a cogrouped applyInArrow: blocks of probes (id, x, k, d) that meet those of the real rows (x, k) of a cell's part."""

    def run(probes: pa.Table, real: pa.Table) -> pa.Table:
        if not probes.num_rows or not real.num_rows:
            return pa.table({"id": pa.array([], key), "d": pa.array([], pa.float64()), "compared": pa.array([], pa.int64())})
        probes, real = _unpacked(probes["block"]), _unpacked(real["block"])
        pk, rk = _ranks(probes, real)
        best = np.array(probes["d"], dtype=float)
        cell = Cell(_numbers(real), rk, tile_rows, fanout)
        compared = cell.nearest(_numbers(probes), pk, best)
        return pa.table({"id": probes["id"], "d": pa.array(best), "compared": pa.array(compared)})

    return run


cloudpickle.register_pickle_by_value(sys.modules[__name__])
