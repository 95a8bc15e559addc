"""Join of documents whose word shingles have a Jaccard similarity of 3/4 or more, by R-trees over group counts.

Every document is a set of hashed shingles.  Its point counts the shingles in each of GROUPS hash groups; the sum of
two points' coordinate minima bounds the overlap of their sets, and so does the sum over the upper corners of two
boxes for all points inside.  Points are first dealt to cells: in one order of all shingles, from the rarest to the
most frequent, a document is in the cell of each shared shingle among its first quarter and one more, and two
documents that link share a cell.  In a cell the points are packed into an R-tree that is joined with itself; pairs
under the bound are dropped, whole branches at a time, and the rest are verified on the whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import shared_dir, written
from .components import components, union_find
from .hashing import mix, shingle_sets
from .tokens import text_slices

#: Groups of small sets, and the most that large ones have.
GROUPS, MOST_GROUPS = 128, 1 << 16
#: Points in a leaf, and nodes in one block of a cell: larger cells are joined block by block.
LEAF, BLOCK = 16, 1000
#: Shingles counted at once to find common ones, the count there that makes one common, how many are noted at most
#: (the most common; this fixes the order of shingles, never what is compared), parts of a common shingle's cell.
#: Common shingles skip the counting by hash, where one of them could fill a task.
COUNTED, COMMON, NOTED, PARTS = 1_000_000, 50, 200_000, 64
#: Shingles that a task gathers before it deals them out; shingles of a bucket on average (the number of buckets
#: follows from their count); parts in which a task counts a bucket (a power of two).
GATHERED, BUCKET, SHARES = 500_000, 4_000_000, 8
#: Pairs of a block that are verified before those that have become connected are left out.
VERIFIED = 256


def linked(inner: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether 100 * inner >= 75 * union, for the sum of two sets' sizes."""
    return 7 * inner >= 3 * sizes


def node_of(x: np.ndarray) -> int:
    """A number for a set: equal sets have the same; others differ but for 64-bit collisions."""
    with np.errstate(over="ignore"):
        return int(mix(np.array([mix(x).sum(dtype=np.uint64) * np.uint64(2) + np.uint64(len(x))], np.uint64)).view(np.int64)[0])


def point_of(x: np.ndarray, per_group: float = 4) -> bytes:
    """Counts of shingles by the upper bits of their hashes, a byte each; 255 stands for any number.

    Larger sets have more groups, about one for per_group shingles: with few, the counts of any two large sets are
    alike."""
    bits = min(MOST_GROUPS.bit_length() - 1, GROUPS.bit_length() - 1 + int(len(x) / (per_group * GROUPS)).bit_length())
    return np.minimum(np.bincount((x >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits), 255).astype("u1").tobytes()


def _folded(points: np.ndarray, groups: int) -> np.ndarray:
    """Rows of counts, neighbouring groups summed up to the given number of groups; 65535 stands for any number."""
    parts = points.reshape(len(points), groups, -1)
    return np.where((parts == 255).any(axis=2), 65535, parts.sum(axis=2, dtype=np.int64)).astype(np.uint16)


def _points(raw: list[bytes], groups: int) -> np.ndarray:
    """Points as bytes, folded to one number of groups."""
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    out = np.zeros((len(raw), groups), np.uint16)
    for n in np.unique(sizes).tolist():
        which = np.flatnonzero(sizes == n)
        out[which] = _folded(np.frombuffer(b"".join(raw[k] for k in which.tolist()), "u1").reshape(len(which), n), groups)
    return out


def _finer(raw: np.ndarray, i: np.ndarray, j: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Which pairs of points pass the bound by all groups that both have."""
    groups = np.fromiter(map(len, raw), np.int64, len(raw))
    groups = np.minimum(groups[i], groups[j])
    ok = np.ones(len(i), bool)
    for g in np.unique(groups[groups > GROUPS]).tolist():
        pairs = np.flatnonzero(groups == g)
        (a, at), (b, bt) = (np.unique(x[pairs], return_inverse=True) for x in (i, j))
        p, q = _points(raw[a].tolist(), g), _points(raw[b].tolist(), g)
        step = max(1, (1 << 21) // g)
        for s in range(0, len(pairs), step):
            part = pairs[s : s + step]
            ok[part] = linked(_overlap(p[at[s : s + step]], q[bt[s : s + step]]), sizes[part])
    return ok


def _batch(columns, fields) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


_SETS = (("doc_id", pa.int64()), ("n", pa.int64()), ("node", pa.int64()), ("point", pa.binary()), ("text_hash", pa.int64()), ("common", pa.binary()))


def _summarised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per document its size, node and point; now and then a row of (shingle, count) pairs that are common here."""
    seen: set[int] = set()
    held, n_held = [], 0

    def common():
        x, n = np.unique(np.concatenate(held), return_counts=True)
        return _batch(([None], [None], [None], [None], [None], [np.stack([x, n.astype(np.uint64)])[:, n >= COMMON].tobytes()]), _SETS)

    for ids, texts in text_slices(batches, "id", "text"):
        sets = shingle_sets(texts)
        nodes = [node_of(x) if len(x) else None for x in sets]
        yield _batch(([x["doc_id"] for x in ids], [len(x) for x in sets], nodes, [point_of(x) if len(x) else None for x in sets], [x["text_hash"] for x in ids], [None] * len(ids)), _SETS)
        for x, node in zip(sets, nodes, strict=True):
            if node is not None and node not in seen:
                seen.add(node)
                held.append(x)
                n_held += len(x)
        if n_held >= COUNTED:
            yield common()
            held, n_held = [], 0
    if held:
        yield common()


def _common_shingles(rows: DataFrame) -> np.ndarray:
    """The NOTED shingles with the highest counts, sorted (at most 1.6 MB)."""

    def pairs(batches):
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                x = np.frombuffer(raw, np.uint64).reshape(2, -1)
                yield _batch((x[0].view(np.int64), x[1].astype(np.int64)), (("h", pa.int64()), ("n", pa.int64())))

    counts = rows.mapInArrow(pairs, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    top = counts.orderBy(F.desc("n"), "h").limit(NOTED).toArrow().column("h").to_numpy()
    return np.sort(top.view(np.uint64))


def prefix_length(n: np.ndarray) -> np.ndarray:
    """A quarter of n and one more: sets that link share a shingle among so many of their first ones."""
    return n - (3 * n + 3) // 4 + 1


def _packed(h: np.ndarray) -> np.ndarray:
    """The lowest 40 bits of each number, five bytes each."""
    return np.ascontiguousarray(h.astype("<u8").view("u1").reshape(-1, 8)[:, :5])


def _unpacked(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 5, 8), "u1")
    out[:, :5] = np.frombuffer(raw, "u1").reshape(-1, 5)
    return out.reshape(-1).view("<u8")


def _slices(bucket: np.ndarray):
    """(bucket, from, to) of each run in sorted buckets."""
    cuts = np.flatnonzero(np.diff(bucket.astype(np.int64), prepend=-1)) if len(bucket) else np.zeros(0, np.int64)
    if not len(cuts):
        return iter(())
    return zip(bucket[cuts].tolist(), cuts.tolist(), [*cuts[1:].tolist(), len(bucket)], strict=True)


_ENTRIES = (("bucket", pa.int32()), ("node", pa.binary()), ("runs", pa.binary()), ("h", pa.binary()))
_SHARED = (("bucket", pa.int32()), ("node", pa.binary()), ("cell", pa.binary()), ("df", pa.binary()), ("n", pa.binary()))
_CELL_ENTRIES = (("bucket", pa.int32()), ("hot", pa.bool_()), ("h", pa.binary()), ("node", pa.binary()))


def _schema(fields) -> str:
    kinds = {pa.int32(): "int", pa.int64(): "long", pa.bool_(): "boolean", pa.binary(): "binary", pa.list_(pa.int64()): "array<long>"}
    return ", ".join(f"{n} {kinds[t]}" for n, t in fields)


def _distinct_sets(batches, wanted):
    """(node, some of the shingles) of the distinct sets that a task sees; wanted chooses from the sorted set."""
    seen: set[int] = set()
    for _, texts in text_slices(batches, "text", "text"):
        for x in shingle_sets(texts):
            if len(x) and (node := node_of(x)) not in seen:
                seen.add(node)
                yield node, wanted(x)


def _is_common(x: np.ndarray, common: np.ndarray) -> np.ndarray:
    if not len(common):
        return np.zeros(len(x), bool)
    return common[np.minimum(np.searchsorted(common, x), len(common) - 1)] == x


def _dealt(common, n_buckets: int):
    """Every set's shingles but the common ones, dealt to buckets by hash, five bytes each, in runs of one node."""

    def flushed(held):
        node, h = np.array([r[0] for r in held], np.int64), np.concatenate([r[1] for r in held])
        owner = np.repeat(np.arange(len(held), dtype=np.int32), [len(r[1]) for r in held])
        bucket = (h % np.uint64(n_buckets)).astype(np.uint16 if n_buckets < 65536 else np.int32)
        order = np.argsort(bucket, kind="stable")
        bucket, h, owner = bucket[order], h[order] // np.uint64(n_buckets), owner[order]
        rows = []
        for k, a, b in _slices(bucket):
            new = np.append(True, owner[a + 1 : b] != owner[a : b - 1])
            place = np.arange(b - a)
            new |= (place - np.maximum.accumulate(np.where(new, place, 0))) % 255 == 0  # a run's length is one byte
            cuts = np.flatnonzero(new)
            rows.append((k, node[owner[a:b][cuts]].tobytes(), np.diff(np.append(cuts, b - a)).astype(np.uint8).tobytes(), _packed(h[a:b]).tobytes()))
        return _batch(zip(*rows, strict=True), _ENTRIES)

    def run(batches):
        shingles, held, n_held = common.value, [], 0
        for entry in _distinct_sets(batches, lambda x: x[~_is_common(x, shingles)]):
            held.append(entry)
            n_held += len(entry[1])
            if n_held >= GATHERED:
                yield flushed(held)
                held, n_held = [], 0
        if n_held:
            yield flushed(held)

    return run


def _node_bucket(node: np.ndarray, n_buckets: int) -> np.ndarray:
    return (node.view(np.uint64) % np.uint64(n_buckets)).astype(np.int32)


def _to_nodes(node: np.ndarray, cell: np.ndarray, df: np.ndarray, n_buckets: int) -> pa.RecordBatch:
    """Shingles on their way back to their sets."""
    bucket = _node_bucket(node, n_buckets)
    order = np.lexsort((node, bucket))
    node, cell, df, bucket = (x[order] for x in (node, cell, df, bucket))
    rows = [(k, node[a:b].tobytes(), cell[a:b].tobytes(), df[a:b].astype(np.uint32).tobytes(), None) for k, a, b in _slices(bucket)]
    return _batch(zip(*rows, strict=True) if rows else [[]] * 5, _SHARED)


def _sizes(n_buckets: int):
    """Sets' sizes (node, n), to where their shingles meet."""

    def run(batches):
        for batch in batches:
            node, n = batch.column("node").to_numpy(), batch.column("n").to_numpy()
            bucket = _node_bucket(node, n_buckets)
            order = np.argsort(bucket, kind="stable")
            node, n = node[order], n[order]
            rows = [(k, node[a:b].tobytes(), b"", b"", n[a:b].tobytes()) for k, a, b in _slices(bucket[order])]
            if rows:
                yield _batch(zip(*rows, strict=True), _SHARED)

    return run


def _common_of_sets(common, n_buckets: int):
    """The common shingles of every set, straight to their sets: they count as the most frequent of all."""

    def run(batches):
        shingles, held, n_held = common.value, [], 0

        def flushed():
            cell = np.searchsorted(shingles, np.concatenate([r[1] for r in held])).astype(np.int64) + (1 << 62)
            node = np.repeat(np.array([r[0] for r in held], np.int64), [len(r[1]) for r in held])
            return _to_nodes(node, cell, np.full(len(cell), 0xFFFFFFFF, np.uint32), n_buckets)

        if len(shingles):
            for entry in _distinct_sets(batches, lambda x: x[_is_common(x, shingles)]):
                if len(entry[1]):
                    held.append(entry)
                    n_held += len(entry[1])
                if n_held >= GATHERED:
                    yield flushed()
                    held, n_held = [], 0
            if n_held:
                yield flushed()

    return run


def _by_bucket(batches):
    """(bucket, its rows) from rows in the order of buckets."""
    bucket, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[0] != bucket:
                if rows:
                    yield bucket, rows
                bucket, rows = row[0], []
            rows.append(row)
    if rows:
        yield bucket, rows


def _joined(rows, k: int, kind) -> np.ndarray:
    return np.concatenate([np.frombuffer(r[k], kind) for r in rows])


def _shared(n_buckets: int):
    """Of each bucket the shingles that two sets or more have, with their number of sets."""

    def shared_part(bucket, h, who, nodes):
        order = np.lexsort((who, h))
        h, who = h[order], who[order]
        fresh = np.append(True, (h[1:] != h[:-1]) | (who[1:] != who[:-1]))  # copies in other tasks
        h, who = h[fresh], who[fresh]
        starts = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        df = np.diff(np.append(starts, len(h)))
        df = np.repeat(df, df)
        kept = df > 1
        cell = (h[kept] * np.uint64(n_buckets) + np.uint64(bucket)).view(np.int64)
        return nodes[who[kept]], cell, df[kept].astype(np.uint32)

    def run(batches):
        for bucket, rows in _by_bucket(batches):
            # nodes as places in a table, and one part of the hashes after another: little memory at a time
            nodes, which = np.unique(_joined(rows, 1, np.int64), return_inverse=True)
            who = np.repeat(which.astype(np.int32), _joined(rows, 2, np.uint8))
            h = np.concatenate([_unpacked(r[3]) for r in rows])
            rows.clear()
            found = []
            for k in range(SHARES):
                part = np.flatnonzero((h & np.uint64(SHARES - 1)) == np.uint64(k))
                if len(part):
                    found.append(shared_part(bucket, h[part], who[part], nodes))
            if found:
                yield _to_nodes(*(np.concatenate(x) for x in zip(*found, strict=True)), n_buckets)

    return run


def _prefixes(n_buckets: int):
    """Of each set the shared shingles among its rarest quarter and one more, dealt to cells.

    Shingles that no other set has come first in the order and are no cell, so most sets have none at all."""

    def run(batches):
        for _, rows in _by_bucket(batches):
            of_size, rows = [r for r in rows if r[4] is not None], [r for r in rows if r[4] is None]
            if not rows:
                continue
            node, cell, df = (_joined(rows, k, t) for k, t in ((1, np.int64), (2, np.int64), (3, np.uint32)))
            sized, n = _joined(of_size, 1, np.int64), _joined(of_size, 4, np.int64)
            by_node = np.argsort(sized)
            rows.clear()
            order = np.lexsort((cell, df, node))
            node, cell = node[order], cell[order]
            fresh = np.append(True, (node[1:] != node[:-1]) | (cell[1:] != cell[:-1]))
            node, cell = node[fresh], cell[fresh]
            starts = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
            shared = np.diff(np.append(starts, len(node)))
            n = n[by_node[np.searchsorted(sized, node[starts], sorter=by_node)]]
            wanted = prefix_length(n) - (n - shared)
            kept = np.arange(len(node)) - np.repeat(starts, shared) < np.repeat(wanted, shared)
            node, cell = node[kept], cell[kept]
            hot = cell >= 1 << 62
            salt = np.where(hot, node.view(np.uint64) % np.uint64(PARTS), np.uint64(0))
            bucket = (mix(cell.view(np.uint64) + salt) % np.uint64(n_buckets)).astype(np.int32)
            for h in (False, True):
                which = np.flatnonzero(hot == h)
                which = which[np.argsort(bucket[which], kind="stable")]
                out = [(k, h, cell[which[a:b]].tobytes(), node[which[a:b]].tobytes()) for k, a, b in _slices(bucket[which])]
                if out:
                    yield _batch(zip(*out, strict=True), _CELL_ENTRIES)

    return run


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From entries in the order of buckets: blocks of each cell's nodes.

    A cell of one node is dropped, unless other parts of it (hot) may hold more.
    """
    fields = (("cell", pa.int64()), ("block", pa.int32()), ("hot", pa.bool_()), ("nodes", pa.list_(pa.int64())))

    def blocks(rows):
        for hot in (False, True):
            of = [r for r in rows if r[1] == hot]
            if not of:
                continue
            h = np.concatenate([np.frombuffer(r[2], np.uint64) for r in of])
            node = np.concatenate([np.frombuffer(r[3], np.int64) for r in of])
            salt = node.view(np.uint64) % np.uint64(PARTS) if hot else np.zeros(len(h), np.uint64)
            order = np.lexsort((node, salt, h))
            h, node, salt = h[order], node[order], salt[order]
            new_cell = np.append(True, (h[1:] != h[:-1]) | (salt[1:] != salt[:-1]))
            fresh = new_cell | np.append(True, node[1:] != node[:-1])
            h, node, salt, new_cell = h[fresh], node[fresh], salt[fresh], new_cell[fresh]
            cuts = np.flatnonzero(new_cell)
            sizes = np.diff(np.append(cuts, len(h)))
            out, known = [], set()
            for a, n in zip(cuts[(sizes > 1) | hot].tolist(), sizes[(sizes > 1) | hot].tolist()):
                for k, c in enumerate(range(a, a + n, BLOCK)):
                    part = node[c : min(c + BLOCK, a + n)]
                    if n <= BLOCK and not hot:
                        if (raw := part.tobytes()) in known:
                            continue
                        known.add(raw)
                    out.append((int(h[a].view(np.int64)), int(salt[a]) * 100_000 + k, hot or n > BLOCK, part))
                    if len(out) == 5000:
                        yield _batch(zip(*out, strict=True), fields)
                        out = []
            if out:
                yield _batch(zip(*out, strict=True), fields)

    for _, rows in _by_bucket(batches):
        yield from blocks(rows)


class RTree:
    """Points packed top-down: a box is halved along the coordinate in which it is widest until LEAF points are left.

    Boxes hold the lower size and the upper corner, all that the bound needs.
    """

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        self.points, self.sizes = points, sizes
        self.boxes: list[tuple] = []  # members, upper corner, least size, largest size, children
        self.root = self._pack(np.arange(len(points)))

    def _pack(self, members: np.ndarray) -> int:
        p, n = self.points[members], self.sizes[members]
        children = None
        if len(members) > LEAF:
            spread = np.ptp(p, axis=0)
            axis = int(spread.argmax())
            by = n if np.ptp(n) > 4 * spread[axis] else p[:, axis]
            order = members[np.argsort(by, kind="stable")]
            children = (self._pack(order[: len(order) // 2]), self._pack(order[len(order) // 2 :]))
        self.boxes.append((members, p.max(axis=0), int(n.min()), int(n.max()), children))
        return len(self.boxes) - 1

    def join(self, other: RTree) -> tuple[np.ndarray, np.ndarray]:
        """(i, j): pairs of points of self and other that pass the bound; with itself each pair once."""
        same, out = self is other, []
        todo = [(self.root, other.root)]
        while todo:
            a, b = todo.pop()
            (ma, ua, la, ha, ca), (mb, ub, lb, hb, cb) = self.boxes[a], other.boxes[b]
            if 4 * ha < 3 * lb or 4 * hb < 3 * la:
                continue
            if not (same and a == b) and not linked(_overlap(ua, ub), la + lb):
                continue
            if ca is None and cb is None:
                x, y = (g.ravel() for g in np.meshgrid(ma, mb, indexing="ij"))
                if same and a == b:
                    x, y = x[x < y], y[x < y]
                n = self.sizes[x] + other.sizes[y]
                ok = linked(np.minimum(self.sizes[x], other.sizes[y]), n)
                x, y, n = x[ok], y[ok], n[ok]
                ok = linked(_overlap(self.points[x], other.points[y]), n)
                out.append((x[ok], y[ok]))
            elif same and a == b:
                todo += [(ca[0], ca[0]), (ca[1], ca[1]), (ca[0], ca[1])]
            elif cb is None or (ca is not None and len(ma) >= len(mb)):
                todo += [(ca[0], b), (ca[1], b)]
            else:
                todo += [(a, cb[0]), (a, cb[1])]
        if not out:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return tuple(np.concatenate(z) for z in zip(*out, strict=True))


def _overlap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The summed minima; a coordinate at its limit in both bounds nothing."""
    low = np.minimum(p, q)
    return low.sum(axis=-1, dtype=np.int64) + (low == 65535).any(axis=-1) * (1 << 40)


def _key_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """The columns of each key's rows, from rows in the order of the first column; the last column is binary."""
    rest = None
    for batch in batches:
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(batch.num_columns - 1)]
        rows = [*cols, np.array([*batch.column(batch.num_columns - 1).to_pylist(), None], object)[:-1]]
        if rest is not None:
            rows = [np.concatenate(x) for x in zip(rest, rows, strict=True)]
        bounds = [0, *(np.flatnonzero(np.diff(rows[0])) + 1).tolist()]
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            yield [x[a:b] for x in rows]
        rest = [x[bounds[-1] :] for x in rows]
    if rest is not None and len(rest[0]):
        yield rest


def _gathered(groups: Iterator[tuple], fields) -> Iterator[pa.RecordBatch]:
    """Batches of columns of arrays, some thousand groups each."""
    out = []
    for columns in groups:
        out.append(columns)
        if len(out) == 2000:
            yield _batch([np.concatenate(x) for x in zip(*out, strict=True)], fields)
            out = []
    if out:
        yield _batch([np.concatenate(x) for x in zip(*out, strict=True)], fields)


def _tree_pairs(side: np.ndarray, n: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(i, j): rows whose points pass the bound: those of side 0 and 1, or all pairs where there is one side."""
    at = [np.flatnonzero(side == s) for s in np.unique(side)]
    trees = [RTree(_points(points[x].tolist(), GROUPS), n[x]) for x in at]
    i, j = trees[0].join(trees[-1])
    i, j = at[0][i], at[-1][j]
    ok = _finer(points, i, j, n[i] + n[j])
    return i[ok], j[ok]


_PAIRS = (("a", pa.int64()), ("b", pa.int64()))


def _first_partners(batches):
    """Of each block's nodes (key, side, node, label, n, point) the pair with the smallest partner that passes the bound."""

    def found():
        for _, side, node, _, n, points in _key_groups(batches):
            i, j = _tree_pairs(side, n, points)
            a, b = np.minimum(node[i], node[j]), np.maximum(node[i], node[j])
            order = np.lexsort((a, b))
            a, b = a[order], b[order]
            one = np.append(True, b[1:] != b[:-1])[: len(b)]
            yield a[one], b[one]

    return _gathered(found(), _PAIRS)


def _may_link(batches):
    """Of each block's rows (key, side, node, label, n, point) those that pass the bound with one of another label, as
    pairs that connect what such pairs connect."""

    def found():
        for _, side, node, label, n, points in _key_groups(batches):
            if (label != label[0]).any():
                i, j = _tree_pairs(side, n, points)
                other = label[i] != label[j]
                a, b = union_find(node[i[other]], node[j[other]])
                yield a[a != b], b[a != b]

    return _gathered(found(), _PAIRS)


def _overlap_of(x: np.ndarray, y: np.ndarray) -> int:
    """The size of two sorted sets' intersection."""
    return int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())


def _spanning_links(batches):
    """Of each block's nodes (key, side, node, label, whole set) links that connect what links connect, and no more.

    Nodes of one label count as connected; of other pairs those that pass the bound are verified, until links have
    connected them."""

    def found():
        for _, side, node, label, raw in _key_groups(batches):
            sets = [_unpacked(x) for x in raw]
            n = np.fromiter(map(len, sets), np.int64, len(sets))
            points = np.array([*(point_of(x << np.uint64(24), 0.25) for x in sets), None], object)[:-1]
            i, j = _tree_pairs(side, n, points)
            group = np.unique(label, return_inverse=True)[1]
            a, b = [], []
            while len(i):
                apart = group[i] != group[j]
                i, j = i[apart], j[apart]
                for x, y in zip(i[:VERIFIED].tolist(), j[:VERIFIED].tolist(), strict=True):
                    if group[x] != group[y] and linked(_overlap_of(sets[x], sets[y]), n[x] + n[y]):
                        group[group == group[y]] = group[x]
                        a.append(node[x])
                        b.append(node[y])
                i, j = i[VERIFIED:], j[VERIFIED:]
            yield np.array(a, np.int64), np.array(b, np.int64)

    return _gathered(found(), _PAIRS)


def _in_blocks(members: DataFrame, of_nodes: DataFrame, run, schema: str) -> DataFrame:
    """members (key, side, node, label) with what of_nodes has of them, each key's rows together, through run."""
    rows = members.select("key", "side", "node", "label").join(of_nodes, "node")
    return rows.select("key", "side", "node", "label", *[c for c in of_nodes.columns if c != "node"]).repartition("key").sortWithinPartitions("key").mapInArrow(run, schema)


def _needed_filter(hashes: DataFrame) -> np.ndarray:
    """A bit for the lowest bits of each of hashes (h), at most 8 MiB, gathered on the executors.  It only spares
    hashing: a text that passes wrongly is dropped later."""
    n_bits = 1 << min(26, max(12, (16 * hashes.count()).bit_length()))
    at = F.col("h").bitwiseAND(F.lit(n_bits - 1))
    words = hashes.groupBy(F.shiftright(at, 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(h & 63 as int))")).alias("bits")).toArrow()
    out = np.zeros(n_bits // 64, np.int64)
    out[words.column("w").to_numpy()] = words.column("bits").to_numpy()
    return out


def _whole_sets(docs: DataFrame, nodes: DataFrame, points: DataFrame) -> DataFrame:
    """node, shingles (the 40 upper bits of their hashes) of some distinct nodes, from one of each node's texts."""
    wanted = written(nodes.join(points.select("node", "text_hash"), "node"), "needed")
    words = docs.sparkSession.sparkContext.broadcast(_needed_filter(wanted.select(F.col("text_hash").alias("h"))))
    fields = (("node", pa.int64()), ("shingles", pa.binary()))

    def sets(batches):
        seen: set[int] = set()
        bits = words.value
        for batch in batches:
            low = batch.column("text_hash").to_numpy() & (len(bits) * 64 - 1)
            mask = (bits[low >> 6] >> (low & 63)) & 1
            for _, texts in text_slices([batch.filter(pa.array(mask == 1))], "text_hash", "text"):
                out = []
                for x in shingle_sets(texts):
                    if len(x) and (node := node_of(x)) not in seen:
                        seen.add(node)
                        out.append((node, _packed(x >> np.uint64(24)).tobytes()))
                if out:
                    yield _batch(zip(*out, strict=True), fields)

    found = docs.select("text_hash", "text").mapInArrow(sets, "node long, shingles binary")
    return written(found.join(wanted.select("node"), "node").dropDuplicates(["node"]), "shingles")


def _verified(docs: DataFrame, pairs: DataFrame, points: DataFrame) -> DataFrame:
    """Those of pairs (a, b) whose whole sets link."""
    nodes = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    found = _whole_sets(docs, nodes, points)

    def check(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                x, y = _unpacked(x), _unpacked(y)
                keep.append(bool(linked(_overlap_of(x, y), len(x) + len(y))))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = pairs.join(found.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a")
    both = left.join(found.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(check, "a long, b long")


def _meetings(near: DataFrame, most: int = BLOCK) -> DataFrame:
    """key, side, node, label of near (component, node, label): what may link comes together once, in blocks where a
    component is large.

    Only nodes of unlike labels need to meet.  So a label with many nodes has blocks of its own, which meet neither
    themselves nor one another, and small labels share blocks: a node goes to as many groups as there are blocks with
    other labels in its component, however many nodes share its own."""
    per = near.groupBy("component", "label").agg(F.count("*").alias("c"))
    total = per.groupBy("component").agg(F.sum("c").alias("total"), F.sum(F.when(F.col("c") <= most // 2, F.col("c")).otherwise(0)).alias("small"))
    per = per.join(total.where(F.col("total") > most), "component")
    alone = F.col("c") > most // 2
    per = written(per.select("component", "label", F.when(alone, F.ceil(F.col("c") / most)).otherwise(0).alias("own"), F.greatest(F.lit(1), F.ceil(F.col("small") / most)).alias("shared")), "labels")
    pure = per.where("own > 0").select("component", F.col("label").alias("of"), F.explode(F.transform(F.sequence(F.lit(0), F.col("own") - 1), lambda i: F.xxhash64(F.lit("own"), "label", i))).alias("block"))
    mixed = per.where("own = 0").select("component", F.lit(None).cast("long").alias("of"), F.xxhash64(F.lit("shared"), F.pmod(F.xxhash64("label"), F.col("shared"))).alias("block")).distinct()
    blocks = written(pure.unionByName(mixed), "blocks")
    x, y = blocks.alias("x"), blocks.alias("y")
    meet = x.join(y, F.expr("x.component = y.component and x.block <= y.block and not coalesce(x.of = y.of, false)"))
    sides = F.expr("if(x.block = y.block, array(struct(x.block as block, 0 as side)), array(struct(x.block as block, 0 as side), struct(y.block as block, 1 as side)))")
    meet = meet.select(F.col("x.component").alias("component"), F.xxhash64("x.component", "x.block", "y.block").alias("key"), F.explode(sides).alias("s")).select("component", "key", "s.block", "s.side")
    block = F.when(F.col("own") > 0, F.xxhash64(F.lit("own"), "label", F.pmod(F.xxhash64("node"), F.col("own")))).otherwise(F.xxhash64(F.lit("shared"), F.pmod(F.xxhash64("label"), F.col("shared"))))
    large = near.join(per, ["component", "label"]).withColumn("block", block).join(meet, ["component", "block"]).select("key", "side", "node", "label")
    few = near.join(per.select("component").distinct(), "component", "left_anti").select(F.xxhash64("component").alias("key"), F.lit(0).alias("side"), "node", "label")
    return few.unionByName(large)


def jaccard_classes(df: DataFrame, text_col: str = "text", id_col: str | None = "doc_id") -> DataFrame:
    """One row per row of df: doc_id (null without id_col), text_hash, n_shingles, node (a number of the set, null for
    an empty one), class (of the links' components the smallest node).  Everything else as in jaccard_components."""
    spark = df.sparkSession
    shared_dir(spark)
    text = F.col(f"`{text_col}`")
    doc_id = F.col(f"`{id_col}`").cast("long") if id_col else F.lit(None).cast("long")
    docs = df.select(doc_id.alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))
    keyed = docs.select(F.struct("doc_id", "text_hash").alias("id"), "text")
    rows = written(keyed.mapInArrow(_summarised, "doc_id long, n long, node long, point binary, text_hash long, common binary"), "sets")
    sets = rows.where("common is null")
    common = spark.sparkContext.broadcast(_common_shingles(rows.where("common is not null").select("common")))
    # one row per distinct set
    points = written(sets.where("node is not null").groupBy("node").agg(F.first("n").alias("n"), F.first("point").alias("point"), F.min("text_hash").alias("text_hash")), "points")

    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(points.agg(F.sum("n")).first()[0] or 0) // BUCKET))
    at = lambda rows: rows.repartition(n, "bucket").sortWithinPartitions("bucket")
    texts = docs.select("text")
    shared = at(texts.mapInArrow(_dealt(common, n), _schema(_ENTRIES))).mapInArrow(_shared(n), _schema(_SHARED))
    shared = shared.unionByName(texts.mapInArrow(_common_of_sets(common, n), _schema(_SHARED)))
    shared = shared.unionByName(points.select("node", "n").mapInArrow(_sizes(n), _schema(_SHARED)))
    entries = at(shared).mapInArrow(_prefixes(n), _schema(_CELL_ENTRIES))
    cells = at(entries).mapInArrow(_cells, "cell long, block int, hot boolean, nodes array<long>")
    cells = written(cells, "cells")
    # parts of large cells meet again in as few blocks as their size asks for
    large = cells.where("hot").select("cell", F.explode("nodes").alias("node"))
    sizes = large.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("k"), F.count("*").alias("m")).where("m > 1").drop("m")
    large = large.join(sizes, "cell").groupBy("cell", "k", F.pmod(F.xxhash64("node"), F.col("k")).cast("int").alias("block")).agg(F.array_sort(F.collect_set("node")).alias("nodes"))
    every = cells.where("not hot").select("cell", F.lit(1).alias("k"), F.lit(0).alias("block"), "nodes").unionByName(large)
    # of cells with the same nodes one is enough
    once = every.where("k = 1").groupBy(F.xxhash64("nodes").alias("cell")).agg(F.lit(0).alias("block"), F.first("nodes").alias("nodes"))
    blocks = written(once.unionByName(every.where("k > 1").select("cell", "block", "nodes")), "blocks")

    node_points = points.select("node", "n", "point")
    members = blocks.select(F.xxhash64("cell", "block").alias("key"), F.lit(0).alias("side"), F.explode("nodes").alias("node")).withColumn("label", F.col("node"))
    found = _in_blocks(members, node_points, _first_partners, "a long, b long").distinct()
    # blocks of one cell meet through their smallest nodes
    heads = blocks.groupBy("cell").agg(F.min(F.col("nodes")[0]).alias("a"), F.count("*").alias("k")).where("k > 1")
    across = blocks.join(heads, "cell").select("a", F.col("nodes")[0].alias("b")).where("a <> b").distinct()
    tried = written(found.unionByName(across).distinct(), "pairs")
    links = written(_verified(docs, tried, points), "links")
    labels = components(links)

    # cells that still hold unlike labels: of those nodes that pass the bound with one of another label, whole sets
    at = blocks.select("cell", "block", F.explode("nodes").alias("node")).join(labels.withColumnRenamed("component", "label"), "node", "left")
    at = at.withColumn("label", F.coalesce("label", "node"))
    per_block = at.groupBy("cell", "block").agg(F.min("label").alias("low"), F.max("label").alias("high"))
    mixed = per_block.groupBy("cell").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low <> high").select("cell")
    per_block = written(per_block.join(mixed, "cell"), "blocks")
    x, y = per_block.alias("x"), per_block.alias("y")
    meet = x.join(y, F.expr("x.cell = y.cell and x.block <= y.block and not (x.low = x.high and y.low = y.high and x.low = y.low)"))
    meet = meet.select(F.col("x.cell").alias("cell"), F.xxhash64("x.cell", "x.block", "y.block").alias("key"), F.explode(F.expr("if(x.block = y.block, array(struct(x.block as block, 0 as side)), array(struct(x.block as block, 0 as side), struct(y.block as block, 1 as side)))")).alias("s")).select("cell", "key", "s.block", "s.side")
    again = meet.join(at, ["cell", "block"])
    near = components(_in_blocks(again, node_points, _may_link, "a long, b long").distinct())
    near = near.join(labels.withColumnRenamed("component", "label"), "node", "left").withColumn("label", F.coalesce("label", "node"))
    near = written(_meetings(written(near, "near")), "near")
    whole = _whole_sets(docs, near.select("node").distinct(), points)
    more = written(_in_blocks(near, whole, _spanning_links, "a long, b long"), "links")
    labels = components(links.unionByName(more))
    out = sets.select("doc_id", "text_hash", F.col("n").alias("n_shingles"), "node").join(labels, "node", "left")
    return out.select("doc_id", "text_hash", "n_shingles", "node", F.coalesce("component", "node").alias("class"))


def jaccard_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df: doc_id, n_shingles, component_id.

    A set is a text's distinct shingles of five words (A-Z as a-z); fewer words are one shingle; null texts and texts
    without words are empty, linked with nothing.  component_id is the smallest doc_id that links reach; equal sets
    link.  Rows with a null id or an id that repeats are judged by their texts all the same; a component without any
    id has null.  An empty table gives no rows; other columns of df are left aside.
    """
    rows = jaccard_classes(df, text_col, id_col)
    least = rows.where("class is not null").groupBy("class").agg(F.min("doc_id").alias("component_id"))
    out = rows.join(least, "class", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
