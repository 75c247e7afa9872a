"""N-gram Jaccard self-join with count-vector R-trees, exact at any size.

Sets. A text's set is its distinct word n-grams as 64-bit hashes. Texts are read once; a set is stored as the high 48 bits of its
hashes (a chance collision inside one pair has a probability of about 1e-9). Equal sets form a class (a 128-bit digest), and
only one member of a class goes on, so copies never meet each other.

Sharding. A single R-tree over everything can't be dealt to tasks: bounding boxes of group counts overlap almost everywhere. So
classes are first brought together by content. Two sets of a and b elements with 100 * i >= p * u differ in at most
d = (a + b) (100 - p) / (100 + p) elements. With the elements dealt by hash into more than d
groups, at least one group holds the same elements in both. Sizes are cut into bands so that a pair lies in
one band or two neighbours; each set therefore has, in its own band's grouping and in that of the band below,
one key a group: the digest of the group's content. A linked pair shares a key, and a key
is so specific (all of a group's elements) that little else shares it. Empty groups give no key unless a
set has more of them than the grouping has spare groups. Keys of one class alone, nearly all, are left out before they are
shuffled a second time, by a bitmap of fixed size over the others.

Links, all found inside shards (``forest``). A shard's sets are points of group counts, bulk-loaded into an
R-tree that is joined with itself from the root down; a pair of nodes is followed only while the summed minima of
their upper corners reach the overlap that their sizes need and while they aren't wholly of one component. Pairs of points
that remain are verified on their sets, a union-find skips those that verified links already connect, and a shard of m members returns
at most m - 1 links, so no pairs of a group are ever emitted.
Classes that shared keys connect are a cluster, and a cluster of up to ``SHARD`` members is one shard, so all its pairs are settled
there. Larger clusters take two rounds. Round 1: each class goes to one shard, that of the smallest class that shares most of its keys; shards over
``SHARD`` members are split, each part with the shard's first class. Round 2: the keys whose members are still in
different components and were not together in one shard of round 1 are open; those with the same least component are one shard, larger ones as pairs of blocks.
There, R-trees over the points alone come first, and only the sets of points that they can't rule out are sent after.
Hence every linked pair is either compared or connected by links.

Defined results: null, empty or word-less texts have an empty set and are linked with nothing; a text of
fewer words than n is one element; rows with equal ids are separate rows; an empty table gives no rows;
extra columns are ignored. A null id counts as larger than any other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm import _text
from strandloom.llm._bits import bitmap, marked
from strandloom.llm._store import dropped, released, stored
from strandloom.llm.components import components

DIMS = (64, 1024)  # least and most coordinates of a shard's points
POINT_DIMS = 256  # coordinates of an R-tree of the points that are sent ahead of sets, and the fewest of a point
POINT_MOST = 1 << 16  # the most
SHARD = 2048  # members of a block
BLOCK_ELEMENTS = 1 << 21  # or so many elements
PART_ELEMENTS = 1 << 17  # elements of a shard that are worked on at a time, beside the shard's own
GROUPS_BYTES = 1 << 22  # bytes of groups that a task takes at a time
LEAF = 32
FAN = 8
ELEMENT_BYTES = 6
KEY_BITS = 48
#: Row numbers by which stored sets are picked are sent to the tasks up to this many (32 MB); beyond it the sets are shuffled to them.
BROADCAST_IDS = 4_000_000

SETS = "row long, doc_id long, n_shingles long, h1 long, h2 long, elements binary"


def bands(p: int, largest: int) -> list[int]:
    """First size of each band; a partner of a set is in its band or a neighbour."""
    out = [1]
    while out[-1] <= largest:
        out.append(max(out[-1] + 1, (100 * (out[-1] - 1)) // p + 1))
    return out


def groups_of(p: int, first: int, end: int) -> tuple[int, int]:
    """Groups of the band of sizes first..end-1, and how many of them are spare for empty groups."""
    small = end - 1
    d = (small + 100 * small // p) * (100 - p) // (100 + p)
    if not d:
        return 0, 0
    spare = 1 + d // 24
    return d + 1 + spare, spare


def element_sets(run: _text.Run, size: int) -> Iterator[np.ndarray]:
    """Sorted distinct elements of each text."""
    win = _text.windows(run.words, size)
    for k in range(run.hi - run.lo):
        a, b = run.first[k], run.first[k + 1]
        if b - a >= size:
            yield np.unique(win[a : b - size + 1])
        elif b > a:
            yield np.array([_text.whole(run.words[a:b])])
        else:
            yield np.zeros(0, np.uint64)


def digests(sets: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A 128-bit digest of each of the sets that lie one after another in an array, first[k] being where set k begins."""
    n = np.diff(first)
    out = np.zeros((len(n), 2), np.uint64)
    full = np.flatnonzero(n)
    if len(full):
        for k, seed in enumerate((0x5851F42D4C957F2D, 0x14057B7EF767814F)):
            out[full, k] = _text.mixed(np.add.reduceat(_text.mixed(sets ^ np.uint64(seed)), first[full]) + n[full].astype(np.uint64))
    return out.view(np.int64)


def packed(sets: np.ndarray) -> np.ndarray:
    """The high ELEMENT_BYTES bytes of each element, which keeps their order."""
    return np.ascontiguousarray((sets >> np.uint64(64 - 8 * ELEMENT_BYTES)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :ELEMENT_BYTES]).reshape(-1)


def unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The elements of a column of packed sets, sorted within each, and where each set begins. Chunks are unpacked in place, without a copy of them together."""
    chunks = [c.cast(pa.large_binary()) for c in (column.chunks if isinstance(column, pa.ChunkedArray) else [column]) if len(c)]
    raw, first = [], [np.zeros(1, np.int64)]
    for c in chunks:
        _, offsets, data = c.buffers()
        offsets = np.frombuffer(offsets, np.int64)[c.offset : c.offset + len(c) + 1]
        raw.append(np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]].reshape(-1, ELEMENT_BYTES) if data else np.zeros((0, ELEMENT_BYTES), np.uint8))
        first.append((offsets[1:] - offsets[0]) // ELEMENT_BYTES + first[-1][-1])
    wide = np.zeros((sum(map(len, raw)), 8), np.uint8)
    at = 0
    for r in raw:
        wide[at : at + len(r), :ELEMENT_BYTES] = r
        at += len(r)
    return wide.reshape(-1).view("<u8"), np.concatenate(first)


def shard_keys(s: np.ndarray, p: int, edges: list[int]) -> np.ndarray:
    n = len(s)
    band = int(np.searchsorted(edges, n, "right")) - 1
    out = []
    for k in (band, band - 1):
        if k < 0:
            continue
        g, spare = groups_of(p, edges[k], edges[k + 1])
        if not g or (k < band and n * p > 100 * (edges[k + 1] - 1)):  # too large for any partner in the band below
            continue
        group = (_text.mixed(s + np.uint64(k)) % np.uint64(g)).astype(np.int64)
        held = np.bincount(group, minlength=g)
        order = np.argsort(group, kind="stable")
        full = np.flatnonzero(held)
        total = np.add.reduceat(_text.mixed(s[order] ^ np.uint64(0xD6E8FEB86659FD93)), np.concatenate([[0], np.cumsum(held[full])[:-1]]))
        key = _text.mixed(_text.mixed(total + full.astype(np.uint64)) + np.uint64(k))
        out.append(key)
        if g - len(full) > spare:
            out.append(_text.mixed(_text.mixed(np.flatnonzero(held == 0).astype(np.uint64)) + np.uint64(k)))
    # 48 bits are shorter to shuffle; an equal key by chance only makes a pair that fails to verify
    return np.concatenate(out) >> np.uint64(64 - KEY_BITS) if out else np.zeros(0, np.uint64)


def prepared(docs: DataFrame, row: str, doc_id: str, text: str, size: int) -> DataFrame:
    """A row for each document: its set's size and digest, and the set where this task meets it first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for b in batches:
            for r in _text.runs(b.column(2)):
                sets = list(element_sets(r, size))
                n = np.array([len(s) for s in sets], np.int64)
                h = digests(np.concatenate(sets), np.concatenate([[0], np.cumsum(n)]))
                new = np.zeros(len(n), bool)
                for k, x in enumerate(zip(h[:, 0].tolist(), h[:, 1].tolist())):
                    if n[k] and x not in seen:
                        if len(seen) > 500_000:
                            seen.clear()
                        seen.add(x)
                        new[k] = True
                elements = pa.array([packed(s).tobytes() if new[k] else None for k, s in enumerate(sets)], pa.binary())
                own = slice(r.lo, r.hi)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0)[own], b.column(1)[own], pa.array(n), pa.array(h[:, 0]), pa.array(h[:, 1]), elements],
                    names=["row", "doc_id", "n_shingles", "h1", "h2", "elements"],
                )

    return docs.select(F.col(f"`{row}`").cast("long"), F.col(f"`{doc_id}`").cast("long"), F.col(f"`{text}`").cast("string")).mapInArrow(run, SETS)


def keyed(heads: DataFrame, p: int, bits=None) -> DataFrame:
    """(key, cls, n) of each class, from heads: (cls, elements). With bits, a broadcast bitmap, a row for each key of a class that it marks; without,
    keys are counted over some classes at a time before they are shuffled, and cls is the smallest of n classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = bands(p, 1000)
        for b in batches:
            for x in range(0, len(b), 1000):
                part = b.slice(x, 1000)
                e, first = unpacked(part.column(1))
                keys = []
                for k in range(len(part)):
                    s = e[first[k] : first[k + 1]]
                    if len(s) >= edges[-1]:
                        edges = bands(p, 2 * len(s))
                    keys.append(shard_keys(s, p, edges))
                key, cls = np.concatenate(keys), np.repeat(part.column(0).to_numpy(), [len(x) for x in keys])
                n = np.ones(len(key), np.int64)
                if bits is not None:
                    ok = marked(bits.value, key, KEY_BITS)
                    key, cls, n = key[ok], cls[ok], n[ok]
                elif len(key):
                    o = np.lexsort((cls, key))
                    key, cls = key[o], cls[o]
                    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
                    key, cls, n = key[new], cls[new], np.diff(np.append(new, len(key)))
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(cls), pa.array(n)], names=["key", "cls", "n"])
            _text.trim()

    return heads.select("cls", "elements").mapInArrow(run, "key long, cls long, n long")


def tree_pairs(vec: np.ndarray, n: np.ndarray, p: int, label: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of points whose summed minima reach the overlap that they need, by joining an R-tree with itself from the root down.
    Pairs of nodes whose points all have one label are left out."""
    label = np.arange(len(n)) if label is None else label
    order = np.lexsort((*vec.T[:4], n))
    vec, size, lab = vec[order], n[order], label[order]
    levels = [(vec, size, size, lab, lab)]
    while len(levels[-1][0]) > 1:
        hi, lo_n, hi_n, lo_l, hi_l = levels[-1]
        cut = np.arange(0, len(hi), FAN)
        levels.append((np.maximum.reduceat(hi, cut), np.minimum.reduceat(lo_n, cut), np.maximum.reduceat(hi_n, cut), np.minimum.reduceat(lo_l, cut), np.maximum.reduceat(hi_l, cut)))
    stack = [(len(levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    most = max(256, (1 << 20) // vec.shape[1])
    while stack:
        k, i, j = stack.pop()
        if len(i) > most:
            half = len(i) // 2
            stack += [(k, i[half:], j[half:]), (k, i[:half], j[:half])]
            continue
        hi, lo_n, hi_n, lo_l, hi_l = levels[k]
        ok = (100 * hi_n[i] >= p * lo_n[j]) & (100 * hi_n[j] >= p * lo_n[i]) & (np.minimum(lo_l[i], lo_l[j]) != np.maximum(hi_l[i], hi_l[j]))
        i, j = i[ok], j[ok]
        need = -(-p * (lo_n[i] + lo_n[j]) // (100 + p))
        ok = np.minimum(hi[i], hi[j]).sum(axis=1) >= need
        i, j = i[ok], j[ok]
        if not len(i):
            continue
        if k == 0:
            yield order[i], order[j]
            continue
        below = len(levels[k - 1][0])
        step = np.arange(FAN)
        a = np.repeat(i * FAN, FAN * FAN) + np.tile(np.repeat(step, FAN), len(i))
        b = np.repeat(j * FAN, FAN * FAN) + np.tile(step, len(i) * FAN)
        ok = (a < below) & (b < below) & ((a <= b) if k > 1 else (a < b))
        stack.append((k - 1, a[ok], b[ok]))


class Shard:
    """Sets one after another, with component labels that verified links merge."""

    def __init__(self, elements: np.ndarray, first: np.ndarray, comp: np.ndarray, side: np.ndarray, p: int):
        self.e, self.first, self.n, self.p, self.side = elements, first, np.diff(first), p, side
        self.label = np.unique(comp, return_inverse=True)[1]
        self.across = bool((side != side[0]).any())
        self.links: list[tuple[int, int]] = []

    def open(self, i: int, j: np.ndarray) -> np.ndarray:
        """Those of j that i may link with and isn't connected to."""
        ok = self.label[j] != self.label[i]
        if self.across:
            ok &= self.side[j] != self.side[i]
        return j[ok & (100 * self.n[j] >= self.p * self.n[i]) & (100 * self.n[i] >= self.p * self.n[j])]

    def linked(self, i: int, j: np.ndarray) -> np.ndarray:
        """Which of j link with i."""
        own = self.e[self.first[i] : self.first[i + 1]]
        n = self.n[j]
        at = np.cumsum(n) - n
        other = self.e[np.repeat(self.first[j] - at, n) + np.arange(int(n.sum()))]
        place = np.searchsorted(own, other)
        place[place == len(own)] = 0
        both = np.add.reduceat(own[place] == other, at, dtype=np.int64)
        return 100 * both >= self.p * (len(own) + n - both)

    def meet(self, i: int, j: np.ndarray) -> None:
        """Link i with those of j that it links with; of each component, members are tried until one links."""
        j, take = self.open(i, j), 1
        while len(j):
            order = np.argsort(self.label[j], kind="stable")
            j = j[order]
            lab = self.label[j]
            new = np.concatenate([[True], lab[1:] != lab[:-1]])
            nth = np.arange(len(j)) - np.repeat(np.flatnonzero(new), np.diff(np.append(np.flatnonzero(new), len(j))))
            now = nth < take
            try_, j = j[now], j[~now]
            cut = np.searchsorted(np.cumsum(self.n[try_]), np.arange(PART_ELEMENTS, int(self.n[try_].sum()) + 1, PART_ELEMENTS))
            for part in np.split(try_, np.unique(cut)):
                if len(part):
                    for k in part[self.linked(i, part)].tolist():
                        if self.label[k] != self.label[i]:
                            self.links.append((i, k))
                            self.label[self.label == self.label[k]] = self.label[i]
            j, take = self.open(i, j), 2 * take

    def counts(self, dims: int) -> np.ndarray:
        """Each set's element counts by dims groups, made from some sets at a time."""
        m = len(self.n)
        out = np.zeros((m, dims), np.uint16 if self.n.max(initial=0) < 1 << 15 else np.int32)
        cut = np.searchsorted(self.first, np.arange(PART_ELEMENTS, self.first[-1], PART_ELEMENTS), "right") - 1
        cut = np.unique(np.concatenate([cut, np.arange(0, m, max(1, PART_ELEMENTS // dims)), [m]]))
        for x, y in zip(cut[:-1].tolist(), cut[1:].tolist()):
            group = (self.e[self.first[x] : self.first[y]] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(65 - dims.bit_length())
            at = np.repeat(np.arange(y - x) * dims, self.n[x:y]) + group.view(np.int64)
            out[x:y] = np.bincount(at, minlength=(y - x) * dims).reshape(-1, dims)
        return out

    def forest(self) -> list[tuple[int, int]]:
        """Links that connect what the shard's links connect, at most one fewer than its members."""
        m = len(self.n)
        self.meet(0, np.arange(1, m))
        if m == 2 or not (self.label != self.label[0]).any():
            return self.links
        dims = 1 << int(np.clip(int(self.n.max()) // 2, *DIMS)).bit_length() - 1
        for i, j in tree_pairs(self.counts(dims), self.n, self.p, self.label):
            order = np.argsort(i, kind="stable")
            i, j = i[order], j[order]
            new = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]]))
            for a, b in zip(new.tolist(), np.append(new[1:], len(i)).tolist()):
                self.meet(int(i[a]), j[a:b])
        return self.links


def shard_links(rows: DataFrame, p: int) -> DataFrame:
    """Links (a, b) that connect what the shards connect. rows: (shard, lo, hi, cls, comp, side, elements); a shard's rows with one (lo, hi)
    meet in one task, and where they have two sides, only across. A task holds one such group at a time."""

    def found(t: pa.Table) -> pa.RecordBatch:
        shard, lo, hi, cls, comp, side = (t.column(k).to_numpy() for k in range(6))
        new = np.flatnonzero(np.concatenate([[True], (shard[1:] != shard[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])]))
        a, b = [], []
        for x, y in zip(new.tolist(), np.append(new[1:], len(t)).tolist()):
            if y - x > 1:
                for i, j in Shard(*unpacked(t.column(6).slice(x, y - x)), comp[x:y], side[x:y], p).forest():
                    a.append(cls[x + i])
                    b.append(cls[x + j])
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches):
            yield found(t)
            _text.trim()

    rows = rows.select("shard", "lo", "hi", "cls", "comp", "side", "elements")
    rows = rows.repartition("shard", "lo", "hi").sortWithinPartitions("shard", "lo", "hi", "cls")
    return rows.mapInArrow(run, "a long, b long")


def point_dims(n: np.ndarray) -> np.ndarray:
    """Coordinates of the points of sets of n elements: with less than one for eight elements, unrelated large sets look alike."""
    return np.clip(1 << np.log2(np.maximum(n, 1)).astype(np.int64) >> 2, POINT_DIMS, POINT_MOST)


def points(heads: DataFrame) -> DataFrame:
    """(cls, n, vec): each class's element counts by point_dims(n) groups, in the fewest bytes a count that hold them all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            e, first = unpacked(b.column(1))
            n, out = np.diff(first), []
            group = e * np.uint64(0x9E3779B97F4A7C15)
            for k, dims in enumerate(point_dims(n).tolist()):
                held = np.bincount((group[first[k] : first[k + 1]] >> np.uint64(65 - dims.bit_length())).astype(np.int64), minlength=dims)
                out.append(held.astype(np.min_scalar_type(int(held.max()))).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), pa.array(out, pa.binary())], names=["cls", "n", "vec"])

    return heads.select("cls", "elements").mapInArrow(run, "cls long, n long, vec binary")


def folded(vec: bytes, own: int, dims: int) -> np.ndarray:
    """A point of own coordinates, with dims of them."""
    return np.frombuffer(vec, f"<u{len(vec) // own}").reshape(dims, -1).sum(axis=1, dtype=np.int32)


def near_points(rows: DataFrame, p: int) -> DataFrame:
    """Of rows (shard, lo, hi, cls, comp, side, n, vec), those that have a partner of another component that the points can't rule out: first
    an R-tree of them in POINT_DIMS coordinates, then those pairs that are left in as many as both have."""

    def possible(i: np.ndarray, j: np.ndarray, n: np.ndarray, own: np.ndarray, vec: list[bytes], held: dict) -> np.ndarray:
        dims, ok = np.minimum(own[i], own[j]), np.ones(len(i), bool)
        need = -(-p * (n[i] + n[j]) // (100 + p))
        for d in np.unique(dims[dims > POINT_DIMS]).tolist():
            if d not in held:
                there = np.flatnonzero(own >= d)
                held[d] = np.cumsum(own >= d) - 1, np.stack([folded(vec[k], int(own[k]), d) for k in there.tolist()])
            place, wide = held[d]
            at = np.flatnonzero(dims == d)
            for part in np.split(at, np.arange(0, len(at), max(1, (1 << 20) // d))[1:]):
                ok[part] = np.minimum(wide[place[i[part]]], wide[place[j[part]]]).sum(axis=1) >= need[part]
        return ok

    def found(t: pa.Table) -> pa.Table:
        shard, lo, hi, _, comp, side, n = (t.column(k).to_numpy() for k in range(7))
        own, vec = point_dims(n), t.column(7).to_pylist()
        new = np.flatnonzero(np.concatenate([[True], (shard[1:] != shard[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])]))
        kept = np.zeros(len(t), bool)
        for x, y in zip(new.tolist(), np.append(new[1:], len(t)).tolist()):
            if y - x > 1:
                across, held = lo[x] != hi[x], {}
                flat = np.stack([folded(v, int(d), POINT_DIMS) for v, d in zip(vec[x:y], own[x:y])])
                for i, j in tree_pairs(flat, n[x:y], p, np.unique(comp[x:y], return_inverse=True)[1]):
                    ok = ~(kept[x + i] & kept[x + j])
                    if across:
                        ok &= side[x + i] != side[x + j]
                    i, j = i[ok], j[ok]
                    ok = possible(i, j, n[x:y], own[x:y], vec[x:y], held)
                    kept[x + i[ok]] = kept[x + j[ok]] = True
        return t.select(["shard", "lo", "hi", "cls", "comp", "side"]).filter(pa.array(kept))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches):
            yield from found(t).to_batches()
            _text.trim()

    rows = rows.select("shard", "lo", "hi", "cls", "comp", "side", "n", "vec").repartition("shard", "lo", "hi").sortWithinPartitions("shard", "lo", "hi", "cls")
    return rows.mapInArrow(run, "shard long, lo long, hi long, cls long, comp long, side long")


def whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole groups of rows, from batches in order of the first three columns; some GROUPS_BYTES or one group at a time, in the batches' own memory."""
    held: list[pa.Table] = []
    size = 0
    for b in batches:
        held.append(pa.table(b.columns, names=b.schema.names))
        size += b.nbytes
        if size < GROUPS_BYTES:
            continue
        t = pa.concat_tables(held)
        key = [t.column(k).to_numpy() for k in range(3)]
        cut = int(np.argmax(np.logical_and.reduce([x == x[-1] for x in key])))  # the last group may go on
        held, size = [t.slice(cut)], 0
        if cut:
            yield t.slice(0, cut)
        del t, b
    if held:
        yield pa.concat_tables(held)


def blocks(m: str, elements: str):
    """Blocks that a shard of m members and so many elements is cut into."""
    return F.greatest(F.ceil(F.col(m) / F.lit(SHARD)), F.ceil(F.col(elements) / F.lit(BLOCK_ELEMENTS)), F.lit(1)).cast("long")


def picked(sets: DataFrame, column: str, ids: DataFrame, how: str) -> DataFrame:
    """The sets whose column is (left_semi) or isn't (left_anti) among ids, a stored table of row numbers."""
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    return sets.join(ids.withColumnRenamed(ids.columns[0], "_id"), F.col(column) == F.col("_id"), how)


def clusters(member: DataFrame, own: DataFrame) -> DataFrame:
    """(node, label): classes that shared keys connect, member: (key, cls), own: (cls, shard). Classes are first connected to the class that they share
    most keys with; only what keys connect beyond that is connected in a second step, on the labels of the first."""
    near = components(own.select(F.col("cls").alias("a"), F.col("shard").alias("b")))
    near = stored(own.join(near, F.col("cls") == F.col("node"), "left").select("cls", F.coalesce("label", "cls").alias("at")), "near")
    held = stored(member.select("key", "cls").join(near, "cls").groupBy("key", "at").agg(F.lit(1)).select("key", "at"), "held")
    least = held.groupBy("key").agg(F.min("at").alias("a"), F.max("at").alias("most")).where("a < most").select("key", "a")
    across = stored(held.join(least, "key").where("at <> a").select("a", F.col("at").alias("b")).distinct(), "across")
    joined = components(across)
    out = stored(near.join(joined, F.col("at") == F.col("node"), "left").select(F.col("cls").alias("node"), F.coalesce("label", "at").alias("label")), "clusters")
    for x in (near, held, across, joined):
        dropped(member.sparkSession, x)
    return out


def first_round(own: DataFrame, heads: DataFrame) -> DataFrame:
    """(shard, part, cls): each class in the shard of the class that is the smallest of most of its keys (own), which is in all parts of it itself."""
    n = heads.select("cls", "n_shingles")
    wide = own.join(n, "cls").groupBy("shard").agg(F.count("*").alias("m"), F.sum("n_shingles").alias("e")).withColumn("parts", blocks("m", "e"))
    own = own.join(wide.select("shard", "parts"), "shard")
    dealt = own.where("cls <> shard").select("shard", F.pmod(F.xxhash64("cls"), F.col("parts")).alias("part"), "cls")
    return dealt.unionByName(wide.select("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.col("shard").alias("cls")))


def second_round(member: DataFrame, place: DataFrame, comp: DataFrame, heads: DataFrame) -> DataFrame:
    """(shard, lo, hi, cls, comp, side) of the keys whose members are neither of one component nor were in one part of one shard.
    Keys with the same least component are one shard, so that a class comes once for all of them."""
    at = place.groupBy("cls").agg(F.max(F.struct(F.col("cls") != F.col("shard"), F.xxhash64("shard", "part").alias("at"))).alias("x")).select("cls", "x.at")
    held = member.join(at, "cls").join(comp.select(F.col("node").alias("cls"), "label"), "cls", "left").select("key", "cls", F.coalesce("label", "cls").alias("comp"), "at")
    open_ = held.groupBy("key").agg(F.min("comp").alias("c1"), F.max("comp").alias("c2"), F.min("at").alias("a1"), F.max("at").alias("a2")).where("c1 < c2 and a1 < a2")
    rest = held.join(open_.select("key", "c1"), "key").groupBy(F.col("c1").alias("shard"), "cls").agg(F.first("comp").alias("comp"))
    rest = rest.join(heads.select("cls", "n_shingles"), "cls")
    size = rest.groupBy("shard").agg(F.count("*").alias("m"), F.sum("n_shingles").alias("e"))
    rest = rest.join(size, "shard").withColumn("nb", blocks("m", "e")).withColumn("side", F.pmod(F.xxhash64("cls"), F.col("nb")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("nb") - 1))
    return rest.withColumn("y", other).select("shard", F.least("side", "y").alias("lo"), F.greatest("side", "y").alias("hi"), "cls", "comp", "side")


def jaccard_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 3, percent: int = 90, row: str | None = None) -> DataFrame:
    """(row, doc_id, n_shingles, component_id) for each row of docs. component_id: the smallest doc_id reachable by links.
    row: a column of distinct row numbers; without it, they are made."""
    p, spark = percent, docs.sparkSession
    if row is None:
        docs, row = docs.select(F.col(f"`{doc_id}`"), F.col(f"`{text}`"), F.monotonically_increasing_id().alias("_row")), "_row"
    whole = stored(prepared(docs, row, doc_id, text, size), "sets")
    made = stored(whole.drop("elements"), "rows")  # what the result needs of the sets, which are dropped
    # a class's smallest row is one whose task met the class there first, so its set is stored
    first = F.min(F.when(F.col("elements").isNotNull(), F.col("row"))).alias("cls")
    classes = stored(whole.where("n_shingles > 0").groupBy("h1", "h2").agg(first, F.min("doc_id").alias("low")), "classes")
    met = whole.where("elements is not null")
    repeats = stored(met.select("row").join(classes.select("cls"), F.col("row") == F.col("cls"), "left_anti"), "repeats")  # other tasks' rows of the classes
    heads = picked(met, "row", repeats, "left_anti").select(F.col("row").alias("cls"), "n_shingles", "elements")
    shared = keyed(heads, p).repartition("key").groupBy("key").agg(F.min("cls").alias("pivot"), F.sum("n").alias("m")).where("m > 1")
    shared = stored(shared.select("key", "pivot"), "shared")  # keys of several classes only
    released(spark)
    bits = spark.sparkContext.broadcast(bitmap(shared, KEY_BITS))
    member = stored(keyed(heads, p, bits).drop("n").join(shared, "key"), "members")
    bits.unpersist()
    dropped(spark, shared)
    released(spark)
    candidates = stored(member.select("cls").distinct(), "candidates")
    heads = picked(heads, "cls", candidates, "left_semi")
    own = stored(member.groupBy("cls").agg(F.mode("pivot", deterministic=True).alias("shard")), "own")
    cluster = clusters(member, own)
    size_of = cluster.join(heads.select("cls", "n_shingles"), F.col("node") == F.col("cls")).groupBy("label").agg(F.count("*").alias("m"), F.sum("n_shingles").alias("e"))
    size_of = stored(size_of.select("label", (blocks("m", "e") > 1).alias("large")), "sizes")
    zero = F.lit(0).cast("long")
    place = cluster.join(size_of.where("not large"), "label").select(F.col("label").alias("shard"), zero.alias("part"), F.col("node").alias("cls"))
    large, far, temporary = size_of.where("large"), None, [candidates, repeats, size_of, cluster, member, own]
    if large.limit(1).count():
        within = stored(cluster.join(large, "label").select(F.col("node").alias("cls")), "within")
        member = stored(member.join(within, "cls", "left_semi"), "members")
        far = stored(first_round(own.join(within, "cls", "left_semi"), heads), "places")
        place = place.unionByName(far)
        temporary += [within, member, far]
    at = place.select("shard", F.col("part").alias("lo"), F.col("part").alias("hi"), "cls", F.col("cls").alias("comp"), zero.alias("side"))
    edges = stored(shard_links(at.join(heads.select("cls", "elements"), "cls"), p), "links")
    comp = components(edges)
    temporary.append(edges)
    released(spark)
    if far is not None:
        rest = second_round(member, far, comp, heads)
        rest = stored(near_points(rest.join(points(heads), "cls"), p), "rest")
        more = stored(shard_links(rest.join(heads.select("cls", "elements"), "cls"), p), "links")
        if more.limit(1).count():
            temporary.append(comp)
            comp = components(edges.union(more))
        temporary += [rest, more]
    for x in (*temporary, whole):
        dropped(spark, x)
    released(spark)
    of = classes.join(comp, classes["cls"] == comp["node"], "left").select("h1", "h2", F.coalesce("label", "cls").alias("comp"), "low")
    low = of.groupBy("comp").agg(F.min("low").alias("component_id"))
    named = of.join(low, "comp").select("h1", "h2", "component_id")
    out = made.where("n_shingles > 0").join(named, ["h1", "h2"]).select("row", "doc_id", "n_shingles", "component_id")
    return out.union(made.where("n_shingles = 0").select("row", "doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def query(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_shingles", "component_id")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates (five words, 0.8) stays: that of the smallest id, a null id counting as largest, of equal
    ids the first row. Rows without words stay. The rows are stored with numbers first, so that the choice holds whatever is computed anew."""
    held = stored(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.monotonically_increasing_id().alias("row")), "numbered")
    found = jaccard_components(held.select("row", "doc.doc_id", "doc.text"), size=5, percent=80, row="row")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "row")
    first = found.where("n_shingles > 0").groupBy("component_id").agg(F.min(order).alias("f")).select(F.col("f.row").alias("row"))
    keep = stored(first.union(found.where("n_shingles = 0").select("row")), "kept")
    dropped(spark, found)  # its tables alone, all stored by jaccard_components
    del found, first
    released(spark)
    return held.join(keep, "row", "left_semi").select("doc.*")
