"""Splits of block-gzipped alignment files: runs of blocks found by their headers, and an index that leads to the blocks of a region.

A place in such a file is a virtual offset: the byte of a block in the file, times 2^16, and the byte within the
block's content. A split begins at the first block after its first byte and there at the first record, which is found by
its shape (sizes that add up, names, a CIGAR that fits the sequence) and that of the record after it. The task on the
left knows by counting where that record begins, and raises an error if the two differ; so a split that went wrong is
never read silently. Records cross block and split ends freely.
"""

from __future__ import annotations

import bisect
import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

#: Bytes read at a time.
READ = 1 << 20
# First bin and size in bits of each level of the index, and the bin that holds statistics.
_LEVELS = ((0, 29), (1, 26), (9, 23), (73, 20), (585, 17), (4681, 14))
_STATISTICS = 37450
_MAGIC = b"\x1f\x8b\x08\x04"


@dataclass
class Bytes:
    """A file read forward in pieces, up to a byte in large ones; counts what it reads."""

    open: Callable
    at: int
    size: int
    upto: int
    held: bytes = b""
    read: int = 0
    file: object = field(default=None, repr=False)

    def take(self, n: int) -> bytes:
        """The next n bytes, fewer at the end of the file, which stay held."""
        while len(self.held) < n and self.at + len(self.held) < self.size:
            if self.file is None:
                self.file = self.open()
                self.file.seek(self.at + len(self.held))
            more = self.file.read(max(n - len(self.held), min(READ, self.upto - self.at - len(self.held))))
            if not more:
                break
            self.held += more
            self.read += len(more)
        return self.held[:n]

    def skip(self, n: int) -> None:
        self.held, self.at = self.held[n:], self.at + n

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


def block_size(head: bytes) -> int:
    """Size of the block that begins with head, 0 if none does."""
    if len(head) < 18 or head[:4] != _MAGIC:
        return 0
    k, end = 12, 12 + struct.unpack_from("<H", head, 10)[0]
    while k + 4 <= min(end, len(head)):
        n = struct.unpack_from("<H", head, k + 2)[0]
        if head[k : k + 2] == b"BC" and n == 2 and k + 6 <= len(head):
            return struct.unpack_from("<H", head, k + 4)[0] + 1
        k += 4 + n
    return 0


def find_block(f: Bytes) -> bool:
    """Moves f to the first block at or after its place: one that inflates and is followed by another block or the end."""
    while True:
        k = f.take(2 * (1 << 16)).find(_MAGIC)
        while k >= 0:
            n = block_size(f.held[k : k + 280])
            if n and k + n <= len(f.take(k + n + 280)):
                after = f.held[k + n : k + n + 280]
                if (not after or block_size(after)) and _inflated(f.held[k : k + n]) is not None:
                    f.skip(k)
                    return True
            k = f.held.find(_MAGIC, k + 1, 1 << 16)
        if len(f.held) < 1 << 16:
            f.skip(len(f.held))
            return False
        f.skip((1 << 16) - 3)


def _inflated(block: bytes) -> bytes | None:
    d = zlib.decompressobj(31)
    try:
        out = d.decompress(block)
    except zlib.error:
        return None
    return out if d.eof else None


class Content:
    """Inflated bytes of a run of blocks, and the virtual offset of each."""

    def __init__(self, f: Bytes, skip: int = 0):
        self.f, self.data, self.at = f, bytearray(), skip
        self.starts, self.places = [], []  # where the content of a block begins in data, and the block in the file

    def more(self) -> bool:
        """Inflates one more block; False at the end of the file."""
        n = block_size(self.f.take(280))
        if not n:
            if self.f.held:
                raise ValueError(f"no block at byte {self.f.at}")
            return False
        out = _inflated(self.f.take(n)[:n])
        if out is None:
            raise ValueError(f"damaged block at byte {self.f.at}")
        self.starts.append(len(self.data))
        self.places.append(self.f.at)
        self.data += out
        self.f.skip(n)
        return True

    def need(self, at: int, n: int) -> bool:
        while len(self.data) < at + n:
            if not self.more():
                return False
        return True

    def offset(self, at: int) -> int:
        """Virtual offset of data[at]; the end of a block is the beginning of the next one that isn't empty."""
        while at >= len(self.data) and self.more():
            pass
        if at >= len(self.data):
            return self.f.size << 16
        k = bisect.bisect_right(self.starts, at) - 1
        return self.places[k] << 16 | at - self.starts[k]

    def drop(self) -> None:
        """Forgets what lies before the current place."""
        k = bisect.bisect_right(self.starts, self.at) - 1
        if k > 16:
            cut = self.starts[k]
            del self.data[:cut], self.starts[:k], self.places[:k]
            self.starts = [s - cut for s in self.starts]
            self.at -= cut


def looks_like_record(c: Content, at: int, lengths: list[int]) -> int:
    """Size of the record that may begin at a place, with its length field; 0 if none does. lengths: those of the contigs."""
    if not c.need(at, 36):
        return 0
    size, ref, pos, n_name, _, _, n_cigar, flag, n_seq, next_ref, next_pos, _ = struct.unpack_from("<iiiBBHHHiiii", c.data, at)
    whole = 32 + n_name + 4 * n_cigar
    if n_name < 1 or n_seq < 0 or flag > 0xFFF or size < whole + (n_seq + 1) // 2 + n_seq:
        return 0
    for r, p in ((ref, pos), (next_ref, next_pos)):
        if not (-1 <= r < len(lengths)) or not (-1 <= p <= (lengths[r] if r >= 0 else 1 << 31)):
            return 0
    if not c.need(at, 4 + whole):
        return 0
    name = c.data[at + 36 : at + 36 + n_name]
    if name[-1] or not all(33 <= x <= 126 for x in name[:-1]):
        return 0
    ops = struct.unpack_from(f"<{n_cigar}I", c.data, at + 36 + n_name)
    if any(o & 15 > 8 for o in ops) or (ops and n_seq and sum(o >> 4 for o in ops if o & 15 in (0, 1, 4, 7, 8)) != n_seq):
        return 0
    return 4 + size


def find_record(c: Content, stop: int, lengths: list[int]) -> int | None:
    """Virtual offset of the first record that begins in a block before byte stop; c begins at a block. None if there is no such record."""
    at, stop = 0, min(stop, c.f.size)
    while c.offset(at) >> 16 < stop:
        n = looks_like_record(c, at, lengths)
        if n and (not c.need(at + n, 1) or looks_like_record(c, at + n, lengths)):
            return c.offset(at)
        at += 1
    return None


@dataclass
class Split:
    """Records that begin at virtual offsets from start to stop. start None: to be found after byte ``after``. follows: another split goes on at stop's byte."""

    after: int
    start: int | None
    stop: int
    follows: bool = False


def splits(size: int, first: int, step: int, chunks: list[tuple[int, int]] | None = None) -> list[Split]:
    """Splits of about step bytes of a file whose first record is at a virtual offset, or of chunks of it."""
    out = []
    for begin, end in [(first, size << 16)] if chunks is None else chunks:
        cuts = list(range((begin >> 16) + step, (end >> 16) - step // 2, step))
        for k in range(len(cuts) + 1):
            out.append(Split(cuts[k - 1] if k else begin >> 16, None if k else begin, cuts[k] << 16 if k < len(cuts) else end, k < len(cuts)))
    return out


def records(open_: Callable, size: int, split: Split, lengths: list[int], seen: Callable[[Bytes], None] = lambda f: None) -> Iterator[tuple[int, memoryview]]:
    """(virtual offset, record without its length field) of a split."""
    upto = min(size, (split.stop >> 16) + (1 << 16))
    f = Bytes(open_, split.after, size, upto)
    try:
        if split.start is None:
            if not find_block(f) or f.at << 16 >= split.stop:
                return
            found = find_record(Content(Bytes(open_, f.at, size, upto)), (split.stop + 0xFFFF) >> 16, lengths)
            if found is None or found >= split.stop:
                return
            f.close()
            f = Bytes(open_, found >> 16, size, upto, read=f.read)
            c = Content(f, found & 0xFFFF)
        else:
            c = Content(f, split.start & 0xFFFF)
        while (here := c.offset(c.at)) < split.stop and here < size << 16:
            if not c.need(c.at, 4) or not c.need(c.at, 4 + (n := struct.unpack_from("<i", c.data, c.at)[0])):
                raise ValueError("the file ends within a record")
            yield here, bytes(c.data[c.at + 4 : c.at + 4 + n])
            c.at += 4 + n
            c.drop()
        if split.follows:
            g = Bytes(open_, split.stop >> 16, size, 0)
            if find_block(g):
                # the next record may begin beyond several blocks, all of which it passes over
                guess = find_record(Content(Bytes(open_, g.at, size, 0)), max(g.at, here >> 16) + 1, lengths)
                if guess is not None and guess != here or guess is None and here < size << 16:
                    raise ValueError(f"records can't be told apart at byte {g.at}; read the file with step=0")
            g.close()
    finally:
        seen(f)
        f.close()


def region_bins(begin: int, end: int) -> set[int]:
    """Bins of the index that may hold records over begin to end (exclusive)."""
    return {b for first, bits in _LEVELS for b in range(first + (begin >> bits), first + (max(begin, end - 1) >> bits) + 1)}


def chunks(index: bytes, ref: int, begin: int, end: int, gap: int = 1 << 16) -> list[tuple[int, int]]:
    """Runs of virtual offsets, in order and apart, that hold all records of a contig over begin to end."""
    if index[:4] != b"BAI\1":
        raise ValueError("not a BAI index")
    (n_ref,) = struct.unpack_from("<i", index, 4)
    at, end = 8, min(end, 1 << 29)
    wanted = region_bins(begin, end)
    for k in range(n_ref):
        found = []
        (n_bin,) = struct.unpack_from("<i", index, at)
        at += 4
        for _ in range(n_bin):
            b, n = struct.unpack_from("<Ii", index, at)
            if k == ref and b in wanted and b != _STATISTICS:
                found += list(struct.iter_unpack("<QQ", index[at + 8 : at + 8 + 16 * n]))
            at += 8 + 16 * n
        (n_window,) = struct.unpack_from("<i", index, at)
        if k == ref:
            # no record over begin starts before the first one of its window of 2^14
            window = begin >> 14
            least = struct.unpack_from("<Q", index, at + 4 + 8 * window)[0] if window < n_window else 0
            out: list[tuple[int, int]] = []
            for a, z in sorted((max(a, least), z) for a, z in found if z > least):
                if out and a >> 16 <= (out[-1][1] >> 16) + gap:
                    out[-1] = (out[-1][0], max(z, out[-1][1]))
                else:
                    out.append((a, z))
            return out
        at += 4 + 8 * n_window
    return []
