"""Merkle trees over ordered entries whose node borders depend on content, with range proofs.

Where a node ends is decided from the digests in it: by a gear hash, by a rolling polynomial, or after a fixed
number of entries. With content-defined borders, the tree of a set of entries does not depend on how they came
together, so merging two histories gives the tree that loading them at once gives.

A node's digest covers its children's digests and their first keys. Entries are (key, value): any ordered
integers and bytes. Proofs are plain data and are checked without the tree.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from operator import itemgetter

Cut = Callable[[bytes, int], bool]
Digest = Callable[[bytes], bytes]
Entry = tuple[int, bytes]


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=32).digest()


def sha256(data: bytes) -> bytes:
    return hashlib.sha256(data).digest()


def _key(k: int) -> bytes:
    return k.to_bytes(8, "big", signed=True)


#: A random number for each byte value, from a rule.
GEAR = [int.from_bytes(digest(bytes([i]))[:8], "big") for i in range(256)]


def gear_cut(fanout: int) -> Cut:
    """Ends a node where the gear hash of an entry's digest has its top bits clear: log2(fanout) of them at the leaves, and one more on each level above."""
    least = max(1, fanout.bit_length() - 1)

    def cut(d: bytes, level: int) -> bool:
        h = 0
        bits = min(64, least + level)
        for b in d:
            h = ((h << 1) + GEAR[b]) & 0xFFFFFFFFFFFFFFFF
        return h >> (64 - bits) == 0

    return cut


def polynomial_cut(fanout: int, width: int = 23) -> Cut:
    """Ends a node where a cyclic polynomial of a digest's bytes has its low bits clear."""
    mask = (1 << width) - 1

    def cut(d: bytes, level: int) -> bool:
        h = 0
        for b in d:
            h = ((h << 1 | h >> (width - 1)) & mask) ^ (GEAR[b] & mask)
        return h % fanout == 0

    return cut


@dataclass(frozen=True)
class Proof:
    """For each level from the leaves: digests and first keys of the node's members left and right of those below."""

    entries: tuple[Entry, ...]
    levels: tuple[tuple[tuple[tuple[bytes, bytes], ...], tuple[tuple[bytes, bytes], ...], tuple[int, ...]], ...]
    first: bool
    last: bool

    def size(self) -> int:
        """Bytes that the proof takes beyond the entries."""
        return sum(len(k) + len(d) for left, right, _ in self.levels for k, d in (*left, *right)) + 2


class ChunkedTree:
    """A tree of entries in the order of their keys, which are distinct."""

    def __init__(self, entries: Sequence[Entry], cut: Cut | None = None, fanout: int = 4, most: int = 92, hashed: Digest = digest) -> None:
        self.entries = sorted(entries)
        self.cut, self.fanout, self.most, self.hashed = cut, fanout, most, hashed
        #: Levels from below: members as (first key, digest), and where each node begins in its level's members.
        self.levels: list[list[tuple[bytes, bytes]]] = []
        self.starts: list[list[int]] = []
        #: Nodes whose digest had to be computed.
        self.made = 0
        self._grow([(_key(k), hashed(_key(k) + v)) for k, v in self.entries], 0, None)

    def _grow(self, members: list[tuple[bytes, bytes]], same: int, old: ChunkedTree | None) -> None:
        """Levels above the leaves, of which the first are the same as in old: nodes that end among those are kept, on each level."""
        self.levels, self.starts = [members], []
        while not self.starts or len(self.starts[-1]) > 1:
            level = len(self.starts)
            members = self.levels[-1]
            kept = [s for s in old.starts[level] if s < same] if old and level < len(old.starts) else []
            # The last of these nodes may go on beyond what is the same.
            whole = max(0, len(kept) - 1)
            starts = kept[:whole] + self._split(members, level, kept[whole] if kept else 0)
            self.starts.append(starts)
            ends = [*starts[1:], len(members)]
            reused = old.levels[level + 1][:whole] if whole else []
            self.made += len(starts) - whole
            self.levels.append(reused + [(members[a][0] if a < b else b"", node_digest(members[a:b], self.hashed)) for a, b in zip(starts[whole:], ends[whole:], strict=True)])
            same = whole

    def _split(self, members: list[tuple[bytes, bytes]], level: int, begin: int = 0) -> list[int]:
        """Where the nodes from begin on start."""
        starts, n = [begin], 0
        for i in range(begin, len(members)):
            d = members[i][1]
            n += 1
            # A node has two members at least, or levels would not become fewer.
            full = n >= self.fanout if self.cut is None else n >= 2 and (n >= self.most or self.cut(d, level))
            if full and i + 1 < len(members):
                starts.append(i + 1)
                n = 0
        return starts

    @property
    def root(self) -> bytes:
        return self.levels[-1][0][1]

    @property
    def height(self) -> int:
        return len(self.starts)

    def merged(self, other: ChunkedTree) -> ChunkedTree:
        """The tree of both trees' entries; of equal keys, the other's value counts. If the other's keys come later, only the right spine is made anew."""
        return self.updated(other.entries)

    def updated(self, entries: Sequence[Entry], gone: Sequence[int] = ()) -> ChunkedTree:
        """This tree with entries set and keys removed. Nodes left of the first change are kept on every level, with their digests."""
        new = dict(self.entries) | dict(entries)
        for k in gone:
            new.pop(k, None)
        out = ChunkedTree([], self.cut, self.fanout, self.most, self.hashed)
        out.entries, out.made = sorted(new.items()), 0
        first = min([k for k, _ in entries] + list(gone), default=None)
        same = len(self.entries) if first is None else bisect_left(self.entries, (first,))
        members = self.levels[0][:same] + [(_key(k), self.hashed(_key(k) + v)) for k, v in out.entries[same:]]
        out._grow(members, same, self)
        return out

    def without(self, keys: Sequence[int]) -> ChunkedTree:
        return self.updated([], keys)

    def lower_bound(self, key: int) -> int:
        """The place of the first entry whose key is not below key; the last place if all are."""
        return max(0, min(len(self.entries) - 1, bisect_left(self.entries, (key,))))

    def newest(self) -> Entry | None:
        """The right-most entry."""
        return self.entries[-1] if self.entries else None

    def prove(self, low: int, high: int) -> Proof:
        """Entries from low to high with one neighbour on each side where there is one, and what leads to the root."""
        key = itemgetter(0)
        a = max(0, bisect_right(self.entries, low - 1, key=key) - 1)
        b = min(len(self.entries), bisect_right(self.entries, high, key=key) + 1)
        shown, levels = tuple(self.entries[a:b]), []
        for members, starts in zip(self.levels, self.starts, strict=False):
            if not members:
                break
            p, q = bisect_right(starts, a) - 1, bisect_right(starts, max(a, b - 1)) - 1
            begin, end = starts[p], starts[q + 1] if q + 1 < len(starts) else len(members)
            cuts = tuple(s - begin for s in starts[p + 1 : q + 1])
            levels.append((tuple(members[begin:a]), tuple(members[b:end]), cuts))
            a, b = p, q + 1
        return Proof(shown, tuple(levels), not shown or shown[0] == self.entries[0], not shown or shown[-1] == self.entries[-1])


def node_digest(members: Sequence[tuple[bytes, bytes]], hashed: Digest = digest) -> bytes:
    return hashed(b"".join(k + d for k, d in members))


def verify(proof: Proof, root: bytes, low: int, high: int, hashed: Digest = digest) -> list[Entry] | None:
    """The entries from low to high if the proof leads to the root and shows all of them; None if it does not."""
    keys = [k for k, _ in proof.entries]
    if keys != sorted(set(keys)):
        return None
    members = [(_key(k), hashed(_key(k) + v)) for k, v in proof.entries]
    left_open = right_open = False
    for left, right, cuts in proof.levels:
        left_open, right_open = left_open or bool(left), right_open or bool(right)
        members = [*left, *members, *right]
        borders = [0, *cuts, len(members)]
        if borders != sorted(set(borders)):
            return None
        members = [(members[a][0], node_digest(members[a:b], hashed)) for a, b in zip(borders, borders[1:])]
    found = members[0][1] if len(members) == 1 else node_digest(members, hashed)
    if found != root or len(members) > 1 and proof.levels:
        return None
    # Entries left out on a side must lie beyond the neighbour that is shown on it.
    if left_open and not (keys and keys[0] < low) or right_open and not (keys and keys[-1] > high):
        return None
    return [e for e in proof.entries if low <= e[0] <= high]
