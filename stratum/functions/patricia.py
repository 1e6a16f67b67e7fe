"""Merkle Patricia tries over nibble paths: digests and inclusion or absence proofs."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Mapping
from os.path import commonprefix


def _h(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


class Trie:
    """A trie of paths (hexadecimal strings of one length) to value digests. Nodes are leaves, extensions and branches."""

    def __init__(self, leaves: Mapping[str, str]) -> None:
        self.leaves = dict(sorted(leaves.items()))
        self.nodes: dict[str, tuple[str, str, tuple[str, ...]]] = {}
        self.root = self._build(list(self.leaves), 0) if self.leaves else ""

    def _put(self, kind: str, path: str, below: tuple[str, ...]) -> str:
        digest = _h(f"{kind}|{path}|{'|'.join(below)}")
        self.nodes[digest] = (kind, path, below)
        return digest

    def _build(self, paths: list[str], depth: int) -> str:
        if len(paths) == 1:
            return self._put("leaf", paths[0][depth:], (self.leaves[paths[0]],))
        shared = commonprefix([paths[0][depth:], paths[-1][depth:]])
        if shared:
            return self._put("extension", shared, (self._build(paths, depth + len(shared)),))
        groups: dict[str, list[str]] = {}
        for p in paths:
            groups.setdefault(p[depth], []).append(p)
        return self._put("branch", "", tuple(self._build(groups[n], depth + 1) if n in groups else "" for n in "0123456789abcdef"))

    def get(self, path: str) -> str | None:
        return self.leaves.get(path)

    def prove(self, path: str) -> list[tuple[str, str, tuple[str, ...]]]:
        """The nodes from the root on the way to a path, as far as there are any."""
        out, digest, rest = [], self.root, path
        while digest:
            kind, part, below = self.nodes[digest]
            out.append((kind, part, below))
            if kind == "leaf" or kind == "extension" and not rest.startswith(part):
                break
            digest, rest = (below[0], rest[len(part) :]) if kind == "extension" else (below[int(rest[0], 16)], rest[1:])
        return out


class VersionedTrie:
    """Tries that share nodes: an insertion copies the nodes on its path, and nodes that no kept root needs are deleted by their number of references.

    The root of a set of leaves is that of Trie, whatever the order in which they came. Paths have one length.
    """

    def __init__(self) -> None:
        self.nodes: dict[str, tuple[str, str, tuple[str, ...]]] = {}
        self.references: Counter[str] = Counter()

    @staticmethod
    def _children(node: tuple[str, str, tuple[str, ...]]) -> list[str]:
        return [] if node[0] == "leaf" else [d for d in node[2] if d]

    def _put(self, kind: str, path: str, below: tuple[str, ...]) -> str:
        digest = _h(f"{kind}|{path}|{'|'.join(below)}")
        if digest not in self.nodes:
            self.nodes[digest] = node = (kind, path, below)
            self.references.update(self._children(node))
        return digest

    def _branch(self, shared: str, children: dict[str, str]) -> str:
        branch = self._put("branch", "", tuple(children.get(n, "") for n in "0123456789abcdef"))
        return self._put("extension", shared, (branch,)) if shared else branch

    def _inserted(self, root: str, path: str, value: str) -> str:
        if not root:
            return self._put("leaf", path, (value,))
        kind, part, below = self.nodes[root]
        if kind == "branch":
            i = int(path[0], 16)
            return self._put("branch", "", (*below[:i], self._inserted(below[i], path[1:], value), *below[i + 1 :]))
        shared = commonprefix([part, path])
        if kind == "extension" and shared == part:
            return self._put("extension", part, (self._inserted(below[0], path[len(part) :], value),))
        if kind == "leaf" and part == path:
            return self._put("leaf", path, (value,))
        k, rest = len(shared), part[len(shared) + 1 :]
        old = self._put("leaf", rest, below) if kind == "leaf" else self._put("extension", rest, below) if rest else below[0]
        return self._branch(shared, {part[k]: old, path[k]: self._put("leaf", path[k + 1 :], (value,))})

    def update(self, root: str, leaves: Mapping[str, str]) -> str:
        """The root after the leaves were set; it is kept until it is released. An empty root is an empty trie."""
        kept = root
        for path, value in leaves.items():
            new = self._inserted(kept, path, value)
            self.references[new] += 1
            if kept != root:
                self.release(kept)
            kept = new
        if kept == root and root:
            self.references[root] += 1
        return kept

    def release(self, root: str) -> int:
        """Gives up a root: nodes without references go, from above. The number of nodes deleted."""
        gone, waiting = 0, [root] if root else []
        while waiting:
            digest = waiting.pop()
            self.references[digest] -= 1
            if self.references[digest] == 0:
                del self.references[digest]
                waiting += self._children(self.nodes.pop(digest))
                gone += 1
        return gone


def verify(proof: list[tuple[str, str, tuple[str, ...]]], root: str, path: str) -> tuple[bool, str | None]:
    """Whether the proof leads from the root along the path, and the value digest it shows; None if it shows absence."""
    digest, rest = root, path
    for kind, part, below in proof:
        if _h(f"{kind}|{part}|{'|'.join(below)}") != digest:
            return False, None
        if kind == "leaf":
            return True, below[0] if part == rest else None
        if kind == "extension":
            if not rest.startswith(part):
                return True, None
            digest, rest = below[0], rest[len(part) :]
        else:
            digest, rest = below[int(rest[0], 16)], rest[1:]
    return digest == "", None
