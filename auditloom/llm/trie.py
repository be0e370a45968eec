"""A Patricia trie over byte strings whose terminals own the smallest identifier, with spill by subtree."""

from __future__ import annotations

import pickle
import tempfile
from collections.abc import Iterator

#: Bytes that a node takes besides its label, about.
NODE_BYTES = 300


class Owner:
    """What a terminal node keeps: the smallest id (null only if all are null), rows seen, rows that bear that id."""

    __slots__ = ("id", "rows", "ties", "tag")

    def __init__(self, id_, rows, ties, tag):
        self.id, self.rows, self.ties, self.tag = id_, rows, ties, tag

    def add(self, id_, rows, ties):
        self.rows += rows
        if id_ == self.id:
            self.ties += ties
        elif self.id is None or (id_ is not None and id_ < self.id):
            self.id, self.ties = id_, ties


class Node:
    __slots__ = ("label", "children", "owner")

    def __init__(self, label, owner=None):
        self.label, self.children, self.owner = label, {}, owner


class Spilled:
    """Stands for a subtree whose strings are in a file; the file has no name and goes with its handle."""

    __slots__ = ("file", "rows")

    def __init__(self):
        self.file, self.rows = tempfile.TemporaryFile(), 0

    def put(self, rest: bytes, owner: Owner) -> None:
        pickle.dump((rest, owner.id, owner.rows, owner.ties, owner.tag), self.file, protocol=5)
        self.rows += 1

    def entries(self) -> Iterator[tuple]:
        self.file.seek(0)
        for _ in range(self.rows):
            yield pickle.load(self.file)
        self.file.close()


def shared_prefix(label: bytes, text: bytes, pos: int) -> int:
    """Length of the common prefix of label and text[pos:], by bisection on slices."""
    low, high = 0, min(len(label), len(text) - pos)
    while low < high:
        mid = (low + high + 1) // 2
        if text.startswith(label[low:mid], pos + low):
            low = mid
        else:
            high = mid - 1
    return low


class PatriciaTrie:
    """Insert whole byte strings; equal strings meet in one terminal node.

    Past ``budget`` bytes the largest subtree under the first branching node goes to a file, and so does
    whatever later reaches it; ``drain`` then rebuilds each spilled subtree alone, by the same rule.
    """

    def __init__(self, budget: int):
        self.budget, self.size, self.root, self.spills = budget, 0, Node(b""), 0

    def insert(self, text: bytes, id_, rows: int = 1, ties: int = 1, tag=None) -> None:
        node, pos, end = self.root, 0, len(text)
        while pos < end:
            child = node.children.get(text[pos])
            if child is None:
                node.children[text[pos]] = Node(text[pos:], Owner(id_, rows, ties, tag))
                self._grow(end - pos)
                return
            if isinstance(child, Spilled):
                child.put(text[pos:], Owner(id_, rows, ties, tag))
                return
            if text.startswith(child.label, pos):
                node, pos = child, pos + len(child.label)
                continue
            cut = shared_prefix(child.label, text, pos)
            fork = Node(child.label[:cut])
            node.children[text[pos]] = fork
            child.label = child.label[cut:]
            fork.children[child.label[0]] = child
            node, pos = fork, pos + cut
            self.size += NODE_BYTES
        if node.owner is None:
            node.owner = Owner(id_, rows, ties, tag)
        else:
            node.owner.add(id_, rows, ties)
        self._grow(0)

    def _grow(self, n: int) -> None:
        """Count a new leaf's bytes; spill only here, when the string is in its place."""
        self.size += n + NODE_BYTES if n else 0
        if self.size > self.budget:
            self._spill()

    def _spill(self) -> None:
        fork = self.root
        while len(fork.children) == 1 and fork.owner is None and isinstance(only := next(iter(fork.children.values())), Node):
            fork = only
        live = {k: sum(len(n.label) + NODE_BYTES for _, n in walk(c)) for k, c in fork.children.items() if isinstance(c, Node)}
        while self.size > self.budget // 2 and live:
            key = max(live, key=live.get)
            spilled = Spilled()
            for path, n in walk(fork.children[key]):
                if isinstance(n, Spilled):
                    for rest, *owner in n.entries():
                        spilled.put(path + rest, Owner(*owner))
                elif n.owner is not None:
                    spilled.put(path, n.owner)
            fork.children[key] = spilled
            self.size -= live.pop(key)
            self.spills += 1

    def drain(self) -> Iterator[tuple[bytes, Owner]]:
        """All strings with their owners; the trie is empty afterwards."""
        root, self.root, self.size = self.root, Node(b""), 0
        later = []
        for path, n in walk(root):
            if isinstance(n, Spilled):
                later.append((path, n))
            elif n.owner is not None:
                yield path, n.owner
        del root
        for path, spilled in later:
            sub = PatriciaTrie(self.budget)
            for rest, *owner in spilled.entries():
                sub.insert(rest, *owner)
            for rest, owner in sub.drain():
                yield path + rest, owner


def walk(node: Node) -> Iterator[tuple[bytes, Node | Spilled]]:
    """Each node below with the string that leads to it; a spilled subtree with the string above it."""
    stack = [(b"", node)]
    while stack:
        above, n = stack.pop()
        if isinstance(n, Spilled):
            yield above, n
            continue
        path = above + n.label
        yield path, n
        stack.extend((path, c) for c in n.children.values())
