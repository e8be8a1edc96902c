"""Deep-shallow sorting of byte strings.

Multikey quicksort splits the strings word by word of WORD bytes as long as their
common prefix is shallow. Groups that still agree there share long prefixes as a
rule; they are ordered by a blind trie, which stores only the byte at which strings
part and so reads each new string once, however long the common prefix is. Equal
strings are sorted once.
"""

from __future__ import annotations

SHALLOW, WORD = 16, 8


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    differ = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (differ.bit_length() + 7) // 8


def deep_shallow_order(strings: list[bytes], shallow: int = SHALLOW) -> list[int]:
    """Indices in ascending order of the strings; equal ones keep their order."""
    equal: dict[bytes, list[int]] = {}
    for i, s in enumerate(strings):
        equal.setdefault(s, []).append(i)
    distinct = list(equal)
    return [i for k in _distinct_order(distinct, shallow) for i in equal[distinct[k]]]


def _distinct_order(strings: list[bytes], shallow: int) -> list[int]:
    order = list(range(len(strings)))
    todo = [(0, len(order), 0)]
    while todo:
        low, high, depth = todo.pop()
        if high - low < 2:
            continue
        if depth >= shallow:
            order[low:high] = _BlindTrie(strings, order[low:high]).order()
            continue
        group = order[low:high]
        # a string that ends inside a word is filled up: the trie tells it from one with zeros there
        letters = [strings[i][depth : depth + WORD].ljust(WORD, b"\0") for i in group]
        pivot = sorted((letters[0], letters[len(letters) // 2], letters[-1]))[1]
        less = [i for i, c in zip(group, letters, strict=True) if c < pivot]
        same = [i for i, c in zip(group, letters, strict=True) if c == pivot]
        more = [i for i, c in zip(group, letters, strict=True) if c > pivot]
        order[low:high] = less + same + more
        todo.append((low, low + len(less), depth))
        todo.append((low + len(less), low + len(less) + len(same), depth + WORD))
        todo.append((high - len(more), high, depth))
    return order


class _Node:
    """An inner node: strings below it agree on `depth` bytes and part at the next."""

    __slots__ = ("children", "depth")

    def __init__(self, depth: int, children: dict[int, object]) -> None:
        self.depth, self.children = depth, children


class _BlindTrie:
    """Leaves are lists of equal strings' indices; -1 stands for a string's end."""

    def __init__(self, strings: list[bytes], members: list[int]) -> None:
        self.strings = strings
        self.root: object = [members[0]]
        for i in members[1:]:
            self._add(i)

    def _add(self, i: int) -> None:
        strings, node = self.strings, self.root
        own = strings[i]
        n = len(own)
        while isinstance(node, _Node):
            at = node.depth
            node = node.children.get(own[at] if at < n else -1) or next(iter(node.children.values()))
        other = strings[node[0]]
        if own == other:
            node.append(i)
            return
        depth = common_prefix(own, other)
        letter = own[depth] if depth < n else -1
        parent, branch, node = None, -1, self.root
        while isinstance(node, _Node) and node.depth < depth:
            parent, branch = node, own[node.depth]
            node = node.children[branch]
        if isinstance(node, _Node) and node.depth == depth:
            node.children[letter] = [i]
            return
        split = _Node(depth, {other[depth] if depth < len(other) else -1: node, letter: [i]})
        if parent is None:
            self.root = split
        else:
            parent.children[branch] = split

    def order(self) -> list[int]:
        out, todo = [], [self.root]
        while todo:
            node = todo.pop()
            if isinstance(node, _Node):
                todo.extend(node.children[c] for c in sorted(node.children, reverse=True))
            else:
                out.extend(node)
        return out
