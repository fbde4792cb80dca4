"""Adaptive radix trees over byte keys, and the trie of whole turns that such a tree holds."""

from __future__ import annotations

from bisect import bisect_left


class Small:
    """Up to `most` children beside their sorted bytes: the layouts of 4 and of 16."""

    __slots__ = ("most", "bytes", "nodes")

    def __init__(self, most: int):
        self.most, self.bytes, self.nodes = most, bytearray(), []

    def find(self, byte: int):
        at = bisect_left(self.bytes, byte)
        return self.nodes[at] if at < len(self.bytes) and self.bytes[at] == byte else None

    def put(self, byte: int, node):
        """Set a child; the layout that holds it then."""
        at = bisect_left(self.bytes, byte)
        if at < len(self.bytes) and self.bytes[at] == byte:
            self.nodes[at] = node
            return self
        if len(self.nodes) == self.most:
            return (Small(16) if self.most == 4 else Indexed()).take(self).put(byte, node)
        self.bytes.insert(at, byte)
        self.nodes.insert(at, node)
        return self

    def take(self, other: Small) -> Small:
        self.bytes[:], self.nodes[:] = other.bytes, other.nodes
        return self

    def __iter__(self):
        return iter(self.nodes)


class Indexed:
    """Up to 48 children behind an index of 256 places."""

    __slots__ = ("index", "nodes")

    def __init__(self):
        self.index, self.nodes = bytearray(b"\xff" * 256), []

    def find(self, byte: int):
        at = self.index[byte]
        return None if at == 255 else self.nodes[at]

    def put(self, byte: int, node):
        at = self.index[byte]
        if at != 255:
            self.nodes[at] = node
        elif len(self.nodes) == 48:
            return Full().take(self).put(byte, node)
        else:
            self.index[byte] = len(self.nodes)
            self.nodes.append(node)
        return self

    def take(self, other: Small) -> Indexed:
        for byte, node in zip(other.bytes, other.nodes):
            self.put(byte, node)
        return self

    def __iter__(self):
        return (self.nodes[at] for at in self.index if at != 255)


class Full:
    """A place for each byte."""

    __slots__ = ("nodes",)

    def __init__(self):
        self.nodes = [None] * 256

    def find(self, byte: int):
        return self.nodes[byte]

    def put(self, byte: int, node):
        self.nodes[byte] = node
        return self

    def take(self, other: Indexed) -> Full:
        self.nodes[:] = [other.find(b) for b in range(256)]
        return self

    def __iter__(self):
        return (n for n in self.nodes if n is not None)


class Node:
    """A compressed path of bytes, the members whose keys end behind it, and the children by their next byte."""

    __slots__ = ("path", "ends", "children")

    def __init__(self, path: bytes):
        self.path, self.ends, self.children = path, [], None

    def add(self, byte: int, node: Node) -> None:
        self.children = (self.children or Small(4)).put(byte, node)


def _same(a: bytes, b: bytes) -> int:
    """Bytes that a and b have in common at their start."""
    n = min(len(a), len(b))
    differ = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (differ.bit_length() + 7) // 8


class RadixTree:
    """Byte keys with members; a node splits where keys part and widens as children come."""

    def __init__(self):
        self.root = Node(b"")
        self.empty = True

    def insert(self, key: bytes, member: int) -> None:
        if self.empty:
            self.root.path, self.empty = key, False
            self.root.ends.append(member)
            return
        node, parent, at = self.root, None, 0
        while True:
            path = node.path
            if not key.startswith(path, at):
                common = _same(path, key[at : at + len(path)])
                upper = Node(path[:common])
                node.path = path[common + 1 :]
                upper.add(path[common], node)
                if parent is None:
                    self.root = upper
                else:
                    parent.add(key[at - 1], upper)
                node, path = upper, upper.path
            at += len(path)
            if at == len(key):
                node.ends.append(member)
                return
            child = node.children.find(key[at]) if node.children is not None else None
            if child is None:
                child = Node(key[at + 1 :])
                child.ends.append(member)
                node.add(key[at], child)
                return
            node, parent, at = child, node, at + 1


class TrieNode:
    """A node of whole units: the members' range, the last unit's place and what lies below."""

    __slots__ = ("depth", "low", "high", "ends", "kids", "leaves", "saved", "closed")

    def __init__(self, depth, low, high, ends, kids, leaves, saved, closed):
        self.depth, self.low, self.high, self.ends = depth, low, high, ends
        self.kids, self.leaves, self.saved, self.closed = kids, leaves, saved, closed


def unit_nodes(tree: RadixTree, width: int, weight, is_open):
    """Nodes of the trie of units of `width` bytes, each after the nodes below it, as (node, children).

    Members are numbered in key order, so a node has the members low to high. Only byte depths that are
    multiples of width are nodes of the trie: others lie inside a unit and hand what is below them up.
    weight(member, depth) is the weight of a member's unit at a depth; saved adds (members - 1) times it
    over a subtree. A node for which is_open(low, high) holds goes on in another tree: it isn't added
    up into its parent, and neither `closed` children nor leaves nor saved of a parent hold it.
    children lists the trie nodes right below.
    """

    def frame(node: Node, at: int) -> list:
        """The tree node, the byte depth where its path begins, and of its subtree low, high, tops, leaves, saved."""
        return [node, at, iter(node.children or ()), *(node.ends[:1] or [None]), *(node.ends[-1:] or [None]), [], 0, 0]

    stack = [frame(tree.root, 0)]
    while stack:
        node, at, kids, low, high, tops, leaves, saved = stack[-1]
        end = at + len(node.path)
        child = next(kids, None)
        if child is not None:
            stack.append(frame(child, end + 1))
            continue
        stack.pop()
        for depth in range(end // width, -(-at // width) - 1, -1):  # unit depths on the node's edge, the deepest first
            ends = node.ends if depth * width == end else []
            closed = sum(1 for t in tops if not is_open(t.low, t.high))
            here = is_open(low, high)
            if not here:
                leaves = leaves if tops else 1
                saved += (high - low) * weight(low, depth) if depth else 0
            made = TrieNode(depth, low, high, ends, len(tops), leaves, saved, closed)
            yield made, tops
            tops = [made]
            if here:
                leaves = saved = 0
        if stack:
            up = stack[-1]
            up[3] = low if up[3] is None else min(up[3], low)
            up[4] = high if up[4] is None else max(up[4], high)
            up[5].extend(tops)
            up[6] += leaves
            up[7] += saved
