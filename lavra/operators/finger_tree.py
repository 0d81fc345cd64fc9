"""A finger B-tree of partial aggregates keyed by event time.

The aggregate is a vector of sums. Each inner node caches the sum of its subtree. The leaf for a key
is looked for from the finger at the right end, where nearly all inserts fall; a late key climbs only
as far as its distance asks for. An insert adds its value to the ancestors of one leaf; eviction cuts
whole subtrees off the left spine. Two bounds go through the keys: below `low` everything has been
evicted and nothing is taken any more, below `published` sums have been given out already. add() says
where a key fell: REFUSED, LATE or OPEN.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right


REFUSED, OPEN, LATE = -1, 0, 1


class _Node:
    __slots__ = ("up", "keys", "vals", "kids", "sum")

    def __init__(self, width: int, leaf: bool):
        self.up: _Node | None = None
        self.keys: list[int] = []  # leaf: its keys; inner: the least key of each child
        self.vals: list[list] = []
        self.kids: list[_Node] | None = None if leaf else []
        self.sum = [0] * width


class FingerTree:
    def __init__(self, width: int, most: int = 16):
        self.width, self.most = width, most
        self.root = self.right = _Node(width, True)
        self.low = self.published = -(1 << 62)
        self.touched = 0  # nodes visited, for tests of the logarithmic bound

    # ---- inserting

    def add(self, key: int, value) -> int:
        """Add a vector to the entry of key, made where it is missing. Gives where the key fell; a refused one changes nothing."""
        if key < self.low:
            return REFUSED
        node = self.right
        while node.up is not None and (not node.keys or key < node.keys[0]):
            node = node.up
            self.touched += 1
        while node.kids is not None:
            i = max(0, bisect_right(node.keys, key) - 1)
            node = node.kids[i]
            self.touched += 1
        i = bisect_left(node.keys, key)
        if i < len(node.keys) and node.keys[i] == key:
            v = node.vals[i]
            for j, x in enumerate(value):
                v[j] += x
        else:
            node.keys.insert(i, key)
            node.vals.insert(i, list(value))
            if i == 0:
                self._lower(node)
        up = node
        while up is not None:
            s = up.sum
            for j, x in enumerate(value):
                s[j] += x
            up = up.up
            self.touched += 1
        if len(node.keys) > self.most:
            self._split(node)
        return LATE if key < self.published else OPEN

    def _lower(self, node: _Node) -> None:
        while node.up is not None:
            up = node.up
            i = up.kids.index(node)
            up.keys[i] = node.keys[0]
            if i:
                break
            node = up

    def _split(self, node: _Node) -> None:
        while len(node.keys) > self.most:
            h = len(node.keys) // 2
            new = _Node(self.width, node.kids is None)
            new.keys, node.keys = node.keys[h:], node.keys[:h]
            if node.kids is None:
                new.vals, node.vals = node.vals[h:], node.vals[:h]
                parts = new.vals
            else:
                new.kids, node.kids = node.kids[h:], node.kids[:h]
                for k in new.kids:
                    k.up = new
                parts = [k.sum for k in new.kids]
            for v in parts:
                for j, x in enumerate(v):
                    new.sum[j] += x
            for j, x in enumerate(new.sum):
                node.sum[j] -= x
            if node is self.right:
                self.right = new
            up = node.up
            if up is None:
                up = self.root = _Node(self.width, False)
                up.keys, up.kids, up.sum = [node.keys[0]], [node], [a + b for a, b in zip(node.sum, new.sum)]
                node.up = up
            i = up.kids.index(node)
            up.kids.insert(i + 1, new)
            up.keys.insert(i + 1, new.keys[0])
            new.up = up
            node = up

    # ---- reading

    def total(self, low: int, high: int) -> list:
        """The sum over low <= key < high, from cached partial sums."""
        out = [0] * self.width
        self._total(self.root, low, high, out)
        return out

    def _total(self, node: _Node, low: int, high: int, out: list) -> None:
        a, b = bisect_left(node.keys, low), bisect_left(node.keys, high)
        if node.kids is None:
            for v in node.vals[a:b]:
                for j, x in enumerate(v):
                    out[j] += x
            return
        a = max(0, a - 1)
        for i in range(a, b):
            inside = node.keys[i] >= low and i + 1 < len(node.keys) and node.keys[i + 1] <= high
            if inside:
                for j, x in enumerate(node.kids[i].sum):
                    out[j] += x
            else:
                self._total(node.kids[i], low, high, out)

    def next_key(self, low: int) -> int | None:
        """The least key that is not below low."""
        node, then = self.root, None
        while node.kids is not None:
            i = max(0, bisect_right(node.keys, low) - 1)
            if i + 1 < len(node.kids):
                then = node.keys[i + 1]
            node = node.kids[i]
            self.touched += 1
        i = bisect_left(node.keys, low)
        return node.keys[i] if i < len(node.keys) else then

    def publish(self, upto: int) -> None:
        """Keys below upto have been given out: what is added there from now on is late."""
        self.published = max(self.published, upto)

    def items(self):
        stack = [self.root]
        while stack:
            node = stack.pop()
            if node.kids is None:
                yield from zip(node.keys, node.vals)
            else:
                stack.extend(reversed(node.kids))

    # ---- evicting

    def evict(self, low: int) -> list:
        """Drop all keys below low, whole subtrees at once; gives the sum of what went."""
        self.low = max(self.low, low)
        gone = self._evict(self.root, low)
        while self.root.kids is not None and len(self.root.kids) == 1:
            self.root = self.root.kids[0]
            self.root.up = None
        if self.root.kids is not None and not self.root.kids:
            self.root = _Node(self.width, True)
        node = self.root
        while node.kids is not None:
            node = node.kids[-1]
        self.right = node
        return gone

    def _evict(self, node: _Node, low: int) -> list:
        gone = [0] * self.width
        if node.kids is None:
            cut = bisect_left(node.keys, low)
            parts, node.keys, node.vals = node.vals[:cut], node.keys[cut:], node.vals[cut:]
        else:
            cut = max(0, bisect_left(node.keys, low) - 1)
            parts = [k.sum for k in node.kids[:cut]]
            node.keys, node.kids = node.keys[cut:], node.kids[cut:]
            if node.kids and node.keys[0] < low:
                parts.append(self._evict(node.kids[0], low))
                if node.kids[0].keys:
                    node.keys[0] = node.kids[0].keys[0]
                else:
                    node.keys, node.kids = node.keys[1:], node.kids[1:]
        for v in parts:
            for j, x in enumerate(v):
                gone[j] += x
        for j, x in enumerate(gone):
            node.sum[j] -= x
        return gone
