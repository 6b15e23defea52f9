"""A finger B-tree of partial aggregates keyed by event time."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

#: Entries of a node before it splits.
WIDTH = 4
#: A partial aggregate: messages, values, their sum, least and greatest.
EMPTY = (0, 0, 0.0, float("inf"), float("-inf"))
#: What an insert meets: a part of the tree that is open, published, or cut off.
OPEN, PUBLISHED, GONE = 0, 1, 2


def merge(a, b):
    return (a[0] + b[0], a[1] + b[1], a[2] + b[2], a[3] if a[3] <= b[3] else b[3], a[4] if a[4] >= b[4] else b[4])


class Node:
    """A leaf has `parts` (own partials) at `keys`; an inner node has `below`, with the least key of each at `keys`."""

    __slots__ = ("keys", "parts", "below", "up", "total")

    def __init__(self, keys, parts=None, below=None):
        self.keys, self.parts, self.below, self.up = keys, parts, below, None
        for x in below or ():
            x.up = self


class FingerTree:
    """Partials by key, in order; `merge` joins two of them, `empty` is that of nothing.

    The finger is the leaf of the newest keys, where nearly every insert goes;
    a late key climbs from it only as far as its subtree reaches and descends
    from there, and then updates the partials of its ancestors, one a level.
    `cut` takes whole subtrees off the left edge, without a look at what they
    hold, and looks into one node a level only.  `between` and `periods` put
    aggregates of a range together from the partials of whole subtrees.

    `publish` and `cut` leave their bounds behind, and an `insert` says which
    part of the tree it met.  `visits` counts the nodes that were looked into.
    """

    def __init__(self, merge=merge, empty=EMPTY):
        self.merge, self.empty = merge, empty
        self.shown = self.floor = -(1 << 62)
        self.visits = 0
        self._reset()

    def _reset(self):
        self.root = self.finger = Node([], [])
        self.root.total = self.empty

    def _refresh(self, node):
        total = self.empty
        for x in node.parts if node.below is None else [n.total for n in node.below]:
            total = self.merge(total, x)
        node.total = total

    def _from_finger(self, key):
        """The lowest ancestor of the finger whose subtree reaches down to `key`."""
        node, steps = self.finger, 1
        while node.up is not None and (not node.keys or key < node.keys[0]):
            node = node.up
            steps += 1
        self.visits += steps
        return node

    def insert(self, key, part) -> int:
        if key < self.floor:
            return GONE
        node = self._from_finger(key)
        while node.below is not None:
            node = node.below[max(0, bisect_right(node.keys, key) - 1)]
            self.visits += 1
        keys, join = node.keys, self.merge
        i = bisect_left(keys, key)
        if i < len(keys) and keys[i] == key:
            node.parts[i] = join(node.parts[i], part)
        else:
            keys.insert(i, key)
            node.parts.insert(i, part)
            if i == 0:
                self._lower(node, key)
        n = node
        while n is not None:
            n.total = join(n.total, part)
            n = n.up
        if len(keys) > WIDTH:
            self._split(node)
        return PUBLISHED if key < self.shown else OPEN

    def _lower(self, node, key):
        while node.up is not None:
            i = node.up.below.index(node)
            node.up.keys[i] = key
            if i:
                return
            node = node.up

    def _split(self, node):
        while len(node.keys) > WIDTH:
            up = node.up
            # newer keys come next to the newest, so nodes there are left full
            half = WIDTH if up is None or up.below[-1] is node else len(node.keys) // 2
            right = Node(node.keys[half:], node.parts and node.parts[half:], node.below and node.below[half:])
            del node.keys[half:]
            del (node.parts if node.below is None else node.below)[half:]
            self._refresh(node)
            self._refresh(right)
            if self.finger is node:
                self.finger = right
            if up is None:
                self.root = Node([node.keys[0], right.keys[0]], None, [node, right])
                self._refresh(self.root)
                return
            i = up.below.index(node)
            up.keys.insert(i + 1, right.keys[0])
            up.below.insert(i + 1, right)
            right.up = up
            node = up

    def cut(self, bound):
        """Take off all keys below `bound`, in bulk; their partial.  Later inserts below it meet nothing."""
        self.floor = max(self.floor, bound)
        gone, path, node = self.empty, [], self.root
        if not node.keys or node.keys[0] >= bound:
            return gone
        while True:
            self.visits += 1
            i = bisect_left(node.keys, bound)
            if node.below is None:
                for p in node.parts[:i]:
                    gone = self.merge(gone, p)
                del node.keys[:i], node.parts[:i]
                break
            i -= 1  # the last subtree that begins below the bound may reach over it
            for n in node.below[:i]:
                gone = self.merge(gone, n.total)
            del node.keys[:i], node.below[:i]
            path.append(node)
            node = node.below[0]
        self._refresh(node)
        for n in reversed(path):
            if n.below[0].keys:
                n.keys[0] = n.below[0].keys[0]
            else:
                del n.below[0], n.keys[0]
            self._refresh(n)
        while self.root.below is not None and len(self.root.below) == 1:
            self.root = self.root.below[0]
            self.root.up = None
        if not self.root.keys:
            self._reset()
            return gone
        node = self.root
        while node.below is not None:
            node = node.below[-1]
        self.finger = node
        return gone

    def evict(self, bound) -> list:
        """`cut`, with the (key, partial) that it takes off, in order."""
        gone = list(self.entries(None, bound))
        self.cut(bound)
        return gone

    def seek(self, low):
        """The least key from `low`, or None."""
        node, after = self._from_finger(low), None
        while node.below is not None:
            i = max(0, bisect_right(node.keys, low) - 1)
            if i + 1 < len(node.keys):
                after = node.keys[i + 1]
            node = node.below[i]
            self.visits += 1
        i = bisect_left(node.keys, low)
        return node.keys[i] if i < len(node.keys) else after

    def periods(self, low, high, width) -> Iterator:
        """(start, partial) of each stretch of `width` that has keys from `low` and below `high`."""
        key = self.seek(low)
        while key is not None and key < high:
            start = key // width * width
            yield start, self.between(start, start + width)
            key = self.seek(start + width)

    def publish(self, bound, width=None) -> list:
        """Publish all keys below `bound`: the periods of them that weren't, if their `width` is given."""
        new = list(self.periods(self.shown, bound, width)) if width else []
        self.shown = max(self.shown, bound)
        return new

    def entries(self, low=None, high=None) -> Iterator:
        """(key, partial) from `low`, and below `high`, in order."""

        def of(node):
            a = 0 if low is None else bisect_left(node.keys, low)
            z = len(node.keys) if high is None else bisect_left(node.keys, high)
            if node.below is None:
                yield from zip(node.keys[a:z], node.parts[a:z])
            else:
                for n in node.below[max(0, a - 1) : z]:
                    yield from of(n)

        return of(self.root)

    def between(self, low, high):
        """The partial of all keys from `low` and below `high`, from whole subtrees where they fit."""
        join = self.merge

        def of(node, end):
            self.visits += 1
            total, keys = self.empty, node.keys
            for i in range(max(0, bisect_right(keys, low) - 1), len(keys)):
                key = keys[i]
                if key >= high:
                    break
                if node.below is None:
                    if key >= low:
                        total = join(total, node.parts[i])
                    continue
                after = keys[i + 1] if i + 1 < len(keys) else end
                if low <= key and after is not None and after <= high:
                    total = join(total, node.below[i].total)
                elif after is None or after > low:
                    total = join(total, of(node.below[i], after))
            return total

        return of(self.root, None)
