"""Nearest remaining point in a k-d tree whose points are taken one by one."""

from __future__ import annotations

import math

import numpy as np

LEAF = 8


class NearTree:
    """Points with numbers 0 to n - 1; equal distances (to 12 places) go to the lower number.

    A node knows the box of its points and how many are left; a search looks
    into the nearer box first and leaves out boxes that are farther than the
    best point so far. The tree is built anew when half its points are taken,
    so boxes shrink with what is left.
    """

    def __init__(self, x: np.ndarray):
        self.x = np.asarray(x, float)
        self.points = [tuple(r) for r in self.x.tolist()]
        self.alive = np.ones(len(x), bool)
        self._build()

    def _build(self) -> None:
        order = np.flatnonzero(self.alive)
        self.size = self.left = len(order)
        self.box: list[tuple] = []
        self.kids: list[tuple[int, int] | None] = []
        self.parent: list[int] = []
        self.count: list[int] = []
        self.members: list[list[int] | None] = []
        self.home = {}
        todo = [(0, len(order), -1)] if len(order) else []
        while todo:
            a, b, parent = todo.pop()
            node = len(self.box)
            part = self.x[order[a:b]]
            low, high = part.min(axis=0), part.max(axis=0)
            self.box.append(tuple(zip(low.tolist(), high.tolist(), strict=True)))
            self.parent.append(parent)
            self.count.append(b - a)
            self.kids.append(None)
            self.members.append(None)
            if parent >= 0:
                one = self.kids[parent]
                self.kids[parent] = (node, -1) if one is None else (one[0], node)
            wide = high - low
            if b - a <= LEAF or not wide.max() > 0:
                self.members[node] = order[a:b].tolist()
                for i in self.members[node]:
                    self.home[i] = node
                continue
            mid = (a + b) // 2
            by = part[:, int(wide.argmax())]
            order[a:b] = order[a:b][np.argpartition(by, mid - a)]
            todo += [(mid, b, node), (a, mid, node)]

    def take(self, i: int) -> None:
        """Point i is no longer there."""
        self.alive[i] = False
        self.left -= 1
        node = self.home.pop(i)
        self.members[node].remove(i)
        while node >= 0:
            self.count[node] -= 1
            node = self.parent[node]
        if self.left > 2 * LEAF and 2 * self.left < self.size:
            self._build()

    def nearest(self, i: int) -> int | None:
        """The nearest point that is left to point i, taken or not."""
        if not self.left:
            return None
        q, points, count, kids, members, box = self.points[i], self.points, self.count, self.kids, self.members, self.box
        best, found = math.inf, -1
        todo = [(0, 0)]
        while todo:
            bound, node = todo.pop()
            if bound > best:
                continue
            inside = members[node]
            if inside is not None:
                for j in inside:
                    s = 0.0
                    for a, b in zip(points[j], q):  # noqa: B905
                        s += (a - b) ** 2
                    key = round(math.sqrt(s) * 1e12)
                    if key < best or key == best and j < found:
                        best, found = key, j
                continue
            near = []
            for kid in kids[node]:
                if count[kid]:
                    s = 0.0
                    for (low, high), v in zip(box[kid], q):  # noqa: B905
                        if v < low:
                            s += (low - v) ** 2
                        elif v > high:
                            s += (v - high) ** 2
                    near.append((round(math.sqrt(s) * 1e12), kid))
            near.sort(reverse=True)
            todo += near
        return found
