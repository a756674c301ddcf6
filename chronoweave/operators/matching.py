"""Perfect matching of greatest weight in a complete graph, exact at every size (Edmonds' blossoms with dual prices, cubic time)."""

from __future__ import annotations

from collections import deque

FREE, EVEN, ODD = -1, 0, 1


class _Search:
    """State of the search over vertices 1..n and blossoms above n; 0 stands for nothing.

    A blossom has a ring of vertices or blossoms of odd length, base first. top[v] is the outermost blossom around v. edge[a][b]
    is the tightest edge (u, v) between a and b, price the duals (vertices: y, blossoms: z / 2), label the place in the forest.
    """

    def __init__(self, weight: list[list[int]]) -> None:
        self.n = n = len(weight)
        most = n + n // 2 + 2
        self.weight = [[0] * (n + 1)] + [[0, *(2 * x for x in row)] for row in weight]
        self.edge: list[list[tuple[int, int] | None]] = [[None] * most for _ in range(most)]
        for u in range(1, n + 1):
            for v in range(1, n + 1):
                if u != v:
                    self.edge[u][v] = (u, v)
        self.price = [max(map(max, self.weight))] * (n + 1) + [0] * (most - n - 1)
        self.mate, self.parent, self.near, self.seen = ([0] * most for _ in range(4))
        self.label = [FREE] * most
        self.top = list(range(n + 1)) + [0] * (most - n - 1)
        self.ring: list[list[int]] = [[] for _ in range(most)]
        self.child = [[v if v == u else 0 for v in range(n + 1)] for u in range(n + 1)] + [[0] * (n + 1) for _ in range(most - n - 1)]
        self.queue: deque[int] = deque()
        self.round = 0

    def outer(self) -> list[int]:
        return [x for x in range(1, len(self.top)) if self.top[x] == x]

    def slack(self, e: tuple[int, int]) -> int:
        u, v = e
        return self.price[u] + self.price[v] - 2 * self.weight[u][v]

    def offer(self, u: int, x: int) -> None:
        """u as the even vertex nearest to x."""
        if not self.near[x] or self.slack(self.edge[u][x]) < self.slack(self.edge[self.near[x]][x]):
            self.near[x] = u

    def look(self, x: int) -> None:
        self.near[x] = 0
        for u in range(1, self.n + 1):
            if self.edge[u][x] and self.top[u] != x and self.label[self.top[u]] == EVEN:
                self.offer(u, x)

    def enqueue(self, x: int) -> None:
        if x <= self.n:
            self.queue.append(x)
        else:
            for y in self.ring[x]:
                self.enqueue(y)

    def crown(self, x: int, b: int) -> None:
        self.top[x] = b
        for y in self.ring[x] if x > self.n else ():
            self.crown(y, b)

    def even_way(self, b: int, x: int) -> int:
        """Turn the ring of b so that x lies an even number of steps after the base; the number."""
        at = self.ring[b].index(x)
        if at % 2:
            self.ring[b][1:] = self.ring[b][:0:-1]
            at = len(self.ring[b]) - at
        return at

    def pair(self, a: int, b: int) -> None:
        """Match a's side of the edge to b and, in a blossom, the rest of the ring along it."""
        u, v = self.edge[a][b]
        self.mate[a] = v
        if a > self.n:
            x = self.child[a][u]
            steps = self.even_way(a, x)
            for i in range(steps):
                self.pair(self.ring[a][i], self.ring[a][i ^ 1])
            self.pair(x, b)
            self.ring[a] = self.ring[a][steps:] + self.ring[a][:steps]

    def flip(self, a: int, b: int) -> None:
        """Match a to b and everything on a's way to its root anew."""
        while True:
            old = self.top[self.mate[a]]
            self.pair(a, b)
            if not old:
                return
            a, b = self.top[self.parent[old]], old
            self.pair(b, a)

    def meeting(self, a: int, b: int) -> int:
        self.round += 1
        while a or b:
            if a:
                if self.seen[a] == self.round:
                    return a
                self.seen[a] = self.round
                a = self.top[self.mate[a]]
                a = a and self.top[self.parent[a]]
            a, b = b, a
        return 0

    def shrink(self, a: int, base: int, b: int) -> None:
        new = next(x for x in range(self.n + 1, len(self.top)) if not self.top[x])
        self.price[new], self.label[new], self.mate[new] = 0, EVEN, self.mate[base]

        def way(x: int) -> list[int]:
            out = []
            while x != base:
                y = self.top[self.mate[x]]
                out += [x, y]
                self.enqueue(y)
                x = self.top[self.parent[y]]
            return out

        self.ring[new] = [base, *reversed(way(a)), *way(b)]
        self.crown(new, new)
        for x in range(len(self.top)):
            self.edge[new][x] = self.edge[x][new] = None
        self.child[new] = [0] * (self.n + 1)
        for part in self.ring[new]:
            for x in range(1, len(self.top)):
                e = self.edge[part][x]
                if e and (not self.edge[new][x] or self.slack(e) < self.slack(self.edge[new][x])):
                    self.edge[new][x], self.edge[x][new] = e, e[::-1]
            for x in range(1, self.n + 1):
                if self.child[part][x]:
                    self.child[new][x] = part
        self.look(new)

    def expand(self, b: int) -> None:
        for x in self.ring[b]:
            self.crown(x, x)
        entry = self.child[b][self.edge[b][self.parent[b]][0]]
        steps = self.even_way(b, entry)
        for i in range(0, steps, 2):
            x, y = self.ring[b][i], self.ring[b][i + 1]
            self.parent[x], self.label[x], self.label[y], self.near[x] = self.edge[y][x][0], ODD, EVEN, 0
            self.look(y)
            self.enqueue(y)
        self.label[entry], self.parent[entry] = ODD, self.parent[b]
        for x in self.ring[b][steps + 1 :]:
            self.label[x] = FREE
            self.look(x)
        self.top[b] = 0

    def tight(self, e: tuple[int, int]) -> bool:
        """Take up a tight edge out of an even vertex; whether the matching grew."""
        a, b = self.top[e[0]], self.top[e[1]]
        if self.label[b] == FREE:
            self.parent[b], self.label[b] = e[0], ODD
            m = self.top[self.mate[b]]
            self.near[b] = self.near[m] = 0
            self.label[m] = EVEN
            self.enqueue(m)
        elif self.label[b] == EVEN:
            base = self.meeting(a, b)
            if not base:
                self.flip(a, b)
                self.flip(b, a)
                return True
            self.shrink(a, base, b)
        return False

    def grow(self) -> bool:
        """One more pair, as the graph is complete and an even number of vertices is left."""
        self.queue.clear()
        self.label, self.near = [FREE] * len(self.top), [0] * len(self.top)
        for x in self.outer():
            if not self.mate[x]:
                self.parent[x], self.label[x] = 0, EVEN
                self.enqueue(x)
        if not self.queue:
            return False
        while True:
            while self.queue:
                u = self.queue.popleft()
                if self.label[self.top[u]] == ODD:
                    continue
                for v in range(1, self.n + 1):
                    if u != v and self.top[u] != self.top[v]:
                        if self.slack((u, v)) == 0:
                            if self.tight((u, v)):
                                return True
                        else:
                            self.offer(u, self.top[v])
            step = None
            for x in self.outer():
                found = []
                if x > self.n and self.label[x] == ODD:
                    found.append(self.price[x] // 2)
                if self.near[x] and self.label[x] != ODD:
                    s = self.slack(self.edge[self.near[x]][x])
                    found.append(s if self.label[x] == FREE else s // 2)
                step = min([*found, *([] if step is None else [step])], default=None)
            for u in range(1, self.n + 1):
                self.price[u] += {EVEN: -step, ODD: step, FREE: 0}[self.label[self.top[u]]]
            for b in self.outer():
                if b > self.n:
                    self.price[b] += {EVEN: 2 * step, ODD: -2 * step, FREE: 0}[self.label[b]]
            for x in self.outer():
                u = self.near[x]
                if self.top[x] == x and u and self.top[u] != x and self.slack(self.edge[u][x]) == 0 and self.tight(self.edge[u][x]):
                    return True
            for b in self.outer():
                if b > self.n and self.label[b] == ODD and self.price[b] == 0:
                    self.expand(b)


def perfect_matching(weight: list[list[int]]) -> list[int]:
    """Partner of each of an even number of vertices, with the greatest sum of (symmetric, whole) weights."""
    search = _Search([[2 * x for x in row] for row in weight])  # even numbers keep halves of slacks whole
    while search.grow():
        pass
    return [m - 1 for m in search.mate[1 : len(weight) + 1]]
