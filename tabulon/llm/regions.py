"""The exact join of one region of a metric space: pivots, Voronoi cells, windows, and comparison of what no window parts."""

from __future__ import annotations

import numpy as np

#: Slack for sums of distances.
EPS = 1e-9


class Region:
    """Links that suffice for the components of the documents of one region.

    Distances are those of Jaccard, 1 - |A & B| / |A | B|; two documents link within the radius 1 - percent / 100. A part of the
    region takes a few pivots, each the farthest from those before. Documents within the radius link with the pivot; if all are one
    component, the part is done. Else each document goes to its nearest pivot's cell, and as boundary to every later cell that its
    window reaches, and each cell is a part of its own. A part that is small, or that its windows don't part, is compared.
    """

    LEAF, PIVOTS = 8, 6
    #: A part of more documents than this is compared by prefixes first.
    PLAIN = 64
    ROWS, COLUMNS = 128, 1024

    def __init__(self, ids: list[int], sets: list[np.ndarray], percent: int) -> None:
        self.ids, self.percent, self.radius = ids, percent, 1 - percent / 100
        self.sizes = np.array([len(s) for s in sets], dtype=np.int64)
        _, token, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = count > 1  # what one document has alone is in no overlap
        number = np.cumsum(shared) - 1
        self.n_tokens = int(shared.sum())
        self.mask = np.zeros(self.n_tokens, dtype=bool)
        on = shared[token]
        self.token = number[token[on]]
        self.first = np.concatenate([[0], np.cumsum(on)])[np.concatenate([[0], np.cumsum(self.sizes)])]
        self.root = np.arange(len(ids))
        self.links: list[tuple[int, int]] = []
        #: Parts that pivots split, and pairs that were compared in parts.
        self.splits = self.compared = 0

    def run(self) -> list[tuple[int, int]]:
        parts = [np.arange(len(self.ids))]
        while parts:
            parts.extend(self.split(parts.pop()))
        return self.links

    # components

    def find(self, xs: np.ndarray) -> np.ndarray:
        up = self.root[xs]
        while (self.root[up] != up).any():
            up = self.root[up]
        self.root[xs] = up
        return up

    def join(self, x: int, ys: np.ndarray) -> None:
        """Links x with one of `ys` in each component that isn't its own."""
        own = low = int(self.find(np.array([x]))[0])
        other, at = np.unique(self.find(ys), return_index=True)
        for r, y in zip(other.tolist(), ys[at].tolist(), strict=True):
            if r != own:
                self.links.append((self.ids[x], self.ids[y]))
                low, high = sorted((low, r))
                self.root[high] = low

    def single(self, part: np.ndarray) -> bool:
        up = self.find(part)
        return bool((up == up[0]).all())

    # pivots and cells

    def tokens_of(self, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of each document of a part, one after the other, and where each begins."""
        n = self.first[part + 1] - self.first[part]
        bounds = np.concatenate([[0], np.cumsum(n)])
        return self.token[np.repeat(self.first[part] - bounds[:-1], n) + np.arange(bounds[-1])], bounds

    def overlap(self, x: int, token: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        own = self.token[self.first[x] : self.first[x + 1]]
        self.mask[own] = True
        sums = np.concatenate([[0], np.cumsum(self.mask[token])])
        self.mask[own] = False
        return sums[bounds[1:]] - sums[bounds[:-1]]

    def near(self, common: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return 100 * common >= self.percent * (a + b - common)

    def split(self, part: np.ndarray) -> list[np.ndarray]:
        if len(part) <= self.LEAF:
            self.compare(part)
            return []
        token, bounds = self.tokens_of(part)
        sizes = self.sizes[part]
        pivot, far, rows = int(part[0]), np.full(len(part), np.inf), []
        for _ in range(self.PIVOTS):
            common = self.overlap(pivot, token, bounds)
            common[part == pivot] = self.sizes[pivot]  # with what it has alone
            self.join(pivot, part[self.near(common, sizes, self.sizes[pivot])])
            rows.append(1 - common / (sizes + self.sizes[pivot] - common))
            far = np.minimum(far, rows[-1])
            pivot = int(part[np.argmax(far)])
            if far.max() <= self.radius:
                break
        if self.single(part):
            return []
        d = np.array(rows)
        nearest, least, cells = np.argmin(d, axis=0), d.min(axis=0), []
        for q in range(len(d)):
            own = nearest == q
            if not own.any():
                continue
            # a partner y in cell q has d(y, q) <= d(y, p) for each pivot p, so d(x, q) <= d(x, p) + 2 radius
            reach = d[q][own].max() + self.radius + EPS
            window = (nearest < q) & (d[q] <= least + 2 * self.radius + EPS) & (d[q] <= reach)
            cells.append(part[own | window])
        if max(map(len, cells)) > 0.8 * len(part) or sum(map(len, cells)) > 1.5 * len(part):
            self.compare(part)
            return []
        self.splits += 1
        return [c for c in cells if len(c) > 1]

    # comparison

    def compare(self, part: np.ndarray) -> None:
        """Joins all links within a part; what is one component already is not compared."""
        if self.single(part):
            return
        if len(part) > self.PLAIN:
            part = self.by_prefix(part)
        if len(part) > 1 and not self.single(part):
            self.by_blocks(part)

    def by_prefix(self, part: np.ndarray) -> np.ndarray:
        """Two near documents share one of the rarest tokens of each, n - need + 1 of n. Joins those that do, if they are few;
        else returns the documents that share any."""
        token, bounds = self.tokens_of(part)
        doc = np.repeat(np.arange(len(part)), np.diff(bounds))
        names, token, count = np.unique(token, return_inverse=True, return_counts=True)
        on = count[token] > 1
        token, doc = token[on], doc[on]
        rank = np.empty(len(names), dtype=np.int64)
        rank[np.argsort(count, kind="stable")] = np.arange(len(names))
        order = np.sort(doc * len(names) + rank[token])
        doc, token = order // max(1, len(names)), order % max(1, len(names))
        held = np.bincount(doc, minlength=len(part))
        n = self.sizes[part]
        prefix = np.clip(n - -(-self.percent * n // 100) + 1 - (n - held), 0, held)
        place = np.arange(len(doc)) - np.concatenate([[0], np.cumsum(held)])[doc]
        on = place < prefix[doc]
        doc, token = doc[on], token[on]
        order = np.argsort(token, kind="stable")
        doc, token = doc[order], token[order]
        count = np.bincount(token, minlength=max(1, len(names)))
        pairs = int((count * (count - 1) // 2).sum())
        if pairs > max(1 << 20, 4 * int(n.sum())):
            return part[np.unique(doc[count[token] > 1])]
        ahead = np.concatenate([[0], np.cumsum(count)])[token + 1] - np.arange(len(doc)) - 1  # later documents of the same token
        a = np.repeat(np.arange(len(doc)), ahead)
        b = a + 1 + np.arange(len(a)) - np.repeat(np.concatenate([[0], np.cumsum(ahead)[:-1]]), ahead) if len(a) else a
        met = np.unique(doc[a] * len(part) + doc[b])
        x, y = part[met // len(part)], part[met % len(part)]
        low, high = np.minimum(self.sizes[x], self.sizes[y]), np.maximum(self.sizes[x], self.sizes[y])
        fits = 100 * low >= self.percent * high
        x, y = x[fits], y[fits]
        edges = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1], [True]])) if len(x) else np.zeros(1, dtype=np.int64)
        for i, j in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            mine = y[i:j]
            mine = mine[self.find(mine) != self.find(x[i : i + 1])]
            if len(mine):
                self.compared += len(mine)
                common = self.overlap(int(x[i]), *self.tokens_of(mine))
                hit = mine[self.near(common, self.sizes[mine], self.sizes[x[i]])]
                if len(hit):
                    self.join(int(x[i]), hit)
        return part[:0]

    def by_blocks(self, part: np.ndarray) -> None:
        """Every document outside the largest component against all of the part: frequent tokens as a matrix product, the rest by postings."""
        token, bounds = self.tokens_of(part)
        k, sizes = len(part), self.sizes[part]
        doc = np.repeat(np.arange(k), np.diff(bounds))
        names, token, count = np.unique(token, return_inverse=True, return_counts=True)
        order = np.argsort(token, kind="stable")
        posting, begin = doc[order], np.concatenate([[0], np.cumsum(count)])
        frequent = count > max(1, k // 64)
        column = np.cumsum(frequent) - 1
        dense = frequent[token]
        d_doc, d_col = doc[dense], column[token[dense]]
        by_col = np.argsort(d_col, kind="stable")
        d_doc, d_col = d_doc[by_col], d_col[by_col]
        rare = ~dense & (count[token] > 1)
        r_doc, r_token = doc[rare], token[rare]
        roots, members = np.unique(self.find(part), return_counts=True)
        largest = part[np.flatnonzero(self.find(part) == roots[np.argmax(members)])[:1]]
        cuts = np.searchsorted(d_col, np.arange(0, int(frequent.sum()) + self.COLUMNS, self.COLUMNS))
        height = min(self.ROWS, max(16, (1 << 24) // k))
        for i in range(0, k, height):
            rows = np.arange(i, min(k, i + height))
            rows = rows[self.find(part[rows]) != self.find(largest)]
            if not len(rows):
                continue
            self.compared += len(rows) * k
            line = np.full(k, -1)
            line[rows] = np.arange(len(rows))
            common = np.zeros((len(rows), k), dtype=np.float32)
            for c, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                docs, cols = d_doc[a:b], d_col[a:b] - c * self.COLUMNS
                x = np.zeros((k, int(cols.max()) + 1 if len(cols) else 1), dtype=np.float32)
                x[docs, cols] = 1
                common += x[rows] @ x.T
            mine = line[r_doc] >= 0
            r, t = line[r_doc[mine]], r_token[mine]
            n = count[t]
            if n.sum():
                at = np.repeat(begin[t] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                common += np.bincount(np.repeat(r, n) * k + posting[at], minlength=len(rows) * k).reshape(len(rows), k)
            hits = self.near(common.astype(np.int64), sizes[rows][:, None], sizes[None, :])
            for j, x in enumerate(part[rows].tolist()):
                hit = part[hits[j]]
                if len(hit):
                    self.join(x, hit)
