"""Suffix order and common prefixes by induced sorting, in bulk, with queues that go to disk.

Suffixes are L (larger than the next one) or S (smaller); an S-suffix behind an L-suffix is a star. The substrings from star
to star are sorted and named, the string of names is sorted by recursion if names repeat, and from the order of the stars
(where most names are unique, found by comparing doubled stretches of names) first all L-, then all S-suffixes are induced. Inducing is a priority queue: the suffix that leaves puts in the one before
it, under that one's first symbol. As symbols leave in order, and equal ones in the order in which they came, the queue is
one list for each range of symbols; lists beyond a budget of memory wait in a scratch file. Entries carry the common
prefix with the entry of the same symbol before them: one more than the least common prefix of what left in between.
"""

from __future__ import annotations

import tempfile

import numpy as np

#: Bytes of waiting entries that a queue holds in memory, entries of a range of symbols about, entries that leave at a time at first.
QUEUE_BYTES, RANGE, BULK = 64_000_000, 1 << 14, 4096
NONE = np.iinfo(np.int32).max
#: Share of different names beyond which no further recursion follows.
UNIQUE = 0.5


class Queue:
    """Entries (key, position, common prefix) by ranges of keys; those of a range come back in the order in which they went in."""

    def __init__(self, bounds: np.ndarray, budget: int):
        self.bounds, self.budget = bounds, budget
        self.lists: list[list[np.ndarray]] = [[] for _ in range(len(bounds) + 1)]
        self.on_disk: list[list[tuple[int, int]]] = [[] for _ in self.lists]
        self.file, self.held = None, 0

    def put(self, entries: np.ndarray) -> None:
        which = np.searchsorted(self.bounds, entries[0], "right").astype(np.int16 if len(self.bounds) < 1 << 15 else np.int32)
        order = np.argsort(which, kind="stable")
        which, entries = which[order], entries[:, order]
        cuts = np.flatnonzero(np.r_[True, which[1:] != which[:-1]])
        for r, a, b in zip(which[cuts].tolist(), cuts.tolist(), [*cuts[1:].tolist(), len(which)]):
            self.lists[r].append(entries[:, a:b])
        self.held += entries.nbytes
        if self.held > self.budget:
            self.spill()

    def spill(self) -> None:
        """The scratch file belongs to this task alone and is gone with it."""
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        at = self.file.seek(0, 2)
        for r, parts in enumerate(self.lists):
            if parts:
                data = np.concatenate(parts, axis=1)
                self.file.write(data.tobytes())
                self.on_disk[r].append((at, data.shape[1]))
                at += data.nbytes
                self.lists[r] = []
        self.held = 0

    def take(self, r: int) -> np.ndarray:
        parts = []
        for at, n in self.on_disk[r]:
            self.file.seek(at)
            parts.append(np.frombuffer(self.file.read(n * 12), np.int32).reshape(3, -1))
        self.held -= sum(x.nbytes for x in self.lists[r])
        parts += self.lists[r]
        self.lists[r], self.on_disk[r] = [], []
        return np.concatenate(parts, axis=1) if parts else np.zeros((3, 0), np.int32)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


class Least:
    """Least values of any stretches of an array."""

    def __init__(self, x: np.ndarray):
        self.rows, size = [x], 1
        while 2 * size <= len(x):
            self.rows.append(np.minimum(self.rows[-1][:-size], self.rows[-1][size:]))
            size *= 2

    def of(self, a: np.ndarray, b: np.ndarray, empty: int) -> np.ndarray:
        """Least of x[a:b]."""
        out = np.full(len(a), empty, np.int64)
        size = b - a
        level = np.frexp(np.maximum(size, 1))[1] - 1
        for k in np.unique(level[size > 0]).tolist():
            at = np.flatnonzero((level == k) & (size > 0))
            row = self.rows[k]
            out[at] = np.minimum(row[a[at]], row[b[at] - (1 << k)])
        return out


def induce(key: np.ndarray, seeds: np.ndarray, seed_lcp: np.ndarray | None, cap: int, budget: int, meet=None) -> tuple[np.ndarray, np.ndarray]:
    """All suffixes that the seeds induce, in order, with common prefixes where seed_lcp is given.

    key: symbols in the order in which they leave. Of equal symbols induced suffixes leave before seeds. meet(p, q) gives
    the common prefixes of suffixes p and q.
    """
    seed_key = key[seeds]
    n_symbols = int(key.max()) + 1
    counts = np.cumsum(np.bincount(key, minlength=n_symbols))
    bounds = np.unique(np.searchsorted(counts, np.arange(RANGE, int(counts[-1]), RANGE), "right") * 2).astype(np.int64)
    queue, carry = Queue(bounds, budget), seed_lcp is not None
    low = np.full(n_symbols if carry else 1, cap, np.int64)
    seen = np.zeros(len(low), bool)
    out_pos: list[np.ndarray] = []
    out_lcp: list[np.ndarray] = []
    seed_cut = np.r_[0, np.searchsorted(seed_key * 2, bounds), len(seeds)]
    before = -1  # the suffix that left last
    for r in range(len(bounds) + 1):
        a, b = seed_cut[r], seed_cut[r + 1]
        top = int(bounds[r]) if r < len(bounds) else NONE
        own = np.zeros((3, b - a), np.int32)
        own[0], own[1] = seed_key[a:b] * 2 + 1, seeds[a:b]
        if carry:
            own[2] = seed_lcp[a:b]
        near = _sorted(np.concatenate([queue.take(r), own], axis=1))
        fresh: list[np.ndarray] = []
        far: list[np.ndarray] = []
        fresh_least, head, bulk = NONE, 0, BULK
        while head < near.shape[1] or fresh:
            if fresh and (head == near.shape[1] or near[0, head] > fresh_least):
                near, head = _sorted(np.concatenate([near[:, head:], *fresh], axis=1)), 0
                fresh, fresh_least = [], NONE
            k, p, v = near[:, head : head + bulk]
            if fresh:
                k = k[: np.searchsorted(k, fresh_least, "right")]
                p = p[: len(k)]
            prev = np.maximum(p - 1, 0)
            q = key[prev]
            puts = (p > 0) & (2 * q >= (k & -2))
            to = np.where(puts, 2 * q, NONE)
            # what leaves later must not come behind what is put in here
            late = np.flatnonzero(k[1:] > np.minimum.accumulate(to)[:-1])
            end = int(late[0]) + 1 if len(late) else len(k)
            bulk = min(max(2 * end, 64), 1 << 20)
            k, p, q, puts, prev, to = k[:end], p[:end], q[:end], puts[:end], prev[:end], to[:end]
            put = np.flatnonzero(puts)
            induced = (k & 1) == 0
            lcp = v[:end]
            if carry:
                # a seed behind an induced suffix of its symbol, and a seed behind one that came before the last induced one
                odd = np.flatnonzero(~induced & np.r_[True, induced[:-1]])
                if len(odd):
                    left = np.where(odd > 0, p[odd - 1], before)
                    lcp = lcp.copy()
                    lcp[odd] = np.where(left < 0, 0, meet(np.maximum(left, 0), p[odd]))
                least = Least(lcp)
                order = np.argsort(q[put], kind="stable")
                at, sym = put[order], q[put][order]
                first = np.r_[True, sym[1:] != sym[:-1]] if len(at) else np.zeros(0, bool)
                since = np.where(first, 0, np.r_[0, at[:-1] + 1]) if len(at) else at
                value = least.of(since, at + 1, cap)
                value = np.where(first, np.minimum(value, low[sym]), value)
                value = np.where(first & ~seen[sym], 0, np.minimum(value + 1, cap))
                low = np.minimum(low, int(lcp.min()))
                last = np.r_[sym[1:] != sym[:-1], True] if len(at) else np.zeros(0, bool)
                low[sym[last]] = least.of(at[last] + 1, np.full(int(last.sum()), end), cap)
                seen[sym] = True
                values = np.empty(len(put), np.int64)
                values[order] = value
            else:
                values = 0
            new = np.empty((3, len(put)), np.int32)
            new[0], new[1], new[2] = to[put], prev[put], values
            here = new[0] < top
            if here.any():
                mine = new[:, here]
                fresh.append(mine)
                fresh_least = min(fresh_least, int(mine[0].min()))
                new = new[:, ~here]
            if new.shape[1]:
                far.append(new)
            out_pos.append(p[induced])
            if carry:
                out_lcp.append(lcp[induced])
            before = int(p[-1])
            head += end
        if far:
            queue.put(np.concatenate(far, axis=1))
    queue.close()
    pos = np.concatenate(out_pos) if out_pos else np.zeros(0, np.int64)
    return pos, np.concatenate(out_lcp) if carry and out_lcp else np.zeros(len(pos), np.int64)


def _sorted(entries: np.ndarray) -> np.ndarray:
    return entries[:, np.argsort(entries[0], kind="stable")]


def finish(names: np.ndarray) -> np.ndarray:
    """The order of all suffixes of names, by doubling what is compared; for strings of which most symbols are unique."""
    order = np.argsort(names, kind="stable")
    s = names[order]
    new = np.r_[True, s[1:] != s[:-1]]
    rank = np.empty(len(names), np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(len(s)), 0))
    size = 1
    while True:
        alone = new & np.r_[new[1:], True]
        at = np.flatnonzero(~alone)
        if not len(at):
            return order
        # the last symbol is unique, so what isn't alone has a suffix behind it
        own = order[at]
        behind = rank[np.minimum(own + size, len(names) - 1)]
        o = np.lexsort((behind, rank[own]))
        order[at] = own = own[o]
        behind, group = behind[o], rank[own]
        new[at] = np.r_[True, (group[1:] != group[:-1]) | (behind[1:] != behind[:-1])]
        rank[own] = np.maximum.accumulate(np.where(new[at], at, 0))
        size *= 2


def names_of(t: np.ndarray, star: np.ndarray) -> tuple[np.ndarray, int]:
    """Ranks of the substrings from each star to the next, both included; of a substring and its beginning the longer is smaller."""
    m = len(star)
    size = np.r_[star[1:] - star[:-1] + 1, 1]
    bits = (int(t.max()) + 1).bit_length()
    each = 63 // bits
    pad = np.uint64((1 << bits) - 1)
    rank, open_ = np.zeros(m, np.int64), np.arange(m)
    for depth in range(0, int(size.max()) + 1, each):
        word = np.zeros(len(open_), np.uint64)
        at, left = star[open_] + depth, size[open_] - depth
        for k in range(each):
            symbol = t[np.minimum(at + k, len(t) - 1)].astype(np.uint64)
            word = (word << np.uint64(bits)) | np.where(k < left, symbol, pad)
        order = np.lexsort((word, rank[open_])) if depth else np.argsort(word, kind="stable")
        open_, word = open_[order], word[order]
        group = rank[open_]
        new_group = np.r_[True, group[1:] != group[:-1]]
        new = new_group | np.r_[True, word[1:] != word[:-1]]
        heads = np.flatnonzero(new)
        of = np.cumsum(new) - 1
        group_heads = np.flatnonzero(new_group)
        rank[open_] = group + heads[of] - group_heads[np.cumsum(new_group) - 1]
        several = np.diff(np.r_[heads, len(open_)])[of] > 1
        open_ = open_[several & (size[open_] >= depth + each)]
        if not len(open_):
            break
    mark = np.zeros(m, np.int64)
    mark[rank] = 1
    dense = np.cumsum(mark) - 1
    return dense[rank], int(dense[-1]) + 1


def _is_s(t: np.ndarray) -> np.ndarray:
    rise = t[1:].astype(np.int64) - t[:-1]
    at = np.flatnonzero(rise)
    return np.r_[np.repeat(rise[at] > 0, np.diff(np.r_[-1, at])), True]


def common(t: np.ndarray, p: np.ndarray, q: np.ndarray, cap: int) -> np.ndarray:
    """Common prefixes of suffixes p and q, up to cap; none reaches over the end, whose symbol is unique."""
    out, alive = np.full(len(p), cap, np.int64), np.arange(len(p))
    for k in range(cap):
        same = t[np.minimum(p[alive] + k, len(t) - 1)] == t[np.minimum(q[alive] + k, len(t) - 1)]
        out[alive[~same]] = k
        alive = alive[same]
        if not len(alive):
            break
    return out


def suffix_order(t: np.ndarray, cap: int = 0, budget: int = QUEUE_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of t in order, and for each its common prefix with the one before, up to cap (0: not wanted).

    t ends with its only zero.
    """
    n = len(t)
    if n == 1:
        return np.zeros(1, np.int64), np.zeros(1, np.int64)
    key = t.astype(np.int32)
    if n >= 1 << 30:
        raise ValueError("a shard holds at most 2^30 symbols")
    is_s = _is_s(t)
    star = np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1
    names, count = names_of(t, star)
    if count > UNIQUE * len(star):
        inner = finish(names)
    else:
        inner = suffix_order(names, 0, budget)[0]
    seeds = star[inner]
    meet = (lambda p, q: common(t, p, q, cap)) if cap else None
    large, large_lcp = induce(key, seeds, np.r_[0, meet(seeds[:-1], seeds[1:])] if cap else None, cap, budget, meet)
    # the other way round S-suffixes are what L-suffixes were; seeds are the L-suffixes behind an S-suffix
    down = large[::-1]
    at = np.flatnonzero((down > 0) & is_s[np.maximum(down - 1, 0)])
    lcp = None
    if cap:
        between = np.r_[0, large_lcp[::-1][:-1]]
        lcp = np.minimum.reduceat(between[: at[-1] + 1], np.r_[0, at[:-1] + 1]) if len(at) else np.zeros(0, np.int64)
    small, small_lcp = induce(int(key.max()) - key, down[at], lcp, cap, budget, meet)
    small = np.r_[n - 1, small[::-1]]
    both = np.concatenate([large, small])
    kind = np.r_[np.zeros(len(large), np.int64), np.ones(len(small), np.int64)]
    order = np.argsort(key[both] * 2 + kind, kind="stable")
    sa = both[order]
    if not cap:
        return sa, np.zeros(0, np.int64)
    small_up = np.r_[0, 0, small_lcp[::-1][: len(small) - 2]] if len(small) > 1 else np.zeros(1, np.int64)
    values, kinds = np.concatenate([large_lcp, small_up])[order], kind[order]
    edge = np.flatnonzero((kinds[1:] != kinds[:-1])) + 1
    values[edge] = common(t, sa[edge - 1], sa[edge], cap)
    return sa, values
