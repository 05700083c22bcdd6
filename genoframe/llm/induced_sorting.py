"""External induced suffix sorting with common-prefix values.

Suffixes are sorted as in induced sorting: leftmost-S suffixes are named by their
substrings, the string of names is sorted by recursion, and a pass up and a pass down the
buckets induce all others from them. Both passes run off a priority queue whose keys are
(character, order of arrival): a monotone queue of first-in-first-out runs, kept by
character for the range of characters that the pass has reached and by range for those
ahead, whose entries - suffix tuples of position and common-prefix value - spill to disk
beyond a set size. Tuples of one bucket are taken in blocks, then those that they
themselves added, and so on.

A tuple's common-prefix value is that with the tuple before it in its bucket: one
more than the least value among the tuples scanned since that one was induced.
Values are held up to `depth`, and order beyond `depth` characters is not needed.

Memory. A string longer than `limit`, and all that goes with it (types, leftmost-S
positions, names, suffixes, common prefixes), is in unnamed scratch files mapped into
memory; steps work on blocks of a fraction of `limit` entries and the queue holds `limit`
entries. The names of leftmost-S substrings come from an induction of their own, and are
sorted by recursion. Only a string of names of no more than `small` entries is
named and sorted in memory, by doubling; with the bounds by default that is where the
recursion ends.
"""

from __future__ import annotations

import tempfile

import numpy as np

from .shared_files import scratch_folder

#: Entries (8 bytes or less) that an array or the queue may hold in memory.
IN_MEMORY = 1 << 21
#: Times IN_MEMORY: names that are sorted in memory.
SMALL = 1


def scratch(n: int, kind, limit: int) -> np.ndarray:
    """An array of zeros, on disk if it is longer than limit."""
    if n <= limit:
        return np.zeros(n, kind)
    out = tempfile.TemporaryFile(dir=scratch_folder())
    out.truncate(max(1, n) * np.dtype(kind).itemsize)
    return np.memmap(out, kind, "r+", shape=(n,))


def blocks(low: int, high: int, size: int):
    return ((i, min(high, i + size)) for i in range(low, high, size))


class BucketQueue:
    """First-in-first-out runs of (position, common prefix) for each character; beyond limit entries they go to disk.

    Characters go up to top. Runs of characters in another range than the open one are held
    together, in order of arrival, until the range is opened.
    """

    RANGES = 256

    def __init__(self, limit: int, top: int):
        self.limit, self.width = limit, top // self.RANGES + 1
        self.far: dict[int, list] = {}
        self.near: dict[int, list] = {}
        self.open, self.held, self.file, self.end = -1, 0, None, 0

    def _append(self, run: list, *arrays: np.ndarray) -> None:
        run.append(arrays)
        self.held += len(arrays[0])
        if self.held > self.limit:
            self.spill()

    def _loaded(self, chunk) -> tuple:
        if isinstance(chunk[0], np.ndarray):
            self.held -= len(chunk[0])
            return chunk
        place, n, kinds = chunk
        self.file.seek(place)
        return tuple(np.frombuffer(self.file.read(n * k.itemsize), k) for k in kinds)

    def spill(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile(dir=scratch_folder())
        for run in [*self.far.values(), *self.near.values()]:
            for k, chunk in enumerate(run):
                if isinstance(chunk[0], np.ndarray):
                    self.file.seek(self.end)
                    for a in chunk:
                        self.file.write(np.ascontiguousarray(a).tobytes())
                    run[k] = (self.end, len(chunk[0]), [a.dtype for a in chunk])
                    self.end += sum(a.nbytes for a in chunk)
        self.held = 0

    def put(self, char: np.ndarray, pos: np.ndarray, lcp: np.ndarray) -> None:
        """Entries in order of arrival."""
        if not len(char):
            return
        place = char // self.width
        if (place == place[0]).all():
            self._put(int(place[0]), char, pos, lcp)
            return
        order = np.argsort(place, kind="stable")
        char, pos, lcp, place = char[order], pos[order], lcp[order], place[order]
        cuts = np.concatenate(([0], np.flatnonzero(place[1:] != place[:-1]) + 1, [len(place)]))
        for i, j in zip(cuts[:-1], cuts[1:]):
            self._put(int(place[i]), char[i:j], pos[i:j], lcp[i:j])

    def _put(self, place: int, char: np.ndarray, pos: np.ndarray, lcp: np.ndarray) -> None:
        if place != self.open:
            self._append(self.far.setdefault(place, []), char, pos, lcp)
            return
        if (char == char[0]).all():
            self._append(self.near.setdefault(int(char[0]), []), pos, lcp)
            return
        order = np.argsort(char, kind="stable")
        char, pos, lcp = char[order], pos[order], lcp[order]
        cuts = np.concatenate(([0], np.flatnonzero(char[1:] != char[:-1]) + 1, [len(char)]))
        for i, j in zip(cuts[:-1], cuts[1:]):
            self._append(self.near.setdefault(int(char[i]), []), pos[i:j], lcp[i:j])

    def take(self, char: int, size: int) -> tuple[np.ndarray, np.ndarray] | None:
        """The entries of a character that came first, about size of them; None if there are none."""
        place = char // self.width
        if place != self.open:
            self.open = place
            for chunk in self.far.pop(place, []):
                self._put(place, *self._loaded(chunk))
        run, parts, n = self.near.get(char), [], 0
        while run and n < size:
            parts.append(self._loaded(run.pop(0)))
            n += len(parts[-1][0])
        if not parts:
            self.near.pop(char, None)
            return None
        return parts[0] if len(parts) == 1 else (np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))


def s_types(t: np.ndarray, limit: int) -> np.ndarray:
    """Whether each suffix is smaller than the next; the last one counts as such."""
    n, out = len(t), scratch(len(t), bool, limit)
    for i, j in reversed(list(blocks(0, n, max(1, limit // 8)))):
        x = np.asarray(t[i : min(n, j + 1)])
        differs = np.flatnonzero(x[:-1] != x[1:])
        smaller = x[differs] < x[differs + 1]
        nearest = np.searchsorted(differs, np.arange(j - i))
        inside = nearest < len(differs)
        own = np.full(j - i, bool(out[j]) if j < n else True)
        own[inside] = smaller[nearest[inside]]
        out[i:j] = own
    return out


def leftmost(s: np.ndarray, limit: int) -> np.ndarray:
    """Positions of S suffixes after an L one; the last position if there are none."""
    size = max(1, limit // 8)
    found = lambda i, j: np.flatnonzero(s[i:j] & ~s[i - 1 : j - 1]) + i
    n = sum(len(found(i, j)) for i, j in blocks(1, len(s), size))
    out, at = scratch(max(1, n), np.int64, limit), 0
    out[0] = len(s) - 1
    for i, j in blocks(1, len(s), size):
        own = found(i, j)
        out[at : at + len(own)] = own
        at += len(own)
    return out


def names_of(t: np.ndarray, s: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """Dense ranks of the substrings from each leftmost-S position to the next, in memory."""
    top = int(t.max()) * 2 + 1
    bits = max(1, top.bit_length())
    per = max(1, 63 // bits)
    sizes = np.concatenate([np.diff(lms) + 1, [1]])

    def key(of: np.ndarray, d: int) -> np.ndarray:
        out = np.zeros(len(of), np.uint64)
        p, left = lms[of] + d, sizes[of] - d
        for j in range(per):
            ok = left > j
            at = np.where(ok, p + j, 0)
            out = (out << np.uint64(bits)) | np.where(ok, t[at].astype(np.uint64) * np.uint64(2) + s[at], 0).astype(np.uint64)
        return out

    rank = np.unique(key(np.arange(len(lms)), 0), return_inverse=True)[1].astype(np.int64)
    d = per
    while (sizes > d).any():
        marked = np.zeros(int(rank.max()) + 1, bool)
        marked[rank[sizes > d]] = True
        sub = np.flatnonzero(marked[rank])
        k = np.unique(key(sub, d), return_inverse=True)[1]
        pair, inside = np.unique(rank[sub] * (int(k.max()) + 1) + k, return_inverse=True)
        group = pair // (int(k.max()) + 1)
        extra = np.zeros(len(marked), np.int64)
        np.add.at(extra, group, 1)
        extra[extra > 0] -= 1
        shift = np.concatenate([[0], np.cumsum(extra)[:-1]])
        first = np.searchsorted(group, group)
        old = rank[sub]
        rank = rank + shift[rank]
        rank[sub] = old + shift[old] + inside - first[inside]
        d += per
    return rank


def doubled(r: np.ndarray, depth: int) -> np.ndarray:
    """The order of the suffixes of r by their first depth entries, by doubling, in memory."""
    rank = np.unique(r, return_inverse=True)[1].astype(np.uint64) + np.uint64(1)
    h, n = 1, len(r)
    while h < depth and int(rank.max()) < n:
        later = np.zeros(n, np.uint64)
        later[: max(0, n - h)] = rank[h:]
        rank = np.unique(rank << np.uint64(32) | later, return_inverse=True)[1].astype(np.uint64) + np.uint64(1)
        h *= 2
    return np.argsort(rank, kind="stable")


def induced_names(t: np.ndarray, s: np.ndarray, lms: np.ndarray, starts: np.ndarray, limit: int) -> tuple[np.ndarray, int]:
    """What names_of() gives, and how many distinct names there are, in bounded memory.

    Leftmost-S positions go to their buckets in any order; an induction from them puts their
    substrings in order, and neighbours are compared.
    """
    size, kind = max(1, limit // 8), np.int64
    seeds, at = scratch(len(lms), kind, limit), None
    counts = _counts_by_char(t, lms, len(starts) - 1, limit)
    at = np.concatenate(([0], np.cumsum(counts)[:-1]))
    for i, j in blocks(0, len(lms), size):
        own = np.asarray(lms[i:j])
        char = t[own].astype(np.int64)
        order = np.argsort(char, kind="stable")
        own, char = own[order], char[order]
        first = np.concatenate(([True], char[1:] != char[:-1]))
        within = np.arange(len(char)) - np.flatnonzero(first)[np.cumsum(first) - 1]
        seeds[at[char] + within] = own
        np.add.at(at, char, 1)
    sa, _ = induced(t, starts, seeds, None, 0, limit)
    names, name, last = scratch(len(lms), kind, limit), -1, None
    for i, j in blocks(0, len(sa), size):
        p = np.asarray(sa[i:j]).astype(np.int64)
        p = p[(p > 0) & s[p] & ~s[np.maximum(p - 1, 0)]]
        if not len(p):
            continue
        k = np.searchsorted(lms, p)
        sizes = lms[np.minimum(k + 1, len(lms) - 1)] - p + 1
        both = np.concatenate([[last[0]], p]) if last else p
        long = np.concatenate([[last[1]], sizes]) if last else sizes
        same = long[1:] == long[:-1]
        live, d = np.flatnonzero(same), 0
        while len(live):
            equal = t[both[live] + d] == t[both[live + 1] + d]
            same[live[~equal]] = False
            live = live[equal]
            d += 1
            live = live[long[live] > d]
        new = ~same if last else np.concatenate(([True], ~same))
        own = name + np.cumsum(new)
        names[k] = own
        name, last = int(own[-1]), (int(p[-1]), int(sizes[-1]))
    return names, name + 1


def common_prefixes(t: np.ndarray, order: np.ndarray, depth: int, limit: int) -> np.ndarray:
    """Of each suffix with the one before it in order, up to depth; 0 for the first. t is a string of 16-bit characters, its last one there once."""
    n, out, size = len(t), scratch(len(order), np.int16, limit), max(1, limit // 8)
    look = scratch(n, np.uint64, limit)  # four characters from each place on
    for i, j in blocks(0, n, size):
        part = np.zeros(j - i + 3, np.uint64)
        part[: min(n, j + 3) - i] = t[i : j + 3]
        for k in range(4):
            look[i:j] |= part[k : k + j - i] << np.uint64(16 * k)
    for i, j in blocks(1, len(order), size):
        a, b = np.asarray(order[i - 1 : j - 1]).astype(np.int64), np.asarray(order[i:j]).astype(np.int64)
        value, at = np.zeros(j - i, np.int16), np.arange(j - i)
        for d in range(0, depth, 4):
            x = np.where(np.maximum(a, b) + d < n, look[np.minimum(a + d, n - 1)] ^ look[np.minimum(b + d, n - 1)], np.uint64(1))
            same, more = x == 0, np.zeros(len(x), np.int16)
            for k in range(1, 4):
                more += (x << np.uint64(64 - 16 * k)) == 0
            value[at] = d + np.where(same, 4, more)
            a, b, at = a[same], b[same], at[same]
            if not len(at):
                break
        out[i:j] = np.minimum(value, depth)
    return out


class Induction:
    """One pass over the buckets: what is scanned puts the suffix before it into the queue. Without depth, no prefixes are kept."""

    def __init__(self, t: np.ndarray, depth: int, limit: int, up: bool, top: int):
        self.t, self.depth, self.up = t, depth, up
        self.queue = BucketQueue(limit, top)
        self.least: dict[int, int] = {}

    def scan(self, c: int, pos: np.ndarray, lcp: np.ndarray | None, equal: bool) -> None:
        """Scans tuples of bucket c in order; equal: whether a like character before belongs to this pass."""
        if not len(pos):
            return
        before = pos - 1
        q = self.t[np.maximum(before, 0)]
        wanted = (before >= 0) & (((q > c) if self.up else (q < c)) | ((q == c) if equal else False))
        at = np.flatnonzero(wanted)
        if not self.depth:
            self.queue.put(q[at].astype(np.int64), before[at], np.zeros(len(at), np.int8))
            return
        whole = int(lcp.min())
        fresh = {}
        if len(at):
            own = q[at]
            order = np.argsort(own, kind="stable")
            at, own = at[order], own[order]
            cuts = np.concatenate(([0], np.flatnonzero(own[1:] != own[:-1]) + 1, [len(own)]))
            tail = np.minimum.accumulate(lcp[::-1])[::-1]
            for i, j in zip(cuts[:-1], cuts[1:]):
                char, idx = int(own[i]), at[i:j]
                edges = np.concatenate(([0], idx[:-1] + 1))
                values = np.minimum.reduceat(lcp[: idx[-1] + 1], edges)
                values[0] = min(int(values[0]), self.least.get(char, -1))
                self.queue.put(own[i:j].astype(np.int64), before[idx], np.minimum(values + 1, self.depth).astype(np.int16))
                fresh[char] = int(tail[idx[-1] + 1]) if idx[-1] + 1 < len(lcp) else self.depth
        for char in self.least:
            if char not in fresh:
                self.least[char] = min(self.least[char], whole)
        self.least |= fresh


def _run_length(t: np.ndarray, p: int, depth: int) -> int:
    part = t[p : p + depth + 1]
    other = np.flatnonzero(part != part[0])
    return int(other[0]) if len(other) else len(part)


def _counts_by_char(t: np.ndarray, positions: np.ndarray | None, top: int, limit: int) -> np.ndarray:
    out = np.zeros(top, np.int64)
    for i, j in blocks(0, len(t) if positions is None else len(positions), max(1, limit // 8)):
        out += np.bincount(t[i:j] if positions is None else t[np.asarray(positions[i:j])], minlength=top)
    return out


def induced(t: np.ndarray, starts: np.ndarray, seeds: np.ndarray, seed_lcp: np.ndarray | None, depth: int, limit: int) -> tuple[np.ndarray, np.ndarray | None]:
    """All suffixes in order, from leftmost-S ones by bucket; with common prefixes up to depth if it isn't 0."""
    n, top, size = len(t), len(starts) - 1, max(1, limit // 8)
    kind = np.int32 if n < 2**31 else np.int64
    sa, lcp = scratch(n, kind, limit), scratch(n, np.int16, limit) if depth else None
    cuts = np.concatenate(([0], np.cumsum(_counts_by_char(t, seeds, top, limit))))
    n_l = np.zeros(top, np.int64)
    used = np.flatnonzero(starts[1:] > starts[:-1]).tolist()

    up = Induction(t, depth, limit, True, top)
    for c in used:
        at = int(starts[c])
        while got := up.queue.take(c, size):
            pos, own = got
            if depth:
                if at == starts[c]:
                    own = own.copy()
                    own[0] = 0
                lcp[at : at + len(pos)] = own
            sa[at : at + len(pos)] = pos
            at += len(pos)
            up.scan(c, pos, own, True)
        n_l[c] = at - starts[c]
        for i, j in blocks(int(cuts[c]), int(cuts[c + 1]), size):
            pos = np.asarray(seeds[i:j]).astype(kind)
            own = np.array(seed_lcp[i:j]) if depth else None
            if depth and i == cuts[c]:
                own[0] = min(depth, _run_length(t, int(sa[at - 1]), depth), _run_length(t, int(pos[0]), depth)) if n_l[c] else 0
            up.scan(c, pos, own, False)

    down = Induction(t, depth, limit, False, top)
    down.queue.put(np.array([used[0]]), np.array([n - 1], kind), np.zeros(1, np.int16 if depth else np.int8))
    for c in reversed(used):
        end, middle, first, last_s = int(starts[c + 1]), int(starts[c] + n_l[c]), True, -1
        while got := down.queue.take(c, size):
            pos, own = got
            new = end - len(pos)
            sa[new:end] = pos[::-1]
            if depth:
                if first:
                    own = own.copy()
                    own[0] = 0
                    first = False
                # each has its value with the next larger one, where that one keeps it
                lcp[new + 1 : end] = own[1:][::-1]
                if end < starts[c + 1]:
                    lcp[end] = own[0]
            end, last_s = new, int(pos[-1])
            down.scan(c, pos, own, True)
        seam = 0
        if depth and n_l[c] and last_s >= 0:
            seam = min(depth, _run_length(t, last_s, depth), _run_length(t, int(sa[middle - 1]), depth))
        if depth and last_s >= 0:
            lcp[middle] = seam
        for j in range(middle, int(starts[c]), -size):
            i = max(int(starts[c]), j - size)
            own = None
            if depth:
                own = np.concatenate([[seam if j == middle else lcp[j]], lcp[i + 1 : j][::-1]]).astype(np.int16)
            down.scan(c, np.ascontiguousarray(sa[i:j][::-1]), own, False)
    return sa, lcp


def sorted_suffixes(t: np.ndarray, depth: int, limit: int = IN_MEMORY, small: int | None = None, prefixes: bool = True) -> tuple[np.ndarray, np.ndarray | None]:
    """Suffix array of t up to depth, and each suffix's common prefix with the one before it.

    t ends with a character that is smaller than all others.
    """
    small = SMALL * limit if small is None else small
    top = max(int(t[i:j].max()) for i, j in blocks(0, len(t), max(1, limit // 8))) + 1
    starts = np.concatenate(([0], np.cumsum(_counts_by_char(t, None, top, limit))))
    s = s_types(t, limit)
    lms = leftmost(s, limit)
    if len(lms) <= small:
        names = names_of(t, s, np.asarray(lms))
        order = np.argsort(names, kind="stable") if int(names.max()) + 1 == len(lms) else doubled(names, depth // 2 + 2)
    else:
        names, distinct = induced_names(t, s, lms, starts, limit)
        if distinct < len(lms):
            order = sorted_suffixes(names, depth // 2 + 2, limit, small, False)[0]
        else:
            order = scratch(len(lms), np.int64, limit)
            for i, j in blocks(0, len(lms), max(1, limit // 8)):
                order[names[i:j]] = np.arange(i, j)
    seeds = scratch(len(lms), np.int64, limit)
    for i, j in blocks(0, len(lms), max(1, limit // 8)):
        seeds[i:j] = lms[np.asarray(order[i:j])]
    if not prefixes:
        return induced(t, starts, seeds, None, 0, limit)
    return induced(t, starts, seeds, common_prefixes(t, seeds, depth, limit), depth, limit)
