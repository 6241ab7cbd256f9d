"""Suffix sorting with common-prefix values by external induced sorting.

Suffixes are L-type when they are larger than the next one, else S-type. The
leftmost S-type suffixes (LMS) are sorted first: their substrings are sorted by
one induction and named, and the string of names, a third as long at most,
is sorted by recursion (in memory once it is short enough). Two inductions then
sort the rest. Tuples (suffix, common prefix with the entry before) wait in a
priority queue ordered by first symbol, which is written to disk in sorted runs
when it outgrows its share of memory. The common prefix of two induced
neighbours is one more than the least value between their sources.

Order and common prefixes are exact up to ``depth`` symbols, which is all that
its users need; longer common prefixes count as ``depth``.
"""

from __future__ import annotations

import os
import shutil
import tempfile
from collections import defaultdict
from collections.abc import Iterator

import numpy as np

#: Tuples kept in memory by a queue or store before it writes to disk.
MEMORY = 4_000_000
#: Length from which a string of names is sorted by recursion instead of in memory.
BASE = 4_000_000


class Scratch:
    """A task's own folder for sorted runs, beside Spark's spill files; gone
    with the task. Losing it loses only the attempt."""

    def __init__(self):
        self.path, self.n = None, 0

    def array(self, a: np.ndarray) -> np.ndarray:
        if self.path is None:
            local = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None
            self.path = tempfile.mkdtemp(prefix="induce-", dir=local if local and os.path.isdir(local) else None)
        self.n += 1
        name = f"{self.path}/{self.n}.npy"
        np.save(name, a)
        return np.load(name, mmap_mode="r")

    def close(self) -> None:
        if self.path is not None:
            shutil.rmtree(self.path, ignore_errors=True)


class DiskQueue:
    """Priority queue of (symbol, suffix, prefix): tuples of one symbol come
    out in the order in which they went in; symbols are asked for in one
    direction only (``sign`` 1: ascending, -1: descending)."""

    def __init__(self, scratch: Scratch, sign: int, memory: int):
        self.scratch, self.sign, self.memory = scratch, sign, memory
        self.fresh: dict[int, list] = defaultdict(list)
        self.held, self.runs = 0, []

    def push(self, symbol: int, suffix: np.ndarray, prefix: np.ndarray) -> None:
        self.fresh[symbol].append((suffix, prefix))
        self.held += len(suffix)
        if self.held > self.memory:
            symbols = sorted(self.fresh, key=lambda s: s * self.sign)
            parts = [self.fresh[s] for s in symbols]
            sizes = [sum(len(x) for x, _ in p) for p in parts]
            self.runs.append([
                np.array(symbols, np.int64), np.concatenate([[0], np.cumsum(sizes)]), 0,
                self.scratch.array(np.concatenate([x for p in parts for x, _ in p])),
                self.scratch.array(np.concatenate([y for p in parts for _, y in p]))])
            self.fresh, self.held = defaultdict(list), 0

    def pull(self, symbol: int) -> tuple[np.ndarray, np.ndarray] | None:
        """All waiting tuples of ``symbol``, or None."""
        got = []
        for run in self.runs:
            while run[2] < len(run[0]) and run[0][run[2]] * self.sign < symbol * self.sign:
                run[2] += 1
            if run[2] < len(run[0]) and run[0][run[2]] == symbol:
                lo, hi = run[1][run[2]], run[1][run[2] + 1]
                got.append((np.asarray(run[3][lo:hi]), np.asarray(run[4][lo:hi])))
                run[2] += 1
        self.runs = [r for r in self.runs if r[2] < len(r[0])]
        fresh = self.fresh.pop(symbol, [])
        self.held -= sum(len(x) for x, _ in fresh)
        got += fresh
        if not got:
            return None
        return got[0] if len(got) == 1 else (np.concatenate([x for x, _ in got]), np.concatenate([y for _, y in got]))


def by_head(heads: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(symbol, places of it in ``heads``), by symbol."""
    order = np.argsort(heads, kind="stable")
    ordered = heads[order]
    cuts = np.append(np.flatnonzero(ordered[1:] != ordered[:-1]) + 1, len(ordered)).tolist()
    lo = 0
    for hi in cuts if len(ordered) else ():
        yield int(ordered[lo]), order[lo:hi]
        lo = hi


class Between:
    """Least prefix values between the sources of one symbol's tuples, within
    the bucket that is being scanned."""

    def __init__(self):
        self.since: dict[int, int] = {}

    def prefixes(self, heads: np.ndarray, at: np.ndarray, prefix: np.ndarray, depth: int):
        """For a scanned block with ``prefix`` values, of which the entries
        ``at`` induce tuples with first symbols ``heads``: (symbol, indices into ``at``,
        prefixes), by symbol."""
        least = np.minimum.accumulate(prefix)
        rest = np.minimum.accumulate(prefix[::-1])[::-1]
        seen = {}
        for symbol, group in by_head(heads):
            where = at[group]
            out = np.empty(len(group), np.uint8)
            before = self.since.get(symbol)
            out[0] = 1 if before is None else min(min(before, int(least[where[0]])) + 1, depth)
            if len(group) > 1:
                low = np.minimum.reduceat(prefix[:where[-1] + 1], where[:-1] + 1)
                out[1:] = np.minimum(low, depth - 1) + np.uint8(1)
            seen[symbol] = int(rest[where[-1] + 1]) if where[-1] + 1 < len(prefix) else depth
            yield symbol, group, out
        whole = int(least[-1])
        self.since = {s: min(v, whole) for s, v in self.since.items()} | seen


def types(t: np.ndarray) -> np.ndarray:
    """True for S-type positions. The last symbol is the smallest and S-type."""
    differs = np.flatnonzero(t[1:] != t[:-1])  # position before a change
    return np.append(np.repeat(t[differs] < t[differs + 1], np.diff(differs, prepend=-1)), True)


def packed(t: np.ndarray) -> np.ndarray:
    """The 64 bits from every position of ``t`` on, zeros behind the end: as many
    symbols as fit, the first in the lowest bits."""
    if t.itemsize == 8:
        return t.view(np.uint64)
    low = np.append(t, np.zeros(8 // t.itemsize, t.dtype)).astype(t.dtype.newbyteorder("<"), copy=False)
    return np.ndarray(len(t), "<u8", low, strides=t.strides)


def common(words: np.ndarray, bits: int, a: np.ndarray, b: np.ndarray, depth: int, enough: np.ndarray | None = None) -> np.ndarray:
    """Common prefix of the different suffixes ``a`` and ``b``, pair by pair, up to
    ``depth``; a pair with ``enough`` symbols in common may count less than it has. ``words`` are the
    ``packed`` text of symbols of ``bits`` bits. The end of the text, which is there once, ends every prefix."""
    out = np.full(len(a), depth, np.int64)
    live, per = np.arange(len(a)), 64 // bits
    for d in range(0, depth, per):
        differ = words[a + d] ^ words[b + d]
        equal = differ == 0
        # Bits below the lowest that differs.
        low = differ[~equal]
        below = np.bitwise_count((low & (~low + np.uint64(1))) - np.uint64(1)).astype(np.int64)
        out[live[~equal]] = np.minimum(below // bits + d, depth)
        if enough is not None:
            done = equal & (enough[live] <= d + per)
            out[live[done]] = min(d + per, depth)
            equal &= ~done
        live, a, b = live[equal], a[equal], b[equal]
        if not len(live):
            break
    return out


def induce(t: np.ndarray, s_type: np.ndarray, lms: np.ndarray, lms_prefix: np.ndarray | None, depth: int,
           scratch: Scratch, memory: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Suffixes in order, by first symbol from the largest to the smallest: for
    every symbol (suffixes ascending, common prefix with the one before).
    ``lms`` holds the LMS suffixes, sorted by first symbol at least. Without
    ``lms_prefix`` the order alone is made, and all prefixes are zeros."""
    symbols = np.unique(t)
    heads, words, order_only = t[lms], packed(t), lms_prefix is None
    if order_only:
        lms_prefix = np.zeros(len(lms), np.uint8)
    lo, hi = np.searchsorted(heads, symbols), np.searchsorted(heads, symbols, side="right")
    queue, kept, held = DiskQueue(scratch, 1, memory), {}, 0
    before = np.append(np.int8(-1), s_type[:-1].astype(np.int8))  # type of the suffix that starts one further left

    def spread(block, prefix, between, queue, want_s):
        at = np.flatnonzero(before[block] == want_s)
        source = block[at] - 1
        if order_only:
            for symbol, group in by_head(t[source]):
                queue.push(symbol, source[group], np.zeros(len(group), np.uint8))
            return
        for symbol, group, values in between.prefixes(t[source], at, prefix, depth):
            queue.push(symbol, source[group], values)

    def edge(left, right):
        return 0 if order_only else int(common(words, 8 * t.itemsize, np.array([left]), np.array([right]), depth)[0])

    for c, a, b in zip(symbols.tolist(), lo, hi, strict=True):
        between, parts = Between(), []
        while (got := queue.pull(c)) is not None:
            block, prefix = got
            if not parts:
                prefix = prefix.copy()
                prefix[0] = 0
            parts.append((block, prefix))
            spread(block, prefix, between, queue, False)
        if b > a:
            prefix = lms_prefix[a:b].copy()
            prefix[0] = edge(parts[-1][0][-1], lms[a]) if parts else 0
            spread(lms[a:b], prefix, between, queue, False)
        if parts:
            pair = (np.concatenate([x for x, _ in parts]), np.concatenate([y for _, y in parts]))
            held += len(pair[0])
            if held > memory:
                pair = tuple(scratch.array(x) for x in pair)
            kept[c] = pair
    queue = DiskQueue(scratch, -1, memory)
    for c in symbols[::-1].tolist():
        between, parts = Between(), []
        if c == t[-1]:  # the end itself, which no suffix induces
            parts.append((np.array([len(t) - 1], lms.dtype), np.zeros(1, np.uint8)))
            spread(*parts[0], between, queue, True)
        while (got := queue.pull(c)) is not None:
            parts.append(got)
            spread(*got, between, queue, True)
        s_pos = np.concatenate([x for x, _ in parts])[::-1] if parts else np.empty(0, lms.dtype)
        s_pre = np.concatenate([y for _, y in parts]) if parts else np.empty(0, np.uint8)
        # Prefix with the entry before, in ascending order: what the next tuple out of the queue held.
        s_pre = np.append(s_pre[1:], np.uint8(0))[::-1].copy() if len(s_pre) else s_pre
        l_pos, l_pre = kept.pop(c, (np.empty(0, lms.dtype), np.empty(0, np.uint8)))
        if len(l_pos):
            join = edge(l_pos[-1], s_pos[0]) if len(s_pos) else 0
            if len(s_pos):
                s_pre[0] = join
            back = np.append(np.uint8(join), np.asarray(l_pre)[:0:-1])
            spread(np.asarray(l_pos)[::-1], back, between, queue, True)
        yield np.concatenate([l_pos, s_pos]), np.concatenate([l_pre, s_pre])


def doubled(names: np.ndarray, reach: int) -> np.ndarray:
    """Order of the suffixes of ``names`` by their first ``reach`` names at
    least, by prefix doubling."""
    n = len(names)
    # As many names as fit in 62 bits at first.
    bits = int(names.max()).bit_length() + 1
    step = max(1, 62 // bits)
    key, after = np.zeros(n, np.int64), np.append(names.astype(np.int64) + 1, np.zeros(step, np.int64))
    for j in range(step):
        key = key << bits | after[j:j + n]
    order = np.argsort(key)
    slots, key = np.arange(n), key[order]
    rank = np.zeros(n + 1, np.int64)  # of a suffix: the first place of its equals, from 1; 0 behind the end
    while True:
        # order[slots] has keys in order; those of one key stand side by side.
        at = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        size = np.diff(np.append(at, len(key)))
        rank[order[slots]] = np.repeat(slots[at] + 1, size)
        slots = slots[np.repeat(size > 1, size)]
        if step >= reach or not len(slots):
            return order
        pos = order[slots]
        key = rank[pos] * (n + 2) + rank[np.minimum(pos + step, n)]
        by = np.argsort(key)
        order[slots], key, step = pos[by], key[by], step * 2


def sort_lms(t: np.ndarray, s_type: np.ndarray, depth: int, scratch: Scratch, memory: int, base: int) -> np.ndarray:
    """LMS suffixes in order (up to ``depth`` symbols)."""
    at = (np.flatnonzero(s_type[1:] & ~s_type[:-1]) + 1).astype(np.int64)
    if len(at) < 2:
        return at
    # Order of the LMS substrings: one induction from LMS suffixes ordered by first symbol alone.
    first = at[np.argsort(t[at], kind="stable")]
    is_lms = np.zeros(len(t), bool)
    is_lms[at] = True
    blocks = [x[is_lms[x]] for x, _ in induce(t, s_type, first, None, depth, scratch, memory)]
    order = np.concatenate(blocks[::-1])
    # Equal neighbours share a name: equal up to and including the next LMS symbol, or to the depth.
    length = np.diff(np.append(at, len(t) - 1)) + 1
    number = np.zeros(len(t), np.int64)
    number[at] = np.arange(len(at))
    of = number[order]
    del number
    size = length[of]
    need = np.minimum(np.maximum(size[:-1], size[1:]), depth)
    same = common(packed(t), 8 * t.itemsize, order[:-1], order[1:], min(depth, int(size.max())), need)
    names = np.cumsum(np.append(1, same < need))
    reduced = np.empty(len(at), np.int64)
    reduced[of] = names
    if names[-1] == len(at):
        return order
    if len(at) <= base:
        return at[doubled(reduced, depth // 2 + 1)]
    r = np.append(reduced, 0)
    inner = sort_lms(r, types(r), depth, scratch, memory, base)
    prefix = common(packed(r), 64, inner[:-1], inner[1:], depth) if len(inner) > 1 else np.empty(0, np.int64)
    got = [x for x, _ in induce(r, types(r), inner, np.append(0, prefix).astype(np.uint8), depth, scratch, memory)]
    ranked = np.concatenate(got[::-1])
    return at[ranked[ranked < len(at)]]


def sorted_suffixes(t: np.ndarray, depth: int, memory: int = MEMORY, base: int = BASE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(suffixes ascending, common prefix with the one before) for every first
    symbol of ``t``, from the largest to the smallest symbol. ``t`` ends with
    a symbol that is smaller than all others; ``depth`` is at most 250."""
    scratch = Scratch()
    try:
        s_type = types(t)
        lms = sort_lms(t, s_type, depth, scratch, memory, base)
        same = common(packed(t), 8 * t.itemsize, lms[:-1], lms[1:], depth) if len(lms) else np.empty(0, np.int64)
        prefix = np.append(0, same).astype(np.uint8) if len(lms) else np.empty(0, np.uint8)
        yield from induce(t, s_type, lms, prefix, depth, scratch, memory)
    finally:
        scratch.close()
