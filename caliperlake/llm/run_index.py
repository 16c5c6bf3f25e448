"""Run-length index of a set of byte strings: a run-compressed Burrows-Wheeler transform with samples at run ends.

Each string ends in a terminator of its own, so no match crosses strings.  A suffix's longest match with any other suffix is
with its neighbour in suffix order.  Going one place back in the text lengthens that match by one as long as
the transform does not start a new run; so the match lengths at the first and last suffix of each run, and their places in the text,
give the matching statistics of every place by one stream over the text.
"""

from __future__ import annotations

import numpy as np

_FIRST = 7  # bytes packed into the first sort key; 257**7 fits 64 bits


def suffix_array(text: np.ndarray, owner: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Places of all suffixes in order.  text holds the strings, each followed by a terminator slot; ends are those slots."""
    n = len(text)
    symbol = text.astype(np.uint64) + np.uint64(1)
    symbol[ends] = 0
    left = ends[owner] - np.arange(n)  # bytes before the terminator
    key = np.zeros(n, np.uint64)
    for j in range(_FIRST):
        key *= np.uint64(257)
        if j < n:
            key[: n - j] += np.where(left[: n - j] > j, symbol[j:], 0).astype(np.uint64)
    order = np.lexsort((np.where(left < _FIRST, owner + 1, 0), key))
    tie = np.where(left < _FIRST, owner + 1, 0)[order]
    sorted_key = key[order]
    new = np.ones(n, bool)
    new[1:] = (sorted_key[1:] != sorted_key[:-1]) | (tie[1:] != tie[:-1])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    step = _FIRST
    while True:
        single = new & np.append(new[1:], True)
        at = np.flatnonzero(~single)  # in groups that are still equal on ``step`` bytes
        if not len(at):
            return order
        place = order[at]
        both = (rank[place] << 32) | rank[place + step]
        by = np.argsort(both, kind="stable")
        order[at] = place[by]
        both = both[by]
        starts = np.ones(len(at), bool)
        starts[1:] = both[1:] != both[:-1]
        new[at] = starts
        rank[order[at]] = np.maximum.accumulate(np.where(starts, at, 0))
        step *= 2


def common_prefix(text: np.ndarray, left: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the match of the suffixes at a and at b, within their strings."""
    most = np.minimum(left[a], left[b])
    out = np.zeros(len(a), np.int64)
    live = np.arange(len(a))
    wide = 32
    padded = np.concatenate([text, np.zeros(wide, np.uint8)])
    view = np.lib.stride_tricks.sliding_window_view(padded, wide)
    while len(live):
        x, y = view[a[live] + out[live]], view[b[live] + out[live]]
        differ = x != y
        same = np.where(differ.any(axis=1), differ.argmax(axis=1), wide)
        out[live] += same
        live = live[(same == wide) & (out[live] < most[live])]
    return np.minimum(out, most)


class RunIndex:
    """Samples at the run ends of the transform of ``strings``."""

    def __init__(self, strings: list[bytes]) -> None:
        lengths = np.array([len(s) for s in strings], np.int64)
        self.starts = np.cumsum(lengths + 1) - lengths - 1
        ends = self.starts + lengths
        text = np.frombuffer(b"".join(s + b"\0" for s in strings), np.uint8)
        owner = np.repeat(np.arange(len(strings)), lengths + 1)
        order = suffix_array(text, owner, ends)
        left = ends[owner] - np.arange(len(text))
        # The transform; the terminators before the strings' first bytes differ from one another.
        bwt = text[order - 1].astype(np.int32)
        first = np.isin(order, self.starts)
        bwt[first] = 256 + owner[order[first]]
        change = bwt[1:] != bwt[:-1]
        heads = np.flatnonzero(np.append(True, change))
        tails = np.flatnonzero(np.append(change, True))
        self.runs, self.length = len(heads), len(text)
        up, down = np.zeros(len(heads), np.int64), np.zeros(len(tails), np.int64)
        up[1:] = common_prefix(text, left, order[heads[1:] - 1], order[heads[1:]])
        down[:-1] = common_prefix(text, left, order[tails[:-1]], order[tails[:-1] + 1])
        self.samples = []
        for place, value in ((order[heads], up), (order[tails], down)):
            by = np.argsort(place)
            self.samples.append((place[by], value[by]))

    def matching_statistics(self) -> np.ndarray:
        """For each place of the text, the length of its longest match with another place; streams from sample to sample."""
        at = np.arange(self.length)
        best = np.zeros(self.length, np.int64)
        for place, value in self.samples:
            k = np.searchsorted(place, at, "right") - 1
            best = np.maximum(best, np.where(k >= 0, value[k] - (at - place[k]), 0))
        return best


def repeated_windows(strings: list[bytes], length: int, block: int = 2_000_000) -> list[np.ndarray]:
    """For each of the distinct strings, which windows of ``length`` bytes also start elsewhere in these strings.

    Strings of more bytes than one index should hold are indexed in pairs of blocks, so memory is bounded and no window is missed.
    """
    flags = [np.zeros(max(0, len(s) - length + 1), bool) for s in strings]
    blocks: list[list[int]] = [[]]
    size = 0
    for i, s in enumerate(strings):
        if size and size + len(s) > block:
            blocks.append([])
            size = 0
        blocks[-1].append(i)
        size += len(s)
    for x in range(len(blocks)):
        for y in range(x if len(blocks) == 1 else x + 1, len(blocks)):
            chosen = blocks[x] if x == y else blocks[x] + blocks[y]
            index = RunIndex([strings[i] for i in chosen])
            long = index.matching_statistics() >= length
            for start, i in zip(index.starts.tolist(), chosen, strict=True):
                flags[i] |= long[start : start + len(flags[i])]
    return flags
