"""A run-length index of texts: the Burrows-Wheeler transform as runs, with the places at the ends of runs, and matching statistics.

Texts are laid end to end, each closed by a mark of its own that sorts before all bytes. Rows of the transform are
the suffixes in order. A run of one symbol is kept as its start, the row to which its first member steps, and the places in
the texts of its first and last row: repetitive texts have few runs. Matching statistics walk queries from right to left
with one row each: where the row's run has the query's next byte, the row steps with it; where it has not, the walk goes
on from the nearer end of the next run of that byte above or below, whichever matches longer.
"""

from __future__ import annotations

import numpy as np

from newsloom.llm.pretoken import spread

#: Symbols of the transform: 0 is the mark of a text's end, byte b is b + 1.
SYMBOLS = 257
#: Symbols in the first key of a sort: seven of nine bits.
HEAD = 7
#: How many symbols of how many places are compared at once.
WIDTH, ROWS = 16, 1 << 15


def suffix_order(code: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """All suffixes in order. code: symbols, with 0 at the places ``marks`` (the last place is one); earlier marks sort before later ones."""
    n = len(code)
    to_mark = marks[np.searchsorted(marks, np.arange(n))] - np.arange(n)
    padded = np.concatenate((code, np.zeros(HEAD, code.dtype))).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for k in range(HEAD):
        key = (key << np.uint64(9)) | np.where(k <= to_mark, padded[k : k + n], np.uint64(0))
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    # suffixes that reach their mark within the key differ by it, and are in the order of marks already
    new = np.ones(n, bool)
    new[1:] = (ordered[1:] != ordered[:-1]) | (to_mark[order[1:]] < HEAD)
    step = HEAD
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    while True:
        alone = new & np.append(new[1:], True)
        rows = np.flatnonzero(~alone)
        if not len(rows):
            return order
        places = order[rows]
        pair = (rank[places].astype(np.uint64) << np.uint64(32)) | rank[places + step].astype(np.uint64)
        by = np.argsort(pair)
        places, pair = places[by], pair[by]
        order[rows] = places  # groups keep their rows, so sorted pairs fill them in order
        new[rows] = np.concatenate(([True], pair[1:] != pair[:-1]))
        rank[places] = rows[np.maximum.accumulate(np.where(new[rows], np.arange(len(rows)), 0))]
        step *= 2


class RunIndex:
    """The index of texts given as bytes end to end and the first byte of each (one more than texts)."""

    def __init__(self, raw: np.ndarray, starts: np.ndarray, depth: int):
        texts = len(starts) - 1
        self.depth = depth
        #: Where in the indexed symbols each text begins.
        self.begins = starts[:-1] + np.arange(texts)
        marks = starts[1:] + np.arange(texts)
        code = np.zeros(len(raw) + texts, np.uint16)
        inner = np.ones(len(code), bool)
        inner[marks] = False
        code[inner] = raw.astype(np.uint16) + np.uint16(1)
        self.code, self.marks = np.concatenate((code, np.zeros(depth + WIDTH, np.uint16))), marks
        self.order = suffix_order(code, marks)
        n = len(code)
        before = code[self.order - 1]
        self.run_start = np.flatnonzero(np.concatenate(([True], before[1:] != before[:-1])))
        run_end = np.append(self.run_start[1:], n) - 1
        self.run_symbol = before[self.run_start].astype(np.int64)
        self.first_place, self.last_place = self.order[self.run_start], self.order[run_end]
        self.run_end = run_end
        # a run's first row steps to: rows of smaller symbols, then earlier runs of its own
        sizes = run_end + 1 - self.run_start
        by = np.argsort(self.run_symbol, kind="stable")
        self.target = np.empty(len(by), np.int64)
        self.target[by] = np.cumsum(sizes[by]) - sizes[by]
        self.by_symbol = self.run_symbol[by] * len(by) + by

    def repeats(self) -> tuple[np.ndarray, np.ndarray]:
        """Places whose ``depth`` next bytes also begin at an earlier place."""
        rows = self.order[self.marks[np.searchsorted(self.marks, self.order)] - self.order >= self.depth]
        same = self.common(rows[:-1], self.code, rows[1:], self.depth) >= self.depth
        group = np.cumsum(np.concatenate(([True], ~same))) - 1 if len(rows) else np.zeros(0, np.int64)
        earliest = np.full(group[-1] + 1 if len(rows) else 0, len(self.code))
        np.minimum.at(earliest, group, rows)
        return rows[rows > earliest[group]]

    def common(self, places: np.ndarray, other: np.ndarray, at: np.ndarray, most: int) -> np.ndarray:
        """How many symbols from places of the index equal those from places of ``other``, ``most`` at most; ``other`` goes on for WIDTH more."""
        out = np.zeros(len(places), np.int64)
        for low in range(0, len(places), ROWS):
            live = np.arange(low, min(low + ROWS, len(places)))
            while len(live):
                done = out[live][:, None] + np.arange(WIDTH)
                mine = self.code[np.minimum(places[live][:, None] + done, len(self.code) - 1)]
                equal = (mine == other[at[live][:, None] + done]) & (mine > 0)
                matched = np.where(equal.all(axis=1), WIDTH, equal.argmin(axis=1))
                out[live] += matched
                live = live[(matched == WIDTH) & (out[live] < most)]
        return np.minimum(out, most)

    def matching(self, raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """For each byte of queries (end to end, with their first bytes), how many bytes from there match some place of the index, ``depth`` at most."""
        lengths = starts[1:] - starts[:-1]
        turn = np.argsort(-lengths, kind="stable")
        ends, lengths = starts[1:][turn], lengths[turn]
        query = np.concatenate((raw.astype(np.uint16) + np.uint16(1), np.zeros(self.depth + WIDTH, np.uint16)))
        out = np.zeros(len(raw), np.uint8 if self.depth < 256 else np.int64)
        row = np.zeros(len(turn), np.int64)
        place = np.full(len(turn), self.order[0])
        size = np.zeros(len(turn), np.int64)
        runs = len(self.run_start)
        for step in range(1, int(lengths.max(initial=0)) + 1):
            live = int(np.searchsorted(-lengths, -step, side="right"))
            at = ends[:live] - step
            symbol = query[at].astype(np.int64)
            run = np.searchsorted(self.run_start, row[:live], side="right") - 1
            off = np.flatnonzero(self.run_symbol[run] != symbol)
            if len(off):
                wanted = symbol[off]
                below = np.searchsorted(self.by_symbol, wanted * runs + run[off])
                down = self.by_symbol[np.minimum(below, runs - 1)]
                up = self.by_symbol[np.maximum(below - 1, 0)]
                has_down, has_up = (below < runs) & (down // runs == wanted), (below > 0) & (up // runs == wanted)
                down, up = down % runs, up % runs
                limit = int(size[off].max(initial=0))
                tail = at[off] + 1
                long_down = np.where(has_down, np.minimum(self.common(self.first_place[down], query, tail, limit), size[off]), -1)
                long_up = np.where(has_up, np.minimum(self.common(self.last_place[up], query, tail, limit), size[off]), -1)
                upward = long_up > long_down
                run[off] = np.where(upward, up, down)
                row[off] = np.where(upward, self.run_end[up], self.run_start[down])
                place[off] = np.where(upward, self.last_place[up], self.first_place[down])
                size[off] = np.maximum(long_up, long_down)
            size[:live] = np.minimum(size[:live] + 1, self.depth)
            row[:live] = self.target[run] + row[:live] - self.run_start[run]
            place[:live] -= 1
            lost = np.flatnonzero(size[:live] == 0)  # a byte that the index doesn't have
            row[lost], place[lost] = 0, self.order[0]
            out[at] = size[:live]
        return out


def runs_of(flags: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of each run of true flags; runs end at edges (first places of parts)."""
    padded = np.concatenate(([False], flags, [False]))
    begin, end = padded[1:] & ~padded[:-1], padded[:-1] & ~padded[1:]
    inner = edges[(edges > 0) & (edges < len(flags))]
    both = inner[flags[inner] & flags[inner - 1]]
    begin[both], end[both] = True, True
    first = np.flatnonzero(begin)
    return first, np.flatnonzero(end) - first


def whole_windows(starts: np.ndarray, size: int) -> np.ndarray:
    """For each byte of texts end to end, whether ``size`` bytes of its text begin there."""
    long = np.diff(starts) >= size
    steps = np.zeros(int(starts[-1]) + 1, np.int8)
    np.add.at(steps, starts[:-1][long], 1)
    np.subtract.at(steps, starts[1:][long] - size + 1, 1)
    return np.cumsum(steps[:-1], dtype=np.int8) > 0


def cut_out(raw: np.ndarray, at: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans of bytes laid end to end, and the first byte of each (one more than spans)."""
    return raw[spread(at, lengths)], np.concatenate(([0], np.cumsum(lengths)))


def marked(raw: np.ndarray, starts: np.ndarray, groups: np.ndarray, size: int, most: int = 1 << 19, within: bool = True) -> np.ndarray:
    """For each byte of texts in order, whether the ``size`` bytes from there, within the text, also begin at an earlier place.

    Texts that may share such strings have one group, and lie together by group, in order within it. Of each group the first
    texts are indexed, and all later ones are streamed against the index: what matches is marked; what is left of a text goes
    on to the next turn, in which four times as many of each group are indexed. No index and no stream holds over ``most`` bytes, or one text.
    within: whether a text can repeat a string of its own; if not, a text alone in its group is done.
    """
    out = np.zeros(len(raw), bool)
    begin, length, group = starts[:-1].copy(), np.diff(starts), groups
    many = 1
    while len(begin):
        keep = length >= size
        begin, length, group = begin[keep], length[keep], group[keep]
        if not within and len(group):
            _, own, number = np.unique(group, return_inverse=True, return_counts=True)
            keep = number[own] > 1
            begin, length, group = begin[keep], length[keep], group[keep]
        if not len(begin):
            break
        head = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        nth = np.arange(len(group)) - np.repeat(head, np.diff(np.append(head, len(group))))
        pick = nth < many
        # whole groups up to so many bytes; a group of more gives its first texts only
        picked = np.where(pick, length, 0)
        so_far = np.cumsum(picked) - np.repeat((np.cumsum(picked) - picked)[head], np.diff(np.append(head, len(group))))
        pick &= (so_far <= most) | (nth == 0)
        picked = np.where(pick, length, 0)
        total = np.add.reduceat(picked, head)
        share = np.repeat(np.cumsum(total) // most, np.diff(np.append(head, len(group))))
        left = ([], [], [])
        for one in np.unique(share).tolist():
            a, z = np.searchsorted(share, (one, one + 1))
            chosen = np.flatnonzero(pick[a:z]) + a
            index = RunIndex(*cut_out(raw, begin[chosen], length[chosen]), size)
            again = index.repeats()
            text = np.searchsorted(index.begins, again, side="right") - 1
            out[begin[chosen][text] + again - index.begins[text]] = True
            others = np.flatnonzero(~pick[a:z]) + a
            parts = np.cumsum(length[others]) // most
            for part in np.split(others, np.flatnonzero(np.diff(parts)) + 1) if len(others) else ():
                query, first = cut_out(raw, begin[part], length[part])
                found = index.matching(query, first) >= size
                at, windows = runs_of(found, first)
                text = np.searchsorted(first, at, side="right") - 1
                for place, n in zip((begin[part][text] + at - first[text]).tolist(), windows.tolist(), strict=True):
                    out[place : place + n] = True
                # windows that are still open, as runs, with the bytes that they cover
                at, windows = runs_of(whole_windows(first, size) & ~found, first)
                text = np.searchsorted(first, at, side="right") - 1
                left[0].append(begin[part][text] + at - first[text])
                left[1].append(windows + size - 1)
                left[2].append(group[part][text])
        begin, length, group = (np.concatenate([np.zeros(0, np.int64), *x]).astype(np.int64) for x in left)
        many *= 4
    return out
