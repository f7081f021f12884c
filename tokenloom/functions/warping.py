"""Time warping of token sequences: distances between tokens, least paths, in numpy.

Paths of several samples are found together, one anti-diagonal of all of them at a time.
The moves of a sample are kept while they fit a bound. Beyond it the totals of some diagonals
are kept: the last part is solved first and gives the cell where the part before has to end,
of which only the rows that a way back from there can reach are gone through again. So memory
grows with the lengths of a sample, and the path is the one that all moves together would have given.
"""

from __future__ import annotations

from collections.abc import Mapping
from typing import NamedTuple

import numpy as np

UP, LEFT = 1, 2  # a diagonal move is 0
MOVE_BYTES = 32 * 1024 * 1024  # moves kept at a time
_DIAGONALS, _COSTS = 64, 1 << 15  # diagonals, and cells of them for each sample, whose costs are read at a time
_STATES = 16  # diagonals of a long sample whose totals are kept for the way back
KEPT_TOKENS = 4096  # tokens of a side whose distances to the other side's are kept
_PAIRS, _PAIR_LETTERS = 1 << 15, 1 << 22  # token pairs, and letters of one side of them, compared at a time
_UNKNOWN_AT_ONCE = 1 << 19  # token pairs whose distances are looked for together
_VALUES = 1 << 20  # different costs of a sample that are listed
_UNKNOWN = np.iinfo(np.uint16).max


# Distances ------------------------------------------------------------------------------------


def _letters(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The letters of all words one after the other, and how many each has."""
    flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    return flat, np.fromiter(map(len, words), np.int64, len(words))


def _spelled(flat: np.ndarray, sizes: np.ndarray, words: np.ndarray, height: int) -> np.ndarray:
    """A row of ``height`` letters for each of ``words``."""
    begins, own = np.cumsum(sizes) - sizes, sizes[words]
    out = np.zeros((len(words), height), flat.dtype)
    at = np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own)
    out[np.repeat(np.arange(len(words)), own), at] = flat[np.repeat(begins[words], own) + at]
    return out


def _bands(sizes: np.ndarray) -> np.ndarray:
    """Lengths that are compared together: by two letters up to 32, by eighths beyond."""
    return np.where(sizes <= 32, (sizes + 1) // 2, np.ceil(8 * np.log2(np.maximum(sizes, 33) / 32)).astype(np.int64) + 16)


def edit_distances(left: list[str], right: list[str], pairs: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Levenshtein distances of the pairs ``(left[a], right[b])``.

    Pairs are compared in groups of like lengths, all pairs of a group cell by cell.
    """
    a, b = pairs
    out = np.zeros(len(a), np.uint16)
    if not len(a):
        return out
    letters, sizes = zip(*map(_letters, (left, right)))
    met = np.bincount(np.concatenate(letters), minlength=1) > 0
    number = (np.cumsum(met) - 1).astype(np.min_scalar_type(int(np.count_nonzero(met))))
    letters = number[letters[0]], number[letters[1]]
    place, words, spelled = [], [], []
    for flat, own in zip(letters, sizes):
        # Words of a band are numbered within it.
        of = _bands(own)
        order = np.argsort(of, kind="stable")
        cuts = np.searchsorted(of[order], np.arange(of.max() + 2))
        number_within = np.empty(len(own), np.int64)
        number_within[order] = np.arange(len(own)) - cuts[of[order]]
        place.append(number_within)
        words.append(of)
        some = [order[x:y] for x, y in zip(cuts, cuts[1:])]
        spelled.append([_spelled(flat, own, k, int(own[k].max()) if len(k) else 0) for k in some])
    key = (words[0] * len(spelled[1])).astype(np.uint16).take(a)
    key += words[1].astype(np.uint16).take(b)
    order = np.argsort(key, kind="stable")
    cuts = np.flatnonzero(np.diff(key[order])) + 1
    for x, y in zip(np.concatenate(([0], cuts)), np.concatenate((cuts, [len(order)]))):
        own, other = divmod(int(key[order[x]]), len(spelled[1]))
        left_words, right_words = spelled[0][own], spelled[1][other]
        most = max(1, min(_PAIRS, _PAIR_LETTERS // (1 + max(left_words.shape[1], right_words.shape[1]))))
        for at in range(x, y, most):
            some = order[at : min(at + most, y)]
            p, q = a[some], b[some]
            first = np.ascontiguousarray(left_words.take(place[0][p], axis=0).T)
            second = np.ascontiguousarray(right_words.take(place[1][q], axis=0).T)
            out[some] = _distances(first, second, sizes[0][p], sizes[1][q])
    return out


def _distances(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """One distance per column of the spelled words ``a`` and ``b`` of lengths ``n`` and ``m``."""
    kind = np.uint8 if len(a) + len(b) < 255 else np.uint16
    row, new = (np.empty((len(b) + 1, a.shape[1]), kind) for _ in range(2))
    row[:] = np.arange(len(b) + 1, dtype=kind)[:, None]
    out = m.astype(np.uint16)  # of an empty first word
    differ, step = np.empty(a.shape[1], bool), np.empty(a.shape[1], kind)
    least = int(n.min())
    ends = [(int(k), m == k) for k in np.flatnonzero(np.bincount(m))] if len(a) else []
    for i in range(len(a)):
        new[0] = i + 1
        for j in range(len(b)):
            np.not_equal(a[i], b[j], out=differ)
            np.add(row[j], differ, out=step, casting="unsafe")
            best = new[j + 1]
            np.minimum(row[j + 1], new[j], out=best)
            best += 1
            np.minimum(best, step, out=best)
        row, new = new, row
        if i + 1 >= least:
            over = n == i + 1
            for k, mine in ends:
                np.copyto(out, row[k], where=over & mine)
    return out


class _Side:
    """The first ``KEPT_TOKENS`` distinct tokens of one side that a task has met, and those of its last sequence, normalised."""

    def __init__(self, marker: str, strip: str, keys: set[str], values: set[str]):
        self.marker, self.strip, self.keys, self.values = marker, strip, keys, values
        self.number: dict[str, int] = {}
        self.tokens: list[str] = []
        self.texts: list[str] = []
        self.is_key: list[bool] = []
        self.is_value: list[bool] = []

    def forget(self) -> None:
        for token in self.tokens[KEPT_TOKENS:]:
            del self.number[token]
        for kept in (self.tokens, self.texts, self.is_key, self.is_value):
            del kept[KEPT_TOKENS:]

    def place(self, tokens: list[str]) -> np.ndarray:
        for token in tokens:
            if token not in self.number:
                self.number[token] = len(self.texts)
                self.tokens.append(token)
                text = token
                if self.strip != "spaces":
                    text = text.replace(self.marker, "")
                if self.strip != "marker":
                    text = text.replace(" ", "")
                self.texts.append(text)
                self.is_key.append(token in self.keys)
                self.is_value.append(token in self.values)
        return np.fromiter(map(self.number.__getitem__, tokens), np.int64, len(tokens))


class TokenCosts:
    """Costs between the tokens of two sides: edit distances, 0 for equivalent special tokens.

    With ``norm`` a distance is divided by the summed lengths. Distances between the first
    ``KEPT_TOKENS`` tokens of each side stay known; they are the frequent ones.
    """

    def __init__(self, norm: bool, marker_t: str, marker_s: str, strip: str, pairs: Mapping[str, str]):
        keys, values = set(pairs), set(pairs.values())
        self.norm = norm
        self.sides = [_Side(marker, strip, keys, values) for marker in (marker_t, marker_s)]
        self.known = np.full((min(64, KEPT_TOKENS),) * 2, _UNKNOWN, np.uint16)

    def _grow(self) -> None:
        need = [min(KEPT_TOKENS, len(s.texts)) for s in self.sides]
        if any(n > have for n, have in zip(need, self.known.shape)):
            shape = [max(have, min(KEPT_TOKENS, 2 * n)) for n, have in zip(need, self.known.shape)]
            grown = np.full(shape, _UNKNOWN, np.uint16)
            grown[: self.known.shape[0], : self.known.shape[1]] = self.known
            self.known = grown

    def table(self, teacher: list[str], student: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Costs between the distinct tokens of two sequences, and which of them each place has."""
        ((codes, rows, cols, values),) = self.tables([(teacher, student)])
        return codes if values is None else values.take(codes), rows, cols

    def tables(self, samples: list[tuple[list[str], list[str]]]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]]:
        """The same of several samples, whose unknown distances are found together.

        Costs are places in a list of values, which comes last and is short enough to be read fast.
        Where tokens are so long that it would not be, there is none and costs are given themselves.
        """
        for side in self.sides:
            side.forget()
        met = [[np.unique(side.place(tokens), return_inverse=True) for side, tokens in zip(self.sides, pair)] for pair in samples]
        self._grow()
        found = [self._found(a, b) for (a, _), (b, _) in met]
        # Rows of many tokens are compared portion by portion.
        waiting, total = [], 0
        for k, ((a, _), (b, _)) in enumerate(met):
            portion = max(1, _UNKNOWN_AT_ONCE // max(1, len(b)))
            for row in range(0, len(a), portion):
                p, q = np.nonzero(found[k][row : row + portion] == _UNKNOWN)
                waiting.append((k, p + row, q))
                total += len(p)
                if total >= _UNKNOWN_AT_ONCE:
                    self._compare(met, found, waiting)
                    waiting, total = [], 0
        self._compare(met, found, waiting)
        for k, ((a, _), (b, _)) in enumerate(met):
            kept = self._kept(a, b)
            self.known[np.ix_(a[: kept[0]], b[: kept[1]])] = found[k][: kept[0], : kept[1]]
        sizes = [np.fromiter(map(len, side.texts), np.int64, len(side.texts)) for side in self.sides]
        flags = [(np.array(side.is_key, bool), np.array(side.is_value, bool)) for side in self.sides]
        out = []
        for k, ((a, rows), (b, cols)) in enumerate(met):
            codes, most = found[k], int(found[k].max(initial=0))
            found[k] = None
            values = np.arange(most + 1, dtype=np.float64)
            if self.norm:
                left, right = sizes[0][a], sizes[1][b]
                width = int(left.max(initial=0) + right.max(initial=0)) + 1
                if (most + 1) * width > _VALUES:
                    codes, values = codes.astype(np.float64), None
                    both = (left[:, None] + right).astype(np.float64)
                    codes = np.divide(codes, both, out=codes, where=both > 0)  # a distance of 0 stays as it is
                else:
                    codes, values = self._coded(codes, left, right, most, width)
            (key_a, value_a), (key_b, value_b) = ((f[0][kinds], f[1][kinds]) for f, kinds in zip(flags, (a, b)))
            if (key_a.any() and value_b.any()) or (value_a.any() and key_b.any()):
                codes[(key_a[:, None] & value_b) | (value_a[:, None] & key_b)] = 0  # which is no cost
            out.append((codes, rows, cols, values))
        return out

    @staticmethod
    def _coded(distances: np.ndarray, left: np.ndarray, right: np.ndarray, most: int, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Distance d over the summed lengths s is at d * width + s."""
        kind = np.uint16 if (most + 1) * width <= _UNKNOWN else np.uint32
        codes = distances.astype(kind)
        codes *= kind(width)
        codes += left.astype(kind)[:, None] + right.astype(kind)
        both = np.arange(width, dtype=np.float64)
        given = np.arange(most + 1, dtype=np.float64)[:, None]
        return codes, np.divide(given, both, out=np.zeros((most + 1, width)), where=both > 0).reshape(-1)

    def _kept(self, a: np.ndarray, b: np.ndarray) -> list[int]:
        return [int(np.searchsorted(kinds, size)) for kinds, size in zip((a, b), self.known.shape)]

    def _found(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        found, kept = np.full((len(a), len(b)), _UNKNOWN, np.uint16), self._kept(a, b)
        found[: kept[0], : kept[1]] = self.known[np.ix_(a[: kept[0]], b[: kept[1]])]
        return found

    def _compare(self, met: list, found: list[np.ndarray], waiting: list[tuple[int, np.ndarray, np.ndarray]]) -> None:
        if not waiting:
            return
        given = [np.concatenate([met[k][side][0].take(places[side]) for k, *places in waiting]) for side in (0, 1)]
        distances, at = edit_distances(*[side.texts for side in self.sides], tuple(given)), 0
        for k, p, q in waiting:
            found[k][p, q] = distances[at : at + len(p)]
            at += len(p)


# Paths ----------------------------------------------------------------------------------------


class Sample(NamedTuple):
    """Costs ``table[rows[i], cols[j]]``, or ``values`` at these, times ``left[i] * right[j]`` where weights are given."""

    table: np.ndarray
    rows: np.ndarray
    cols: np.ndarray
    left: np.ndarray | None = None
    right: np.ndarray | None = None
    values: np.ndarray | None = None

    @property
    def shape(self) -> tuple[int, int]:
        return len(self.rows), len(self.cols)


class _Warp:
    """The recurrence over a few samples by falling number of diagonals, whose rows lie one after the other.

    Every sample's rows have a place before the first one, which is infinite like all that lies
    outside, so a step is the same for all places. Samples that are over are left out.
    """

    def __init__(self, samples: list[Sample]):
        self.shapes = [s.shape for s in samples]
        self.last = np.array([n + m - 2 for n, m in self.shapes])
        self.ends: dict[int, list[int]] = {}
        for k, d in enumerate(self.last.tolist()):
            self.ends.setdefault(d, []).append(k)
        self.base = np.cumsum([1] + [n + 1 for n, _ in self.shapes])  # place of each first row, and one behind the last
        self.parts = []
        for s in samples:
            (n, m), (_, kinds) = s.shape, s.table.shape
            # Places of the reversed columns, and of infinite costs before and behind them.
            across = np.full(2 * n + m - 1, kinds)
            across[n : n + m] = s.cols[::-1]
            weights = None
            if s.left is not None:
                weights = np.asarray(s.left, np.float64), np.ones(2 * n + m - 1)
                weights[1][n : n + m] = s.right[::-1]
            beyond = np.inf if s.values is None else len(s.values)
            table = np.concatenate((s.table, np.full((len(s.table), 1), beyond, s.table.dtype)), axis=1).reshape(-1)
            values = None if s.values is None else np.append(s.values, np.inf)
            self.parts.append((table, values, s.rows * (kinds + 1), across, weights))

    def costs(self, first: int, last: int, rows: slice, live: int) -> np.ndarray:
        """Costs of the diagonals ``first .. last`` by diagonal and place; ``rows`` are those of a single sample."""

        def windows(values: np.ndarray, n: int, m: int) -> np.ndarray:
            # Row i of diagonal d has column d - i, which is at i + n + m - 1 - d here.
            ahead = np.lib.stride_tricks.sliding_window_view(values, rows.stop - rows.start if single else n)
            begin = n + m - 1 - first + (rows.start if single else 0)
            return ahead[begin : begin - count : -1] if begin >= count else ahead[begin::-1]

        single, count = len(self.parts) == 1, last - first + 1
        if single:
            out = np.empty((count, rows.stop - rows.start + 1))
        else:
            out = np.empty((count, self.base[live] - 1))
        for k, ((n, m), (table, values, places, across, weights)) in enumerate(zip(self.shapes[:live], self.parts)):
            begin, end = (1, out.shape[1]) if single else (self.base[k], self.base[k] + n)
            over = max(0, last - self.last[k])  # diagonals of other samples
            own = count - over
            given = windows(across, n, m)[:own]
            cost = table.take(given + (places[rows] if single else places))
            if values is not None:
                cost = values.take(cost)
            if weights is not None:
                cost *= weights[0][rows] if single else weights[0]
                cost *= windows(weights[1], n, m)[:own]
            out[:, begin - 1] = np.inf
            out[:own, begin:end] = cost
            out[own:, begin:end] = np.inf
        return out

    def start(self) -> tuple[np.ndarray, np.ndarray]:
        """Totals of diagonals -1 and 0 by place."""
        older, newer = (np.full(self.base[-1] - 1, np.inf) for _ in range(2))
        newer[self.base[:-1]] = self.costs(0, 0, slice(0, self.shapes[0][0]), len(self.parts))[0, self.base[:-1]]
        return older, newer

    def run(self, state: tuple[np.ndarray, np.ndarray], first: int, last: int, moves: _Moves | None, totals: dict[int, float], rows: slice | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Totals of diagonal ``last`` from those of ``first``; moves and final totals are added on the way.

        Of equal ways the first of diagonal, up and left is taken. With ``rows`` of a single sample
        the places before them are taken for infinite, and ``state`` has only them and one before.
        """
        rows = rows or slice(0, self.shapes[0][0])
        older, newer = state[0].copy(), state[1].copy()
        spare, best = np.full_like(newer, np.inf), np.empty(len(newer))
        if first == 0:
            for k in self.ends.get(0, ()):
                totals[k] = float(newer[self.base[k]])
        at = first + 1
        while at <= last:
            live = int(np.count_nonzero(self.last >= at))
            if live < len(self.parts):
                older, newer, spare, best = (v[: self.base[live] - 1] for v in (older, newer, spare, best))
            stop = min(last, at + max(1, min(_DIAGONALS, live * _COSTS // len(newer))) - 1)
            some, held = rows, slice(0, len(newer))
            if len(self.parts) == 1:
                # Rows beyond those of these diagonals stay as they are: before them nothing is read again, behind them all is infinite.
                some = slice(max(rows.start, at - self.shapes[0][1]), min(rows.stop, stop + 1))
                held = slice(some.start - rows.start, some.stop - rows.start + 1)
            cost = self.costs(at, stop, some, live)[:, 1:]
            older, newer, spare, all_of = older[held], newer[held], spare[held], (older, newer, spare)
            now = best[: held.stop - held.start - 1]
            if held.start:
                older[0] = newer[0] = spare[0] = np.inf
            for d in range(at, stop + 1):
                diagonal, up, left = older[:-1], newer[:-1], newer[1:]
                np.minimum(diagonal, up, out=now)
                if moves is not None:
                    moves.add(d, held.start, up, diagonal, left, now)
                np.minimum(now, left, out=now)
                np.add(now, cost[d - at], out=spare[1:])
                older, newer, spare, all_of = newer, spare, older, (all_of[1], all_of[2], all_of[0])
                spare[0] = np.inf
                for k in self.ends.get(d, ()):
                    if len(self.parts) > 1:
                        totals[k] = float(newer[self.base[k] + self.shapes[k][0] - 1])
                    elif rows.stop == self.shapes[0][0]:
                        totals[k] = float(newer[-1])
            older, newer, spare = all_of
            at = stop + 1
        return older, newer

    def ways(self) -> list[tuple[float, np.ndarray]]:
        """Totals and paths of all samples, whose moves are all kept."""
        last, totals = int(self.last.max()), {}
        moves = _Moves(0, last, int(self.base[-1]) - 2)
        self.run(self.start(), 0, last, moves, totals)
        i, j = (np.array([s[k] - 1 for s in self.shapes]) for k in (0, 1))
        way, steps = [], np.zeros(len(i), np.int64)
        while True:
            way.append((i, j))
            going = (i + j) > 0
            if not going.any():
                break
            steps += going
            # A move has the place of its row, without the first place of all.
            was_up, was_left = moves.at(i + j, self.base[:-1] + i - 1)
            i, j = i - (going & ~was_left), j - (going & (was_left | ~was_up))
        ways = np.array(way, np.int32)
        return [(totals[k], np.ascontiguousarray(ways[: steps[k] + 1, :, k][::-1])) for k in range(len(steps))]

    def solve(self, state, first: int, last: int, cell: tuple[int, int], path: list, totals: dict[int, float], low: int = 0) -> tuple[int, int]:
        """The path of a single sample from ``cell`` back to diagonal ``first``; ``state`` begins at the place before row ``low``.

        A way back from a cell goes up by a row a diagonal at most, and the totals on it depend
        on no other rows. So all but the first run are about as wide as they are long.
        """
        rows = slice(max(low, cell[0] - (last - first)), cell[0] + 1)
        state = tuple(v[rows.start - low : rows.stop - low + 1].copy() for v in state)
        for v in state:
            v[0] = np.inf if rows.start > low or low == 0 else v[0]
        if last - first < 2 or (last - first) * (rows.stop - rows.start) * 2 <= MOVE_BYTES:
            moves = _Moves(first, last, rows.stop - rows.start)
            self.run(state, first, last, moves, totals, rows)
            i, j = cell
            while i + j > first:
                path.append((i, j))
                was_up, was_left = moves.at(i + j, i - rows.start)
                i, j = i - (not was_left), j - bool(was_left or not was_up)
            return i, j
        stops = sorted({first + (last - first) * k // _STATES for k in range(_STATES + 1)})
        kept = [state]
        for begin, end in zip(stops, stops[1:-1]):
            kept.append(self.run(kept[-1], begin, end, None, totals, rows))
        for begin in reversed(stops[:-1]):
            if sum(cell) > begin:
                cell = self.solve(kept.pop(), begin, sum(cell), cell, path, totals, rows.start)
            else:
                kept.pop()
        return cell


class _Moves:
    """Whether the least way into a place came from up or from the left, neither of them if diagonally."""

    def __init__(self, first: int, last: int, width: int):
        self.first, self.used, self.begin = first + 1, 0, np.zeros(last - first + 1, np.int64)
        self.up, self.left = (np.zeros((last - first) * width, bool) for _ in range(2))

    def add(self, d: int, start: int, up: np.ndarray, diagonal: np.ndarray, left: np.ndarray, best: np.ndarray) -> None:
        own = slice(self.used, self.used + len(best))
        self.begin[d - self.first], self.used = own.start - start, own.stop
        np.less(up, diagonal, out=self.up[own])
        np.less(left, best, out=self.left[own])

    def at(self, d, place):
        where = self.begin.take(d - self.first, mode="clip") + place
        return self.up.take(where, mode="clip"), self.left.take(where, mode="clip")


def warp_all(samples: list[Sample]) -> list[tuple[float, np.ndarray]]:
    """Least total cost and path of every sample, in the given order.

    Samples of like size are warped together as long as their moves fit ``MOVE_BYTES``.
    """
    out: list = [None] * len(samples)
    order = sorted(range(len(samples)), key=lambda k: -sum(samples[k].shape))
    at = 0
    while at < len(order):
        most, rows, group = sum(samples[order[at]].shape), 0, []
        for k in order[at:]:
            rows += samples[k].shape[0] + 1
            if group and (2 * rows * most > MOVE_BYTES or most > 64 + 2 * sum(samples[k].shape)):
                break
            group.append(k)
        at += len(group)
        warp = _Warp([samples[k] for k in group])
        if len(group) == 1:
            path, totals = [], {}
            (n, m), = warp.shapes
            warp.solve(warp.start(), 0, n + m - 2, (n - 1, m - 1), path, totals)
            path.append((0, 0))
            out[group[0]] = (totals[0], np.array(path[::-1], np.int32))
            continue
        for k, found in zip(group, warp.ways()):
            out[k] = found
    return out


def dtw_path(cost: np.ndarray) -> tuple[float, np.ndarray]:
    """Least total cost and path through a matrix of costs."""
    n, m = cost.shape
    return warp_all([Sample(cost, np.arange(n), np.arange(m))])[0]
