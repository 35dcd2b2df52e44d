"""Rank sums of the rows of one block under many draws, in whole NumPy arrays.

A row's weight in a draw is its entity's multiplicity, which a few draws at a time hold as bytes: one row of them per entity, so that
a row takes its weights in a single read. The rows of a group are ranked in pieces of some thousand, cut between scores. Where scores
repeat, a piece adds up the rows of a score first; elsewhere running sums are taken over short lanes, in sixteen bits.
Sums do not depend on how rows are cut.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

from tidemark.operators.splits import multiplicities

SIDES = {"total": ((0, 1), (2, 3)), "post": ((1,), (3,)), "pre": ((0,), (2,)), "cross": ((0, 1), (2,))}  # channels: positives before and after the index, negatives
PAIRS = ((0, 2), (0, 3), (1, 2), (1, 3))
PIECE = 8192  # rows ranked at a time
_LANE = 32  # rows of a running sum in sixteen bits; of a sum before it is added to its score
_TIED = 8  # rows a score and channel from which a piece adds them up first
_SLAB, _WIDE = 1 << 27, 64  # bytes of multiplicities at a time, and draws


@dataclass(frozen=True)
class Form:
    """What is measured with one weight of the rows: scopes, and the statistics of each (auc, ap, brier)."""

    name: str
    stats: Mapping[str, Sequence[str]]
    scopes: tuple[str, ...] = field(init=False)
    ap: tuple[str, ...] = field(init=False)
    brier: bool = field(init=False)

    def __post_init__(self) -> None:
        for name, value in (("scopes", tuple(self.stats)), ("ap", tuple(s for s, x in self.stats.items() if "ap" in x)), ("brier", any("brier" in x for x in self.stats.values()))):
            object.__setattr__(self, name, value)


class Slabs:
    """Multiplicities for draws 0 (ones) to ``draws``: (lo, hi, (entities + 1) x (draws lo..hi-1)); the last row is zero."""

    def __init__(self, table: pa.Table, draws: int, strata: tuple | None):
        self.draws, self.strata = draws, strata
        if strata is None:
            packed = table.column("w").to_pylist()
            self.pad = len(packed)
            self.bytes = np.zeros((self.pad + 1, draws + 1), np.uint8)
            self.bytes[:-1, 0] = 1
            for i, w in enumerate(packed):
                if w is not None:
                    self.bytes[i, 1:] = np.frombuffer(w, np.uint8)[:draws]
            self.index = np.arange(self.pad)
        else:
            self.pad = sum(n for _, n in strata) + 1
            self.index = pa.compute.fill_null(table.column("slot"), self.pad - 1).to_numpy().astype(np.intp)
        self.width = max(8, min(_WIDE, _SLAB // (self.pad + 1)))

    def __iter__(self) -> Iterator[tuple[int, int, np.ndarray]]:
        return self.some(np.ones(self.draws + 1, bool))

    def some(self, wanted: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        """Only slabs with a wanted draw."""
        for lo in range(0, self.draws + 1, self.width):
            hi = min(lo + self.width, self.draws + 1)
            if not wanted[lo:hi].any():
                continue
            if self.strata is None:
                yield lo, hi, np.ascontiguousarray(self.bytes[:, lo:hi])
            else:
                m = np.zeros((self.pad + 1, hi - lo), np.uint8)
                m[:-1] = multiplicities(self.strata, lo, hi).T
                yield lo, hi, m


def channel(table: pa.Table) -> np.ndarray:
    return 2 * (1 - table.column("y").to_numpy().astype(np.int64)) + table.column("post").to_numpy().astype(np.int64)


class Block:
    """The rows of one block: groups, scores, channels, a weight per form, and sums of rows that were added up before."""

    def __init__(self, table: pa.Table, groups: list[tuple[tuple, np.ndarray]], forms: Sequence[Form], draws: int, strata: tuple | None):
        self.forms, self.draws = forms, draws
        self.slabs = Slabs(table, draws, strata)
        self.score, self.channel = table.column("s").to_numpy(), channel(table)
        self.counts = [table.column(unit(i)).to_numpy().astype(np.float64) for i in range(len(forms))]
        summed = table.column("sums").to_pylist() if table.column("sums").null_count < table.num_rows else []
        self.summed = {i: np.frombuffer(x, np.float64).reshape(len(forms), draws + 1) for i, x in enumerate(summed) if x is not None}
        self.groups = groups

    def totals(self) -> np.ndarray:
        """(groups, forms, 8, draws + 1): weight of each channel, and its weighted squared error."""
        own, out = self.slabs, np.zeros((len(self.groups), len(self.forms), 8, self.draws + 1))
        flat = out.reshape(len(self.groups), -1, self.draws + 1)
        whole, some = [], []
        for k, (_, at) in enumerate(self.groups):
            square = (self.score[at] - (self.channel[at] < 2)) ** 2
            q = np.zeros((len(self.forms), 8, len(at)))
            for f, form in enumerate(self.forms):
                for c in range(4):
                    q[f, c] = np.where(self.channel[at] == c, self.counts[f][at], 0)
                    if form.brier:
                        q[f, 4 + c] = q[f, c] * square
            q = q.reshape(-1, len(at))
            for j, i in enumerate(at.tolist() if self.summed else ()):
                if i in self.summed:
                    c = self.channel[i]
                    out[k, :, c] += self.summed[i]
                    out[k, :, 4 + c] += self.summed[i] * square[j]
                    q[:, j] = 0
            used = np.flatnonzero(q.any(axis=1))
            if 2 * len(at) < own.pad:
                some.append((k, used, own.index[at], q[used]))
            else:  # the group's sums by entity, for all draws
                whole.append((k, used, np.stack([np.bincount(own.index[at], q[u], own.pad + 1) for u in used])))
        by_entity = np.concatenate([v for *_, v in whole]) if whole else None
        for lo, hi, m in own:
            if whole:
                sums = np.zeros((len(by_entity), hi - lo))
                for first in range(0, own.pad + 1, PIECE):
                    sums += by_entity[:, first : first + PIECE] @ m[first : first + PIECE].astype(np.float64)
                at = 0
                for k, used, v in whole:
                    flat[k, used, lo:hi] += sums[at : at + len(v)]
                    at += len(v)
            for k, used, index, q in some:
                for first in range(0, len(index), PIECE):
                    flat[k, used, lo:hi] += q[:, first : first + PIECE] @ m.take(index[first : first + PIECE], axis=0).astype(np.float64)
        return out

    def ranks(self, before: np.ndarray | None, whole: np.ndarray | None) -> np.ndarray:
        """(groups, forms, 12, draws + 1): weight of each channel, ``PAIRS`` below each other inside the block, and AP sums of the four scopes.

        ``before``, ``whole`` (groups, forms, 8, draws + 1): what lies in lower blocks, and in all; for AP only.
        """
        out = np.zeros((len(self.groups), len(self.forms), 12, self.draws + 1))
        pieces = [[_Piece(self, at[cut]) for cut in _cuts(self.score[at])] for _, at in self.groups]
        for lo, hi, m in self.slabs:
            for k, own in enumerate(pieces):
                stats = out[k, :, :, lo:hi]
                for piece in own:
                    for f, form in enumerate(self.forms):
                        ends = None if whole is None else (before[k, f, :4, lo:hi] + stats[f, :4], whole[k, f, :4, lo:hi])
                        piece.add(m, lo, hi, f, form, stats[f], ends)
        return out


def unit(form: int) -> str:
    """The column of a form's weight."""
    return f"c{form}" if form else "c"


def _cuts(score: np.ndarray) -> list[np.ndarray]:
    """Runs of about ``PIECE`` rows in order of score; a score is never cut."""
    order = np.argsort(score, kind="stable")
    s = score[order]
    starts = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
    goals = np.searchsorted(starts, np.arange(PIECE, len(s), PIECE))
    cuts = np.unique(starts[goals[goals < len(starts)]])
    return np.split(order, cuts)


class _Piece:
    def __init__(self, block: Block, at: np.ndarray):
        s, ch, index = block.score[at], block.channel[at], block.slabs.index[at]
        counts = [c[at] for c in block.counts]
        held = [(j, block.summed[i]) for j, i in enumerate(at.tolist()) if i in block.summed] if block.summed else []
        key = np.lexsort((index, *counts[::-1], ch, s))
        s, ch, index, counts = s[key], ch[key], index[key], [c[key] for c in counts]
        new = np.concatenate([[True], (s[1:] != s[:-1]) | (ch[1:] != ch[:-1])])
        units = np.flatnonzero(new)
        self.tied = bool(held) or len(s) >= _TIED * len(units)
        self.pad = block.slabs.pad
        if self.tied:
            if held:
                place = np.empty(len(key), np.intp)
                place[key] = np.arange(len(key))
                rows = [place[j] for j, _ in held]
                index[rows] = self.pad
                of_row = np.cumsum(new) - 1
                self.held = [(of_row[r], x) for r, (_, x) in zip(rows, held, strict=True)]
            else:
                self.held = []
            same = ~new
            for c in counts:
                same[1:] &= c[1:] == c[:-1]
            parts = np.flatnonzero(~same)
            sizes = np.diff(np.append(parts, len(s)))
            lane = min(_LANE, 1 << int(np.log2(len(s) / len(parts))))  # about as long as the sums are
            lanes = -(-sizes // lane)
            first = np.concatenate([[0], np.cumsum(lanes)])
            padded = np.full(first[-1] * lane, self.pad, np.intp)
            padded[np.repeat(first[:-1] * lane - parts, sizes) + np.arange(len(s))] = index
            self.index, self.parts = np.ascontiguousarray(padded.reshape(-1, lane).T), first[:-1]
            self.weigh = [None if (c[parts] == 1).all() else c[parts][:, None] for c in counts]
            self.units = np.searchsorted(parts, units) if len(parts) > len(units) else None
            s, ch = s[units], ch[units]
            self.channels = [np.flatnonzero(ch == c) for c in range(4)]
            scores = [s[own] for own in self.channels]
            place = [np.arange(len(own) + 1) for own in self.channels]
        else:
            self.index, self.weigh, place, scores = [], [[] for _ in counts], [], []
            for c in range(4):
                own = np.flatnonzero(ch == c)
                wide = len(own) // _LANE + 1  # rows in lanes: the row at p is p // _LANE of the lane's p % _LANE
                lane = lambda x, fill: np.ascontiguousarray(np.append(x, np.full(wide * _LANE - len(x), fill, x.dtype)).reshape(wide, _LANE).T)  # noqa: B023, E731
                self.index.append(lane(index[own], self.pad))
                for w, all_ in zip(self.weigh, counts, strict=True):
                    w.append(None if (all_[own] == 1).all() else lane(all_[own], 0.0)[:, :, None])
                p = np.arange(len(own) + 1)
                place.append(p % _LANE * wide + p // _LANE)
                scores.append(s[own])
        self.last = [p[-1] for p in place]
        # where the scores of positives lie among all channels: below them, and up to them where these differ
        self.lo, self.ties = {}, {}
        for a in (0, 1):
            if not len(scores[a]):
                continue
            for c in range(4):
                lo = np.searchsorted(scores[c], scores[a])
                if self.tied:
                    self.lo[a, c] = place[c][lo]
                else:
                    shape = self.index[a].shape
                    where = np.zeros(shape[0] * shape[1], np.intp)
                    where[place[a][:-1]] = place[c][lo]
                    self.lo[a, c] = where
                if c > 1:
                    hi = np.searchsorted(scores[c], scores[a], side="right")
                    some = np.flatnonzero(hi > lo)
                    if len(some):
                        self.ties[a, c] = some if self.tied else place[a][some], place[c][lo[some]], place[c][hi[some]]

    def _weights(self, m: np.ndarray, lo: int, hi: int, f: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Per channel: the weights of its rows (or scores), and their running sums with what lies before each."""
        if self.tied:
            if f == 0:  # the same sums of bytes for all forms
                sums = np.empty((self.index.shape[1], hi - lo), np.uint16)
                for first in range(0, len(sums), 2048):
                    own = m.take(self.index[0, first : first + 2048], axis=0).astype(np.uint16)
                    for row in self.index[1:]:
                        own += m.take(row[first : first + 2048], axis=0)
                    sums[first : first + 2048] = own
                self.base = np.add.reduceat(sums, self.parts, axis=0, dtype=np.float64)
            x = self.base if self.weigh[f] is None else self.base * self.weigh[f]
            if f == len(self.weigh) - 1:
                self.base = None
            if self.units is not None:
                x = np.add.reduceat(x, self.units, axis=0)
            if self.held:
                x = x.copy()
                for u, sums in self.held:
                    x[u] += sums[f, lo:hi]
            weights = [x[own] for own in self.channels]
            runs = []
            for w in weights:
                run = np.zeros((len(w) + 1, hi - lo))
                np.cumsum(w, axis=0, out=run[1:])
                runs.append(run)
            return weights, runs
        weights, runs = [], []
        for index, times in zip(self.index, self.weigh[f], strict=True):
            w = m.take(index, axis=0)
            run = np.zeros(w.shape, np.uint16 if times is None else np.float64)
            w = w.astype(run.dtype) if times is None else w * times
            for k in range(1, _LANE):
                np.add(run[k - 1], w[k - 1], out=run[k])
            before = np.zeros(w.shape[1:], np.int32 if times is None else np.float64)
            np.cumsum((run[-1] + w[-1])[:-1], axis=0, dtype=before.dtype, out=before[1:])
            weights.append(w.reshape(-1, hi - lo))
            runs.append((run + before).reshape(-1, hi - lo))
        return weights, runs

    def add(self, m: np.ndarray, lo: int, hi: int, f: int, form: Form, stats: np.ndarray, ends: tuple[np.ndarray, np.ndarray] | None) -> None:
        """Adds the piece to the statistics of its group's lower pieces."""
        weights, runs = self._weights(m, lo, hi, f)
        total = np.stack([run[last] for run, last in zip(runs, self.last, strict=True)]).astype(np.float64)
        pairs = {(a, b) for scope in form.scopes for a in SIDES[scope][0] for b in SIDES[scope][1]}
        for a in (0, 1):
            if (a, a) not in self.lo:
                continue
            w = weights[a].astype(np.float64)
            below: dict[int, np.ndarray] = {}

            def run(c: int, a: int = a, below: dict = below) -> np.ndarray:
                if c not in below:
                    below[c] = runs[c].take(self.lo[a, c], axis=0)
                return below[c]

            for j, (a_, b) in enumerate(PAIRS):
                if a_ == a and (a, b) in pairs:
                    if not total[b].any() and not stats[b].any():
                        continue
                    u = np.einsum("ij,ij->j", w, run(b)) + total[a] * stats[b]
                    if (a, b) in self.ties:
                        at, first, last = self.ties[a, b]
                        u += np.einsum("ij,ij->j", w.take(at, axis=0), runs[b].take(last, axis=0) - runs[b].take(first, axis=0)) / 2
                    stats[4 + j] += u
            for scope in form.ap:
                pos, neg = SIDES[scope]
                if a not in pos:
                    continue
                before, whole = ends
                left = sum(run(c) for c in pos)
                above = (whole[list(pos)] - before[list(pos)]).sum(axis=0) - left
                every = (whole[[*pos, *neg]] - before[[*pos, *neg]]).sum(axis=0) - (left + sum(run(c) for c in neg))
                np.maximum(every, 1e-300, out=every)
                above /= every
                stats[8 + list(SIDES).index(scope)] += np.einsum("ij,ij->j", w, above)
        stats[:4] += total


def combined(blocks: Sequence[np.ndarray], totals: np.ndarray | None, forms: Sequence[Form]) -> Iterator[tuple[Form, str, tuple[np.ndarray, ...]]]:
    """(form, scope, (n_pos, n_neg, u, ap sum, squared error) by draw) from the ``ranks`` of a group's blocks in order of score and its ``totals``."""
    for f, form in enumerate(forms):
        stats = np.zeros_like(blocks[0][f])
        for block in blocks:
            for j, (a, b) in enumerate(PAIRS):
                stats[4 + j] += block[f, 4 + j] + block[f, a] * stats[b]
            stats[8:] += block[f, 8:]
            stats[:4] += block[f, :4]
        for scope in form.scopes:
            pos, neg = SIDES[scope]
            u = sum(stats[4 + PAIRS.index((a, b))] for a in pos for b in neg)
            error = totals[f, [4 + c for c in (*pos, *neg)]].sum(axis=0) if totals is not None else np.zeros(stats.shape[1])
            yield form, scope, (stats[list(pos)].sum(axis=0), stats[list(neg)].sum(axis=0), u, stats[8 + list(SIDES).index(scope)], error)


_STEP = 256  # rows of a value block whose weights are added before a draw looks for its own among them


class ValueBlock:
    """The rows of one block in order of value: groups, values, and factors of the draws for some parts of a group."""

    def __init__(self, table: pa.Table, groups: list[tuple[tuple, np.ndarray]], factors: Mapping[tuple, Sequence[tuple[int, np.ndarray]]], draws: int, strata: tuple | None):
        self.draws, self.slabs = draws, Slabs(table, draws, strata)
        value, part, counts = (table.column(c).to_numpy() for c in ("s", "post", "c"))
        summed = table.column("sums").to_pylist() if table.column("sums").null_count < table.num_rows else []
        self.groups = []
        for name, at in groups:
            at = at[np.argsort(value[at], kind="stable")]
            own = factors.get(name, ())
            kind = np.zeros(len(at), np.intp)
            for k, (p, _) in enumerate(own):
                kind[part[at] == p] = k + 1
            index, count = self.slabs.index[at], counts[at].astype(np.float64)
            held = [(j, np.frombuffer(summed[i], np.float64)) for j, i in enumerate(at.tolist()) if summed[i] is not None] if summed else []
            for j, _ in held:
                index[j] = self.slabs.pad
            self.groups.append((value[at], index, count, kind, np.stack([np.ones(draws + 1), *[f for _, f in own]]), held))

    def totals(self) -> np.ndarray:
        """(groups, draws + 1)"""
        out = np.zeros((len(self.groups), self.draws + 1))
        sums = [np.zeros_like(factor) for *_, factor, _ in self.groups]
        runs = []
        for k, (_, index, count, kind, factor, held) in enumerate(self.groups):
            for c in np.unique(kind):
                own = kind == c
                by, q = index[own], count[own]
                if len(by) >= self.slabs.pad:  # by entity, for all draws
                    by, q = np.arange(self.slabs.pad + 1), np.bincount(by, q, self.slabs.pad + 1)
                runs.append((k, c, by, q))
            for j, x in held:
                sums[k][kind[j]] += x
        for lo, hi, m in self.slabs:
            for k, c, by, q in runs:
                for first in range(0, len(by), PIECE):
                    sums[k][c, lo:hi] += q[first : first + PIECE] @ m.take(by[first : first + PIECE], axis=0).astype(np.float64)
        for k, (*_, factor, _) in enumerate(self.groups):
            out[k] = (sums[k] * factor).sum(axis=0)
        return out

    def find(self, before: np.ndarray, total: np.ndarray, goal: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """(group, draws, values): the first value whose running weight reaches a draw's goal, where that lies in this block. All arguments are (groups, draws + 1)."""
        here = (before < goal) & (before + total >= goal)
        found = []
        for lo, hi, m in self.slabs.some(here.any(axis=0)):
            for k, (value, index, count, kind, factor, held) in enumerate(self.groups):
                draws = np.flatnonzero(here[k, lo:hi])
                if not len(draws):
                    continue
                times, plain = np.ascontiguousarray(factor[:, lo:hi]), (count == 1).all()
                steps = np.zeros((-(-len(value) // _STEP), hi - lo))
                for first in range(0, len(value), PIECE):
                    rows = slice(first, first + PIECE)
                    w = m.take(index[rows], axis=0)
                    if len(times) > 1:
                        w = times.take(kind[rows], axis=0) * w
                    if not plain:
                        w = w * count[rows, None]
                    whole = len(w) // _STEP * _STEP
                    at = first // _STEP
                    steps[at : at + whole // _STEP] = w[:whole].reshape(-1, _STEP, hi - lo).sum(axis=1, dtype=np.float64)
                    if whole < len(w):
                        steps[at + whole // _STEP] = w[whole:].sum(axis=0, dtype=np.float64)
                for j, x in held:
                    steps[j // _STEP] += x[lo:hi] * times[kind[j]]
                run, want = before[k, lo:hi][draws] + steps[:, draws].cumsum(axis=0), goal[k, lo:hi][draws]
                run[-1] = np.maximum(run[-1], want)  # reached in this block, whatever the order of adding
                step = (run >= want).argmax(axis=0)
                start = np.where(step > 0, run[step - 1, np.arange(len(draws))], before[k, lo:hi][draws])
                row = step * _STEP + np.arange(_STEP)[:, None]
                inside = row < len(value)
                row = np.minimum(row, len(value) - 1)
                w = m[index[row], draws] * count[row] * times[kind[row], draws] * inside
                for j, x in held:
                    w[j % _STEP] += np.where(step == j // _STEP, x[lo:hi][draws] * times[kind[j], draws], 0)
                last = _STEP - 1 - (w[::-1] > 0).argmax(axis=0)
                fine = start + w.cumsum(axis=0)
                first_ = np.where((fine >= want).any(axis=0), (fine >= want).argmax(axis=0), last)
                found.append((k, draws + lo, value[row[first_, np.arange(len(draws))]]))
        return found
