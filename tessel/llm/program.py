"""The configuration linear program of packing: as few sequences as cover a histogram of lengths.

A configuration is a multiset of lengths that fits one sequence. The program gives every configuration p a number x_p >= 0
and minimises their sum, where each length i must be covered: sum_p a_ip x_p >= b_i. Multiplicative weights solve it.
Every length has a price, at first its share of a sequence. In each round a configuration that is worth most at these
prices, a knapsack, is used until one of its lengths has gained a step of cover or is covered in full, and the prices of
its lengths fall by exp(-rate * cover gained). Covered lengths leave the program; it ends when all have.

The knapsack is a dynamic program over the whole histogram. Prices only fall, so its table bounds the worth of all
configurations until it is made again: configurations are drawn from it while they reach 1 - SLACK of that bound.

Any prices y give a lower bound by duality, sum_i b_i y_i / max_p a_p . y; so do the published dual feasible functions. If
the best solution is further than `gap` above the best bound, another pass starts from the prices that gave the bound,
then from those that the last pass taught: what had to be put into poor configurations gets dearer, again by a factor.
Passes end when the gap is reached or several of them have gained nothing, so a histogram decides their number.

Whole sequences: every configuration's number is rounded down, and what that leaves is packed by configurations drawn from
the knapsack's table at the same prices, now within what is left. Best fit is tried for the remainder too, and stands if
it needs fewer sequences.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

import numpy as np

#: A configuration drawn from an old table is worth at least this much less than the best.
SLACK = 1e-3
#: (lengths of a sequence, longest first; how many such sequences).
Plan = list[tuple[tuple[int, ...], int]]
Config = tuple[tuple[int, int], ...]  # (place of a length, times), by place


@dataclass
class Solution:
    """How often each configuration is used, the sum of it, the lower bound, and the prices that it began with."""

    use: dict[Config, float] = field(default_factory=dict)
    value: float = 0.0
    bound: float = 0.0
    price: np.ndarray | None = None


class Program:
    """lengths: falling, each at most size; counts: how many there are of each."""

    def __init__(self, lengths: np.ndarray, counts: np.ndarray, size: int):
        self.lengths, self.counts, self.size = lengths, counts, size

    def table(self, price: np.ndarray) -> np.ndarray:
        """The most that lengths of c in all are worth, for each c up to size: knapsack dynamic programming."""
        size, some = self.size, price > 0
        worth, by_length = np.zeros(size + 1), np.full(size + 1, -np.inf)
        by_length[size - self.lengths[some]] = price[some]  # by size - length: both operands below are slices
        least = int(self.lengths[some].min()) if some.any() else size + 1
        for c in range(least, size + 1):
            worth[c] = max(worth[c - 1], (worth[: c - least + 1] + by_length[size - c : size - least + 1]).max())
        return worth

    def drawn(self, worth: np.ndarray, price: np.ndarray, room: np.ndarray) -> Counter[int]:
        """A configuration read back from the table, longest first among equals, that holds no length more often than room."""
        found: Counter[int] = Counter()
        free, room = self.size, np.where(price > 0, room, 0)
        while free > 0:
            first = np.searchsorted(-self.lengths, -free)  # lengths that fit
            value = np.where(room[first:] > 0, price[first:] + worth[free - self.lengths[first:]], -1.0)
            if not len(value) or value.max() <= 0:
                break
            i = int((value >= value.max() - 1e-12).argmax())
            length, p = int(self.lengths[first + i]), price[first + i]
            most = min(int(room[first + i]), free // length)
            times = np.arange(1, most + 1)  # as many at once as the table allows
            k = int(times[np.flatnonzero(times * p + worth[free - length * times] >= value[i] - 1e-12)[-1]])
            found[first + i] += k
            room[first + i] -= k
            free -= k * length
        return found

    def covered(self, start: np.ndarray, rate: float, step: float) -> tuple[Solution, np.ndarray]:
        """One pass of multiplicative weights; with it, how poor the configurations of each length were on average."""
        n, counts = len(self.lengths), self.counts
        cover, poor = np.zeros(n), np.zeros(n)
        out, worth, price = Solution(price=start), None, start.copy()
        while price.any():
            found: Counter[int] = Counter()
            if worth is not None:
                found = self.drawn(worth, price, counts)
            if not found or sum(price[i] * k for i, k in found.items()) < (1 - SLACK) * worth[-1]:
                worth = self.table(price)
                out.bound = max(out.bound, float(counts @ price / worth[-1]))
                found = self.drawn(worth, price, counts)
            at, times = np.array(list(found)), np.array(list(found.values()))
            x = float((np.minimum(1 - cover[at], step) * counts[at] / times).min())
            filled = float((self.lengths[at] * times).sum()) / self.size
            config = tuple(sorted(found.items()))
            out.use[config] = out.use.get(config, 0.0) + x
            out.value += x
            gain = times * x / counts[at]
            cover[at] += gain
            poor[at] += gain * (1 - filled)
            cover[at[cover[at] > 1 - 1e-9]] = 1.0
            price[at] = np.where(cover[at] < 1, start[at] * np.exp(-rate * cover[at]), 0.0)
        return out, poor

    def dual(self) -> tuple[float, np.ndarray]:
        """The best bound of the dual feasible functions, and its prices, none of which make a configuration worth more than 1.

        With x a length's share of a sequence: x itself, or floor((k + 1) x) / k (x where (k + 1) x is whole); then, for a
        cut a, 1 for lengths over size - a and 0 for those under a.
        """
        best = (0.0, self.lengths / self.size)
        for k in range(9):
            at = (k + 1) * self.lengths
            y = np.where(at % self.size == 0, self.lengths / self.size, at // self.size / max(k, 1)) if k else self.lengths / self.size
            for a in np.unique(np.minimum(self.lengths, self.size - self.lengths)):
                z = np.where(self.lengths > self.size - a, 1.0, np.where(self.lengths < a, 0.0, y))
                best = max(best, (float(self.counts @ z), z), key=lambda v: v[0])
        return best

    def solved(self, gap: float = 0.01, rate: float = 0.05, step: float = 1.0, patience: int = 4) -> Solution:
        """A solution whose value is at most 1 + gap times its bound, or the best after `patience` passes without gain."""
        price = self.lengths / self.size
        best, poor = self.covered(price, rate, step)
        if best.value <= (1 + gap) * best.bound:
            return best
        bound, price = self.dual()
        best.bound, price, idle = max(best.bound, bound), price + 1e-3 * self.lengths / self.size, 0
        while best.value > (1 + gap) * best.bound and idle < patience:
            out, poor = self.covered(price, rate, step)
            bound, idle = max(best.bound, out.bound), idle + 1
            if out.value < best.value * (1 - gap / 10) or bound > best.bound * (1 + gap / 10):
                idle = 0
            best = min(best, out, key=lambda s: s.value)
            best.bound = bound
            price = price * np.exp(poor / max(poor.max(), 1e-12))
        return best

    def rest(self, left: np.ndarray, price: np.ndarray) -> Plan:
        """Whole sequences for what is left, by configurations drawn at the given prices."""
        plan: Plan = []
        left, worth, there = left.copy(), None, 0
        while left.any():
            now = np.where(left > 0, price, 0.0)
            found = Counter() if worth is None else self.drawn(worth, now, left)
            poor = not found or sum(now[i] * k for i, k in found.items()) < (1 - SLACK) * worth[-1]
            if worth is None or poor and np.count_nonzero(left) < 0.97 * there:
                worth, there = self.table(now), np.count_nonzero(left)
                found = self.drawn(worth, now, left)
            times = min(int(left[i]) // k for i, k in found.items())
            plan.append((tuple(int(self.lengths[i]) for i, k in sorted(found.items()) for _ in range(k)), times))
            for i, k in found.items():
                left[i] -= k * times
        return plan

    def rounded(self, solution: Solution, shares: tuple[float, ...] = (1.0, 0.9)) -> Plan:
        """Whole sequences for all counts: the fewest of a few shares of the solution, or as many as its bound calls for."""
        best: Plan | None = None
        for share in shares:
            plan = self.whole(solution, share)
            if best is None or sequences(plan) < sequences(best):
                best = plan
            if sequences(best) <= np.ceil(solution.bound - 1e-6):
                break
        return best

    def whole(self, solution: Solution, share: float) -> Plan:
        """A share of the solution rounded down, fullest first, and what that leaves."""
        plan: Plan = []
        left = self.counts.copy()
        for config, x in sorted(solution.use.items(), key=lambda c: -sum(int(self.lengths[i]) * k for i, k in c[0])):
            times = min(int(share * x + 1e-9), *(int(left[i]) // k for i, k in config))
            if times > 0:
                plan.append((tuple(int(self.lengths[i]) for i, k in config for _ in range(k)), times))
                for i, k in config:
                    left[i] -= k * times
        fit = best_fit({int(x): int(n) for x, n in zip(self.lengths, left) if n}, self.size)
        return plan + min((self.rest(left, np.maximum(solution.price, 1e-6 * self.lengths / self.size)), fit), key=sequences)


def sequences(plan: Plan) -> int:
    return sum(times for _, times in plan)


def best_fit(left: dict[int, int], size: int) -> Plan:
    """Longest first; what stays free takes the longest length that fits, again and again. Equal sequences are made at once."""
    plan: Plan = []
    there = np.zeros(size + 1, np.int64)
    for length, n in left.items():
        there[length] = n
    while (some := np.flatnonzero(there)).size:
        config, free = Counter({int(some[-1]): 1}), size - int(some[-1])
        while True:
            fits = [x for x in some[: np.searchsorted(some, free, "right")][::-1][:64] if there[x] > config[int(x)]]
            if not fits:
                fits = [x for x in some[: np.searchsorted(some, free, "right")][::-1] if there[x] > config[int(x)]][:1]
            if not fits:
                break
            config[int(fits[0])] += 1
            free -= int(fits[0])
        times = min(int(there[x]) // k for x, k in config.items())
        plan.append((tuple(sorted(config.elements(), reverse=True)), times))
        for x, k in config.items():
            there[x] -= k * times
    return plan
