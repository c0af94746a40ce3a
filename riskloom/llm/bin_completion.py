"""Bin completion over a table of lengths: how to fill bins of one capacity, for any number of items.

Items of one length are alike, so the search works on counts (at most ``capacity`` of them) and decides on many equal bins at
once. For the largest length left it enumerates the fillings of the rest of its bin that no other filling dominates, fullest
first. A branch ends when the bins so far plus a bound on the space that must be wasted reach the best packing known, and
best-fit-decreasing packings of what is left serve as incumbents at every node.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: (lengths in the bin with their copies, largest first), number of such bins
Pattern = tuple[tuple[tuple[int, int], ...], int]


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Bins that any packing needs: for each threshold, items too large to meet, plus what doesn't fit beside them."""
    sizes = np.array(sorted(counts), np.int64)
    n = np.array([counts[x] for x in sizes.tolist()], np.int64)
    above, total = (np.concatenate([[0], np.cumsum(x)]) for x in (n, sizes * n))
    small = np.concatenate([[0], sizes[2 * sizes <= capacity], capacity - sizes[2 * sizes > capacity] + 1])
    # alone: with no item of at least `small`; paired: over half, may take such items
    a = np.searchsorted(sizes, capacity - small, "right")
    b = np.minimum(a, np.searchsorted(sizes, capacity // 2, "right"))
    alone, paired = above[-1] - above[a], above[a] - above[b]
    room = paired * capacity - (total[a] - total[b])
    rest = np.maximum(0, total[b] - total[np.minimum(b, np.searchsorted(sizes, small - 1, "right"))] - room)
    return int(max(-(-total[-1] // capacity), (alone + paired - (-rest // capacity)).max()))


def best_fit(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Best-fit decreasing, for all items of a length at once."""
    open_bins: dict[int, list[list]] = {}  # space left: [pattern, bins]
    spaces = 0  # a bit for each space that is open
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            fitting = spaces >> length
            if not fitting:
                per = min(capacity // length, left)
                bins = left // per
                open_bins.setdefault(capacity - per * length, []).append([((length, per),), bins])
                spaces |= 1 << (capacity - per * length)
                left -= per * bins
                continue
            space = length + (fitting & -fitting).bit_length() - 1
            pattern, bins = open_bins[space].pop()
            if not open_bins[space]:
                del open_bins[space]
                spaces ^= 1 << space
            per = min(space // length, left)
            used = min(bins, left // per)
            if bins > used:
                open_bins.setdefault(space, []).append([pattern, bins - used])
                spaces |= 1 << space
            open_bins.setdefault(space - per * length, []).append([(*pattern, (length, per)), used])
            spaces |= 1 << (space - per * length)
            left -= per * used
    return [(pattern, bins) for groups in open_bins.values() for pattern, bins in groups]


def _fits_into(small: tuple[int, ...], large: tuple[int, ...]) -> bool:
    """Whether the items of ``small`` can be put into the items of ``large`` as bins."""
    if not small:
        return True
    return any(large[i] >= small[0] and _fits_into(small[1:], (*large[:i], large[i] - small[0], *large[i + 1 :])) for i in range(len(large)) if large[i] not in large[:i])


def fillings(counts: dict[int, int], space: int, steps: list[int]) -> Iterator[tuple[int, ...]]:
    """Undominated fillings of ``space``, fullest first, each made when it is asked for; ``steps[0]`` is what the search may still try.

    The best single item dominates every filling that is no larger, so only fuller ones are looked at.
    """
    sizes = sorted((n for n, c in counts.items() if c and n <= space), reverse=True)
    if not sizes or sizes[0] == space:
        yield tuple(sizes[:1])
        return
    sums, inside = 1, (1 << (space + 1)) - 1  # a bit for each sum of any copies of the sizes
    for n in sizes:
        shift = n
        while shift <= space:
            sums, shift = (sums | sums << shift) & inside, 2 * shift
    kept: list[tuple[int, ...]] = []
    for full in range(space, sizes[0], -1):
        stack = [((), 0, full)] if sums >> full & 1 else []
        while stack and steps[0] > 0:
            items, i, room = stack.pop()
            if i == len(sizes):
                continue
            steps[0] -= 1
            n = sizes[i]
            stack.append((items, i + 1, room))
            if n > room or items.count(n) >= counts[n] or not sums >> (room - n) & 1:
                continue
            if room > n:
                stack.append(((*items, n), i, room - n))
            elif len(items) >= 8 or not any(_fits_into((*items, n), x) for x in kept if len(x) <= 8):  # long ones cost more to compare than to try
                kept.append((*items, n))
                yield kept[-1]
    if not any(_fits_into(sizes[:1], x) for x in kept):
        yield (sizes[0],)


def complete_bins(counts: dict[int, int], capacity: int, nodes: int = 3000) -> list[Pattern]:
    """A packing of all items into few bins. ``nodes`` (with 2000 steps of filling each) bounds the search, not the packing: the best found is returned."""
    left = {n: c for n, c in counts.items() if c}  # one table, from which a branch takes its bins and puts them back
    bound, best, steps = lower_bound(left, capacity), best_fit(left, capacity), [2000 * nodes]
    most = sum(b for _, b in best)
    done: list[Pattern] = []  # bins of the branch
    stack: list[tuple[int, Iterator]] = []  # largest length and fillings of each node; a node but for the first has one of the bins above

    def take(pattern: Pattern, sign: int) -> None:
        for n, k in pattern[0]:
            left[n] -= sign * k * pattern[1]

    def visit(size: int) -> bool:
        """Whether the node is worth branching."""
        nonlocal best, most
        now = {n: c for n, c in left.items() if c}
        if size + lower_bound(now, capacity) >= most:
            return False
        rest = best_fit(now, capacity)
        if (found := size + sum(b for _, b in rest)) < most:
            best, most = done + rest, found
        if now:
            largest = max(now)
            stack.append((largest, fillings(left, capacity - largest, steps)))
        return bool(now)

    size = 0
    visit(size)
    while stack and nodes and steps[0] > 0 and most > bound:
        largest, after = stack[-1]
        left[largest] -= 1  # it's in the bin that is filled
        filling = next(after, None)
        left[largest] += 1
        if filling is None:
            stack.pop()
            if done:
                size -= done[-1][1]
                take(done.pop(), -1)
            continue
        nodes -= 1
        copies: dict[int, int] = {}
        for n in (largest, *filling):
            copies[n] = copies.get(n, 0) + 1
        bins = min(left[n] // k for n, k in copies.items())
        done.append((tuple(sorted(copies.items(), reverse=True)), bins))
        take(done[-1], 1)
        size += bins
        if not visit(size):
            size -= bins
            take(done.pop(), -1)
    return best
