"""Suffix sorting by Lyndon-prefix groups, in linear time and without renaming."""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Places of all suffixes of `text` (non-negative integers) in ascending order.

    First, suffixes are grouped by their longest Lyndon prefix. Groups are taken in descending
    order; each member points to the nearest earlier suffix of a smaller group, whose prefix is
    thereby found to go on with this group's, so it leaves its group for one just behind,
    further behind the more members point to it. Then the order within the groups follows in
    one ascending pass: a suffix that has its place gives the next place in their groups to
    those that its left neighbour's pointers lead to, for their prefixes end where it begins.
    """
    n = len(text) + 1  # an end mark, smaller than all, comes last
    values = np.append(text.astype(np.int64) + 1, 0)
    order = np.argsort(values, kind="stable")
    ordered = values[order]
    first = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
    starts = np.repeat(first, np.diff(np.r_[first, n]))
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    group = np.empty(n, np.int64)
    group[order] = starts
    members, at, group = order.tolist(), place.tolist(), group.tolist()
    end = np.zeros(n + 1, np.int64)
    end[first] = np.r_[first[1:], n]
    end = end.tolist()
    before = [-1] * n

    high = n
    while high:
        low = group[members[high - 1]]
        if high - low == 1:
            s = members[low]
            p = s - 1
            while p >= 0 and group[p] > low:
                p = before[p]
            before[s] = p
            if p >= 0:
                g = group[p]
                last = end[g] - 1
                if last > g:
                    end[g] = last
                    other, k = members[last], at[p]
                    members[k], at[other] = other, k
                    members[last], at[p] = p, last
                    group[p], end[last] = last, last + 1
        else:
            counts: dict[int, int] = {}
            for s in sorted(members[low:high]):
                p = s - 1
                while p >= 0 and group[p] > low:
                    p = before[p]
                if p >= 0 and group[p] == low:
                    p = before[p]
                before[s] = p
                if p >= 0:
                    counts[p] = counts.get(p, 0) + 1
            for c in sorted(set(counts.values()), reverse=True):
                moved = [p for p, times in counts.items() if times == c]
                tops: dict[int, int] = {}
                for p in moved:
                    g = group[p]
                    last = end[g] - 1
                    tops.setdefault(g, last + 1)
                    end[g] = last
                    other, k = members[last], at[p]
                    members[k], at[other] = other, k
                    members[last], at[p] = p, last
                begins = {g: end[g] for g in tops}
                for g, top in tops.items():
                    end[begins[g]] = top
                for p in moved:
                    group[p] = begins[group[p]]
        high = low

    out = [0] * n
    out[0] = n - 1
    free = list(range(n))
    group[n - 1] = -1
    for i in range(n):
        s = out[i] - 1
        while s >= 0 and group[s] >= 0:
            g = group[s]
            out[free[g]] = s
            free[g] += 1
            group[s] = -1
            s = before[s]
    return np.array(out[1:], np.int64)
