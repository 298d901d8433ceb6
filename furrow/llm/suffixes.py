"""Suffix arrays by linear grouping, and their longest common prefixes."""

from __future__ import annotations


def suffix_array(s: list[int]) -> list[int]:
    """The order of the suffixes of s, whose last symbol is smaller than all others and occurs once.

    First, suffixes are grouped by their Lyndon prefix. They start in groups by first symbol. Groups are taken in
    descending order; each suffix of the group points to the previous suffix of a lower group, and suffixes pointed
    to move to a new group just above the one they were in, those pointed to more often higher: their Lyndon
    prefix has grown by that of the group taken. Then the groups are emitted: going through the order from its
    start, the suffix before each entry takes the next place of its group, then the one that suffix points to,
    and so on until one is placed already. No symbol is renamed and nothing recurs.
    """
    n = len(s)
    names = {c: k for k, c in enumerate(sorted(set(s)))}
    group = [names[c] for c in s]
    members: list[list[int]] = [[] for _ in names]
    for i, g in enumerate(group):
        members[g].append(i)
    up = list(range(1, len(members) + 1))
    down = list(range(-1, len(members) - 1))
    up[-1] = -1
    before = [-1] * n
    done = bytearray(n)
    g = len(members) - 1
    while g >= 0:
        own = members[g]
        if len(own) > 1:
            own = [i for i in own if group[i] == g]
            own.sort()
            members[g] = own
        elif own and group[own[0]] != g:
            own = members[g] = []
        for i in own:
            done[i] = 1
        times: dict[int, int] = {}
        for i in own:
            j = i - 1
            while j >= 0 and done[j]:
                j = before[j]
            before[i] = j
            if j >= 0:
                times[j] = times.get(j, 0) + 1
        if times:
            if len(times) == 1 or max(times.values()) == 1:
                levels = [list(times)]
            else:
                by: dict[int, list[int]] = {}
                for j, k in times.items():
                    by.setdefault(k, []).append(j)
                levels = [by[k] for k in sorted(by, reverse=True)]
            for level in levels:
                new: dict[int, int] = {}
                for j in level:
                    k = group[j]
                    x = new.get(k)
                    if x is None:
                        x = new[k] = len(members)
                        members.append([])
                        above = up[k]
                        up.append(above)
                        down.append(k)
                        up[k] = x
                        if above >= 0:
                            down[above] = x
                    members[x].append(j)
                    group[j] = x
        g = down[g]
    bottom = 0
    while down[bottom] >= 0:
        bottom = down[bottom]
    start, at, g = [0] * len(members), 0, bottom
    while g >= 0:
        start[g] = at
        at += len(members[g])
        g = up[g]
    order, placed = [-1] * n, bytearray(n)
    order[0] = n - 1
    placed[n - 1] = 1
    start[group[n - 1]] += 1
    for r in range(n):
        j = order[r] - 1
        while j >= 0 and not placed[j]:
            k = group[j]
            order[start[k]] = j
            start[k] += 1
            placed[j] = 1
            j = before[j]
    return order


def common_prefixes(s: list[int], order: list[int]) -> list[int]:
    """How many symbols each suffix in the order shares with the one before it."""
    n = len(s)
    rank = [0] * n
    for r, i in enumerate(order):
        rank[i] = r
    out, h = [0] * n, 0
    for i in range(n):
        r = rank[i]
        if r:
            j = order[r - 1]
            while i + h < n and j + h < n and s[i + h] == s[j + h]:
                h += 1
            out[r] = h
            if h:
                h -= 1
        else:
            h = 0
    return out
