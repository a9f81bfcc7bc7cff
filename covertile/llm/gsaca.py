"""Suffix sorting by linear grouping: suffixes are grouped by their Lyndon prefixes, then each group's order is emitted."""

from __future__ import annotations

from collections.abc import Sequence


def suffix_array(text: Sequence[int]) -> list[int]:
    """Starts of the suffixes of ``text`` (integers of any size) in lexicographic order; a prefix comes before what it begins.

    First phase: groups of suffixes begin as first symbols and are taken in descending order. Each suffix of a group points
    to the nearest one before it that belongs to a smaller group (its previous smaller). What is pointed to continues with
    this group's Lyndon prefix, as often as it is pointed to, so it leaves its group for a new one right above it. Second
    phase: from the smallest suffix on, the suffix before each placed one and the chain of its pointers take the next free
    places of their groups.
    """
    n = len(text) + 1
    if n == 1:
        return []
    symbols = sorted(set(text))
    # group 0 holds the end of the text, below every symbol
    number = {s: g + 1 for g, s in enumerate(symbols)}
    group = [number[s] for s in text]
    group.append(0)
    members: list[list[int]] = [[] for _ in range(len(symbols) + 1)]
    for i, g in enumerate(group):
        members[g].append(i)
    below = list(range(-1, len(symbols)))
    above = [*range(1, len(symbols) + 1), -1]
    left = list(range(n))  # jumps over suffixes that are done
    smaller = [-1] * n
    falling: list[int] = []
    g = len(symbols)
    while g >= 0:
        own = [i for i in members[g] if group[i] == g]
        members[g] = own
        for i in own:
            left[i] = i - 1
        times: dict[int, int] = {}
        for i in own:
            j = i - 1
            while j >= 0 and left[j] != j:
                j = left[j]
            k = i
            while k > j and left[k] != j:  # shorten the way for those that follow
                left[k], k = j, left[k]
            smaller[i] = j
            if j >= 0:
                times[j] = times.get(j, 0) + 1
        if times:
            parts: dict[tuple[int, int], list[int]] = {}
            for j, c in times.items():
                parts.setdefault((c, group[j]), []).append(j)
            for c, h in sorted(parts, reverse=True):
                new = len(members)
                moved = parts[c, h]
                members.append(moved)
                for j in moved:
                    group[j] = new
                up = above[h]
                above[h] = new
                above.append(up)
                below.append(h)
                if up >= 0:
                    below[up] = new
        falling.append(g)
        g = below[g]
    start = [0] * len(members)
    at = 0
    for g in reversed(falling):
        start[g] = at
        at += len(members[g])
    order = [-1] * n
    placed = bytearray(n)
    order[0] = n - 1
    placed[n - 1] = 1
    for i in range(n):
        j = order[i] - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            order[start[g]] = j
            start[g] += 1
            placed[j] = 1
            j = smaller[j]
    return order[1:]
