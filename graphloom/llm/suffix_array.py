"""Linear grouping suffix-array construction.

Every suffix starts with a longest Lyndon word, its Lyndon prefix. Phase one
finds the groups of suffixes with equal Lyndon prefixes, ordered by that prefix:
groups start as the suffixes of one symbol and are taken in descending order.
When a group is taken, each of its suffixes points to the previous suffix that
is still in a lower group (its previous smaller suffix); that one's prefix is
extended by the group's, once per suffix that points to it, so it leaves its
group for a new one right above. Phase two emits the order inside the groups:
running through the array from its smallest suffix, the suffix before the
current one, and those its pointers lead to, take the next place of their group.
Nothing is renamed and nothing recurses; each suffix changes group once for each
suffix that points to it, so both phases are linear.
"""

from __future__ import annotations

from collections.abc import Sequence


def lyndon_groups(text: Sequence[int]) -> tuple[list[list[int]], list[int]]:
    """Groups of suffixes by Lyndon prefix, highest first, and previous-smaller pointers."""
    n = len(text)
    by: dict[int, list[int]] = {}
    for i, c in enumerate(text):
        if c in by:
            by[c].append(i)
        else:
            by[c] = [i]
    order = sorted(by)
    members = [by[c] for c in order]
    group = [0] * n
    for g, m in enumerate(members):
        for i in m:
            group[i] = g
    lower = list(range(-1, len(order) - 1))
    higher = list(range(1, len(order) + 1))
    done = bytearray(n)
    previous = [-1] * n
    taken: list[list[int]] = []
    g = len(order) - 1
    while g >= 0:
        mine = [i for i in members[g] if group[i] == g]
        if mine:
            mine.sort()
            taken.append(mine)
            for i in mine:
                done[i] = 1
            times: dict[int, int] = {}
            for i in mine:
                p = i - 1
                while p >= 0 and done[p]:
                    p = previous[p]
                previous[i] = p
                if p >= 0:
                    times[p] = times.get(p, 0) + 1
            moved: dict[tuple[int, int], list[int]] = {}
            for p, k in times.items():
                key = (k, group[p])
                if key in moved:
                    moved[key].append(p)
                else:
                    moved[key] = [p]
            for key in sorted(moved, reverse=True) if len(moved) > 1 else moved:
                q, new = key[1], len(members)
                above = higher[q]  # q is below g, so something is above it
                for p in moved[key]:
                    group[p] = new
                members.append(moved[key])
                lower.append(q)
                higher.append(above)
                higher[q] = lower[above] = new
        g = lower[g]
    return taken, previous


def suffix_array(text: Sequence[int]) -> list[int]:
    """Start positions of all suffixes of ``text`` (symbols are comparable), in order."""
    n = len(text)
    taken, previous = lyndon_groups(text)
    slot = [0] * n  # of each suffix: its group
    free = []
    start = n
    for g, mine in enumerate(taken):
        start -= len(mine)
        free.append(start)
        for i in mine:
            slot[i] = g
    array = [-1] * n
    placed = bytearray(n)
    at = n  # the empty suffix comes first
    for r in range(n + 1):
        s = at - 1
        while s >= 0 and not placed[s]:
            g = slot[s]
            array[free[g]] = s
            free[g] += 1
            placed[s] = 1
            s = previous[s]
        if r < n:
            at = array[r]
    return array
