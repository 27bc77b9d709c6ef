"""Re-Pair grammars of many token sequences at once.

Re-Pair replaces the most frequent pair of neighbouring symbols by a new symbol until no pair repeats.
Here all sequences of a batch go through together, to the end of all repeats: in each round every pair that is repeated within
its sequence and at least as frequent as both overlapping pairs is replaced. A rule is named by a hash
of what it derives, so equal rules of different sequences have equal names.
"""

from __future__ import annotations

import numpy as np

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of ordered pairs."""
    with np.errstate(over="ignore"):
        h = (a * _A) ^ ((b + _B) * np.uint64(0xFF51AFD7ED558CCD))
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(32))


def _counts(keys: np.ndarray) -> np.ndarray:
    """For each key, how often it occurs."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    sizes = np.diff(np.append(starts, len(keys)))
    out = np.empty(len(keys), np.int64)
    out[order] = np.repeat(sizes, sizes)
    return out


def grammars(symbols: np.ndarray, owner: np.ndarray, special: np.ndarray, uses: int = 4, least: int = 5) -> dict[str, np.ndarray]:
    """Which terminals stand in much-used rules, and the final sequences of all owners.

    ``symbols`` are 64-bit names of terminals, ``owner`` tells the sequence of each (ascending) and
    ``special`` marks terminals of interest. ``reused`` marks the terminals that a rule derives which
    is used ``uses`` times or more in its sequence and is ``least`` terminals long or longer, at any
    level of the grammar; ``counted`` the same for rules with a special terminal. ``symbol``, ``own``
    and ``length`` (terminals it derives) describe the final sequences; ``rules`` has the owner of every rule.
    """
    n = len(symbols)
    symbol, own = symbols.astype(np.uint64), owner.astype(np.int64)
    length, begin = np.ones(n, np.int64), np.arange(n)
    salt = mix(own.astype(np.uint64), np.full(n, 7, np.uint64))
    seen = np.concatenate([[0], np.cumsum(special)])
    reused, counted = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
    rules = [np.zeros(0, np.int64)]
    while len(symbol) > 1:  # until no pair repeats
        pair = mix(symbol[:-1], symbol[1:])
        within = own[:-1] == own[1:]
        count = np.where(within, _counts(np.where(within, pair ^ salt[:-1], np.arange(len(pair), dtype=np.uint64))), 0)
        left = np.concatenate([[0], count[:-1]])
        right = np.concatenate([count[1:], [0]])
        chosen = (count >= 2) & (count > left) & (count >= right)
        # in runs of equally frequent pairs the one of the least name starts, so that periods stay in step
        level = (count >= 2) & (count >= left) & (count >= right) & ~chosen
        if level.any():
            before = np.concatenate([[np.uint64(2**64 - 1)], pair[:-1]])
            after = np.concatenate([pair[1:], [np.uint64(2**64 - 1)]])
            least_name = (pair < before) | (left < count)
            chosen |= level & least_name & ((pair <= after) | (right < count))
            if symbol.size and (same := level & (pair == before)).any():  # a a a a: every second one
                place = np.arange(len(count))
                run = np.maximum.accumulate(np.where(same, 0, place))
                chosen |= same & ((place - run) % 2 == 0)
            for _ in range(2):
                chosen &= ~np.concatenate([[False], chosen[:-1]])
        at = np.flatnonzero(chosen)
        if not len(at):
            break
        total = length[at] + length[at + 1]
        rules.append(own[at][np.unique(pair[at] ^ salt[at], return_index=True)[1]])
        often = (count[at] >= uses) & (total >= least)
        first, last = begin[at], begin[at] + total
        np.add.at(reused, first[often], 1)
        np.add.at(reused, last[often], -1)
        often &= seen[last] > seen[first]
        np.add.at(counted, first[often], 1)
        np.add.at(counted, last[often], -1)
        keep = np.ones(len(symbol), bool)
        keep[at + 1] = False
        symbol = symbol.copy()
        symbol[at] = pair[at]
        length[at] = total
        symbol, own, length, salt, begin = symbol[keep], own[keep], length[keep], salt[keep], begin[keep]
    return {"reused": np.cumsum(reused)[:n] > 0, "counted": np.cumsum(counted)[:n] > 0, "symbol": symbol, "own": own, "length": length, "rules": np.concatenate(rules)}
