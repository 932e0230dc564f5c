"""SuperMinHash signatures, for many sets at once.

SuperMinHash gives every element a random permutation of the slots; at rank j an element offers the slot in its
permutation the value j + r with a fresh r in [0, 1), and a slot keeps its smallest offer. Ranks of an element are correlated
through the permutation (no slot is offered twice by one element), which lowers the variance against independent slots.

Offers at rank j are all below offers at rank j + 1. So sets are processed rank by rank instead of element by
element, and a set stops as soon as all its slots are filled: later ranks can't change it. Large sets end after the
first rank; a set of n elements takes about (slots / n) ln(slots) ranks.
"""

from __future__ import annotations

import numpy as np

from .words import U, mix

_STEP = 0x9E3779B97F4A7C15


def signatures(elements: np.ndarray, off: np.ndarray, slots: int) -> np.ndarray:
    """One row of ``slots`` 64-bit values per set: rank in the top 16 bits, r in the others. ``off``: first element of each set.

    Empty sets have all bits set in every slot. Elements are 64-bit hashes and may not repeat in a set.
    """
    n = len(off) - 1
    out = np.full(n * slots, ~U(0), U)
    of = np.repeat(np.arange(n), np.diff(off))
    seeds = elements
    swaps: list[np.ndarray] = []  # of each rank so far, the position it was swapped with
    for rank in range(slots):
        if not len(of):
            break
        draw = mix(seeds + U((2 * rank + 1) * _STEP & 0xFFFFFFFFFFFFFFFF))
        r = mix(draw ^ U(0xA5A5A5A5A5A5A5A5)) >> U(16)
        at = rank + ((draw >> U(32)) * U(slots - rank) >> U(32)).astype(np.int64)
        swaps.append(at)
        slot = at.copy()
        for t in range(rank - 1, -1, -1):  # what the earlier swaps have put there
            slot[slot == swaps[t]] = -1 - t
            slot = np.where(slot < 0, -1 - slot, slot)
        np.minimum.at(out, of * slots + slot, (U(rank) << U(48)) | r)
        open_sets = (out.reshape(n, slots) == ~U(0)).any(axis=1)
        more = open_sets[of]
        if not more.all():
            of, seeds = of[more], seeds[more]
            swaps = [s[more] for s in swaps]
    return out.reshape(n, slots)
