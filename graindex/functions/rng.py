"""The 32-bit generator mulberry32: its n-th number depends on the seed and n alone, so it is a column expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the generator: the step of its state, and the shifts and the constant of its mixing.
STEP, SHIFTS, ODD = 0x6D2B79F5, (15, 7, 14), 61
_MASK = 0xFFFFFFFF


def random_number(seed: Column | int, n: Column) -> Column:
    """The n-th number (from 1) of a seed, at least 0 and under 1; null if either is null."""
    low = lambda x: x.bitwiseAND(F.lit(_MASK))

    def times(x: Column, y: Column) -> Column:
        """The low 32 bits of a product, by halves, as whole products don't fit into 64 bits."""
        return low(x * y.bitwiseAND(F.lit(0xFFFF)) + F.shiftleft((x * F.shiftright(y, 16)).bitwiseAND(F.lit(0xFFFF)), 16))

    start = low((F.lit(seed) if isinstance(seed, int) else seed).cast("long"))
    a = low(start + times(low(n.cast("long")), F.lit(STEP)))
    t = times(a.bitwiseXOR(F.shiftright(a, SHIFTS[0])), a.bitwiseOR(F.lit(1)))
    t = low(t + times(t.bitwiseXOR(F.shiftright(t, SHIFTS[1])), t.bitwiseOR(F.lit(ODD)))).bitwiseXOR(t)
    return t.bitwiseXOR(F.shiftright(t, SHIFTS[2])) / F.lit(float(1 << 32))


class Mulberry:
    """The same numbers one after another, for the few draws of a driver."""

    def __init__(self, seed: int):
        self.state = seed & _MASK

    def __call__(self) -> float:
        self.state = a = (self.state + STEP) & _MASK
        t = (a ^ a >> SHIFTS[0]) * (a | 1) & _MASK
        t ^= (t + ((t ^ t >> SHIFTS[1]) * (t | ODD) & _MASK)) & _MASK
        return (t ^ t >> SHIFTS[2]) / (1 << 32)
