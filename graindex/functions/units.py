"""Measurements and colours as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: RGB of beer colour by whole degree SRM, 1 to 40, for the usual swatch chart.
SRM_RGB = [
    (255, 230, 153), (255, 216, 120), (255, 202, 90), (255, 191, 66), (251, 177, 35), (248, 166, 0), (243, 156, 0), (234, 143, 0),
    (229, 133, 0), (222, 124, 0), (215, 114, 0), (207, 105, 0), (203, 98, 0), (195, 89, 0), (187, 81, 0), (181, 76, 0),
    (176, 69, 0), (166, 62, 0), (161, 55, 0), (155, 50, 0), (149, 45, 0), (142, 41, 0), (136, 35, 0), (130, 30, 0),
    (123, 26, 0), (119, 25, 0), (112, 20, 0), (106, 14, 0), (102, 13, 0), (94, 11, 0), (90, 10, 2), (86, 10, 5),
    (82, 9, 7), (76, 5, 5), (71, 6, 6), (68, 6, 7), (63, 7, 8), (59, 6, 7), (58, 7, 11), (54, 8, 10),
]


def gravity(value: Column) -> Column:
    """A specific gravity: 1056 is 1.056, and what is above 2 after that is none."""
    scaled = F.when(value > 100, value / 1000).otherwise(value)
    return F.when(scaled <= 2, scaled)


def attenuation(og: Column, fg: Column) -> Column:
    return F.when(og > 1, (og - fg) / (og - 1) * 100)


def alcohol(og: Column, fg: Column) -> Column:
    return (og - fg) * 131.25


def srm_from_ebc(ebc: Column) -> Column:
    return ebc / 1.97


def srm_from_lovibond(lovibond: Column) -> Column:
    return lovibond * 1.3546 - 0.76


def celsius(fahrenheit: Column) -> Column:
    return (fahrenheit - 32) * 5 / 9


def plausible(value: Column, low: float, high: float) -> Column:
    """The value where it is in the closed interval, else null."""
    return F.when(value.between(low, high), value)


def colour_hex(srm: Column) -> Column:
    """A colour like #ffca5a for a degree SRM: clamped to the table, and linear between its entries."""
    at = F.least(F.greatest(srm, F.lit(1.0)), F.lit(float(len(SRM_RGB))))
    low = F.floor(at).cast("int")
    high = F.least(low + 1, F.lit(len(SRM_RGB)))
    def channel(i: int) -> Column:
        table = F.array(*[F.lit(rgb[i]) for rgb in SRM_RGB])
        a, b = F.element_at(table, low), F.element_at(table, high)
        return F.lpad(F.lower(F.hex(F.floor(a + (b - a) * (at - low) + 0.5).cast("long"))), 2, "0")

    return F.when(srm.isNotNull(), F.concat(F.lit("#"), *[channel(i) for i in range(3)]))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where a norm is 0."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def jaccard(a: Column, b: Column) -> Column:
    """0 where both sets are empty."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(F.array_distinct(a)) + F.size(F.array_distinct(b)) - both
    return F.when(either > 0, both / either).otherwise(0.0)


def gravity_range(low: Column, high: Column) -> Column:
    """A range of gravities, each in points if above 2 (1060 is 1.060); null unless both are there."""
    scaled = lambda x: F.when(x > 2, x / 1000).otherwise(x)
    return F.when(low.isNotNull() & high.isNotNull(), F.struct(scaled(low).alias("lo"), scaled(high).alias("hi")))


def blended_colour(share: Column, first: tuple[int, int, int], second: tuple[int, int, int], power: float = 1.0) -> Column:
    """A colour like #f2d98c between two, by a share that is clamped to 0 to 1 and raised to ``power``."""
    t = F.pow(F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)), F.lit(power))
    part = lambda a, b: F.lpad(F.lower(F.hex(F.floor(F.lit(float(a)) + (b - a) * t + 0.5).cast("long"))), 2, "0")
    return F.when(share.isNotNull(), F.concat(F.lit("#"), *[part(a, b) for a, b in zip(first, second, strict=True)]))


#: Ends of the ramp of strength, and of the ramp of similarity with its power.
STRENGTH_RAMP = ((0xF2, 0xD9, 0x8C), (0x8A, 0x2B, 0x06))
SIMILARITY_RAMP = ((26, 26, 25), (57, 135, 229), 1.35)


def strength_colour(abv: Column, low: Column, high: Column) -> Column:
    return blended_colour((abv - low) / F.greatest(F.lit(1e-6), high - low), *STRENGTH_RAMP)


def similarity_colour(score: Column) -> Column:
    return blended_colour(score, *SIMILARITY_RAMP)


def difference(a: Column, b: Column, digits: int = 1) -> Column:
    """How the second differs from the first: '+1.2', '-0.3', '=' under 0.05, and '—' where either is unknown."""
    d = b - a
    sign = F.when(d > 0, "+").otherwise("-")
    return F.when(d.isNull(), "—").when(F.abs(d) < 0.05, "=").otherwise(F.concat(sign, F.format_string(f"%.{digits}f", F.abs(d))))


def range_text(box: Column, digits: int = 0, unit: str = "", short: bool = False) -> Column:
    """'4–6', or '4' where both ends are equal, and '—' for none; ``short`` leaves out a last .0."""
    one = lambda x: F.regexp_replace(F.format_string(f"%.{digits}f", x), r"\.0$" if short else r"$^", "")
    both = F.when(box["lo"] == box["hi"], one(box["lo"])).otherwise(F.concat(one(box["lo"]), F.lit("–"), one(box["hi"])))
    return F.when(box.isNull(), "—").otherwise(F.concat(both, F.lit(unit)))
