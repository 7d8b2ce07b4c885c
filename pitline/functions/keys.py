"""Composite order keys of fixed width."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LONG_DIGITS, MOST_DIGITS = 18, 38


def packed_key(parts: list[tuple[Column, int]]) -> Column:
    """One number that orders rows as the parts do one after another; a part is a whole number from 0 on and its width in decimal digits.

    Up to 18 digits in all it is a bigint, up to 38 a decimal. Both have a fixed width, so min_by and max_by over the key keep to hash aggregation,
    where a struct would make Spark sort all rows before it combines any. A null, negative or wider part is an error, never a wrong order.
    """
    digits = sum(width for _, width in parts)
    if not parts or min(width for _, width in parts) < 1 or digits > MOST_DIGITS:
        raise ValueError(f"a packed key has 1 to {MOST_DIGITS} digits, not {digits}")

    def checked(part: Column, width: int) -> Column:
        inside = F.coalesce((part >= 0) & (part < 10 ** min(width, LONG_DIGITS)), F.lit(False))
        wrong = F.raise_error(F.concat(F.lit(f"not a part of {width} digits: "), F.coalesce(part.cast("string"), F.lit("null"))))
        return F.when(inside, part.cast("bigint")).otherwise(wrong.cast("bigint"))

    words: list[tuple[Column, int]] = []  # parts joined as long as they fit a bigint
    for part, width in parts:
        value = checked(part, width)
        if words and words[-1][1] + width <= LONG_DIGITS:
            words[-1] = (words[-1][0] * F.lit(10**width) + value, words[-1][1] + width)
        else:
            words.append((value, width))
    key = words[0][0]
    if len(words) > 1:
        key = key.cast(f"decimal({MOST_DIGITS},0)")
        for word, width in words[1:]:
            key = (key * F.lit(10**width).cast(f"decimal({width + 1},0)") + word.cast(f"decimal({width},0)")).cast(f"decimal({MOST_DIGITS},0)")
    return key
