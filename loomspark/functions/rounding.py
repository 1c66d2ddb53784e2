"""Rounding of the exact value of a binary double, half to even: what `round` of Python gives, bit for bit."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .staging import let

_HALF_BITS, _BITS = 1 << 27, 1 << 53


def round_exact(x: Column, places: int) -> Column:
    """x rounded to 0 to 4 places.

    round(2.675, 2) is 2.67, for the double lies below 2.675; functions that go by its shortest decimal
    give 2.68. The fraction is cut in two integers of 26 and 27 bits and a rest, the products with the
    power of ten are taken in longs, and the remainder is held against one half exactly.
    Null, NaN and infinite values stay, and so does the sign of zero.
    """
    if not 0 <= places <= 4:
        raise ValueError("places must be 0 to 4")
    ten = 10**places
    x = x.cast("double")
    long = lambda c: F.floor(c).cast("long")

    def of_size(a: Column) -> Column:
        whole = long(a)
        f = a - whole.cast("double")
        high = long(f * (1 << 26))
        low = f * (1 << 26) - high.cast("double")  # exact, below 1
        middle = long(low * _HALF_BITS)
        rest = low * _HALF_BITS - middle.cast("double")
        product = high * ten
        left = product.bitwiseAND(F.lit((1 << 26) - 1)) * _HALF_BITS + middle * ten
        q = F.shiftright(product, 26) + F.shiftright(left, 53)
        over = (left.bitwiseAND(F.lit(_BITS - 1)) - (_BITS >> 1)).cast("double") + rest * float(ten)  # its sign is exact
        odd = (whole.bitwiseAND(F.lit(1)) if places == 0 else F.lit(0)) + q
        up = (over > 0) | ((over == 0) & (odd % 2 == 1))
        return F.struct(whole.alias("i"), (q + up.cast("long")).alias("q"))

    def value(r: Column) -> Column:
        i, q = r["i"] + F.when(r["q"] >= ten, 1).otherwise(0), r["q"] % ten
        if not places:
            return i.cast("double")
        exact = i < (_BITS // ten - 1)
        shown = F.concat(i.cast("string"), F.lit("."), F.lpad(q.cast("string"), places, "0"))
        return F.when(exact, (i * ten + q).cast("double") / float(ten)).otherwise(shown.cast("double"))

    size = F.abs(x)
    return F.when(x.isNull() | F.isnan(x) | (size >= float(1 << 52)) | (x == 0), x).otherwise(let(let(size, of_size), value) * F.when(x < 0, -1.0).otherwise(1.0))
