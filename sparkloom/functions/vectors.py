"""Vector expressions over array columns, one vector a row; all-pairs work is in operators.knn."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column, b: Column) -> Column:
    """Null for a vector of length 0."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def rounded(x: Column | str, digits: int) -> Column:
    """As DuckDB's round(): the nearest whole number of the double times a power of ten, halves away from zero.

    Spark's round goes by a double's decimal text instead, so the two differ where the product ends in exactly a half.
    """
    x = (F.col(x) if isinstance(x, str) else x).cast("double")
    y = x * 10.0**digits
    near = F.rint(y)
    whole = F.when(F.abs(y - near) == 0.5, y + F.signum(y) * 0.5).otherwise(near)
    return F.when(F.abs(y) < float("inf"), whole / 10.0**digits).otherwise(x)


def truncate(x: Column, at: float = 0.15, to: float = 0.0) -> Column:
    return F.when(x < at, to).otherwise(x)


def normalised(v: Column, eps: float = 1e-12) -> Column:
    # the length is bound to a name, else it would be computed for each element
    return F.transform(F.array(norm(v) + eps), lambda n: F.transform(doubles(v), lambda x: x / n))[0]


def stretch(v: Column, scale: int) -> Column:
    """Every element `scale` times."""
    return F.flatten(F.transform(v, lambda x: F.array_repeat(x, scale)))


def pad(v: Column, to: Column) -> Column:
    return F.concat(doubles(v), F.array_repeat(F.lit(0.0), F.greatest(to - F.size(v), F.lit(0))))


def downsample(v: Column, keep: int, of: int) -> Column:
    """The first `keep` of every `of` elements, zeros added so that `of` divides the length."""
    if keep == of:
        return doubles(v)
    return F.filter(pad(v, (F.ceil(F.size(v) / of) * of).cast("int")), lambda x, i: i % of < keep)


def downsample_steps(v: Column, to: int) -> Column:
    """Every n-th element, n being how often `to` goes into the length; under twice `to`, the first `to`."""
    step = F.floor(F.size(v) / to)
    return F.when(F.size(v) >= 2 * to, F.filter(v, lambda x, i: i % step == 0)).otherwise(F.slice(v, 1, to))


def head_of_windows(v: Column, dim: int, windows: int) -> Column:
    """The first `dim` elements of each of `windows` windows of equal length."""
    width = F.floor(F.size(v) / windows)
    return F.filter(v, lambda x, i: (i < width * windows) & (i % width < dim))


def stretch_shift_add(rows: Column, scale: int, offset: int = 0) -> Column:
    """Rows (equal lengths) with zeros between elements, each rolled on by its share of the scale, and added."""
    n = F.size(rows)
    size = F.size(rows[0]) * scale

    def place(k: Column) -> Column:
        # what a row gives to place k: its element (k - shift) / scale where that is whole
        def of(row: Column, i: Column) -> Column:
            at = F.pmod(k - F.floor(i * scale / n) - offset, size)
            return F.when(at % scale == 0, F.get(doubles(row), (at / scale).cast("int"))).otherwise(0.0)

        return total(F.transform(rows, of))

    return F.when(n > 0, F.transform(F.sequence(F.lit(0), (size - 1).cast("int")), place))


def weighted_sum(*pairs: tuple[Column, float]) -> Column:
    """Sum of w * v over the vectors that aren't null."""
    out = None
    scaled = lambda v, w: F.transform(doubles(v), lambda x: x * w)
    for v, w in pairs:
        own = scaled(v, w)
        out = own if out is None else F.when(out.isNull(), own).when(own.isNull(), out).otherwise(F.zip_with(out, own, lambda x, y: x + y))
    return out


def bits_text(v: Column) -> Column:
    """A vector's signs as a string of 0 and 1."""
    return F.array_join(F.transform(v, lambda x: F.when(x > 0, "1").otherwise("0")), "")


def bits_hex(bits: Column, size: int) -> Column:
    """Big-endian hexadecimal digits of `size` bits, zeros added at the end up to whole bytes."""
    whole = -(-size // 8) * 8
    padded = F.rpad(bits, whole, "0")
    parts = [F.lower(F.lpad(F.conv(F.substring(padded, i + 1, min(32, whole - i)), 2, 16), min(32, whole - i) // 4, "0")) for i in range(0, whole, 32)]
    return F.concat(*parts)


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two hexadecimal codes of equal length, 15 digits at a time."""
    chunk = lambda c, i: F.conv(F.substring(c, i * 15 + 1, 15), 16, 10).cast("long")
    places = F.sequence(F.lit(0), F.floor((F.length(a) - 1) / 15).cast("int"))
    return F.aggregate(places, F.lit(0), lambda s, i: s + F.bit_count(chunk(a, i).bitwiseXOR(chunk(b, i)))).cast("long")


def hash_similarity(a: Column, b: Column, bits: int) -> Column:
    return 1 - 2 * hamming(a, b) / bits


def replace_at(items: Column, places: Column, lists: Column) -> Column:
    """The list with the elements at `places` (0-based) replaced by the lists of the same rank."""

    def at(x: Column, i: Column) -> Column:
        k = F.array_position(places, i)
        return F.when(k > 0, F.get(lists, (k - 1).cast("int"))).otherwise(F.array(x))

    return F.flatten(F.transform(items, at))


def calibrated(x: Column, slope: Column, intercept: Column) -> Column:
    return slope * x + intercept
