"""Column expressions: vectors, identifiers, prices and item text. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Units of euro per unit of local currency by market; other markets count 1.
EURO_RATES = {
    "gr": 1.0, "sk": 1.0, "si": 1.0, "hr": 1.0, "lt": 1.0, "lv": 1.0, "it": 1.0, "ee": 1.0,
    "bg": 0.51, "cz": 0.04, "ro": 0.20, "pl": 0.23, "hu": 0.0025,
}


def dot(a: Column, b: Column) -> Column:
    """Inner product of two numeric arrays, summed from left to right in doubles."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def as_doubles(a: Column) -> Column:
    return a.cast("array<double>")


def l2_normalize(a: Column) -> Column:
    """a over its length; a zero vector stays as it is."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x / n)).otherwise(a)


def array_mean(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)


def array_std(a: Column) -> Column:
    """Population standard deviation, by deviations from the mean."""
    m = array_mean(a)
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + (x - m) * (x - m)) / F.size(a))


def abs_difference(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.abs(x - y))


def masked_mean(vectors: Column, mask: Column, dim: int) -> Column:
    """Mean of the vectors whose mask is not 0; zeros if there are none."""
    kept = F.filter(F.arrays_zip(vectors.alias("v"), mask.alias("m")), lambda z: z["m"] != 0)
    zero = F.array_repeat(F.lit(0.0), dim)
    total = F.aggregate(kept, zero, lambda s, z: F.zip_with(s, z["v"], lambda x, y: x + y))
    n = F.greatest(F.size(kept), F.lit(1))
    return F.transform(total, lambda x: x / n)


def numbers(c: Column) -> Column:
    """All runs of digits in a dirty id cell, as strings."""
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"\d+"), F.lit(0))


def first_number(c: Column) -> Column:
    """The first run of digits in a cell, null without one."""
    return F.nullif(F.regexp_extract(F.coalesce(c, F.lit("")), r"\d+", 0), F.lit(""))


def euro_rate(market: Column) -> Column:
    rates = F.create_map(*[F.lit(x) for pair in EURO_RATES.items() for x in pair])
    return F.coalesce(F.element_at(rates, F.lower(market)), F.lit(1.0))


def to_euro(price: Column, market: Column) -> Column:
    """Price in euro; an unknown or missing market counts 1, a null price stays null."""
    return price * euro_rate(market)


def item_text(title: Column, description: Column, limit: int | None = None) -> Column:
    """Title and description in one trimmed string; the description may be cut for short-input scorers."""
    d = F.coalesce(description, F.lit(""))
    return F.trim(F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.substring(d, 1, limit) if limit else d))


def query_prefix(text: Column) -> Column:
    return F.concat(F.lit("query: "), text)


def match(a: Column, b: Column) -> Column:
    """1 where two codes are equal and known (not 0), else 0."""
    return ((a == b) & (a != 0)).cast("double")


def compatible(a: Column, b: Column) -> Column:
    """Whether two codes agree or either is unknown (0)."""
    return (a == b) | (a == 0) | (b == 0)


def in_hash_order(*keys: Column | str, seed: str = "42") -> Column:
    """A reproducible shuffle key: md5 of the seed and the keys."""
    cols = [F.col(k) if isinstance(k, str) else k for k in keys]
    return F.md5(F.concat_ws(":", F.lit(seed), *[c.cast("string") for c in cols]).cast("binary"))
