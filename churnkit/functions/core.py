"""Scalar helpers shared by every operator.

They encode the null and alignment rules of the original analysis:

* ``safe_div`` - NULL or 0 denominator gives 0 (never raises under ANSI).
* ``floor_days`` - whole days as ``timedelta.days`` (floors, so one hour in
  the future is ``-1``), computed on exact integer microseconds.
* ``frac_days`` - fractional days.
* ``nullif_zero`` - counts built by filter-then-group are NULL, not 0,
  when nothing matches.
* ``map_lookup`` - literal map lookups for small fixed dictionaries (JVM
  side, no join).
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

US_PER_DAY = 86_400_000_000
US_PER_HOUR = 3_600_000_000


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def micros(ts) -> Column:
    """Epoch microseconds of a timestamp (timestamp_ntz is read as UTC)."""
    return F.unix_micros(col_(ts).cast("timestamp"))


def floor_div(a: Column, b: int) -> Column:
    """Exact floor division of a long by a positive constant."""
    return ((a - F.pmod(a, F.lit(b))) / F.lit(b)).cast("long")


def floor_days(later, earlier) -> Column:
    """pandas ``(later - earlier).dt.days``: floored whole days."""
    return floor_div(micros(later) - micros(earlier), US_PER_DAY)


def frac_days(later, earlier) -> Column:
    return (micros(later) - micros(earlier)) / F.lit(float(US_PER_DAY))


def safe_div(a, b) -> Column:
    """a / b with NULL or zero denominator -> 0 (and NULL numerator -> 0)."""
    return F.coalesce(F.try_divide(col_(a), F.nullif(col_(b), F.lit(0))), F.lit(0.0))


def nullif_zero(c) -> Column:
    return F.nullif(col_(c), F.lit(0))


def cnt(cond: Column) -> Column:
    """Conditional count (NULL condition counts as false)."""
    return F.count_if(F.coalesce(cond, F.lit(False)))


def _money(c) -> Column:
    return col_(c).try_cast("decimal(28,6)")


def money_sum(c) -> Column:
    """Sum of money or credits to a millionth.  Added up as decimals, so the order in which rows and partial sums meet
    does not matter; NULL, NaN and infinite values count as missing."""
    return F.sum(_money(c)).cast("double")


def money_avg(c) -> Column:
    return F.try_divide(money_sum(c), F.count(_money(c)))


def flag(cond: Column) -> Column:
    """Boolean -> 0/1 int with NULL -> 0 (``.astype(int)`` on a comparison)."""
    return F.coalesce(cond, F.lit(False)).cast("int")


def map_lookup(mapping: dict, key: Column) -> Column:
    """Literal map lookup; absent key -> NULL."""
    m = F.create_map(*[F.lit(x) for x in chain.from_iterable(mapping.items())])
    return F.element_at(m, key) if mapping else F.lit(None)


def norm_lower(c) -> Column:
    """``astype(str).str.lower().str.strip()`` - NULL stays NULL here."""
    return F.lower(F.trim(col_(c)))


def encode_top_n(c, top_values, fill_na: str = "unknown") -> Column:
    """NULL -> fill_na; lower/trim; not in list -> 'other'."""
    v = F.lower(F.trim(F.coalesce(col_(c), F.lit(fill_na))))
    allowed = [t.lower() for t in top_values] + [fill_na]
    return F.when(v.isin(allowed), v).otherwise(F.lit("other"))


def round_doubles(df, scale: int = 6):
    """Round every double column (report projection used by registered queries)."""
    out = []
    for f in df.schema.fields:
        if f.dataType.typeName() in ("double", "float"):
            out.append(F.round(F.col(f.name), scale).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


def clip_lower(x, lo) -> Column:
    """``Series.clip(lower=lo)``: NULL stays NULL (``greatest`` would skip it)."""
    x = col_(x)
    return F.when(x.isNotNull(), F.greatest(x, F.lit(lo) if not isinstance(lo, Column) else lo))
