"""Column-level helpers. Everything here is a built-in Spark expression."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F, types as T

TRUE_WORDS = ("1", "true", "yes")  # fixed values


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def norm(c: Column | str) -> Column:
    """Trimmed lower-case text; the comparison form of family names."""
    return F.lower(F.trim(col(c)))


def to_double(c: Column | str) -> Column:
    """Numeric coercion: text that is no number, NaN and infinities become null."""
    x = col(c).try_cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def finite(c: Column | str) -> Column:
    """True for a value that is neither null, NaN nor infinite."""
    x = col(c).cast("double")
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def null_if_not_finite(c: Column | str) -> Column:
    return F.when(finite(c), col(c).cast("double"))


def divide(a: Column | str, b: Column | str) -> Column:
    """a / b, null when b is zero or missing."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def canon_stem(c: Column | str) -> Column:
    """Canonical form of a recording name, applied in this fixed order."""
    s = F.lower(col(c))
    s = F.regexp_replace(s, "-", "_")
    s = F.regexp_replace(s, "__+", "_")
    s = F.btrim(s, F.lit("_"))
    return F.regexp_replace(s, "npig", "nping")


def is_attack(df: DataFrame, name: str) -> Column:
    """Attack flag of a label column whose type may be boolean, number or text."""
    dtype = df.schema[name].dataType
    c = F.col(name)
    if isinstance(dtype, T.BooleanType):
        return F.coalesce(c, F.lit(False))
    if isinstance(dtype, T.NumericType):
        return F.coalesce(null_if_not_finite(c) > 0, c == float("inf"), F.lit(False))
    text = norm(c)
    return F.coalesce(text.startswith("attack") | text.isin(*TRUE_WORDS), F.lit(False))


def seed_of(split_name: Column | str) -> Column:
    """Seed number inside a split name such as ``stratified_seed42``; null without one."""
    return F.regexp_extract(col(split_name), r"seed(\d+)", 1).try_cast("int")


def order_hash(key: Column | str, seed: Column | int) -> Column:
    """Seeded, engine-independent shuffle key."""
    s = F.lit(seed) if isinstance(seed, int) else seed
    return F.md5(F.concat_ws("|", col(key).cast("string"), s.cast("string")))


def hash_number(key: Column) -> Column:
    """First eight hex digits of md5 as a bigint."""
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint")


def clip_unit(c: Column | str, eps: float = 1e-6) -> Column:
    """Scores for fusion: not finite becomes one half, then kept inside [eps, 1-eps]."""
    x = F.when(finite(c), col(c).cast("double")).otherwise(0.5)
    return F.least(F.greatest(x, F.lit(eps)), F.lit(1.0 - eps))


def logit(c: Column | str, eps: float = 1e-6) -> Column:
    p = clip_unit(c, eps)
    return F.ln(p / (1.0 - p))


def metric_score(c: Column | str) -> Column:
    """Scores for ranking metrics: NaN and -inf become 0, +inf becomes 1, clipped to [0, 1]."""
    x = col(c).cast("double")
    x = F.when(x.isNull() | F.isnan(x), 0.0).otherwise(x)
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def sanitize_proba(p: Column | str, eps: float = 1e-15) -> Column:
    """Array of class scores to a probability vector.

    Bad entries become 0, negatives become 0, the row is normalised (an all-zero row
    becomes uniform); with eps > 0 it is clipped to [eps, 1-eps] and normalised again.
    """
    raw = F.transform(
        col(p),
        lambda v: F.when(finite(v), F.greatest(v.cast("double"), F.lit(0.0))).otherwise(0.0),
    )
    unit = _normalise(raw, uniform_if_zero=True)
    if eps <= 0:
        return F.transform(unit, lambda v: F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0)))
    clipped = F.transform(unit, lambda v: F.least(F.greatest(v, F.lit(eps)), F.lit(1.0 - eps)))
    return _normalise(clipped, uniform_if_zero=False)


def array_sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, v: acc + v)


def _normalise(a: Column, uniform_if_zero: bool) -> Column:
    # The one-element array binds the row sum to a name, so it is computed once per row.
    def body(total: Column) -> Column:
        scaled = F.transform(a, lambda v: F.try_divide(v, total))
        if not uniform_if_zero:
            return scaled
        flat = F.transform(a, lambda v: F.try_divide(F.lit(1.0), F.size(a).cast("double")))
        return F.when(total > 0, scaled).otherwise(flat)

    return F.transform(F.array(array_sum(a)), body)[0]


def argmax(a: Column) -> Column:
    """0-based position of the largest entry, the first one on ties."""
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def class_column_names(classes: list[str]) -> list[str]:
    """Column names ``p_<class>`` for probability outputs, safe and unique."""
    names: list[str] = []
    for j, label in enumerate(classes):
        stem = "p_" + (re.sub(r"[^0-9A-Za-z_]+", "_", str(label).strip()) or f"cls{j}")
        name, copy = stem, 2
        while name in names:
            name, copy = f"{stem}__{copy}", copy + 1
        names.append(name)
    return names
