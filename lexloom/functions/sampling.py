"""Reproducible draws: every number depends on a key of the row and never on the order of rows."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column
from pyspark.sql import functions as F


def u01(seed: int, key: Column, salt: str) -> Column:
    """A uniform number in [0, 1) from seed, key and salt."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), key.cast("string"), F.lit(salt)))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def u01_sql(seed: int, key: str, salt: str) -> str:
    """:func:`u01` for an SQL oracle."""
    return f"(('0x' || substr(md5('{seed}|' || ({key})::VARCHAR || '|{salt}'), 1, 8))::BIGINT / 4294967296.0)"


def _steps(weights: list[float]) -> list[float]:
    total = sum(weights)
    return [round(x / total, 9) for x in accumulate(weights)]


def weighted(values: list[str], weights: list[float], u: Column) -> Column:
    """The value in whose share of the cumulative weights ``u`` falls."""
    out = F.lit(values[-1])
    for value, upto in reversed(list(zip(values, _steps(weights)))[:-1]):
        out = F.when(u < upto, F.lit(value)).otherwise(out)
    return out


def weighted_sql(values: list[str], weights: list[float], u: str) -> str:
    """:func:`weighted` for an SQL oracle."""
    quote = lambda v: "'" + v.replace("'", "''") + "'"
    cases = " ".join(f"WHEN {u} < {upto} THEN {quote(v)}" for v, upto in list(zip(values, _steps(weights)))[:-1])
    return f"CASE {cases} ELSE {quote(values[-1])} END"


def pick(values: list[str], u: Column) -> Column:
    """One of equally likely values."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.floor(u * len(values)) + 1).cast("int"))


def pick_sql(values: list[str], u: str) -> str:
    """:func:`pick` for an SQL oracle."""
    return "[" + ", ".join(f"'{v}'" for v in values) + f"][(floor({u} * {len(values)}) + 1)::INT]"


def even_stride(lo: Column, hi: Column, k: int) -> Column:
    """``k`` evenly spaced numbers of [lo, hi), or all of them if there are no more than ``k``; none if it is empty."""
    n = hi - lo
    few = F.when(n > 0, F.sequence(lo, hi - 1)).otherwise(F.array().cast("array<bigint>"))
    return F.when(n <= k, few).otherwise(F.transform(F.sequence(F.lit(0).cast("bigint"), F.lit(k - 1).cast("bigint")), lambda i: lo + F.floor(i * n / k)))


def plain_stride(n: Column, k: int) -> Column:
    """The first ``k`` of every n-th number below ``n``, where the step is n / k rounded down and at least 1; none if ``n`` is 0."""
    step = F.greatest(F.floor(n / k), F.lit(1)).cast("bigint")
    last = F.least(F.lit(k).cast("bigint"), F.ceil(n / step).cast("bigint")) - 1
    return F.when(n > 0, F.transform(F.sequence(F.lit(0).cast("bigint"), last), lambda i: i * step)).otherwise(F.array().cast("array<bigint>"))
