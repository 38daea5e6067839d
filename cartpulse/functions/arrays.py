"""Array expressions for the per-pair series (cycle gaps, month series).

Each helper returns a Spark SQL expression string over column names so that
the whole computation stays inside Catalyst as higher-order functions
(``transform``/``filter``/``aggregate``); nothing leaves the JVM.  ``col``
wraps one into a Column.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(expr: str) -> Column:
    return F.expr(expr)


def arr_mean(a: str) -> str:
    """Mean of a numeric array (NULL when empty)."""
    return f"try_divide(aggregate({a}, 0D, (acc, x) -> acc + x), size({a}))"




def arr_sum(a: str) -> str:
    return f"aggregate({a}, 0L, (acc, x) -> acc + x)"


# --- D2 outlier clipping -------------------------------------------------
# ``a`` is the array, ``m`` / ``s`` name columns already holding its mean and
# population std (computed once, referenced many times).

def _flat(a: str, s: str) -> str:
    return f"(size({a}) < 2 OR {s} = 0)"


def clip_strength(a: str, m: str, s: str) -> str:
    """First element of the penalty triple: std/mean (1.0 when mean <= 0);
    2 when there are fewer than two values or no spread."""
    return f"CASE WHEN {_flat(a, s)} THEN 2D WHEN {m} > 0 THEN {s} / {m} ELSE 1D END"


def clip_mean(a: str, m: str, s: str) -> str:
    return f"CASE WHEN {_flat(a, s)} THEN 0D ELSE {m} END"


def clip_std(a: str, m: str, s: str) -> str:
    return f"CASE WHEN {_flat(a, s)} THEN 0D ELSE {s} END"


def clip_values(a: str, m: str, s: str, threshold: float) -> str:
    """Values clipped to mean +- threshold * std_pop (unchanged without spread)."""
    t = repr(float(threshold))
    return (
        f"CASE WHEN {_flat(a, s)} THEN transform({a}, x -> CAST(x AS DOUBLE)) "
        f"ELSE transform({a}, x -> greatest(least(CAST(x AS DOUBLE), {m} + {t} * {s}), "
        f"{m} - {t} * {s})) END"
    )


# --- D3 weekly blocks ------------------------------------------------------

#: Blocks held by one long of a block mask.
MASK_BITS = 62


def mask_words(n_blocks: int) -> int:
    return -(-n_blocks // MASK_BITS)


def blocks_from_masks(masks: list[str], n_blocks: int) -> str:
    """Ascending block numbers whose bit is set; mask j holds blocks from j * MASK_BITS on."""
    parts = []
    for j, mask in enumerate(masks):
        top = min(MASK_BITS, n_blocks - j * MASK_BITS) - 1
        parts.append(f"transform(filter(sequence(0, {top}), b -> (shiftright({mask}, b) & 1L) = 1L), b -> b + {j * MASK_BITS})")
    return f"concat({', '.join(parts)})"


def last_n(a: str, n: int) -> str:
    """The last n elements (all when shorter)."""
    return f"slice({a}, greatest(size({a}) - {n - 1}, 1), {n})"


def successive_diffs(a: str, scale: int = 1) -> str:
    """a[i] - a[i-1] for i >= 1, times scale."""
    return f"transform(slice({a}, 2, size({a})), (x, i) -> (x - {a}[i]) * {scale})"


# --- D8-D11 month series ---------------------------------------------------

def positive_floor_mean(a: str) -> str:
    """floor of the mean of the strictly positive entries, 0 when none."""
    pos = f"filter({a}, x -> x > 0)"
    return (
        f"CASE WHEN size({pos}) = 0 THEN 0L "
        f"ELSE CAST(floor({arr_sum(pos)} / size({pos})) AS BIGINT) END"
    )


def discretize(a: str, thr: str) -> str:
    """Bit string: position i < n-1 is 1 iff a[i] > 0 and a[i] + a[i+1] >= thr;
    the last position is 1 iff a[n-1] >= thr."""
    return (
        f"array_join(transform({a}, (x, i) -> CASE WHEN i < size({a}) - 1 "
        f"THEN IF(x > 0 AND x + {a}[i + 1] >= {thr}, '1', '0') "
        f"ELSE IF(x >= {thr}, '1', '0') END), '')"
    )


def thin_runs(bits: str) -> str:
    """Left to right, a 1 right after a kept 1 becomes 0 (1111 -> 1010)."""
    return f"regexp_replace({bits}, '11', '10')"


def count_ones(bits: str) -> str:
    return f"(length({bits}) - length(replace({bits}, '1', '')))"


def zero_run_gaps(bits: str, min_peaks: int) -> str:
    """Lengths of the non-empty zero runs before, between and after the 1s;
    empty when there are fewer than min_peaks ones."""
    return (
        f"CASE WHEN {count_ones(bits)} >= {min_peaks} THEN "
        f"filter(transform(split({bits}, '1'), s -> CAST(length(s) AS BIGINT)), g -> g > 0) "
        f"ELSE CAST(array() AS ARRAY<BIGINT>) END"
    )


def join_longs(a: str) -> str:
    """Array of integers as 'a,b,c' (empty string for an empty array)."""
    return f"array_join(transform({a}, x -> CAST(x AS STRING)), ',')"


def join_doubles(a: str, digits: int = 6) -> str:
    return f"array_join(transform({a}, x -> format_string('%.{digits}f', round(x, {digits}))), ',')"
