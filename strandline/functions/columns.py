"""Column expressions shared by the operators: time grid, safe arithmetic, ranks, quantiles, normal distribution."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def bucket(time: str | Column, width: str) -> Column:
    """Start of the epoch-aligned bucket; widths must divide a day or be whole days (UTC)."""
    return F.window(time, width)["start"]


def bucket_seconds(time: str | Column, minutes: int) -> Column:
    """The same start as epoch seconds; usable several times in one projection, which ``window`` isn't."""
    return F.floor(F.unix_timestamp(time) / (minutes * 60)) * (minutes * 60)


def parse_interval_ms(interval: str | Column) -> Column:
    """``5m 1h 1d 1w 1M`` (30 days) in milliseconds; null for anything else."""
    c = F.col(interval) if isinstance(interval, str) else interval
    n = F.regexp_extract(c, r"^(\d+)[mhdwM]$", 1)
    unit = F.regexp_extract(c, r"^\d+([mhdwM])$", 1)
    factor = F.create_map(*[F.lit(x) for kv in {"m": 60_000, "h": 3_600_000, "d": 86_400_000, "w": 604_800_000, "M": 2_592_000_000}.items() for x in kv])
    return F.when(n != "", n.cast("long") * F.try_element_at(factor, unit).cast("long"))


def align_down(time: str | Column, ms: int | Column) -> Column:
    """The time floored to a multiple of ``ms`` since the epoch."""
    step = F.lit(ms) if isinstance(ms, int) else ms
    return F.timestamp_millis((F.floor(F.unix_millis(time) / step) * step).cast("long"))


def safe_divide(a: Column, b: Column, otherwise=None) -> Column:
    out = F.when(b != 0, a / b)
    return out if otherwise is None else F.coalesce(out, F.lit(otherwise))


def clamp(x: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), x))


def lag_seconds(time: str, as_of: Column) -> Column:
    """Seconds from ``time`` to ``as_of``, floored at 0; null for null."""
    return F.when(F.col(time).isNotNull(), F.greatest(F.unix_timestamp(as_of) - F.unix_timestamp(time), F.lit(0)))


def centred_rank(value: str, by: list[str], tie: str, digits: int | None = None) -> Column:
    """``2 (rank - 1) / max(n - 1, 1) - 1`` among the rows of ``by``; ties by ``tie``.

    With ``digits``, values that are equal when rounded so are ties; the values themselves stay as they are.
    """
    order = F.col(value) if digits is None else F.round(value, digits)
    position = F.row_number().over(Window.partitionBy(*by).orderBy(order, tie)) - 1
    return position / F.greatest(F.count("*").over(Window.partitionBy(*by)) - 1, F.lit(1)) * 2.0 - 1.0


def floor_quantile(values: Column, p: float) -> Column:
    """The value at index ``floor((n - 1) p)`` of the sorted array; no interpolation."""
    return F.element_at(F.array_sort(values), (F.floor((F.size(values) - 1) * F.lit(p)) + 1).cast("int"))


def frame(by: list[str], order: str, back: int, to: int = 0) -> WindowSpec:
    return Window.partitionBy(*by).orderBy(order).rowsBetween(-back, to)


def squash(x: Column, scale: float = 1.0) -> Column:
    y = x / max(scale, 1e-9)
    return y / F.sqrt(1.0 + y * y)


def logistic(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def normal_cdf(x: Column) -> Column:
    """Error-function polynomial of Abramowitz and Stegun 7.1.26 (fixed constants)."""
    z = F.abs(x) / F.lit(2.0) ** 0.5
    t = 1.0 / (1.0 + 0.3275911 * z)
    poly = ((((1.061405429 * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t
    erf = 1.0 - poly * F.exp(-z * z)
    return 0.5 * (1.0 + F.when(x < 0, -erf).otherwise(erf))


#: Acklam's rational approximation of the inverse normal distribution (fixed constants).
_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01)
_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)


def _horner(coefficients, x: Column) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + c
    return out


def inverse_normal_cdf(p: Column) -> Column:
    low = F.sqrt(-2.0 * F.ln(p))
    high = F.sqrt(-2.0 * F.ln(1.0 - p))
    q = p - 0.5
    tail = lambda r: _horner(_C, r) / _horner((*_D, 1.0), r)
    return F.when(p < 0.02425, tail(low)).when(p > 1 - 0.02425, -tail(high)).otherwise(_horner(_A, q * q) * q / _horner((*_B, 1.0), q * q))


def bars_for_hours(hours: Column, bar_minutes: int) -> Column:
    """the bars that ``hours`` take, one at least."""
    return F.greatest(F.lit(1).cast("long"), F.ceil(hours * 60.0 / bar_minutes))
