"""Column expressions used inside the table jobs; all stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from fleetlens import catalog as cat


def nearest_of(candidates: Sequence[float], x: Column) -> Column:
    """Candidate with the smallest distance to x; the smaller candidate on ties."""
    options = [F.struct(F.abs(F.lit(float(c)) - x).alias("distance"), F.lit(float(c)).alias("candidate")) for c in candidates]
    return F.least(*options)["candidate"]


def first_passing(candidates: Sequence[float], passes: Callable[[float], Column]) -> Column:
    """First candidate that passes, NULL if none does."""
    return F.coalesce(*[F.when(passes(c), F.lit(float(c))) for c in candidates])


def divisors(n: Column) -> Column:
    """Sorted divisors of a small positive integer."""
    return F.filter(F.sequence(F.lit(1), n.cast("int")), lambda d: n % d == 0)


def clip(x: Column, low: Column, high: Column) -> Column:
    """Bound x; where low exceeds high the result is high."""
    return F.least(F.greatest(x, low), high)


def duration_seconds(amount: Column, unit: Column) -> Column:
    """Duration in whole seconds; NULL for an unknown unit."""
    factor = None
    for name, seconds in cat.DURATION_UNITS.items():
        branch = unit == name
        factor = F.when(branch, F.lit(seconds)) if factor is None else factor.when(branch, F.lit(seconds))
    return (amount * factor).cast("long")


def epoch_to_seconds(ts: Column) -> Column:
    """Epoch in seconds or milliseconds, told apart by 2^32, as seconds."""
    return F.when(ts >= F.lit(1 << 32), F.floor(ts / 1000)).otherwise(ts).cast("long")


def local_text_to_epoch(text: Column, zone: str) -> Column:
    """'yyyy-MM-dd HH:mm:ss' in a named zone as UTC epoch seconds."""
    return F.unix_timestamp(F.to_utc_timestamp(F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss")), zone))


def epoch_to_text(ts: Column) -> Column:
    return F.date_format(F.timestamp_seconds(ts), "yyyy-MM-dd HH:mm:ss")


def success_percent(success: Column, total: Column) -> Column:
    return F.when(total.isNull() | (total == 0), F.lit(0.0)).otherwise(F.round(ratio(success, total) * 100, 3))


def ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient, NULL where the denominator is zero."""
    return F.try_divide(numerator, denominator)


def display_value(value: Column, unit: Column, adaptive_size: Column | None = None) -> Column:
    """Scale a value for display by its unit, three decimals."""
    megabytes = F.lit(float(1024**2)) if adaptive_size is None else adaptive_size
    factor = (
        F.when(unit == "s", F.lit(1000.0))
        .when(unit == "GB", F.lit(float(cat.GIB)))
        .when(unit == "MB/s", megabytes)
        .when(unit == "MHz", F.lit(1e6))
        .otherwise(F.lit(1.0))
    )
    return F.round(value / factor, 3)


def throughput_unit_index(average: Column) -> Column:
    """Unit step (B/s, KB/s, ... TB/s) for an average; never below the first."""
    return F.when(average >= 1, F.least(F.floor(F.log10(average) / 3), F.lit(4))).otherwise(F.lit(0)).cast("int")


# Rate units by step.
RATE_UNITS = ["B/s", "KB/s", "MB/s", "GB/s", "TB/s"]


def _unit_key(unit: Column) -> Column:
    # Drop a trailing plural and the word or letter for byte: 'Gigabytes', 'GB', 'GiB' -> giga, g, gi.
    return F.regexp_replace(F.lower(unit), r"(byte|b)?s?$", "")


def unit_multiplier(unit: Column, binary: bool = True) -> Column:
    """Bytes per unit as DECIMAL(28,0); NULL for an unknown unit."""
    pairs: list[Column] = []
    for power, (symbol, name, bin_symbol, bin_name) in enumerate(cat.SIZE_UNITS, start=1):
        plain = (1024 if binary else 1000) ** power
        for key, value in ((symbol, plain), (name, plain), (bin_symbol, 1024**power), (bin_name, 1024**power)):
            if key != "B":
                pairs += [F.lit(key.lower()), F.lit(str(value)).cast("decimal(28,0)")]
    lookup = F.create_map(*pairs)
    return F.when(
        F.lower(unit).startswith("b") | (F.trim(unit) == ""), F.lit("1").cast("decimal(28,0)")
    ).otherwise(lookup[_unit_key(F.trim(unit))])


def parse_size(text: Column, binary: bool = True) -> Column:
    """Size text such as '24 GB', '1.5Ki' or '80gibibytes' as bytes, DECIMAL(38,0); NULL if unreadable."""
    pattern = r"^\s*(\d+(?:\.\d+)?)\s*([A-Za-z]*)\s*$"
    number = F.regexp_extract(text, pattern, 1)
    factor = unit_multiplier(F.regexp_extract(text, pattern, 2), binary)
    whole = F.try_multiply(number.try_cast("decimal(20,0)"), factor)
    fraction = F.floor(number.try_cast("double") * factor.cast("double"))
    return F.when(
        F.regexp_like(text, F.lit(pattern)),
        F.when(number.contains("."), fraction.try_cast("decimal(38,0)")).otherwise(whole.try_cast("decimal(38,0)")),
    )


def format_size(size: Column, binary: bool = True, suffix: str = "B") -> Column:
    """Bytes as text in the largest unit not above the value, at most two decimals."""
    base = 1024 if binary else 1000
    out = None
    for power in range(len(cat.SIZE_UNITS), 0, -1):
        symbol = cat.SIZE_UNITS[power - 1][2 if binary else 0]
        factor = float(base**power)
        scaled = F.format_string("%.2f", F.bround(size.cast("double") / factor, 2))
        text = F.concat(F.regexp_replace(scaled, r"\.?0+$", ""), F.lit(symbol + suffix))
        branch = size.cast("double") >= factor
        out = F.when(branch, text) if out is None else out.when(branch, text)
    return out.otherwise(F.concat(size.cast("string"), F.lit(suffix)))


def parameter_count(
    model_type: Column, vocab: Column, hidden: Column, num_hidden_layers: Column, num_layers: Column
) -> Column:
    """Transformer parameter count; one model family names its depth differently."""
    depth = F.when(model_type == "chatglm", num_layers).otherwise(num_hidden_layers).cast("long")
    width = hidden.cast("long")
    attention = depth * (4 * width * width + 4 * width)
    feed_forward = depth * (8 * width * width + 5 * width)
    norms = 4 * depth * width
    return vocab.cast("long") * width + attention + feed_forward + norms
