"""Scoring rules: constants stand beside the expression they belong to."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the anomaly predicate.
DROP_RATIO, ERROR_DELTA, ERROR_TIMES, LOCK_MIN = 0.75, 0.015, 4.0, 5.0
RATE_DELTA, RATE_TIMES, GENERIC_TIMES = 100.0, 3.0, 3.0
SAW_PEAK, SAW_TROUGH = 1.8, 0.4


def unit(c: Column) -> Column:
    """Clamped to [0, 1]."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def weighted(*parts: tuple[Column, float]) -> Column:
    """Weighted mean, clamped; 0 without weight."""
    total = sum(w for _, w in parts)
    return unit(sum((c * w for c, w in parts), F.lit(0.0)) / total) if total > 0 else F.lit(0.0)


def is_drop(name: Column) -> Column:
    return name == "cache.hit_ratio"


def is_anomalous(name: Column, baseline: Column, value: Column, sawtooth: Column) -> Column:
    """Whether a point departs from its series' baseline; the rule follows from the metric's name."""
    return (
        F.when(is_drop(name), value <= baseline * DROP_RATIO)
        .when(name.endswith("error_rate"), (value >= baseline + ERROR_DELTA) & (value >= baseline * ERROR_TIMES))
        .when(name == "db.locks.waiting", value >= LOCK_MIN)
        .when(name == "pod.restarts.count", value > baseline)
        .when(name == "memory.rss_bytes", sawtooth)
        .when(name.isin("request.rate_rps", "client.retry.rate_rps"), (value >= baseline + RATE_DELTA) & (value >= baseline * RATE_TIMES))
        .when(baseline == 0, value > 0)
        .otherwise(value >= baseline * GENERIC_TIMES)
    )


def magnitude(baseline: Column, peak: Column, trough: Column, note: Column) -> Column:
    """m / (m + 1) of the largest relative departure; without a baseline a fixed value."""
    size = F.abs(baseline)
    up = F.abs(peak - baseline) / F.greatest(size, F.lit(0.01))
    down = F.when(size <= 1, F.abs(baseline - trough) / F.greatest(size, F.lit(0.01)) * 1.5).otherwise(F.abs(baseline - trough) / F.greatest(size, F.lit(1.0)))
    m = F.greatest(F.coalesce(up, F.lit(0.0)), F.coalesce(down, F.lit(0.0)))
    return F.when(baseline.isNull(), F.when(F.lower(F.coalesce(note, F.lit(""))).contains("uncertain"), 0.35).otherwise(0.55)).otherwise(unit(m / (m + 1)))


def severity_strength(severity: Column) -> Column:
    s = F.upper(severity)
    return F.when(s == "FATAL", 1.0).when(s == "ERROR", 0.95).when(s.isin("WARN", "WARNING"), 0.72).when(s == "INFO", 0.45).otherwise(0.55)


def pattern_strength(severity: Column, count: Column) -> Column:
    base = F.when(severity.isin("ERROR", "FATAL"), 0.82).when(severity.isin("WARN", "WARNING"), 0.68).otherwise(0.55)
    return base + F.when(count >= 10, 0.08).when(count >= 3, 0.04).otherwise(0.0)


def alignment(marker: Column, in_window: Column) -> Column:
    """How well a change's place on the timeline fits it as a cause."""
    return (
        F.when(marker.isin("change", "trigger", "non-causal-change"), 0.95)
        .when(marker == "recovery", 0.45)
        .when(marker.isin("symptom", "propagation", "amplification"), 0.70)
        .when(marker == "data-gap", 0.35)
        .when(in_window, 0.65)
        .otherwise(0.10)
    )


def suspicion(support: Column, counter: Column) -> Column:
    """A cause's score from its support and what speaks against it."""
    net = support - 1.15 * counter
    return F.when(net <= 0, F.greatest(F.lit(0.0), F.least(F.lit(0.18), 0.05 + 0.05 * support))).otherwise(1 - F.exp(-0.75 * net))


def ref_quality(found: Column, total: Column, signals: Column) -> Column:
    """Share of references that resolve, with a bonus for more than one kind of signal."""
    return F.when(total == 0, 0.0).otherwise(unit(found / total + F.when(signals > 1, 0.05).otherwise(0.0)))


def is_counter_delta(note: Column, factor: Column, start: Column, end: Column) -> Column:
    """A window delta that speaks against a cause: noted so, hardly grown, or hardly moved."""
    low = F.lower(F.coalesce(note, F.lit("")))
    return low.contains("flat") | low.contains("counter") | F.coalesce(factor <= 1.20, F.lit(False)) | (F.abs(end - start) <= 0.1 * F.greatest(F.abs(start), F.lit(1.0)))


def damped_edge(base: Column, src: Column, dst: Column) -> Column:
    """An edge's confidence where an endpoint is uncertain; unknown endpoints count as certain."""
    weak = (F.coalesce(src, F.lit(1.0)) < 0.5) | (F.coalesce(dst, F.lit(1.0)) < 0.5)
    return F.when(weak, F.greatest(base - 0.20, F.lit(0.30))).otherwise(base)


def near(a: Column, b: Column, relative: float = 0.05, floor: float = 0.001) -> Column:
    """Equal within a relative tolerance or a floor."""
    return F.abs(a - b) <= F.greatest(F.abs(b) * relative, F.lit(floor))


def token_cost(json: Column) -> Column:
    """Tokens of a compact JSON text: its bytes over four, rounded up."""
    return F.ceil(F.octet_length(json) / 4).cast("long")


def fnv1a64(c: Column) -> Column:
    """64-bit FNV-1a of the UTF-8 bytes as 16 hex digits, by 32-bit halves so that nothing overflows."""
    data = F.encode(c, "utf-8")
    low_prime, mask = 0x1B3, 0xFFFFFFFF

    def step(state: Column, i: Column) -> Column:
        byte = F.conv(F.hex(F.substring(data, i, F.lit(1))), 16, 10).cast("long")
        low = state["low"].bitwiseXOR(byte)
        product = low * low_prime
        # times 2**40 + 0x1b3, modulo 2**64: the 2**40 part moves the low half's bits into the high half by 8.
        high = state["high"] * low_prime + F.shiftright(product, 32) + F.shiftleft(low.bitwiseAND(F.lit(0xFFFFFF)), 8)
        return F.struct(high.bitwiseAND(F.lit(mask)).alias("high"), product.bitwiseAND(F.lit(mask)).alias("low"))

    start = F.struct(F.lit(0xCBF29CE4).cast("long").alias("high"), F.lit(0x84222325).cast("long").alias("low"))
    places = F.when(F.octet_length(c) > 0, F.sequence(F.lit(1), F.octet_length(c))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(places, start, step, lambda s: F.lower(F.concat(F.lpad(F.hex(s["high"]), 8, "0"), F.lpad(F.hex(s["low"]), 8, "0"))))
