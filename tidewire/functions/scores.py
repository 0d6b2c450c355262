"""Health and quality scores: each takes columns and returns a column."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The weights of the health score.
WEIGHTS = {"frame_drop": 0.3, "timestamp": 0.2, "buffer": 0.15, "error_rate": 0.2, "bitrate": 0.05, "param_changes": 0.05, "latency": 0.05}


def frame_drops(rate: Column, warning: float = 0.05, critical: float = 0.1) -> Column:
    return F.when(rate >= critical, 0.0).when(rate >= warning, 0.5 * (critical - rate) / (critical - warning)).otherwise(1.0 - F.pow(rate / warning, 2))


def timestamp_drift(ms: Column, most: float = 100.0) -> Column:
    return F.when(F.abs(ms) >= most, 0.0).otherwise(1.0 - F.abs(ms) / most)


def buffer_use(share: Column) -> Column:
    return F.when((share < 0.3) | (share > 0.95), 0.0).when((share >= 0.5) & (share <= 0.8), 1.0).when(share < 0.5, (share - 0.3) / 0.2).otherwise((0.95 - share) / 0.15)


def error_rate(rate: Column) -> Column:
    """Falls from 1.0 to 0.4 just above a rate of 0.001, as specified."""
    return F.when(rate >= 0.1, 0.0).when(rate <= 0.001, 1.0).otherwise(1.0 - (F.log10(rate * 1000) + 3) / 5)


def bitrate_variance(variance: Column) -> Column:
    return F.when(variance >= 0.5, 0.0).otherwise(1.0 - variance * 2)


def parameter_changes(n: Column) -> Column:
    return F.when(n == 0, 1.0).when(n >= 10, 0.0).otherwise(1.0 - n / 10.0)


def latency(ms: Column, most: float = 500.0, free: float = 50.0) -> Column:
    return F.when(ms >= most, 0.0).when(ms <= free, 1.0).otherwise(1.0 - (ms - free) / (most - free))


def weighted(parts: dict[str, Column], weights: dict[str, float] = WEIGHTS) -> Column:
    return reduce(lambda a, b: a + b, [parts[k] * w for k, w in weights.items()]) / sum(weights.values())


def monitor_score(drops: Column, cpu: Column, memory: Column, latency_ms: Column, corruption: Column) -> Column:
    """Product of the penalties of all issues."""
    return (
        F.when(drops > 0.1, 0.5).when(drops > 0.05, 0.8).otherwise(1.0) * F.when(cpu > 0.9, 0.6).otherwise(1.0)
        * F.when(memory > 0.9, 0.7).otherwise(1.0) * F.when(latency_ms > 200, 0.8).otherwise(1.0) * F.when(corruption > 10, 0.7).otherwise(1.0)
    )


def monitor_issues(drops: Column, cpu: Column, memory: Column, latency_ms: Column, corruption: Column) -> Column:
    return F.array_compact(F.array(F.when(drops > 0.05, "frame_drops"), F.when(cpu > 0.9, "cpu_usage"), F.when(memory > 0.9, "memory_usage"), F.when(latency_ms > 200, "latency"), F.when(corruption > 10, "corruption")))


def monitor_status(score: Column, degraded: float = 0.7, critical: float = 0.3) -> Column:
    return F.when(score >= 0.9, "healthy").when(score >= degraded, "degraded").when(score >= critical, "unhealthy").otherwise("critical")


def session_score(active: Column, codec: Column, loss: Column, resets: Column, ssrc_changes: Column, jitter_ms: Column, underruns: Column, overruns: Column, rate_drops: Column) -> Column:
    """100 less a penalty for each finding, 0 at least."""
    lost = F.when(active, 0).otherwise(50) + F.when(codec, 0).otherwise(20) + F.when(loss > 0.1, 30).when(loss > 0.05, 15).when(loss > 0.01, 5).otherwise(0)
    for found, points in ((resets > 0, 10), (ssrc_changes > 0, 5), (jitter_ms > 100, 10), (underruns > 0, 5), (overruns > 0, 5), (rate_drops > 0, 10)):
        lost = lost + F.when(found, points).otherwise(0)
    return F.greatest(F.lit(0), F.lit(100) - lost)


def session_status(score: Column) -> Column:
    return F.when(score >= 90, "excellent").when(score >= 75, "good").when(score >= 50, "fair").when(score >= 25, "poor").otherwise("critical")


def adaptive_quality(cpu: Column, memory: Column, drops: Column, loss: Column, latency_ms: Column) -> Column:
    def part(x: Column, full: float) -> Column:
        return 1.0 - F.least(x / full, F.lit(1.0))

    late = F.when(latency_ms > 100, F.greatest(F.lit(0.0), 1.0 - (latency_ms - 100) / 400.0)).otherwise(1.0)
    return part(cpu, 0.8) * 0.25 + part(memory, 0.8) * 0.2 + part(drops, 0.05) * 0.25 + part(loss, 0.02) * 0.2 + late * 0.1
