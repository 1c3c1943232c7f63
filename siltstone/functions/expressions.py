"""Scalar expressions of the incident domain. All are plain Column functions that stay inside code generation."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

NULL_WORDS = ("nan", "none", "null", "")


def local_parts(ts: Column, tz: str) -> dict[str, Column]:
    """hour_local, dow_local (Monday is 0) and date_local of a UTC timestamp in a zone."""
    local = F.from_utc_timestamp(ts, tz)
    return {"hour_local": F.hour(local), "dow_local": F.weekday(local), "date_local": F.to_date(local)}


def canonical_cause(label: Column, aliases: Mapping[str, str] | None = None) -> Column:
    """Trimmed, lower-cased, null words as null, aliases replaced, blanks and slashes as one underscore."""
    c = F.lower(F.trim(label))
    c = F.when(~c.isin(*NULL_WORDS), c)
    for old, new in (aliases or {}).items():
        c = F.when(c == old, new).otherwise(c)
    return F.regexp_replace(c, r"[ /]+", "_")


def clean_category(label: Column) -> Column:
    """Trimmed, with the words nan, None, NULL and the empty text as null; upper and lower case matter."""
    c = F.trim(label)
    return F.when(~c.isin("nan", "None", "NULL", ""), c)


def clean_corridor(label: Column, missing: str = "Non-corridor") -> Column:
    return F.trim(F.coalesce(label, F.lit(missing)))


def parse_flag(v: Column) -> Column:
    """TRUE, T, 1, YES and FALSE, F, 0, NO in any case; anything else is null."""
    c = F.upper(F.trim(v.cast("string")))
    return F.when(c.isin("TRUE", "T", "1", "YES"), True).when(c.isin("FALSE", "F", "0", "NO"), False)


def minutes_between(start: Column, end: Column) -> Column:
    return (F.unix_micros(end) - F.unix_micros(start)) / F.lit(6e7)


def geo_valid(lat: Column, lon: Column) -> Column:
    return F.coalesce((F.abs(lat) > 1) & (F.abs(lon) > 1), F.lit(False))


def cyclical(hour: Column, dow: Column) -> dict[str, Column]:
    """Sine and cosine of the hour and the day of the week, and weekend and peak flags; nulls count as noon, Monday."""
    h, d = F.coalesce(hour, F.lit(12)), F.coalesce(dow, F.lit(0))
    turn = 2 * math.pi
    return {
        "hour_sin": F.sin(h * turn / 24),
        "hour_cos": F.cos(h * turn / 24),
        "dow_sin": F.sin(d * turn / 7),
        "dow_cos": F.cos(d * turn / 7),
        "is_weekend": d.isin(5, 6).cast("int"),
        "is_peak": (h.between(7, 10) | h.between(17, 20)).cast("int"),
    }


def clip(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def noisy_or_trust(flags: Sequence[tuple[Column, float]]) -> Column:
    """The product of 1 - weight over the flags that hold, within 0 and 1."""
    trust = F.lit(1.0)
    for flag, weight in flags:
        trust = trust * F.when(flag, 1 - weight).otherwise(1.0)
    return clip(trust, 0.0, 1.0)


def lookup(c: Column, values: Mapping[str, float], default: float) -> Column:
    out = None
    for key, value in values.items():
        out = F.when(c == key, value) if out is None else out.when(c == key, value)
    return F.lit(default) if out is None else out.otherwise(default)


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = 6371.0) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * radius * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def zone_key(corridor: Column) -> Column:
    """The first token of a corridor name in upper case, up to an opening bracket."""
    first = F.upper(F.trim(F.split(F.split(corridor, r"[\s\-_/]")[0], r"\(")[0]))
    return F.when(F.coalesce(first, F.lit("")) == "", "UNKNOWN").otherwise(first)


def cases(rules: Sequence[tuple[Column, object]], otherwise: object) -> Column:
    """The value of the first rule that holds."""
    out = None
    for rule, value in rules:
        out = F.when(rule, value) if out is None else out.when(rule, value)
    return out.otherwise(otherwise)


def first_positive(*cs: Column) -> Column:
    """The first of the columns that is positive, else the first that is not null."""
    return F.coalesce(*[F.when(c > 0, c) for c in cs], *cs)


def finite(c: Column) -> Column:
    """Null for NaN and infinities."""
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def duration_label(minutes: Column) -> Column:
    return F.when(minutes < 60, F.format_string("%d min", F.floor(minutes))).when(minutes < 1440, F.format_string("%d h", F.floor(minutes / 60))).otherwise(F.format_string("%d d", F.floor(minutes / 1440)))


def sane_quantiles(p50: Column, p80: Column, p95: Column, week: float = 10080.0, ratio: float = 15.0) -> Column:
    """Whether a triple is plausible: no week-long median or tail, no far tail, no flat long tail."""
    return ~((p50 > week) | (p95 > week) | (p95 > F.greatest(F.lit(240.0), p50 * ratio)) | ((p80 == p95) & (p95 > 1440)))


def sorted_quantiles(p50: Column, p80: Column, p95: Column) -> dict[str, Column]:
    """The triple in order with p95 at most max(10 p50, 1440), and whether it had crossed."""
    s = F.array_sort(F.array(p50, p80, p95))
    top = F.least(s[2], F.greatest(s[0] * 10, F.lit(1440.0)))
    t = F.array_sort(F.array(s[0], s[1], top))
    return {"crossed": (p50 > p80) | (p80 > p95), "clamped": s[2] > top, "s50": t[0], "s80": t[1], "s95": t[2]}


def reasons(rules: Mapping[str, Column]) -> Column:
    """The names of the rules that hold, joined by |; null if there is none."""
    out = F.concat_ws("|", *[F.when(rule, name) for name, rule in rules.items()])
    return F.nullif(out, F.lit(""))


def lognormal_from_quantiles(p50: Column, p95: Column, least_sigma: float = 0.1) -> tuple[Column, Column]:
    return F.log(p50), F.greatest((F.log(p95) - F.log(p50)) / F.lit(1.645), F.lit(least_sigma))


def effectiveness(spend: Sequence[tuple[Column, float]], most: float = 0.9) -> Column:
    """Saturating effect of resources: 1 - exp(-sum of rate times amount), at most `most`."""
    total = sum((n * rate for n, rate in spend), F.lit(0.0))
    return F.least(F.lit(most), 1 - F.exp(-total))


def normal_cdf(x: Column) -> Column:
    """Standard normal distribution function by a rational approximation of erfc, good to about 1e-7."""
    z = F.abs(x) / math.sqrt(2)
    t = 1 / (1 + z * 0.5)
    #: Fixed values of the published approximation.
    terms = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)
    poly = F.lit(terms[-1])
    for c in reversed(terms[:-1]):
        poly = poly * t + c
    tail = t * F.exp(-z * z + poly) / 2
    return F.when(x >= 0, 1 - tail).otherwise(tail)


def normal_pdf(x: Column) -> Column:
    return F.exp(-x * x / 2) / math.sqrt(2 * math.pi)


def gaussian_crps(y: Column, mean: Column, sd: Column) -> Column:
    s = F.greatest(sd, F.lit(1e-6))
    z = (y - mean) / s
    return s * (z * (2 * normal_cdf(z) - 1) + 2 * normal_pdf(z) - 1 / math.sqrt(math.pi))


def gaussian_entropy(sd: Column) -> Column:
    return 0.5 * math.log(2 * math.pi * math.e) + F.log(sd)


def gaussian_kl(m1: Column, s1: Column, m0: Column, s0: Column) -> Column:
    return clip(F.log(s0 / s1) + (s1 * s1 + (m1 - m0) * (m1 - m0)) / (2 * s0 * s0) - 0.5, 0.0, 1e6)


def log_gamma(x, log=F.log):
    """The logarithm of the gamma function of a positive column (or, with numpy's log, array): Stirling's series eight
    places further up, where it is right to some 12 digits."""
    y = x + 8.0
    series = 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y) - 1 / (1680 * y * y * y * y * y * y * y)
    down = log(x) + log(x + 1.0) + log(x + 2.0) + log(x + 3.0) + log(x + 4.0) + log(x + 5.0) + log(x + 6.0) + log(x + 7.0)
    return (y - 0.5) * log(y) - y + 0.5 * math.log(2 * math.pi) + series - down
