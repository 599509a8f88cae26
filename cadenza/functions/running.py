"""Column functions of running: conversions, power, gradient factor, bands, calendar bins and formatting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cadenza import constants as C


def kmh(dd: Column, dt: Column) -> Column:
    """Speed in km/h; null where dt is 0."""
    return F.try_divide(dd, dt) * 3.6


def m_per_km(da: Column, dd: Column) -> Column:
    """Gradient in m/km; null where dd is 0."""
    return F.try_divide(da, dd) * 1000


def clip(x: Column, low: float, high: float) -> Column:
    """x within the limits; null stays null."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def inverse(x: Column, numerator: float) -> Column:
    """numerator / x, for pace and speed; null unless x is positive."""
    return F.when(x > 0, F.lit(numerator) / x)


def factor_at(gradient: Column, curve: str = "balanced_runner") -> Column:
    """The curve's factor at a gradient in m/km, linear between knots and level beyond them: one expression, no join."""
    xs, ys = C.KNOTS, C.REFERENCE_CURVES[curve]
    found = F.when(gradient <= xs[0], F.lit(ys[0]))
    for x0, x1, y0, y1 in zip(xs, xs[1:], ys, ys[1:]):
        found = found.when(gradient < x1, F.lit((y1 - y0) / (x1 - x0)) * (gradient - x0) + y0)
    return F.when(gradient.isNotNull(), found.otherwise(F.lit(ys[-1])))


def factor_sql(gradient: str, curve: str = "balanced_runner") -> str:
    xs, ys = C.KNOTS, C.REFERENCE_CURVES[curve]
    arms = [f"when {gradient} <= {xs[0]!r} then {ys[0]!r}::double"]
    arms += [f"when {gradient} < {x1!r} then {(y1 - y0) / (x1 - x0)!r}::double * ({gradient} - {x0!r}::double) + {y0!r}::double" for x0, x1, y0, y1 in zip(xs, xs[1:], ys, ys[1:])]
    return f"case when {gradient} is null then null {' '.join(arms)} else {ys[-1]!r}::double end"


def power(speed: Column, gradient: Column, mass_kg: float | None) -> Column:
    """Watts at a speed (m/s) and gradient (m/km); null without a mass."""
    if mass_kg is None:
        return F.lit(None).cast("double")
    slope = F.when(gradient.isNotNull(), F.greatest(gradient / 1000.0, F.lit(C.MIN_SLOPE)))
    per_kg = speed * (C.COST_OF_TRANSPORT + C.GRAVITY * slope)
    return F.when(per_kg.isNotNull(), F.lit(float(mass_kg)) * F.greatest(per_kg, F.lit(0.0)))


def power_sql(speed: str, gradient: str, mass_kg: float) -> str:
    return f"{float(mass_kg)!r}::double * greatest({speed} * (1.0::double + 9.81::double * greatest({gradient} / 1000.0::double, -0.05::double)), 0.0::double)"


def band(gradient_pct: Column) -> Column:
    """The name of a gradient's band."""
    found = None
    for name, _, upper in C.GRADIENT_BANDS:
        if upper is None:
            return F.when(gradient_pct.isNotNull(), found.otherwise(F.lit(name)))
        found = F.when(gradient_pct < upper, F.lit(name)) if found is None else found.when(gradient_pct < upper, F.lit(name))


def within_year_bin(date: Column, granularity: str = "week") -> Column:
    """The month, or the week counted from January 1st (1 to 53)."""
    return F.month(date) if granularity == "month" else F.floor((F.dayofyear(date) - 1) / 7).cast("int") + 1


def reference_bin(index: Column, granularity: str = "week") -> Column:
    """A within-year bin's date in the leap year 2000."""
    return F.make_date(F.lit(2000), index, F.lit(1)) if granularity == "month" else F.date_add(F.lit("2000-01-01").cast("date"), (index - 1) * 7)


def reference_date(date: Column) -> Column:
    """Month and day in the leap year 2000."""
    return F.make_date(F.lit(2000), F.month(date), F.dayofmonth(date))


def bin_start(date: Column, granularity: str = "week") -> Column:
    """The first of the month, or the Monday, of a date."""
    return F.trunc(date, "month") if granularity == "month" else F.date_sub(date, F.weekday(date))


def hms(seconds: Column) -> Column:
    """h:mm:ss, or m:ss under an hour; empty for null and non-finite. Halves round to even."""
    finite = seconds.isNotNull() & ~F.isnan(seconds) & (F.abs(seconds) != float("inf"))
    n = F.rint(F.when(finite, seconds)).cast("long")
    hours, minutes, secs = F.floor(n / 3600), F.floor(F.pmod(n, F.lit(3600)) / 60), F.pmod(n, F.lit(60))
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    long = F.concat(hours.cast("string"), F.lit(":"), two(minutes), F.lit(":"), two(secs))
    return F.when(~finite, "").when(hours != 0, long).otherwise(F.concat(minutes.cast("string"), F.lit(":"), two(secs)))


def pace_text(seconds_per_km: Column) -> Column:
    """m:ss/km; empty for null and non-finite."""
    finite = seconds_per_km.isNotNull() & ~F.isnan(seconds_per_km) & (F.abs(seconds_per_km) != float("inf"))
    n = F.rint(F.when(finite, seconds_per_km)).cast("long")
    return F.when(~finite, "").otherwise(F.concat(F.floor(n / 60).cast("string"), F.lit(":"), F.lpad(F.pmod(n, F.lit(60)).cast("string"), 2, "0"), F.lit("/km")))


def seconds_of(text: Column) -> Column:
    """Seconds of an h:m:s text."""
    p = F.split(text, ":")
    return p[0].cast("long") * 3600 + p[1].cast("long") * 60 + p[2].cast("long")


def split_seconds(seconds: Column) -> Column:
    """[hours, minutes, seconds]."""
    return F.array(F.floor(seconds / 3600), F.floor(F.pmod(seconds, F.lit(3600)) / 60), F.pmod(seconds, F.lit(60)).cast("long"))


def as_clock(seconds: Column) -> Column:
    """Seconds as a timestamp from the epoch, to the millisecond; null for null and non-finite."""
    return F.when(~F.isnan(seconds) & (F.abs(seconds) != float("inf")), F.timestamp_millis((seconds * 1000).cast("long")))


def rgba(color: Column, alpha: float) -> Column:
    """rgba(...) of a #RRGGBB color; other texts stay as they are."""
    c = F.ltrim(color, F.lit("#"))
    part = lambda k: F.conv(F.substring(c, k, 2), 16, 10)
    return F.when(F.length(c) == 6, F.concat(F.lit("rgba("), F.concat_ws(",", part(1), part(3), part(5), F.lit(str(alpha))), F.lit(")"))).otherwise(color)


def translated(texts: Column, lang: Column, key: Column) -> Column:
    """Map lookup in nested maps lang -> key -> text, with English and then the key itself as fallback."""
    own = F.try_element_at(F.try_element_at(texts, lang), key)
    return F.coalesce(own, F.try_element_at(F.try_element_at(texts, F.lit("en")), key), key)
