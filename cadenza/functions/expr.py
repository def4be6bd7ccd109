"""Scalar expressions over notes, times and arrays; all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cadenza.schema import DEFAULT_BAR_TICKS, NOTE_NAMES


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def pitch_class(pitch: Column | str) -> Column:
    """0..11."""
    return F.pmod(_col(pitch), F.lit(12)).cast("int")


def note_name(pitch: Column | str) -> Column:
    """C, C#, ... B."""
    return F.element_at(F.array(*[F.lit(n) for n in NOTE_NAMES]), pitch_class(pitch) + 1)


def octave_name(pitch: Column | str, first: int = -1) -> Column:
    """Name with octave; pitch 0 lies in octave ``first``."""
    return F.concat(note_name(pitch), (F.floor(_col(pitch) / 12) + first).cast("string"))


def is_chord(pitches: Column | str) -> Column:
    """Three or more distinct values."""
    return F.size(F.array_distinct(_col(pitches))) >= 3


def bar_ticks(ticks_per_beat: Column | str, numerator: Column | str, denominator: Column | str | None = None) -> Column:
    """Length of a bar in ticks; without a denominator the beat is a quarter; without a numerator the fallback."""
    beats = _col(numerator) * _col(ticks_per_beat)
    ticks = beats if denominator is None else F.floor(beats * 4 / _col(denominator))
    return F.coalesce(ticks.cast("long"), F.lit(DEFAULT_BAR_TICKS).cast("long"))


def bar_seconds(tempo: Column | str, numerator: Column | str) -> Column:
    """Length of a bar in seconds; 2 where tempo or signature is missing."""
    return F.coalesce(60.0 / _col(tempo) * _col(numerator), F.lit(2.0))


def quantize(value: Column | str, unit: float) -> Column:
    """To the nearest multiple, halves to the even one."""
    return F.bround(_col(value) / F.lit(unit)) * F.lit(unit)


def octave_bucket(pitch: Column | str) -> Column:
    """Rounded octave, halves to the even one."""
    return F.bround(_col(pitch) / F.lit(12.0)).cast("int")


def pad(values: Column | str, n: int, fill: Column) -> Column:
    """Exactly ``n`` elements: cut, or filled at the end."""
    return F.slice(F.concat(_col(values), F.array_repeat(fill, n)), 1, n)


def group_label(path: Column | str) -> Column:
    """What stands before the first underscore of a file name."""
    return F.element_at(F.split(F.element_at(F.split(_col(path), "/"), -1), "_"), 1)


def as_percent(share: Column | str) -> Column:
    """0.1234 -> 12.34%."""
    return F.format_string("%.2f%%", _col(share) * 100)


def syncopated(start: Column | str, tempo: Column | float, beats_per_bar: Column | float = 4.0, tolerance: float = 0.1) -> Column:
    """Whether an onset lies more than ``tolerance`` of a beat after its beat; before the next beat counts as off."""
    beat = F.lit(60.0) / (tempo if isinstance(tempo, Column) else F.lit(float(tempo)))
    bar = beat * (beats_per_bar if isinstance(beats_per_bar, Column) else F.lit(float(beats_per_bar)))
    return ~(((_col(start) % bar) / beat) % 1 <= tolerance)


def squared_distance(a: Column, b: Column, weights: Column | None = None) -> Column:
    """Sum of squares of (weighted) differences of two arrays of doubles."""
    zero = F.lit(0.0)
    diff = F.zip_with(a, b, lambda x, y: x - y)
    if weights is not None:
        diff = F.zip_with(diff, weights, lambda d, w: d * w)
    return F.aggregate(diff, zero, lambda s, d: s + d * d)


def match_ratio(a: Column | str, b: Column | str) -> Column:
    """Positions where two arrays agree, by the longer length; 1 for two empty arrays."""
    a, b = _col(a), _col(b)
    longer = F.greatest(F.size(a), F.size(b))
    same = F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda s, x: s + x)
    return F.when(longer == 0, 1.0).otherwise(same / longer)
