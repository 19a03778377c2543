"""Scores of single axes as Column expressions; a value that is missing on either side scores 0."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Wheel number of each key, minor and major.
WHEEL_MINOR = {"Abm": 1, "Ebm": 2, "Bbm": 3, "Fm": 4, "Cm": 5, "Gm": 6, "Dm": 7, "Am": 8, "Em": 9, "Bm": 10, "F#m": 11, "C#m": 12}
WHEEL_MAJOR = {"B": 1, "F#": 2, "Db": 3, "Ab": 4, "Eb": 5, "Bb": 6, "F": 7, "C": 8, "G": 9, "D": 10, "A": 11, "E": 12}
#: Other spellings of keys.
RESPELLED = {"Gb": "F#", "Gbm": "F#m", "C#": "Db", "Dbm": "C#m", "D#m": "Ebm", "D#": "Eb", "A#m": "Bbm", "A#": "Bb", "G#m": "Abm", "G#": "Ab", "Cb": "B", "Cbm": "Bm", "E#": "F", "E#m": "Fm", "B#": "C", "B#m": "Cm"}
KEYS = [*WHEEL_MINOR, *WHEEL_MAJOR]


def or_zero(score: Column) -> Column:
    return F.coalesce(score, F.lit(0.0))


def linear(a: Column, b: Column, width: float) -> Column:
    """1 at equal values, 0 from a distance of `width`."""
    return or_zero(F.greatest(F.lit(0.0), 1 - F.abs(a - b) / F.lit(float(width))))


def _both_set(a: Column, b: Column, score: Column) -> Column:
    """0 where either value is the negative sentinel."""
    return or_zero(F.when((a < 0) | (b < 0), 0.0).otherwise(score))


def bpm(a: Column, b: Column) -> Column:
    return _both_set(a, b, linear(a, b, 20))


def spectral(a: Column, b: Column) -> Column:
    return linear(a, b, 2000)


def brightness(a: Column, b: Column) -> Column:
    """Not cut at 0: values beyond [0, 1] may give less."""
    return _both_set(a, b, 1 - F.abs(a - b))


def color_temp(a: Column, b: Column) -> Column:
    return linear(a, b, 2)


def palette(a: Column, b: Column) -> Column:
    return linear(a, b, 300)


def hue(a: Column, b: Column) -> Column:
    d = F.abs(a - b)
    return or_zero(F.greatest(F.lit(0.0), 1 - F.least(d, 360 - d) / 180))


def aspect(a: Column, b: Column) -> Column:
    return or_zero(F.when((a > 0) & (b > 0), F.greatest(F.lit(0.0), 1 - F.abs(F.ln(a) - F.ln(b)))))


def duration(a: Column, b: Column) -> Column:
    return or_zero(F.when((a > 0) & (b > 0), F.greatest(F.lit(0.0), 1 - (F.greatest(a, b) / F.least(a, b) - 1) / 4)))


def calendar_days(date: Column) -> Column:
    """Days of `YYYY-MM-DD...`, with mean years and months; null for other texts."""
    part = lambda i: F.try_to_number(F.split_part(F.substring(date, 1, 10), F.lit("-"), F.lit(i)), F.lit("9999" if i == 1 else "99")).cast("double")
    return part(1) * 365.25 + part(2) * 30.44 + part(3)


def temporal(a: Column, b: Column) -> Column:
    """Falls by e every 180 days."""
    return or_zero(F.exp(-F.abs(calendar_days(a) - calendar_days(b)) / 180))


def _folders(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda x: x != "")


def provenance(a: Column, b: Column) -> Column:
    """Closeness of two folders in their tree."""
    pa, pb = _folders(a), _folders(b)
    least = F.least(F.size(pa), F.size(pb))
    same = F.transform(F.arrays_zip(pa.alias("x"), pb.alias("y")), lambda z: F.coalesce(z["x"] == z["y"], F.lit(False)))
    first_off = F.array_position(same, F.lit(False)).cast("int")
    shared = F.when(first_off > 0, first_off - 1).otherwise(least)
    far = F.size(pa) + F.size(pb) - 2 * shared
    deepest = F.greatest(F.size(pa), F.size(pb))
    steps = F.when(a == b, 1.0).when(deepest == 0, 0.0).when(far == 0, 1.0).when(far == 1, 0.7).when(far == 2, 0.5).when(far == 3, 0.35).when(far == 4, 0.25)
    return or_zero(F.when(a.isNotNull() & b.isNotNull(), steps.otherwise(F.greatest(F.lit(0.1), shared / deepest * 0.3))))


def normal_key(key: Column) -> Column:
    """One spelling for each key; unknown names stay as they are."""
    s = F.trim(key)
    for word, short in ((" minor", "m"), (" major", ""), (" min", "m"), (" maj", "")):
        s = F.replace(s, F.lit(word), F.lit(short))
    s = F.trim(s)
    table = F.create_map(*[F.lit(x) for kv in RESPELLED.items() for x in kv])
    return F.coalesce(F.try_element_at(table, s), s)


def _wheel(key: Column) -> tuple[Column, Column]:
    number = F.create_map(*[F.lit(x) for kv in {**WHEEL_MINOR, **WHEEL_MAJOR}.items() for x in kv])
    return F.try_element_at(number, key), key.isin(*WHEEL_MINOR)


def wheel_distance(a: Column, b: Column) -> Column:
    d = F.abs(a - b)
    return F.least(d, 12 - d)


def key_compatibility(a: Column, b: Column) -> Column:
    """Harmonic fit by steps on the wheel; equal names fit whatever they are. The order of the cases counts."""
    ka, kb = normal_key(a), normal_key(b)
    (na, ma), (nb, mb) = _wheel(ka), _wheel(kb)
    d, same = wheel_distance(na, nb), ma == mb
    score = (
        F.when(ka == kb, 1.0)
        .when(na.isNull() | nb.isNull(), 0.1)
        .when((d == 0) & ~same, 0.95)
        .when((d == 1) & same, 0.85)
        .when((d == 3) & ~same, 0.8)
        .when((d == 1) & ~same, 0.7)
        .when((d == 5) & same, 0.6)
        .when(d == 2, 0.5)
        .when((d == 3) & same, 0.4)
        .when(d == 4, 0.3)
        .when((d == 5) & ~same, 0.2)
        .when(d == 6, 0.1)
        .otherwise(0.15)
    )
    return or_zero(F.when(a.isNotNull() & b.isNotNull(), score))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Between 0 and 1; 0 for vectors that are missing, empty, of unlike size or without length."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    fits = (F.size(a) == F.size(b)) & (F.size(a) > 0)
    return or_zero(F.when(fits & (norm >= 1e-12), F.least(F.greatest(dot(a, b) / norm, F.lit(0.0)), F.lit(1.0))))


def raw_cosine(a: Column, b: Column) -> Column:
    """Not cut; a tiny term keeps the divisor above 0."""
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)) + 1e-12)


def unit(v: Column) -> Column:
    """The vector over its length; a vector without length stays."""
    n = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: x.cast("double") / F.when(n < 1e-12, 1.0).otherwise(n))


def mean_vector(vectors: Column) -> Column:
    """Mean of an array of vectors of one size."""
    total = F.aggregate(F.slice(vectors, 2, F.greatest(F.size(vectors) - 1, F.lit(0))), F.transform(vectors[0], lambda x: x.cast("double")), lambda s, v: F.zip_with(s, v, lambda x, y: x + y.cast("double")))
    return F.transform(total, lambda x: x / F.size(vectors))


def contrast_vector(positive: Column, negative: Column, weight: float = 0.3) -> Column:
    """Unit vector of the mean positive less a share of the mean negative one."""
    return unit(F.when(F.size(negative) > 0, F.zip_with(mean_vector(positive), mean_vector(negative), lambda p, n: p - weight * n)).otherwise(mean_vector(positive)))


def best_match(seed: Column, cand: Column, default_weight: Column | float = 1.0, several: bool = False) -> Column:
    """Mean over the seed's segments (struct vector, area_frac) of the best cosine with a segment of cand, by area.

    several: each segment has an array `vectors` and counts once, by the best of them.
    """
    weight = lambda s: F.coalesce(s["area_frac"], F.lit(default_weight) if isinstance(default_weight, float) else default_weight)
    among = lambda v, c, m: F.greatest(m, cosine(v, c))
    if several:
        best = lambda s: F.aggregate(s["vectors"], F.lit(0.0), lambda m, v: F.aggregate(cand, m, lambda n, c: F.aggregate(c["vectors"], n, lambda k, w: among(v, w, k))))
    else:
        best = lambda s: F.aggregate(cand, F.lit(0.0), lambda m, c: among(s["vector"], c["vector"], m))
    total = F.aggregate(seed, F.lit(0.0), lambda t, s: t + weight(s))
    found = F.aggregate(seed, F.lit(0.0), lambda t, s: t + weight(s) * best(s))
    return or_zero(F.when((F.size(seed) > 0) & (F.size(cand) > 0) & (total >= 1e-12), found / total))


Score = Callable[[Column, Column], Column]
