"""Numbers, angles, text and dates as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: lengths and areas in metres
FOOT, SQFT_PER_M2, M2_PER_SQFT = 0.3048, 10.764, 0.0929
# fixed values: street words and what they stand for
STREET_WORDS = {"st": "street", "ave": "avenue", "blvd": "boulevard", "rd": "road", "dr": "drive", "pl": "place"}
OCTANTS = ["N", "NE", "E", "SE", "S", "SW", "W", "NW"]


def uniform(seed: int, *keys: Column | str, draw: int = 0) -> Column:
    """A number in (0, 1) that depends on seed, keys and draw alone, the same in every engine and on every run."""
    text = F.concat_ws("|", F.lit(str(seed)), *(F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in keys), F.lit(str(draw)))
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long") + F.lit(0.5)) / F.lit(4294967296.0)


def number_or_null(text: Column) -> Column:
    """A number written with thousands commas and a +/- mark, or null."""
    return F.regexp_replace(text, r"[,+]|/-", "").try_cast("double")


def first_non_zero(*values: Column) -> Column:
    """The first value that is neither null nor zero."""
    return F.coalesce(*(F.nullif(v, F.lit(0)) for v in values[:-1]), values[-1])


def prefix(text: Column, mark: str = "_") -> Column:
    return F.substring_index(text, mark, 1)


def first_rule(value: Column, rules: list[tuple[Column, object]], default: object = None) -> Column:
    """What the first rule that holds gives; the list's order decides."""
    out = F.lit(default)
    for condition, result in reversed(rules):
        out = F.when(condition, F.lit(result)).otherwise(out)
    return out


def first_listed_prefix(value: Column, weights: list[tuple[str, float]], default: float) -> Column:
    return first_rule(value, [(value.startswith(p), w) for p, w in weights], default)


def hhmm(seconds: Column) -> Column:
    """Seconds of day as hh:mm."""
    minutes = F.floor(seconds / 60).cast("int")
    return F.concat(F.lpad((F.floor(minutes / 60) % 24).cast("string"), 2, "0"), F.lit(":"), F.lpad((minutes % 60).cast("string"), 2, "0"))


def plain_address(text: Column) -> Column:
    """Blanks folded, a trailing unit number dropped."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"\s+", " "), r"(?i) (?:unit|apt|#) ?[0-9a-z]+$", ""))


def address_key(text: Column) -> Column:
    """Upper case, before the first comma."""
    return F.upper(F.trim(F.substring_index(text, ",", 1)))


def street_key(text: Column) -> Column:
    """Lower case, without marks and a leading direction, abbreviations written out."""
    words = F.split(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9 ]", ""), r"^(?:n|s|e|w|north|south|east|west) ", ""), " +")
    table = F.create_map(*(F.lit(x) for pair in STREET_WORDS.items() for x in pair))
    return F.array_join(F.transform(words, lambda w: F.coalesce(F.try_element_at(table, w), w)), " ")


def loose_date_ok(text: Column) -> Column:
    """YYYY, YYYY-MM or YYYY-MM-DD."""
    return text.rlike(r"^[0-9]{4}(?:-(?:0[1-9]|1[0-2])(?:-(?:0[1-9]|[12][0-9]|3[01]))?)?$")


def canonical_url(url: Column) -> Column:
    """Without fragment and trailing slash."""
    return F.regexp_replace(F.regexp_replace(url, "#.*$", ""), "/$", "")


def host(url: Column) -> Column:
    return F.regexp_extract(url, "^[a-z]+://([^/?#]+)", 1)


def turn(degrees_a: Column, degrees_b: Column) -> Column:
    """Signed circular difference in (-180, 180]."""
    return F.pmod(degrees_a - degrees_b + 540, F.lit(360.0)) - 180


def bearing(dx: Column, dy: Column) -> Column:
    """Degrees clockwise from north."""
    return F.pmod(F.degrees(F.atan2(dx, dy)), F.lit(360.0))


def octant(degrees: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, OCTANTS)), F.pmod(F.floor(degrees / 45 + 0.5), F.lit(8)).cast("int") + 1)


def tobler(grade: Column) -> Column:
    """Walking time on a grade against the flat, by Tobler's function, as the mean of both directions."""
    speed = lambda g: F.exp(-3.5 * F.abs(g + 0.05))
    flat = F.lit(2.718281828459045) ** F.lit(-3.5 * 0.05)
    return (flat / speed(grade) + flat / speed(-grade)) / 2


def von_mises(delta_radians: Column, kappa: float) -> Column:
    return F.exp(F.lit(kappa) * (F.cos(delta_radians) - 1))


def smoothstep(t: Column) -> Column:
    x = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    return x * x * (3 - 2 * x)


def point_u(x: Column, y: Column, z: Column) -> Column:
    """A 24-bit hash of three integers as a share of 1, free of overflow under ANSI arithmetic.

    Only bits 0-38 of the product reach the result, so the product is taken in two halves.
    """
    low39, low20, m = (1 << 39) - 1, (1 << 20) - 1, 0x5BD1E995
    mixed = (x * 73856093).bitwiseXOR(y * 19349663).bitwiseXOR(z * 83492791)
    a = mixed.bitwiseXOR(F.shiftright(mixed, 13)).bitwiseAND(low39)
    high = F.shiftright(a, 20) * m
    product = (a.bitwiseAND(low20) * m + F.shiftleft(high.bitwiseAND((1 << 19) - 1), 20)).bitwiseAND(low39)
    return product.bitwiseXOR(F.shiftright(product, 15)).bitwiseAND(0xFFFFFF) / F.lit(float(1 << 24))


_UTM_A, _UTM_F = 6378137.0, 1 / 298.257223563
_UTM_N = _UTM_F / (2 - _UTM_F)
#: Metres of grid a unit of Krüger's plane: the scale on the central meridian times the rectifying radius.
UTM_UNIT = 0.9996 * _UTM_A / (1 + _UTM_N) * (1 + _UTM_N**2 / 4 + _UTM_N**4 / 64)
#: Krüger's series to third order: from the sphere to the plane, back, and from conformal to geographic latitude.
UTM_ALPHA = [_UTM_N / 2 - 2 * _UTM_N**2 / 3 + 5 * _UTM_N**3 / 16, 13 * _UTM_N**2 / 48 - 3 * _UTM_N**3 / 5, 61 * _UTM_N**3 / 240]
UTM_BETA = [_UTM_N / 2 - 2 * _UTM_N**2 / 3 + 37 * _UTM_N**3 / 96, _UTM_N**2 / 48 + _UTM_N**3 / 15, 17 * _UTM_N**3 / 480]
UTM_DELTA = [2 * _UTM_N - 2 * _UTM_N**2 / 3 - 2 * _UTM_N**3, 7 * _UTM_N**2 / 3 - 8 * _UTM_N**3 / 5, 56 * _UTM_N**3 / 15]
UTM_C = 2 * _UTM_N**0.5 / (1 + _UTM_N)


def _utm_sphere(lat: Column, lon: Column, zone: int) -> tuple[Column, Column, Column, Column]:
    phi, lam = F.radians(lat), F.radians(lon - F.lit(zone * 6 - 183.0))
    t = F.sinh(F.atanh(F.sin(phi)) - UTM_C * F.atanh(UTM_C * F.sin(phi)))
    return t, lam, F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))


def utm(lat: Column, lon: Column, zone: int = 11) -> tuple[Column, Column]:
    """Easting and northing of WGS84 degrees by Krüger's series to third order."""
    _, _, xi, eta = _utm_sphere(lat, lon, zone)
    east, north = eta, xi
    for j, k in enumerate(UTM_ALPHA, 1):
        east = east + k * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + k * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return F.lit(500000.0) + UTM_UNIT * east, UTM_UNIT * north


def utm_convergence(lat: Column, lon: Column, zone: int = 11) -> Column:
    """The angle, in degrees clockwise, from true north to the grid's north at a place."""
    t, lam, xi, eta = _utm_sphere(lat, lon, zone)
    sigma, tau = F.lit(1.0), F.lit(0.0)
    for j, k in enumerate(UTM_ALPHA, 1):
        sigma = sigma + 2 * j * k * F.cos(2 * j * xi) * F.cosh(2 * j * eta)
        tau = tau + 2 * j * k * F.sin(2 * j * xi) * F.sinh(2 * j * eta)
    root, tilt = F.sqrt(1 + t * t), t * F.tan(lam)
    return F.degrees(F.atan2(tau * root + sigma * tilt, sigma * root - tau * tilt))


def utm_inverse(east: Column, north: Column, zone: int = 11) -> tuple[Column, Column]:
    """WGS84 degrees (lat, lon) of a grid's place: the inverse series, which returns to :func:`utm`'s place within a tenth of a millimetre in the zone."""
    xi, eta = north / UTM_UNIT, (east - 500000.0) / UTM_UNIT
    back_xi, back_eta = xi, eta
    for j, k in enumerate(UTM_BETA, 1):
        back_xi = back_xi - k * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        back_eta = back_eta - k * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(back_xi) / F.cosh(back_eta))
    lat = chi
    for j, k in enumerate(UTM_DELTA, 1):
        lat = lat + k * F.sin(2 * j * chi)
    return F.degrees(lat), F.degrees(F.atan2(F.sinh(back_eta), F.cos(back_xi))) + F.lit(zone * 6 - 183.0)


def value_noise(x: Column, y: Column, scale: float, seed: int, side: int = 63) -> Column:
    """Smooth noise in [0, 1): keyed values on a lattice that repeats every ``side`` cells, blended by smooth steps."""
    fx, fy = x / scale, y / scale
    i, j = F.floor(fx), F.floor(fy)
    sx, sy = smoothstep(fx - i), smoothstep(fy - j)
    at = lambda a, b: uniform(seed, F.pmod(i + a, F.lit(side)).cast("long"), F.pmod(j + b, F.lit(side)).cast("long"))
    low, high = at(0, 0) * (1 - sx) + at(1, 0) * sx, at(0, 1) * (1 - sx) + at(1, 1) * sx
    return low * (1 - sy) + high * sy
