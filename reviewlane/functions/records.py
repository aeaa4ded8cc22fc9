"""Column rules for observation records: text, time, frequency and number handling."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Receive bands, in hertz, both ends included; the first that fits counts.
BANDS = [
    ("vhf_2m", 143.0e6, 147.0e6),
    ("uhf_70cm", 430.0e6, 440.0e6),
    ("uhf_400", 399.0e6, 403.0e6),
    ("l_band", 1.2e9, 1.3e9),
    ("s_band", 2.2e9, 2.5e9),
]

COMMIT_DIGITS = 6  # fixed value


def client_version(v: Column) -> Column:
    """Trimmed text, null if nothing is left (O1.15)."""
    return F.nullif(F.trim(v), F.lit(""))


def release_family(v: Column) -> Column:
    """The trimmed version without what `git describe` adds to a release; null if nothing is left (O3.1).

    That is a count of commits and a commit of COMMIT_DIGITS hexadecimal digits or more, set
    off by a plus or a point, and a mark for a dirty tree.
    """
    described = rf"^(.*?)([+.]\d+[.]g[0-9a-f]{{{COMMIT_DIGITS},}})?([.]dirty)?$"
    return F.nullif(F.regexp_extract(F.trim(v), described, 1), F.lit(""))


def family_or_unknown(v: Column) -> Column:
    """What stands before the first plus and hyphen, or `unknown` (O3.2)."""
    head = F.split(F.split(v, r"\+")[0], "-")[0]
    return F.coalesce(F.nullif(F.trim(head), F.lit("")), F.lit("unknown"))


def finite(x: Column) -> Column:
    """The number, or null if it is NaN or infinite (O2.12, O10.18)."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def rx_frequency(metadata: Column, observed: Column, downlink: Column) -> Column:
    """The first of the client's, the observed and the catalogue frequency that is not null or zero (O3.9)."""
    own = F.get_json_object(metadata, "$.radio.parameters['rx-freq']").cast("double")
    return F.coalesce(*(F.nullif(x.cast("double"), F.lit(0.0)) for x in (own, observed, downlink)))


def band(hz: Column) -> Column:
    """Name of the receive band; `other` outside all, `unknown` without a finite number (O3.10)."""
    name = F.lit("other")
    for label, low, high in reversed(BANDS):
        name = F.when(hz.between(low, high), label).otherwise(name)
    return F.when(finite(hz).isNull(), "unknown").otherwise(name)


def azimuth_sweep(rise: Column, fall: Column) -> Column:
    """The shorter arc between two bearings (O3.13)."""
    arc = F.pmod(F.abs(fall - rise), F.lit(360.0))
    return F.least(arc, 360.0 - arc)


def wrapped_difference(a: Column, b: Column) -> Column:
    """Signed bearing difference in [-180, 180) (O10.22)."""
    return F.pmod(a - b + 180.0, F.lit(360.0)) - 180.0


def local_hour(start: Column, longitude: Column) -> Column:
    """Hour of day at a longitude, without seconds; an unknown longitude counts as zero (O10.10)."""
    return F.pmod(F.hour(start) + F.minute(start) / 60.0 + F.coalesce(longitude, F.lit(0.0)) / 15.0, F.lit(24.0))


def seconds(t: Column) -> Column:
    """Seconds since 1970 as written, whatever the session's time zone (O10.9)."""
    second = F.extract(F.lit("SECOND"), t).cast("double")
    return F.unix_date(F.to_date(t)) * 86400.0 + F.hour(t) * 3600.0 + F.minute(t) * 60.0 + second


def tle_epoch(line1: Column) -> Column:
    """Seconds since 1970 of the element set's epoch yyddd.frac; years from 57 on are 19yy (O10.12)."""
    year = F.substring(line1, 19, 2).try_cast("int")
    full = F.when(year >= 57, year + 1900).otherwise(year + 2000)
    days = F.substring(line1, 21, 12).try_cast("double")
    return F.unix_date(F.make_date(full, F.lit(1), F.lit(1))) * 86400.0 + (days - 1.0) * 86400.0


def revolution(line1: Column, line2: Column, start: Column) -> Column:
    """Whole orbits from the epoch to start (seconds); -1 where the elements can't be read (O10.13, O10.14)."""
    motion = F.substring(line2, 53, 11).try_cast("double")
    turns = F.floor((start - tle_epoch(line1)) / (86400.0 / F.when(motion > 0, motion)))
    return F.coalesce(turns, F.lit(-1))


def next_cursor(link: Column) -> Column:
    """The cursor of a link header's rel="next" part (O1.14)."""
    return F.nullif(F.regexp_extract(link, r'<[^>]*[?&]cursor=([^&>]*)[^>]*>\s*;\s*rel="next"', 1), F.lit(""))


def url_time(url: Column) -> Column:
    """yyyy-mm-ddThh:mm:ss of the first timestamp in a capture's address, where dashes part the time too (O3.8)."""
    found = F.regexp_extract(url, r"\d{4}(-\d\d){2}T\d\d(-\d\d){2}", 0)
    return F.when(found != "", F.concat(F.left(found, F.lit(11)), F.translate(F.right(found, F.lit(8)), "-", ":")))


def confidence(p: Column) -> Column:
    return F.greatest(p, 1.0 - p)


def logit(p: Column) -> Column:
    """Log odds with p kept 1e-6 from its ends (O10.17)."""
    q = F.greatest(F.least(p, F.lit(1 - 1e-6)), F.lit(1e-6))
    return F.log(q / (1.0 - q))


def sigmoid(z: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-z))


def site_key(latitude: Column, longitude: Column) -> Column:
    """A place to three decimals, rounded half to even (O10.20)."""
    return F.struct(F.bround(latitude, 3).alias("lat"), F.bround(longitude, 3).alias("lng"))


def ceil_share(share_percent: int, budget: int) -> int:
    """max(1, ceil(share * budget)) in whole numbers (O10.23)."""
    return max(1, -(-share_percent * budget // 100))


def features(mhz: Column, elevation: Column, minutes: Column, lat: Column, lng: Column, hour: Column) -> Column:
    """Seven numbers of a pass; the hour stands on a circle and nulls are zero (O3.15)."""
    angle = hour * (2 * math.pi / 24.0)
    return F.array(*(F.coalesce(x, F.lit(0.0)) for x in (mhz, elevation, minutes, lat, lng, F.sin(angle), F.cos(angle))))


def numbers_in(text: Column) -> Column:
    """Numbers written in a text, without trailing zeros after a point (O10.4)."""
    found = F.regexp_extract_all(text, F.lit(r"(-?\d+(?:\.\d+)?)"), F.lit(1))
    return F.transform(found, lambda x: F.when(x.contains("."), F.regexp_replace(x, r"\.?0+$", "")).otherwise(x))
