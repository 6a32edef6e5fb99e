"""Column expressions that turn raw text fields into typed flow values."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

# IANA protocol numbers kept apart; everything else is "other".
PROTO_NUMBERS = {6: "tcp", 17: "udp", 1: "icmp", 58: "icmp"}

DMY = r"^(\d{1,2})/(\d{1,2})/(\d{4}) (\d{1,2}):(\d{2})(:(\d{2}))?$"
_DMY_LOOSE = r"^(\d{1,2})/(\d{1,2})/(\d{4})\s+(\d{1,2}):(\d{2})(?::(\d{2}))?"


def text(c: Column) -> Column:
    return F.trim(F.coalesce(c.cast("string"), F.lit("")))


def number(c: Column) -> Column:
    """Double, or NULL for anything that is not a finite or infinite number."""
    v = F.trim(c.cast("string")).try_cast("double")
    return F.when(~F.isnan(v), v)


def proto_name(c: Column) -> Column:
    s = F.lower(text(c))
    n = number(c)
    by_number = F.lit("other")
    for num, name in PROTO_NUMBERS.items():
        by_number = F.when(n == num, F.lit(name)).otherwise(by_number)
    return (F.when(n.isNotNull(), by_number)
             .when(s.isin("tcp", "udp", "icmp"), s)
             .otherwise(F.lit("other")))


def port(c: Column) -> Column:
    s = text(c)
    hexed = F.conv(F.substring(s, 3, 16), 16, 10).try_cast("long")
    return F.coalesce(F.when(s.startswith("0x"), hexed).otherwise(number(c).try_cast("long")),
                      F.lit(0).cast("long"))


def _date_days(y: Column, m: Column, d: Column) -> Column:
    iso = F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0"))
    return F.unix_date(iso.try_cast("date"))


def _part(s: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(s, pattern, group), F.lit(""))


def clock12_epoch(c: Column) -> Column:
    """d/m/Y H:M[:S] whose afternoon hours lost their +12: hours 1..7 are 13..19."""
    s = text(c)
    d, m, y, hh, mm, ss = (_part(s, _DMY_LOOSE, i) for i in range(1, 7))
    h = hh.try_cast("int")
    h = F.when(h.between(1, 7), h + 12).otherwise(h)
    secs = h * 3600 + mm.try_cast("int") * 60 + F.coalesce(ss.try_cast("int"), F.lit(0))
    return (_date_days(y, m, d).cast("double") * 86400 + secs).cast("double")


def clock24_epoch(c: Column) -> Column:
    """d/m/Y H:M:S on a 24-hour clock; NULL when seconds are missing or out of range."""
    s = text(c)
    d, m, y, hh, mm, _, ss = (_part(s, DMY, i) for i in range(1, 8))
    h, mi, se = hh.try_cast("int"), mm.try_cast("int"), ss.try_cast("int")
    ok = (h < 24) & (mi < 60) & (se < 60)
    return F.when(ok, (_date_days(y, m, d).cast("double") * 86400 + h * 3600 + mi * 60 + se)
                  .cast("double"))


#: Date-times that are not ISO-like, after "/" and "," are "-" and nothing; the first form that fits holds, so a month
#: stands before a day wherever it can.
_FORMS = ("M-d-yyyy H:mm[:ss][.SSSSSS]", "M-d-yyyy h:mm[:ss][.SSSSSS] a", "d-M-yyyy H:mm[:ss][.SSSSSS]", "yyyy-M-d h:mm[:ss][.SSSSSS] a",
          "MMM d yyyy H:mm[:ss]", "MMM d yyyy h:mm[:ss] a", "d MMM yyyy H:mm[:ss]", "d-MMM-yyyy H:mm[:ss]")


def calendar_epoch(c: Column) -> Column:
    """Date-times in mixed forms: ISO-like, month-first, by month name, with or without AM/PM; a zone offset is
    honoured, a bare time counts as UTC."""
    s = F.regexp_replace(text(c), "/", "-")
    naive = s.try_cast("timestamp_ntz")
    zoned = F.when(s.rlike(r"(Z|[+-]\d{2}:?\d{2})$") & s.contains(":"), s.try_cast("timestamp"))
    micros = F.coalesce(F.unix_micros(zoned), ntz_micros(naive))
    t = F.regexp_replace(F.regexp_replace(F.regexp_replace(s, ",", ""), r"([A-Za-z]{3})[a-z]+(?=[ -])", "$1"),
                         r"\s*([AaPp])\.?[Mm]\.?$", " $1M")
    t = F.regexp_replace(t, r"\s+", " ")
    # read in the session's zone and taken back out of it, which leaves the bare time
    forms = [ntz_micros(F.try_to_timestamp(t, F.lit(f)).cast("timestamp_ntz")) for f in _FORMS]
    return F.coalesce(micros, *forms) / F.lit(1e6)


def ntz_micros(c: Column) -> Column:
    """Microseconds since the epoch of a zone-less timestamp, whatever the session zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), c)


def epoch_to_iso(c: Column) -> Column:
    days = F.floor(c / 86400)
    sec = (F.floor(c) - days * 86400).cast("int")
    return F.format_string("%s %02d:%02d:%02d", F.date_from_unix_date(days.cast("int")).cast("string"),
                           F.floor(sec / 3600).cast("int"), F.floor((sec % 3600) / 60).cast("int"),
                           (sec % 60).cast("int"))


def subnet24(ip: Column) -> Column:
    return F.concat(F.substring_index(ip, ".", 3), F.lit(".0/24"))


_OCTET = r"(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
IPV4 = rf"^{_OCTET}(\.{_OCTET}){{3}}$"
_H = r"[0-9A-Fa-f]{1,4}"
IPV6 = ("^(" + "|".join(
    [rf"({_H}:){{7}}{_H}", r"::", rf"({_H}:){{1,7}}:", rf":(:{_H}){{1,7}}"]
    + [rf"({_H}:){{1,{7 - n}}}(:{_H}){{1,{n}}}" for n in range(1, 7)]) + ")$")


def is_ip(c: Column) -> Column:
    return F.coalesce(c.rlike(IPV4) | c.rlike(IPV6), F.lit(False))
