"""Date texts of web pages as instants: the parser behind tessera.operators.instants (plain Python, no Spark)."""

from __future__ import annotations

import re
from datetime import UTC, datetime, timedelta, timezone
from functools import cache
from zoneinfo import ZoneInfo

# Month names and their usual short forms in English, German, Spanish and French.
_MONTHS = {
    1: "january jan januar jänner enero ene janvier janv",
    2: "february feb februar febrero février févr fevrier",
    3: "march mar märz maerz mär mrz marzo mars",
    4: "april apr abril abr avril avr",
    5: "may mai mayo",
    6: "june jun juni junio juin",
    7: "july jul juli julio juillet juil",
    8: "august aug agosto ago août aout",
    9: "september sep sept septiembre septembre",
    10: "october oct oktober okt octubre octobre",
    11: "november nov noviembre novembre",
    12: "december dec dezember dez diciembre dic décembre déc decembre",
}
MONTH_OF = {name: m for m, names in _MONTHS.items() for name in names.split()}
_NAME = "(?P<name>" + "|".join(sorted(MONTH_OF, key=len, reverse=True)) + r")(?![^\W\d_])\.?"

_TIME = r"(?P<h>\d{1,2})\s?(?::|h|(?<=\d)\.(?=\d\d(?!\d)))\s?(?P<mi>\d{2})(?!\d)(?:[:.](?P<s>\d{2})(?!\d)(?:[.,](?P<f>\d+))?)?(?:\s?(?P<ap>[ap])\.?\s?m\b\.?)?(?:\s(?:uhr|hrs?|h)\b)?"
_HOUR = r"(?P<h>\d{1,2})\s?(?P<ap>[ap])\.?\s?m\b\.?"
_ZONE = r"(?:\s?(?:(?P<z>z)(?![^\W_])|(?:(?:utc|gmt)\s?)?(?P<sign>[+-])(?P<oh>\d{1,2}):?(?P<om>\d{2})?(?!\d)|(?P<iana>[a-z]+(?:/[a-z_+-]+){1,2})|(?P<abbr>[a-z]{2,5})(?![^\W_/])))?(?:\s?\[(?P<bracket>[a-z_/+-]+)\])?(?:\s?\([^()\d]*\))?"
_BETWEEN = r"(?:\s?t\s?(?=\d)|\s?,?\s?(?:(?:at|à|um|a las|a|-|·|\|)\s)?)"
_CLOCK = rf"(?:{_BETWEEN}(?:{_TIME}){_ZONE})?"
_CLOCK_H = rf"{_BETWEEN}(?:{_HOUR}){_ZONE}"

_DATES = (
    r"(?P<y>\d{4})(?P<sep>[-/.])(?P<m>\d{1,2})(?P=sep)(?P<d>\d{1,2})",
    r"(?P<n1>\d{1,2})(?P<sep>[-/.])(?P<n2>\d{1,2})(?P=sep)(?P<y>\d{4})",
    rf"(?P<d>\d{{1,2}})-{_NAME}-(?P<y>\d{{4}}|\d{{2}})",
    rf"(?P<d>\d{{1,2}})(?:st|nd|rd|th|er|º|\.)?\s(?:de\s)?{_NAME},?\s(?:del?\s)?(?P<y>\d{{4}})",
    rf"{_NAME}\s(?P<d>\d{{1,2}})(?:st|nd|rd|th)?,?\s(?P<y>\d{{4}})",
)
_PATTERNS = [re.compile(rf"(?<![\w/+-]){d}(?!\d){clock}", re.I) for d in _DATES for clock in (_CLOCK_H, _CLOCK)]
_PATTERNS.append(re.compile(rf"(?<!\w){_NAME}\s(?P<d>\d{{1,2}})\s{_TIME}{_ZONE}\s(?P<y>\d{{4}})(?!\d)", re.I))
_PATTERNS.append(re.compile(rf"(?<!\w)(?P<y>\d{{4}})(?P<m>\d{{2}})(?P<d>\d{{2}})t(?P<h>\d{{2}}):?(?P<mi>\d{{2}})(?::?(?P<s>\d{{2}})(?:[.,](?P<f>\d+))?)?{_ZONE}", re.I))
_BARE = re.compile(r"(?<![\w.,:/+-])(\d+)(?:[.,](\d+))?(?![\w:/-])(?!\.\d)")
_SPELLED = re.compile(r"(\d{4})(\d{2})(\d{2})(?:(\d{2})(\d{2})(?:(\d{2}))?)?")
_BLANK = re.compile(r"\s+")

EPOCH = datetime(1970, 1, 1, tzinfo=UTC)
_FIRST, _LAST = (int((datetime(y, 1, 1, tzinfo=UTC) - EPOCH).total_seconds()) * 10**6 for y in (2015, 2027))


@cache
def _zone(name: str) -> ZoneInfo | None:
    try:
        return ZoneInfo(name)
    except (KeyError, ValueError, OSError):
        pass
    try:  # names in another letter case
        return ZoneInfo("/".join("_".join(w.capitalize() for w in p.split("_")) for p in name.split("/")))
    except (KeyError, ValueError, OSError):
        return None


@cache
def abbreviations(zones: tuple[str, ...]) -> dict[str, dict[str, int]]:
    """Offsets in minutes by abbreviation and zone, as the zones used them from 2015 to 2026."""
    known: dict[str, dict[str, int]] = {}
    for name in zones:
        if z := _zone(name):
            for day in range(0, 12 * 365, 15):
                t = datetime(2015, 1, 1, tzinfo=z) + timedelta(days=day)
                if (abbr := t.tzname()) and abbr.isalpha():
                    known.setdefault(abbr.upper(), {})[name] = int(t.utcoffset().total_seconds() // 60)
    return known


def _us(t: datetime) -> int:
    return (t - EPOCH) // timedelta(microseconds=1)


def _local(t: datetime, zone: ZoneInfo, day_only: bool) -> int | None:
    """The earlier instant of a local time; none if it never occurs, but a day then begins where the gap ends."""
    at = t.replace(tzinfo=zone).astimezone(UTC)
    if at.astimezone(zone).replace(tzinfo=None) == t:
        return _us(at)
    if not day_only:
        return None
    offsets = [t.replace(tzinfo=zone, fold=f).utcoffset() for f in (0, 1)]
    return _us((t - min(offsets)).replace(tzinfo=UTC)) - int(abs(offsets[1] - offsets[0]).total_seconds() * 10**6)


def _bare(whole: str, fraction: str | None) -> int | None:
    if len(whole := whole.lstrip("0") or "0") > 19:  # beyond nanoseconds
        return None
    for unit in (10**6, 10**3, 1):
        us = int(whole) * unit
        if fraction and unit > 1:
            us += int(fraction[:9].ljust(9, "0")) * unit // 10**9
        if _FIRST <= us < _LAST:
            return us
    us = int(whole) // 1000  # nanoseconds
    return us if _FIRST <= us < _LAST else None


def instant(raw: str | None, zone: str | None, order: str | None, zones: tuple[str, ...] = (), trusted: bool = True) -> int | None:
    """Microseconds since 1970 UTC that `raw` denotes, or None.

    `zone` (IANA) and `order` (DMY or MDY) are those of the publisher; `zones` are all publishers' zones, whose
    abbreviations count. With trusted=False only values that carry their own offset or zone count. Empty and blank
    texts, impossible dates, relative times and texts with further digits beside the date denote nothing.
    """
    if not raw or not any(c.isdigit() for c in raw):
        return None
    text = _BLANK.sub(" ", raw.replace("\u2212", "-").replace("\u2013", "-")).strip()
    home = _zone(zone) if zone and trusted else None
    if number := _BARE.search(text):
        whole, fraction = number.groups()
        if not any(c.isdigit() for c in text[: number.start()] + text[number.end() :]) and (fraction is None or len(whole) >= 9):
            spelled = _SPELLED.fullmatch(whole) if fraction is None else None
            if spelled:
                try:
                    t = datetime(*(int(x or 0) for x in spelled.groups()))
                    if 1900 <= t.year <= 2100:
                        return _local(t, home, spelled[4] is None) if home else None
                except ValueError:
                    pass
            return _bare(whole, fraction)
    for pattern in _PATTERNS:
        if m := pattern.search(text):
            if not any(c.isdigit() for c in text[: m.start()] + text[m.end() :]):
                return _matched(m.groupdict(), home, zone, order, zones)
    return None


def _matched(g: dict[str, str | None], home: ZoneInfo | None, zone: str | None, order: str | None, zones: tuple[str, ...]) -> int | None:
    year = int(g["y"]) + (2000 if len(g["y"]) == 2 else 0)
    if g.get("n1"):
        a, b = int(g["n1"]), int(g["n2"])
        if order not in ("DMY", "MDY"):
            return None
        day, month = (a, b) if order == "DMY" else (b, a)
    else:
        month, day = int(g["m"]) if g.get("m") else MONTH_OF[g["name"].lower()], int(g["d"])
    hour, timed = int(g.get("h") or 0), bool(g.get("h"))
    if g.get("ap"):
        if not 1 <= hour <= 12:
            return None
        hour = hour % 12 + 12 * (g["ap"].lower() == "p")
    fraction = int((g.get("f") or "")[:6].ljust(6, "0"))
    try:
        t = datetime(year, month, day, hour, int(g.get("mi") or 0), int(g.get("s") or 0), fraction)
    except ValueError:
        return None
    try:
        if g.get("z"):
            return _us(t.replace(tzinfo=UTC))
        if g.get("sign"):
            minutes = int(g["oh"]) * 60 + int(g.get("om") or 0)
            if minutes > 14 * 60 or int(g.get("om") or 0) > 59:
                return None
            return _us(t.replace(tzinfo=timezone(timedelta(minutes=minutes if g["sign"] == "+" else -minutes))))
        if abbr := (g.get("abbr") or "").upper():
            if abbr in ("UTC", "GMT", "UT"):
                return _us(t.replace(tzinfo=UTC))
            by_zone = abbreviations(zones).get(abbr)
            if by_zone:
                minutes = by_zone.get(zone, next(iter(by_zone.values())))
                return _us(t.replace(tzinfo=timezone(timedelta(minutes=minutes))))
            if g["abbr"].isupper() and len(abbr) >= 3:
                return None  # a zone of nobody
        if name := g.get("iana") or g.get("bracket"):
            if own := _zone(name):
                return _local(t, own, not timed)
        return _local(t, home, not timed) if home else None
    except OverflowError:
        return None
