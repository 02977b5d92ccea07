from datetime import UTC, datetime

import pytest

from tessera.functions.dates import instant

ZONES = ("America/New_York", "America/Chicago", "Europe/London", "Europe/Berlin", "Pacific/Auckland", "Asia/Kolkata")


def us(*parts):
    return int(datetime(*parts, tzinfo=UTC).timestamp()) * 10**6


@pytest.mark.parametrize(
    ("raw", "zone", "order", "expected"),
    [
        ("2023-07-04T07:42:59Z", None, None, us(2023, 7, 4, 7, 42, 59)),
        ("2023-07-04t07:42:59z", None, None, us(2023, 7, 4, 7, 42, 59)),
        ("Published 2024-03-16T13:46:49.3881239-04", None, None, us(2024, 3, 16, 17, 46, 49) + 388123),
        ("2023-08-11 16:05:11−07:00", None, None, us(2023, 8, 11, 23, 5, 11)),
        ("2025-08-04T21:20:02 UTC+01:00", None, None, us(2025, 8, 4, 20, 20, 2)),
        ("1597775037", None, None, 1597775037 * 10**6),
        ("1696182415.818", None, None, 1696182415818000),
        ("1639044914089630", None, None, 1639044914089630),
        ("1716448800655", None, None, 1716448800655000),
        ("20221001164227", "America/Chicago", "MDY", us(2022, 10, 1, 21, 42, 27)),
        ("20220906T232409Z", None, None, us(2022, 9, 6, 23, 24, 9)),
        ("05/06/2024 08:29", "America/New_York", "MDY", us(2024, 5, 6, 12, 29)),
        ("05/06/2024 08:29", "Europe/London", "DMY", us(2024, 6, 5, 7, 29)),
        ("Wednesday, 03-Sep-25 16:42:53 GMT", None, None, us(2025, 9, 3, 16, 42, 53)),
        ("Sun, 07 Nov 2021 01:43:34 EST", "America/New_York", "MDY", us(2021, 11, 7, 6, 43, 34)),
        ("2021-11-07 01:43:34", "America/New_York", "MDY", us(2021, 11, 7, 5, 43, 34)),
        ("Thu Aug 07 21:52:34 EDT 2025", None, None, us(2025, 8, 8, 1, 52, 34)),
        ("Mon Jun 12 2023 11:59:54 GMT-0400 (Eastern Daylight Time)", None, None, us(2023, 6, 12, 15, 59, 54)),
        ("28. Januar 2021, 18:08 Uhr", "Europe/Berlin", "DMY", us(2021, 1, 28, 17, 8)),
        ("15 septembre 2023 à 14h53", "Europe/Berlin", "DMY", us(2023, 9, 15, 12, 53)),
        ("27 de marzo de 2024, 23:15", "Europe/Berlin", "DMY", us(2024, 3, 27, 22, 15)),
        ("March 13, 2022 3:33 AM", "America/New_York", "MDY", us(2022, 3, 13, 7, 33)),
        ("July 26, 2022 12:50 a.m. BST", "America/New_York", "MDY", us(2022, 7, 25, 23, 50)),
        ("2023-08-12 11:39:02 America/New_York", None, None, us(2023, 8, 12, 15, 39, 2)),
        ("2024-11-01T11:44:57-04:00[America/New_York]", None, None, us(2024, 11, 1, 15, 44, 57)),
        ("2022-02-24", "Pacific/Auckland", "DMY", us(2022, 2, 23, 11)),
        ("2022-03-13 02:39:44", "America/New_York", "MDY", None),
        ("2024-04-31", "America/New_York", "MDY", None),
        ("31/11/2022 08:15", "America/New_York", "MDY", None),
        ("2022-06-17T25:10:00Z", None, None, None),
        ("2022-02-24", None, "DMY", None),
        ("05/06/2024", "Europe/London", None, None),
        ("2 days ago", "Europe/London", "DMY", None),
        ("yesterday", "Europe/London", "DMY", None),
        ("0000-00-00 00:00:00", "Europe/London", "DMY", None),
        ("", "Europe/London", "DMY", None),
        ("  ", "Europe/London", "DMY", None),
        (None, "Europe/London", "DMY", None),
        ("1" * 400, "Europe/London", "DMY", None),
    ],
)
def test_instant(raw, zone, order, expected):
    assert instant(raw, zone, order, ZONES) == expected


def test_untrusted_values_need_their_own_zone():
    assert instant("2023-02-02 10:00", "Europe/London", "DMY", ZONES, trusted=False) is None
    assert instant("2023-02-02T10:00Z", "Europe/London", "DMY", ZONES, trusted=False) == us(2023, 2, 2, 10)


def test_long_texts_around_a_date():
    at = us(2023, 7, 4, 7, 42, 59)
    assert instant(" " * 600 + "2023-07-04T07:42:59Z" + "\n\t" * 600, None, None, ZONES) == at
    assert instant("word " * 5000 + "2023-07-04T07:42:59Z by " + "word " * 5000, None, None, ZONES) == at
    assert instant("1597775037" + " " * 600, None, None, ZONES) == 1597775037 * 10**6
    assert instant("1" * 6000, None, None, ZONES) is None and instant("May " + "1" * 6000, None, None, ZONES) is None
