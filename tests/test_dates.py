import pytest

from kinforge.functions.dates import MONTHS, month_of, parse_date


@pytest.mark.parametrize(
    ("raw", "value"),
    [
        # numbers
        ("3.2.1871", "3 FEB 1871"), ("1871-02-03", "3 FEB 1871"), ("13/25/1871", "1871"), ("2.25.1871", "25 FEB 1871"), ("00.00.1871", "1871"), ("00.04.1871", "APR 1871"), ("09 1871", "SEP 1871"),
        ("30.071871", "30 JUL 1871"), ("0309.1871", "3 SEP 1871"), (".06.1871", "JUN 1871"), (".061871", "JUN 1871"), ("...1871", "1871"), (".14.02.1871", "14 FEB 1871"), ("31.6.1800", "31 JUN 1800"), ("870", "1870"),
        ("4.05.18", "4 MAY 2018"), ("30.101.1871", "1871"),
        # words
        ("12 okt 1888", "12 OCT 1888"), ("Jan 9, 1850", "9 JAN 1850"), ("03NOV1912", "3 NOV 1912"), ("5. MAJA 1893", "5 MAY 1893"), ("4th March 1790", "4 MAR 1790"), ("6 veliki traven 1901", "6 MAY 1901"), ("7 v.srpan 1900", "7 AUG 1900"),
        ("7bris 1790", "SEP 1790"), ("9 10ber 1790", "9 DEC 1790"), ("2 Iunii 1700", "2 JUN 1700"), ("8 xber 1840", "8 DEC 1840"), ("15 Bla 1900", "ABT 1900"), ("20 JUN", "20 JUN"), ("22MA01970", "22 MAY 1970"),
        # qualifiers
        ("okoli 1890", "ABT 1890"), ("~1890", "ABT 1890"), ("pred 1890", "BEF 1890"), ("PRD 1890", "BEF 1890"), ("nach 5. mai 1890", "AFT 5 MAY 1890"), ("Est. 1890", "EST 1890"), ("L.1890", "1890"), ("ABT pred 1890", "BEF 1890"), ("AFTJUL 1890", "AFT JUL 1890"),
        ("WFT est 1890", "ABT 1890"), ("<1890", "BEF 1890"), ("cca !890", "ABT 1890"), ("bef", ""),
        # doubt
        ("1890?", "ABT 1890"), ("3.2.1890 ??", "ABT 3 FEB 1890"), ("17.3.19xx", "ABT 17 MAR 1900"), ("184-", "ABT 1840"), ("19__", "ABT 19__"), ("XX.05.1890", "MAY 1890"), ("pred 189x", "BEF 1890"),
        # ranges
        ("from 1890 to 1900", "FROM 1890 TO 1900"), ("1890 do 1900", "FROM 1890 TO 1900"), ("from 1890", "FROM 1890"), ("od 1890", "FROM 1890"), ("do 1890", "TO 1890"), ("between 1890 and 1891", "BET 1890 AND 1891"), ("BET 1890 - 1891", "BET 1890 AND 1891"),
        ("med 3.2.1890 - 4.5.1891", "FROM 3 FEB 1890 TO 4 MAY 1891"), ("bet 1890", "ABT 1890"), ("1890 - 1900", "1890-1900"), ("1863-1", "1863"), ("1731/32", "1731/32"), ("1846/7", "1846/7"), ("1 FEB 1800/1801", "1 FEB 1800/1801"),
        # nothing
        ("__.__.1901", "1901"), ("--.--1901", "1901"), (".<>.1901", "1901"), ("?", ""), ("", ""), ("__.__.____", ""), ("NN", ""), ("unknown", ""), ("17", ""), ("/", ""), ("Private", "Private"),
        # marks around
        ("=)=)1840", "1840"), ("č2000", "2000"), ("(1620)", "1620"), ("182O", "1820"), ("12.03.1900  10H", "12 MAR 1900"), ("08.01~1938", "8 JAN 1938"), ("R.15.02.1931", "15 FEB 1931"), ("27.05.1946 L", "27 MAY 1946"),
    ],
)
def test_parse(raw, value):
    assert parse_date(raw) == (value, None)


def test_unreadable_dates_warn():
    for raw in ("some time ago", "from then to now", "bet x and 1900"):
        value, warning = parse_date(raw)
        assert value is None and warning


def test_canonical_dates_stay():
    for d in ("3 FEB 1871", "ABT 1890", "BEF 1890", "FROM 1890 TO 1900", "BET 1890 AND 1891", "FEB 1871", "FROM 1890", "CAL 1890", "EST 3 FEB 1871"):
        assert parse_date(d)[0] == d


def test_months():
    assert [month_of(w) for w in ("januar", "März", "maja", "listopad", "septembris", "oktobru", "xyz", "marija")] == [1, 3, 5, 11, 9, 10, None, None]
    assert [month_of(m) for m in MONTHS] == list(range(1, 13))
