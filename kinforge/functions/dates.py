"""Genealogical dates: normalisation, sort keys and year extractors.

A date is a string such as ``ABT 12 MAR 1850``. Normalisation is a parser applied to distinct
values; keys, years and the importers' formats are Column expressions.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import strip

#: fixed values: month abbreviations of the interchange format
MONTHS = ("JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC")
#: fixed values: month words of English, German, Slovenian, Latin and Italian with the misspellings met in old books, in calendar order
MONTH_WORDS = (
    "jan january ian gen genn gennaio pros prosinec",
    "feb february febr febb febbraio frb fen vel sveč svečan",
    "mar march mär mrz märz maerz marec mart marzo suš sušec",
    "apr april aprile apil",
    "may mai maj maij maaj manj ma mag maggio",
    "jun june juni junij iun giu giugno rožn rožnik jjun jum iûno iugno",
    "jul july juli julij iul lug luglio srp srpan",
    "aug august avg avgust ago agosto svg abg eog",
    "sep sept september septembr set settembre kos kosec",
    "oct october okt oktober ott ottobre vin vinotok kim kimovec ašr pkt",
    "nov november novemb novembre list listopad naov niv nob",
    "dec december dez dezember dic dicembre grud gruden dac dsc xber xbr xbris",
)
#: fixed values: Slovenian and Latin stems of each month and the endings that they take
STEMS = ("januar ianuar", "februar", "marc mart", "april", "maj mai", "junij iun jun", "julij iul jul", "avgust august", "septembr", "oktobr octobr", "novembr", "decembr")
ENDINGS = {"januar": "- ja ju ius ii io", "ianuar": "ius ii io", "februar": "- ja ju ius ii io", "marc": "a u", "mart": "ius ii io", "april": "a u is i", "maj": "a u", "mai": "us i o", "avgust": "a u", "august": "us i o"}
FOR_J, FOR_I, FOR_BR = "a u", "ius ii io", "a u is io"
#: fixed values: qualifiers and what they become; longer words are tried first
QUALIFIERS = {
    "ABT": "about abt abtt abtg 1bt ~ ' circa cir cca ccca ccac cvca çca žcca ccc cc ca c okoli okli oli okrog okrig olkrog okorg orog krog og org okr ok približno priblizno priblixno pribl "
    "videno predvideno prevideno jeseni pogrešan pogresan izračunano izracunano recimo around say at urbar etu estimated abg ˇ",
    "BEF": "before bef pred prred prd vor <",
    "AFT": "after aft po nach >",
    "CAL": "calculated calc cal",
    "EST": "est ges act",
    "FROM": "since from od seit",
    "": "l letu letom",
}


def _month_table() -> dict[str, int]:
    table = {w: i for i, words in enumerate(MONTH_WORDS, 1) for w in words.split()}
    for i, stems in enumerate(STEMS, 1):
        for stem in stems.split():
            endings = ENDINGS.get(stem) or (FOR_J if stem.endswith("ij") else FOR_BR if stem.endswith("br") else FOR_I)
            table |= {stem + ("" if e == "-" else e): i for e in endings.split()}
    return table


_MONTH = _month_table()


def month_number(word: Column) -> Column:
    """1..12, or null for a word that is no month."""
    known = F.create_map(*[F.lit(x) for pair in _MONTH.items() for x in pair])
    return F.element_at(known, F.lower(F.regexp_replace(strip(word), r"\.+\z", "")))


def month_name(number: Column) -> Column:
    n = number.cast("int")
    return F.when(n.between(1, 12), F.element_at(F.array(*[F.lit(m) for m in MONTHS]), F.when(n.between(1, 12), n).otherwise(1)))


def _int(c: Column) -> Column:
    return F.nullif(c, F.lit("")).try_cast("int")


# -- normalisation: a small parser in Python, applied to distinct values in Arrow batches.
# A value is tidied by rewrites, tried as a range, freed of qualifiers and cut into number and word
# tokens; the sequence of token kinds decides how it is read.

#: fixed values: texts that stand for no date
NO_DATE = frozenset(("NO", "NE", "DA", "Y", "NOT MARRIED", "HITRO", "UMRL", "CIVILNA", "UNKNOWN", "XXX-TEMPLATE"))
_NOTHING = re.compile(r"(?i)\?+|[n+]+|\d\d|[/.]|-+")
_PLAUSIBLE = re.compile(r"(?=(1\d{3}|20[0-2]\d))")
_SEPARATORS = " .,/-:~\t"
_TOKENS = re.compile(r"\d+|[^\W\d_]+\.?|[\s.,/\-:~]+|.")
_HOUR = re.compile(r"\s+\d{1,2}H?$")
#: a number with signs for unknown digits, with no letter beside it
_BLURRED = re.compile(r"(?<![^\W\d_])(?=[xXyY?]*\d)(?=\d*[xXyY?])[\dxXyY?]+(?![^\W\d_])")
_ROMAN = {"7": "SEP", "8": "OCT", "9": "NOV", "10": "DEC"}
_QUALIFIER = sorted(((w, q) for q, words in QUALIFIERS.items() for w in words.split()), key=lambda x: -len(x[0]))
#: spelling that is put right before a date is read, in order; none of it says that the date is doubtful
_TIDY = [
    (re.compile(r"(?<![A-Za-z])X+(?![A-Za-z])"), "00"),  # X stands for a day or month
    (re.compile(r"[()]"), ""),
    (re.compile(r"^[=≈≡＝]+\s*"), ""),
    (re.compile(r"^(?!ˇ)[^\x00-\x7f]\s*(?=\d)"), ""),
    (re.compile(r"^[\s.-]*[\s.-](?=[\s.-])"), ""),
    (re.compile(r"\bO(?=\d)|(?<=\d)O(?=\d|\b)"), "0"),
    (re.compile(r"~{2,}"), "~"),
    (re.compile(r"(?i)(?<=\d)(?:st|nd|rd|th)\b"), ""),
    (re.compile(r"[,\s]+$"), ""),
    (re.compile(r"(?i)^[tm]\s+(?=\d)"), ""),
    (re.compile(r"(?i)\b(abt|aft|bef|cal|est)(?=(?:" + "|".join(MONTHS) + r")\b)"), r"\1 "),
    (re.compile(r"^!(?=\d+$)"), "1"),
    (re.compile(r"^[A-Za-z]\.\s*(?=\d)"), ""),
    (re.compile(r"(?<=\d)\s+[A-Za-z]$"), ""),
    (re.compile(r"(?i)MA0(?=\d)"), "MAY"),
    (re.compile(r"^(\d{1,2})[.,\s](\d{1,2})[.,\s](\d\d)$"), r"\1.\2.20\3"),
]
_SPANS = {"from": (("to", "do"), "FROM {} TO {}"), "od": (("to", "do"), "FROM {} TO {}"), "": (("to", "do"), "FROM {} TO {}"), "between": (("and", "-"), "BET {} AND {}"), "bet": (("and", "-"), "BET {} AND {}"), "med": (("-", "–"), "FROM {} TO {}")}


def month_of(word: str) -> int | None:
    return _MONTH.get(word.lower().rstrip("."))


def _two_word_months(v: str) -> str:
    """The little and the great traven and srpan, Latin months with a number, as abbreviations."""
    pairs = {("m", "traven"): 4, ("v", "traven"): 5, ("m", "srpan"): 7, ("v", "srpan"): 8}
    v = re.sub(r"(?i)\b(m|mali|v|vel|veliki)[. ] ?(traven|srpan)", lambda m: MONTHS[pairs[m[1][0].lower(), m[2].lower()] - 1], v)
    return re.sub(r"(?i)\b(7|8|9|10)b(?:ris|r|er)\b", lambda m: _ROMAN[m[1]], v)


def _spelled(day: int, month: int | None, year: str) -> str:
    year = "1" + year if len(year) == 3 else year
    return " ".join([*([str(day)] if day else []), *([MONTHS[month - 1]] if month else []), year])


def _numeric(day: int, month: int, year: str) -> str:
    """Day and month by number: exchanged where only that makes a month; both unknown where nothing does."""
    if month > 12 and 1 <= day <= 12 and month <= 31:
        day, month = month, day
    return _spelled(day, month, year) if 1 <= month <= 12 else _spelled(0, None, year)


def parse_single(v: str) -> str | None:
    """One date without a qualifier in canonical form; else the last plausible year in it."""
    v = _two_word_months(v.strip())
    year, dual = None, re.search(r"(?<!\d)\d{3,4}/\d{1,4}$", v)
    tokens = _TOKENS.findall(v[: dual.start()] if dual else v)
    if dual:
        tokens.append(dual[0])
    gaps = [t for t in tokens if not t.strip(_SEPARATORS)]
    parts = [t for t in tokens if t.strip(_SEPARATORS)]
    lead = bool(tokens) and tokens[0] in gaps and tokens[0][0] in ".,"
    if tokens and tokens[0] in gaps and not lead:
        parts = []
    kinds = "".join("w" if re.match(r"[^\W\d_]", t) else "Y" if "/" in t else str(len(t)) if t.isdigit() else "?" for t in parts)
    kinds = re.sub("[12]", "n", kinds).replace("3", "y").replace("4", "y")
    if kinds in ("nwy", "nwY", "wny", "wnY", "wy", "wY"):
        word = month_of(parts[kinds.index("w")])
        year = parts[-1]
        if word is None:
            return f"ABT {year}"
        return _spelled(int(parts[kinds.index("n")]) if "n" in kinds else 0, word, year)
    if kinds == "nny":
        return _numeric(int(parts[0]), int(parts[1]), parts[2])
    if kinds == "ynn" and gaps == ["-", "-"] and len(parts[0]) == 4:
        return _numeric(int(parts[2]), int(parts[1]), parts[0])
    if kinds == "ny":
        return _numeric(0, int(parts[0]), parts[1])
    if kinds == "y":
        return _spelled(0, None, parts[0])
    if kinds == "n6" and len(gaps) == 1:
        return _numeric(int(parts[0]), int(parts[1][:2]), parts[1][2:])
    if kinds == "yy" and len(parts[0]) == len(parts[1]) == 4 and len(gaps) == 1:
        return _numeric(int(parts[0][:2]), int(parts[0][2:]), parts[1])
    if lead and kinds == "6":
        return _numeric(0, int(parts[0][:2]), parts[0][2:])
    found = _PLAUSIBLE.findall(v)
    return found[-1] if found else None


def split_qualifier(v: str) -> tuple[str | None, str]:
    """Up to five qualifiers off the front; the last one that says something counts; None if there is none."""
    last = None
    for _ in range(5):
        low = v.lower()
        for word, q in _QUALIFIER:
            if low.startswith(word):
                rest = v[len(word) :]
                if word[-1].isalpha():
                    if rest and not re.match(r"[\s\d.:~]", rest):
                        continue
                    rest = re.sub(r"^[.:]", "", rest)
                v, last = rest.strip(), q if last is None or q else last
                break
        else:
            break
    return last, v


def _span(v: str) -> tuple[str | None, str | None] | None:
    """A range of two dates or one open to a side; None if the value is neither."""
    opener = re.match(r"(?i)(from|od|between|bet|med)\s+", v)
    words, form = _SPANS[opener[1].lower() if opener else ""]
    body = v[opener.end() :] if opener else v
    for w in words:
        cut = re.search(rf"(?i)(?<=\S)\s+{w}\s+(?=\S)" if w.isalpha() else rf"(?<=\S)\s*{w}\s*(?=\S)", body)
        if cut:
            ends = [parse_date(body[: cut.start()]), parse_date(body[cut.end() :])]
            bad = next((warning for _, warning in ends if warning), None)
            return (None, bad) if bad else (form.format(ends[0][0], ends[1][0]), None)
    half = re.match(r"(?i)(from|to|do|between|bet)\s+(\S.*)$", v)
    if not half:
        return None
    value, warning = parse_date(half[2])
    kind = half[1].lower()
    if warning:
        return None, warning
    if kind in ("between", "bet"):
        return value if re.match(r"(?:ABT|EST|CAL|BEF|AFT)\b", value) or not value else f"ABT {value}", None
    return f"{'FROM' if kind == 'from' else 'TO'} {value}", None


def parse_date(raw: str | None) -> tuple[str | None, str | None]:
    """(value, warning): an empty value removes the date, a warning leaves it as it is."""
    raw = raw or ""
    v = raw.strip()
    if v.upper() == "PRIVATE":
        return raw, None
    if not v or _NOTHING.fullmatch(v) or v.strip("()").upper() in NO_DATE:
        return "", None
    v = v.rstrip(".'`*/")
    sure = v.rstrip("?").rstrip() or v
    plain = _HOUR.sub("", sure) if sure[:1].isdigit() else sure
    filled = _BLURRED.sub(lambda m: re.sub(r"\D", "0", m[0]), plain)
    doubt = sure != v or filled != plain
    v = filled
    for pattern, put in _TIDY:
        v = pattern.sub(put, v)
    v = v.strip()
    if re.fullmatch(r"\d{1,2}\s+[A-Za-z]+\.?", v) and not re.match(r"\d+b(?:ris|r|er)\b", v):
        return raw, None
    if not v or _NOTHING.fullmatch(v):
        return "", None
    if re.fullmatch(r"\d{3}-", v):
        return f"ABT {v[:3]}0", None
    if re.search(r"_|--|<>|(?<!\d)<(?!\d{3})", v):  # marks for unknown parts
        year, part = re.search(r"\b\d{3,4}\b", v), re.search(r"\b(\d{1,3})_+", v)
        return year[0] if year else f"ABT {part[1]:_<4}" if part else "", None
    two = re.fullmatch(r"(\d{3,4})\s*-\s*(\d{1,4})", v)
    if two and (len(two[2]) > 2 or re.fullmatch(r"\d+-\d+", v)):
        return f"{two[1]}-{two[2]}" if len(two[2]) > 2 else two[1], None
    if re.fullmatch(r"\d{3,4}/\d{1,4}", v):
        return v, None
    span = _span(v)
    if span:
        return span
    q, rest = split_qualifier(re.sub(r"(?i)^wft\s+est\.?(?=\s|\d|$)", "abt", v))
    if not rest:
        return "", None
    one = parse_single(re.sub(r"^!(?=\d+$)", "1", rest))
    if one is None:
        return None, f"cannot read date: {raw}"
    q = "ABT" if doubt and not q else q
    return (one if not q or one.startswith("ABT ") else f"{q} {one}"), None


@F.pandas_udf(T.StructType([T.StructField("value", T.StringType()), T.StructField("warning", T.StringType())]))
def normalize(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for raw in batches:
        yield pd.DataFrame([parse_date(x) for x in raw], columns=["value", "warning"])


def normalized(df: DataFrame, column: str) -> DataFrame:
    """Adds ``value`` and ``warning``: dates repeat, so each distinct one is parsed once and joined back."""
    known = df.select(column).distinct().withColumn("_n", normalize(F.col(column))).select(F.col(column).alias("_raw"), F.col("_n.value").alias("value"), F.col("_n.warning").alias("warning"))
    return df.join(known, F.col(column).eqNullSafe(F.col("_raw")), "left").drop("_raw")


def sort_key(c: Column) -> Column:
    """``y, m, d`` for ordering; without a date 99999, 99, 99; without a year 99999; missing parts 0."""
    year = F.regexp_extract(c, r"(?<!\d)(1\d{3}|20\d{2})(?!\d)", 1)
    month = F.regexp_extract(F.upper(c), "(" + "|".join(MONTHS) + ")", 1)
    day = F.regexp_extract(F.upper(c), r"(?<!\d)(\d{1,2})\s+(?:" + "|".join(MONTHS) + ")", 1)
    none = F.coalesce(strip(c), F.lit("")) == ""
    number = F.coalesce(month_number(F.nullif(month, F.lit(""))), F.lit(0))
    return F.struct(
        F.when(none | (year == ""), 99999).otherwise(_int(year)).alias("y"), F.when(none, 99).otherwise(number).alias("m"), F.when(none, 99).otherwise(F.coalesce(_int(day), F.lit(0))).alias("d"),
    )


def birth_year(c: Column) -> Column:
    """A whole year of 1000 to 2029, else the first one to three digits before underscores, with 9 for each missing digit."""
    partial = F.regexp_extract(c, r"(?U)\b([0-9]{1,3})_+\b", 1)
    return F.coalesce(year_strict(c), _int(F.when(partial != "", F.rpad(partial, 4, "9"))))


def year_strict(c: Column) -> Column:
    return _int(F.regexp_extract(c, r"(?U)\b(1[0-9]{3}|20[0-2][0-9])\b", 1))


def year_query(c: Column) -> Column:
    return _int(F.regexp_extract(c, r"(?<!\d)(1\d{3}|20\d{2})(?!\d)", 1))


def year_any(c: Column) -> Column:
    return _int(F.regexp_extract(c, r"(\d{3,4})", 1))


def year_four(c: Column) -> Column:
    return _int(F.regexp_extract(c, r"(\d{4})", 1))


def from_iso(c: Column) -> Column:
    """``yyyy-mm-dd``, ``yyyy-mm`` and ``yyyy`` (a time may follow); anything else as it is."""
    rx = r"^(\d{4})(?:-(\d{2})(?:-(\d{2}))?)?(?:[T ].*)?\z"
    y, m, d = (F.regexp_extract(c, rx, k) for k in (1, 2, 3))
    return F.when(c.rlike(rx), F.concat_ws(" ", F.when(_int(d) > 0, _int(d).cast("string")), month_name(_int(m)), y)).otherwise(c)


def from_compact(c: Column) -> Column:
    """``yyyymmdd`` with zeros for missing parts."""
    y, m, d = F.substring(c, 1, 4), _int(F.substring(c, 5, 2)), _int(F.substring(c, 7, 2))
    known = m.between(1, 12)
    return F.when(c.rlike(r"^\d{8}\z") & (y != "0000"), F.concat_ws(" ", F.when(known & (d > 0), d.cast("string")), F.when(known, month_name(m)), y)).otherwise("")


def from_slovenian(c: Column) -> Column:
    """``d. m. yyyy``; parts may be question marks."""
    rx = r"^\s*(\d{1,2}|\?+)\.\s*(\d{1,2}|\?+)\.\s*(\d{4})\s*\z"
    d, m, y = _int(F.regexp_extract(c, r"^\s*(\d{1,2})\.", 1)), _int(F.regexp_extract(c, r"\.\s*(\d{1,2})\.", 1)), F.regexp_extract(c, rx, 3)
    return F.when(c.rlike(rx), F.concat_ws(" ", F.when(m.isNotNull() & (d > 0), d.cast("string")), month_name(m), y)).when(strip(c).rlike(r"^\d{4}\z"), strip(c))


def split_life(c: Column) -> Column:
    """Birth and death text at the first dash."""
    parts = F.split(c, "[―–-]", 2)
    return F.struct(strip(F.element_at(parts, 1)).alias("birth"), strip(F.coalesce(F.get(parts, F.lit(1)), F.lit(""))).alias("death"))


def death_in_notes(c: Column) -> Column:
    full = F.regexp_extract(c, r"(?i)umrla?o?\s+(\d{1,2}\.\s*\d{1,2}\.\s*\d{4})", 1)
    year = F.regexp_extract(c, r"(?i)umrla?o?\s+(?:leta\s+)?(\d{4})", 1)
    return F.when(full != "", from_slovenian(full)).otherwise(year)


def years_in_title(c: Column) -> Column:
    return F.regexp_extract(c, r"(\d{4}\s*[-–]\s*\d{4}|\d{4})", 1)
