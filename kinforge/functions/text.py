"""Name, place, identifier, URL and collation functions as Column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: fixed values: words that stand for an unknown name
STUBS = ("UNKNOWN", "UNNAMED", "NEZNAN", "XXY", "XXX", "XX", "XY")
#: fixed values: words that join names and stay in lower case inside them
PARTICLES = "de da di du des del della dei dos das do von van vom vor der den ten ter te la le les v. vd. of the y e".split()
#: fixed values: beginnings of names that keep a capital letter behind them
PREFIXES = "Mac Mc M' De Di Da Du Van Von Der Den Ten La Le L' St St. O' D'".split()
#: fixed values: collation offsets of Slavic letters behind their base letter
SLAVIC = {"č": ("c", 0x7D), "ć": ("c", 0x7E), "đ": ("d", 0x7F), "š": ("s", 0x7F), "ž": ("z", 0x7F)}


def strip(c: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+\z", "")


def name_is_placeholder(c: Column) -> Column:
    """Signs only, a word for unknown, two N or one letter three times and more; signs around do not count."""
    core = F.upper(F.regexp_replace(c, r"(?U)^[_.?,\s\-()\[\]<>]+|[_.?,\s\-()\[\]<>]+\z", ""))
    signs = (strip(c) != "") & c.rlike(r"(?U)^[_.?,\s/\-()\[\]<>]+\z")
    return signs | core.isin(*STUBS) | core.rlike(r"(?U)^N[\s.]*N\z") | core.rlike(r"^([A-Z])\1{2,}\z")


def name_pieces(c: Column) -> Column:
    """The surnames with their slashes and the texts between them, in order; a last slash without a partner is text."""
    return F.regexp_extract_all(c, F.lit(r"/[^/]*/|[^/]+(?:/[^/]*\z)?|/[^/]*\z"), F.lit(0))


def _is_surname(piece: Column) -> Column:
    return piece.rlike(r"^/[^/]*/\z")


def _inner(piece: Column) -> Column:
    return strip(F.replace(piece, F.lit("/"), F.lit("")))


def normalize_name(c: Column) -> Column:
    """Single spaces, also inside the slashes that hold the surname."""
    one = strip(F.regexp_replace(c, r"(?U)\s+", " "))
    return F.regexp_replace(one, r"/ ?([^/]*?) ?/", "/$1/")


def name_parts(c: Column) -> Column:
    """``given, surname``; a suffix behind the surname goes to the given name."""
    given = strip(F.regexp_extract(c, r"^([^/]*)", 1))
    tail = strip(F.regexp_extract(c, r"^[^/]*/[^/]*/(.*)$", 1))
    return F.struct(strip(F.concat_ws(" ", F.nullif(given, F.lit("")), F.nullif(tail, F.lit("")))).alias("given"), strip(F.regexp_extract(c, r"/([^/]*)/", 1)).alias("surname"))


def clean_name_placeholder(c: Column) -> Column:
    """Unknown or empty given names and surnames become NN; a name with nothing real becomes NN alone."""
    pieces = name_pieces(c)
    given = strip(F.array_join(F.filter(pieces, lambda p: ~_is_surname(p)), ""))
    has_given = (given != "") & ~name_is_placeholder(given)

    def known(p: Column) -> Column:
        inner = F.regexp_replace(p, "^/|/\\z", "")
        surname = F.when(name_is_placeholder(inner) | (strip(inner) == "") & has_given, "/NN/").otherwise(p)
        return F.when(_is_surname(p), surname).when(name_is_placeholder(p), F.regexp_replace(p, r"(?U)\S(?:.*\S)?", "NN")).otherwise(p)

    new = F.transform(pieces, known)
    real = F.exists(new, lambda p: ~_inner(p).isin("", "NN"))
    none_given = F.forall(new, lambda p: _is_surname(p) | (strip(p) == ""))
    whole = normalize_name(F.array_join(new, ""))
    paired = F.exists(pieces, _is_surname)
    in_parts = F.when(~real, "NN").when(none_given, F.concat(F.lit("NN "), whole)).otherwise(whole)
    return F.when(c == "", c).when(paired, in_parts).when(name_is_placeholder(c), "NN").otherwise(normalize_name(c))


def title_words(c: Column) -> Column:
    """Each run of letters with a capital first letter: hyphens and apostrophes begin a new one."""
    pieces = F.regexp_extract_all(c, F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0))
    return F.array_join(F.transform(pieces, lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.lower(F.substring(w, F.lit(2), F.length(w))))), "")


def title_surname(c: Column) -> Column:
    return F.array_join(F.transform(F.split(c, " "), lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.lower(F.substring(w, F.lit(2), F.length(w))))), " ")


def _name_case(segment: Column) -> Column:
    """The words of a segment in title case; particles behind the first word are lower case, texts in parentheses stay."""
    tokens = F.regexp_extract_all(segment, F.lit(r"(?U)\([^)]*\)|[^\s(]+|\s+|\("), F.lit(0))
    first = F.array_position(F.transform(tokens, lambda t: t.rlike(r"(?U)^[^\s(]")), True) - 1
    kept = r"^(?:" + "|".join(p.replace(".", r"\.") for p in PREFIXES) + r")\p{Lu}\P{Lu}*\z"

    def cased(t: Column, i: Column) -> Column:
        particle = F.when(i == first, title_words(t)).otherwise(F.lower(t))
        return (
            F.when(t.rlike(r"(?U)^[\s(]"), t).when(F.upper(t) == "NN", "NN").when(t.rlike(kept) & (t != F.upper(t)), t)
            .when(F.lower(t).isin(*PARTICLES), particle).otherwise(title_words(t))
        )

    return F.array_join(F.transform(tokens, cased), "")


def capitalize_name(c: Column) -> Column:
    """Each surname and each text between surnames in name case, with normal white space."""
    cased = F.transform(name_pieces(c), lambda p: F.when(_is_surname(p), F.concat(F.lit("/"), _name_case(F.regexp_replace(p, "^/|/\\z", "")), F.lit("/"))).otherwise(_name_case(p)))
    return F.when(strip(c) == "", c).otherwise(normalize_name(F.array_join(cased, "")))


def lower_if_shouted(c: Column) -> Column:
    """Name case for names without lower-case letters; others only with normal white space."""
    shouted = c.rlike(r"\p{L}") & ~c.rlike(r"\p{Ll}")
    return F.when(strip(c) == "", c).when(shouted, capitalize_name(c)).otherwise(normalize_name(c))


def initials(c: Column) -> Column:
    words = F.filter(F.split(strip(c), r"\s+"), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.lit("."))), " ")


def shorten_name(c: Column) -> Column:
    """``L. /R./``: initials with the slashes kept."""
    p = name_parts(c)
    given = initials(F.regexp_extract(c, r"^([^/]*)", 1))
    return F.when(c.contains("/"), strip(F.concat_ws(" ", F.nullif(given, F.lit("")), F.concat(F.lit("/"), initials(p["surname"]), F.lit("/"))))).otherwise(initials(c))


def shorten_given(c: Column) -> Column:
    """``L. /Renko/``: the surname in full."""
    given = initials(F.regexp_extract(c, r"^([^/]*)", 1))
    return F.when(c.contains("/"), F.concat_ws(" ", F.nullif(given, F.lit("")), F.regexp_extract(c, r"(/[^/]*/)", 1))).otherwise(initials(c))


def sex_code(c: Column) -> Column:
    v = F.upper(strip(c))
    return F.when(v.startswith("M"), "m").when(v.startswith("F"), "f").otherwise("")


def _plain(letter: str) -> str:
    return "".join(x for x in unicodedata.normalize("NFD", letter.lower()) if unicodedata.category(x) != "Mn")


#: letters without their marks, in lower case; marks on their own, which go, stand last
PLAIN = {c: f for c, f in ((c, _plain(c)) for c in map(chr, range(0x41, 0x10000)) if not 0xD800 <= ord(c) < 0xE000) if c != f and len(f) < 2}


def fold(c: Column) -> Column:
    """Lower case without accents."""
    marked = sorted(PLAIN, key=lambda x: PLAIN[x] == "")
    return F.translate(c, "".join(marked), "".join(PLAIN[x] for x in marked))


# -- places
def place_placeholder(c: Column) -> Column:
    return F.when(c.rlike(r"^[_.?,/\-()\[\]<> ]+\z"), "").otherwise(c)


def place_without_country(c: Column, country: str = r"Sloveni(?:ja|a)") -> Column:
    """The text before the country's name, without separators at the ends."""
    cut = F.regexp_replace(c, rf"(?is),?\s*{country}\b.*", "")
    return F.regexp_replace(cut, r"^[, ]+|[, ]+\z", "")


def place_parts(c: Column) -> Column:
    return F.transform(F.split(c, ","), strip)


def place_duplicates(c: Column) -> Column:
    parts = place_parts(c)
    kept = F.filter(parts, lambda x, i: (i == 0) | (F.lower(x) != F.lower(F.get(parts, i - 1))))
    return F.when(F.size(kept) < F.size(parts), F.array_join(kept, ", ")).otherwise(c)


def place_ends(c: Column) -> Column:
    """First and last part of more than two."""
    parts = place_parts(c)
    return F.when(F.size(parts) > 2, F.concat_ws(", ", F.element_at(parts, 1), F.element_at(parts, -1))).otherwise(c)


def build_place(*parts: Column) -> Column:
    return F.concat_ws(", ", *[F.nullif(strip(p), F.lit("")) for p in parts])


# -- identifiers and URLs
def stable_id(*fields: Column) -> Column:
    return F.substring(F.md5(F.concat_ws("\x1f", *[F.coalesce(f.cast("string"), F.lit("")) for f in fields]).cast("binary")), 1, 8)


def find_urls(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"https?://[^\s<>\"']+"), F.lit(0))


def url_host(c: Column) -> Column:
    return F.lower(F.regexp_extract(c, r"^[a-zA-Z]+://([^/?#]*)", 1))


def domain(c: Column) -> Column:
    """The last two labels of the host."""
    labels = F.split(url_host(c), r"\.")
    return F.when(F.size(labels) > 1, F.concat_ws(".", F.element_at(labels, -2), F.element_at(labels, -1))).otherwise(url_host(c))


def domain_path(c: Column, levels: int = 1) -> Column:
    path = F.filter(F.split(F.regexp_extract(c, r"^[a-zA-Z]+://[^/?#]*([^?#]*)", 1), "/"), lambda x: x != "")
    return F.concat_ws("/", F.concat(F.array(url_host(c)), F.slice(path, 1, levels)))


def url_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), r"/+\z", "")


# -- collation
def _first(letter: str) -> str:
    """What a letter of a case-folded text is sorted as: the base of its canonical decomposition."""
    return unicodedata.normalize("NFD", letter)[0]


#: sort forms by letter, for the letters whose form is another: those of one letter and those of several, as for a sharp s
FORMS = {c: "".join(x if x in SLAVIC else _first(x) for x in c.casefold()) for c in map(chr, range(0x41, 0x10000)) if not 0xD800 <= ord(c) < 0xE000}
SINGLE = {c: f for c, f in FORMS.items() if len(f) == 1 and c != f}
SEVERAL = {c: f for c, f in FORMS.items() if len(f) > 1}


def collation_key(c: Column) -> Column:
    """Case-folded base letters, with č, ć behind c, đ behind d, š behind s, ž behind z."""
    out = F.translate(c, "".join(SINGLE), "".join(SINGLE.values()))
    for letter, (base, offset) in SLAVIC.items():
        out = F.replace(out, F.lit(letter), F.lit(base + chr(offset)))
    pairs = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")) for k, v in SEVERAL.items()])
    return F.when(out.rlike(f"[{''.join(SEVERAL)}]"), F.aggregate(pairs, out, lambda t, p: F.replace(t, p["k"], p["v"]))).otherwise(out)
