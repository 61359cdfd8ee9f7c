"""Character sets that Python has no codec for, and the choice of one from a file's bytes."""

from __future__ import annotations

import re
import unicodedata

#: fixed values: letters and signs of the library character set of older tree files, by byte
ANSEL_SIGNS = {
    0xA1: "Ł", 0xA2: "Ø", 0xA3: "Đ", 0xA4: "Þ", 0xA5: "Æ", 0xA6: "Œ", 0xA7: "ʹ", 0xA8: "·", 0xA9: "♭", 0xAA: "®", 0xAB: "±", 0xAC: "Ơ", 0xAD: "Ư", 0xAE: "ʼ",
    0xB0: "ʻ", 0xB1: "ł", 0xB2: "ø", 0xB3: "đ", 0xB4: "þ", 0xB5: "æ", 0xB6: "œ", 0xB7: "ʺ", 0xB8: "ı", 0xB9: "£", 0xBA: "ð", 0xBC: "ơ", 0xBD: "ư", 0xBE: "□", 0xBF: "■",
    0xC0: "°", 0xC1: "ℓ", 0xC2: "℗", 0xC3: "©", 0xC4: "♯", 0xC5: "¿", 0xC6: "¡", 0xC7: "ß", 0xC8: "€", 0xCD: "e", 0xCE: "o", 0xCF: "ß",
}
#: fixed values: its marks, which stand before their letter, from byte 0xE0 on
ANSEL_MARKS = dict(enumerate((
    0x0309, 0x0300, 0x0301, 0x0302, 0x0303, 0x0304, 0x0306, 0x0307, 0x0308, 0x030C, 0x030A, 0xFE20, 0xFE21, 0x0315, 0x030B, 0x0310,
    0x0327, 0x0328, 0x0323, 0x0324, 0x0325, 0x0333, 0x0332, 0x0326, 0x031C, 0x032E, 0xFE22, 0xFE23, 0x0338, 0xFFFD, 0x0313, 0xFFFD,
), 0xE0))
#: fixed values: letters that one vendor writes as a prefix letter and a byte; the prefix A
PREFIX_A = {
    0x21: "š", 0x31: "Ž", 0x32: "ň", 0x33: "ž", 0x3F: "í", 0x5E: "Č", 0x7E: "Ř", 0x81: "Á", 0x84: "Ä", 0x85: "Å", 0x86: "Ć", 0x89: "É", 0x90: "Đ", 0x91: "ń", 0x92: "Ś", 0x93: "ś",
    0x96: "Ö", 0x97: "ď", 0x99: "ů", 0x9A: "Ú", 0xA0: "Š", 0xA4: "ä", 0xA6: "ć", 0xA7: "ç", 0xA8: "č", 0xA9: "é", 0xAB: "ë", 0xAC: "ě", 0xAD: "í", 0xAE: "î", 0xB0: "đ", 0xB1: "ñ",
    0xB4: "ô", 0xB5: "ő", 0xB6: "ö", 0xB8: "ř", 0xBB: "ü", 0xC2: "Ą",
}
#: fixed values: the same with the prefix byte 0xC2
PREFIX_C2 = {0x31: "ą", 0x33: "ł", 0x3F: "ż", 0x4C: "Ł", 0x61: "ş", 0x6F: "ș", 0x97: "Ż"}
#: fixed values: bytes of another code page among windows-1250, and what stands for them there
DOS_BYTES = bytes.maketrans(b"\x81\x83\x88\x90\x98", b"\xfc\xe2\xea\xc9\xff")
#: pairs of prefix and byte from which a file counts as written that way
MANY_PAIRS = 50

_PAIRS = re.compile(b"A[" + b"".join(re.escape(bytes([b])) for b in PREFIX_A if b > 0x7F) + b"]")
_SLAVIC = re.compile(rb"[\x9a\x9e\x8a\x8e\xe8\xc8]")
_DISGUISED = re.compile(rb"[\x00-\x7f][\x9a\x9e\x8a\x8e]|[\xe8\xc8][\x00-\x7f]")
_ANSEL = {b: ANSEL_SIGNS.get(b, "�") for b in range(0x80, 0xE0)} | ANSEL_MARKS
_MARKED = re.compile("([" + "".join(chr(c) for c in sorted(set(ANSEL_MARKS.values()) - {0xFFFD})) + "]+)(.)", re.S)
_PREFIXED = re.compile(rb"A([" + b"".join(re.escape(bytes([b])) for b in PREFIX_A) + rb"])|\xc2([" + b"".join(re.escape(bytes([b])) for b in PREFIX_C2) + rb"])|([\x80-\xff])", re.S)


def looks_like_1250(raw: bytes) -> bool:
    """Bytes of š, ž, č where UTF-8 cannot have them."""
    return bool(_DISGUISED.search(raw))


def from_ansel(raw: bytes) -> str:
    return unicodedata.normalize("NFC", _MARKED.sub(r"\2\1", raw.decode("latin-1").translate(_ANSEL)))


def is_ansel(raw: bytes) -> bool:
    """Its bytes 0x80 to 0x9F mean nothing: a file that has them is in another set, whatever its header says."""
    return not re.search(rb"[\x80-\x9f]", raw)


def has_prefix_letters(raw: bytes, header: str | None) -> bool:
    """Many pairs, no fewer than the Slavic letters of windows-1250, and a header that says UTF-8 or nothing."""
    if header not in (None, "UTF-8", "UTF8"):
        return False
    pairs = sum(1 for _ in _PAIRS.finditer(raw))
    return pairs >= MANY_PAIRS and pairs >= sum(1 for _ in _SLAVIC.finditer(raw))


def from_prefix_letters(raw: bytes) -> str:
    """Pairs become their letters, other high bytes those of windows-1250."""
    at, out = 0, []
    for m in _PREFIXED.finditer(raw):
        out.append(raw[at : m.start()].decode("ascii"))
        at = m.end()
        out.append(PREFIX_A[m[1][0]] if m[1] else PREFIX_C2[m[2][0]] if m[2] else m[3].decode("cp1250", "replace"))
    return "".join([*out, raw[at:].decode("ascii")])


#: letters of western languages whose bytes are rare letters in windows-1250, and letters of windows-1250 the other way round
_WESTERN, _CENTRAL = re.compile("[àêñåøãòùÀÊÅØ]"), re.compile("[ćđőűłżśźĆĐŐŰŁŻŚŹ]")
_CYRILLIC = re.compile(rb"[\xc0-\xff]{2,}")


def guessed(raw: bytes) -> str:
    """The likeliest codec: UTF-8 if it fits; Cyrillic if high bytes stand in runs; else by which letters they would be.

    Where nothing speaks for another one it is windows-1250.
    """
    try:
        raw.decode("utf-8")
        return "utf-8"
    except UnicodeDecodeError:
        pass
    high = len(re.findall(rb"[\x80-\xff]", raw))
    in_runs = sum(len(m.group()) for m in _CYRILLIC.finditer(raw))
    if high >= 20 and in_runs > 0.8 * high:
        return "cp1251"
    if looks_like_1250(raw):
        return "cp1250"
    west, central = raw.decode("cp1252", "replace"), raw.decode("cp1250", "replace")
    return "cp1252" if len(_WESTERN.findall(west)) > 2 * len(_CENTRAL.findall(central)) + 1 else "cp1250"
