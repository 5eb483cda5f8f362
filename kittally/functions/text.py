"""Cell-value expressions, ``Column -> Column``, built from native functions only."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import keywords as K

# Whitespace as Unicode text handling sees it; trim() and \s know ASCII blanks only.
WS = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
CJK = r"[\x{4e00}-\x{9fff}\x{3400}-\x{4dbf}]"
CYRILLIC = r"[\x{400}-\x{4ff}]"
LATIN = "[A-Za-z]"
DIGIT = r"\p{Nd}"
DASH = r"[\-\x{2013}\x{2014}\x{2012}\x{2015}]"
ARTEFACT_TAIL = r"(?is)(_x[0-9a-f]{4}_|[\r\n]).*\z"
WS_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008"
    "\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
NOISE_CHARS = WS_CHARS + "-\u2013\u2014\u2012\u2015.,/_;:'\"()[]{}|\\"
PART_NOISE = rf"""[{WS}\-\x{{2013}}\x{{2014}}\x{{2012}}\x{{2015}}.,/_;:'"()\[\]{{}}|\\]+"""
FULL_WIDTH, HALF_WIDTH = "０１２３４５６７８９", "0123456789"
FLOAT_TEXT = (
    r"(?i)^[+-]?(([0-9]+(_[0-9]+)*(\.([0-9]+(_[0-9]+)*)?)?|\.[0-9]+(_[0-9]+)*)(e[+-]?[0-9]+(_[0-9]+)*)?"
    r"|inf|infinity|nan)\z"
)
CARD_NUMBER = (
    r"(?:[A-Za-z]+[0-9]*[A-Za-z]*(?:-[0-9]+)+[A-Za-z0-9_-]*"
    r"|[A-Za-z]{1,3}[0-9]{3,}[A-Za-z0-9_-]*"
    rf"|(?:TP|процесс|операция|card)[{WS}]*-?[{WS}]*[0-9]+)"
)
PREFIX_AS = r"([A-Za-z0-9]+[-_])?[A-Za-z]?[-_]?AS[-_]?[0-9]+"
DECORATIVE = "[☆★●○◆◇■□▲△▼▽♠♣♥♦↗→←↑↓«»„]"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def alternation(words: list[str]) -> str:
    """Regex matching any of the words literally (longest-first is not needed for a test)."""
    return "|".join(re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", w) for w in words)


def has_any(c: Column | str, words: list[str]) -> Column:
    """True where the text contains one of the words."""
    return _col(c).rlike(alternation(words))


def strip(c: Column | str) -> Column:
    """Without blanks at both ends; native trimming costs a fraction of a regex."""
    return F.btrim(_col(c), F.lit(WS_CHARS))


def _head(c: Column | str) -> Column:
    """Stripped text before the first line break or escaped control character.

    Escapes are rare, so their regex runs only where the text can hold one.
    """
    s = strip(c)
    line = F.substring_index(F.substring_index(s, "\n", 1), "\r", 1)
    escaped = F.contains(s, F.lit("_x")) | F.contains(s, F.lit("_X"))
    return F.when(escaped, F.regexp_replace(line, ARTEFACT_TAIL, "")).otherwise(line)


def part_key(c: Column | str) -> Column:
    """Format-free part number: upper-case letters and digits of the first line."""
    return F.coalesce(F.upper(F.translate(_head(c), NOISE_CHARS, "")), F.lit(""))


def quantity(c: Column | str, default: float = 0.0) -> Column:
    """Quantity of a text cell; comma is always the decimal sign."""
    s = strip(_head(c))
    plain = F.translate(s, FULL_WIDTH, HALF_WIDTH)
    return (
        F.when(plain.rlike(r"^[-+]?[0-9]+(?:[.,][0-9]+)?\z"), F.translate(plain, ",", ".").cast("double"))
        .when(s.rlike(rf"^(?:{DASH}{{1,3}}|{DASH}[{WS}]*{DASH})\z"), F.lit(0.0))
        .otherwise(F.lit(float(default)))
    )


def cell_quantity(value: str, num: str, kind: str, default: float = 0.0) -> Column:
    """Quantity of a typed cell: numbers as they are, dates and booleans rejected."""
    return (
        F.when(F.col(kind) == "n", F.col(num))
        .when(F.col(kind) == "s", quantity(value, default))
        .otherwise(F.lit(float(default)))
    )


def _at_least(c: Column, n: int) -> Column:
    """At least ``n`` characters once blanks at both ends are left out (n > 1)."""
    return c.rlike(rf"(?s)[^{WS}].{{{n - 2},}}[^{WS}]")


def is_part(c: Column | str) -> Column:
    """Strict part-number test: letter with digit, or a digit in four characters or more.

    The digit test comes first; it also rules out every garbage word.
    """
    s = _col(c)
    ok = (
        s.rlike(DIGIT)
        & ((s.rlike(LATIN) & _at_least(s, 3)) | _at_least(s, 4))
        & ~s.rlike(f"{CJK}|{CYRILLIC}")
    )
    return F.coalesce(ok, F.lit(False))


def is_part_lenient(c: Column | str) -> Column:
    s = strip(c)
    shape = (
        s.rlike(rf"^[^\n]*{LATIN}") & s.rlike(rf"^[A-Za-z0-9\-./_{WS}]{{3,}}\z")
    ) | s.rlike(rf"^{DIGIT}{{3,}}\z")
    ok = (
        (F.length(s) >= 3)
        & ~F.lower(s).isin(K.GARBAGE)
        & ~s.rlike(f"{CJK}|{CYRILLIC}")
        & shape
    )
    return F.coalesce(ok, F.lit(False))


def clean_name(c: Column | str) -> Column:
    flat = F.regexp_replace(F.translate(_col(c), "\r", ""), f"[{WS}]+", " ")
    return F.coalesce(F.trim(flat), F.lit(""))


def norm_text(c: Column | str) -> Column:
    bare = F.regexp_replace(F.lower(_col(c)), "_x[0-9a-f]{4}_", "")
    return F.trim(F.regexp_replace(bare, f"[{WS}]+", " "))


def clean_cell(c: Column | str) -> Column:
    """Text before the first line break or escaped control character."""
    return F.coalesce(strip(_head(c)), F.lit(""))


def is_numeric_str(c: Column | str) -> Column:
    return F.coalesce(strip(F.replace(_col(c), F.lit(","), F.lit("."))).rlike(FLOAT_TEXT), F.lit(False))


def _numeric_kind(kind: Column | str | None) -> Column:
    return F.lit(False) if kind is None else F.coalesce(_col(kind).isin("n", "b"), F.lit(False))


def score_part(c: Column | str, kind: Column | str | None = None) -> Column:
    """How much a cell looks like a part number, 0 to 1."""
    s = strip(c)
    digit = s.rlike(DIGIT)
    raw = (
        F.when(s.rlike(f"{CJK}|{CYRILLIC}"), -0.3).otherwise(0.0)
        + F.when(s.rlike(LATIN) & digit, 0.6).when(digit & (F.length(s) >= 6), 0.3).otherwise(0.0)
        + F.when(F.contains(s, F.lit("-")), 0.2).otherwise(0.0)
    )
    return F.round(
        F.when(_col(c).isNull(), 0.0)
        .when(_numeric_kind(kind), 0.1)
        .when(F.length(s) < 3, 0.0)
        .when(has_any(F.lower(s), K.VALUE_HEADER_WORD), 0.1)
        .otherwise(F.least(F.greatest(raw, F.lit(0.0)), F.lit(1.0))),
        4,
    )


def score_name(c: Column | str, kind: Column | str | None = None) -> Column:
    """How much a cell looks like a part name, 0 to 1."""
    s = strip(c)
    latin, digit = s.rlike(LATIN), s.rlike(DIGIT)
    raw = (
        F.when(s.rlike(CJK), 0.5).otherwise(0.0)
        + F.when(s.rlike(CYRILLIC), 0.4).otherwise(0.0)
        + F.when(latin & ~digit, 0.3).otherwise(0.0)
        + F.when(F.length(s) > 10, 0.2).otherwise(0.0)
        - F.when(latin & digit, 0.1).otherwise(0.0)
    )
    return F.round(
        F.when(_col(c).isNull() | _numeric_kind(kind) | (F.length(s) < 2), 0.0)
        .when(is_part(s), 0.1)
        .otherwise(F.least(F.greatest(raw, F.lit(0.0)), F.lit(1.0))),
        4,
    )


def score_qty(c: Column | str, kind: Column | str | None = None) -> Column:
    """How much a cell looks like a quantity, 0 to 1."""
    s = strip(c)
    return (
        F.when(_col(c).isNull(), 0.0)
        .when(_numeric_kind(kind), 1.0)
        .when(is_numeric_str(s), 0.9)
        .when(s.rlike(rf"^{DIGIT}+[{WS}]*[^{WS}]"), 0.85)
        .when((F.upper(s) == "S") | (s == "-"), 0.2)
        .otherwise(0.0)
    )


def basename(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), r"(?s)^.*/", "")


def stem(c: Column | str) -> Column:
    """Base name without its extension; leading dots do not start one."""
    return F.regexp_replace(basename(c), r"(?s)^(.*[^.].*)\.[^.]*\z", "$1")


def extension(c: Column | str) -> Column:
    return F.regexp_extract(basename(c), r"(?s)^.*[^.].*(\.[^.]*)\z", 1)


def fix_card_prefix(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), "(?i)^SSQRT", "SQRT")


def _some(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def found_card_number(c: Column | str) -> Column:
    """First card number anywhere in the text, or null."""
    hit = F.regexp_extract(_col(c), f"(?iu)({CARD_NUMBER})", 1)
    return _some(fix_card_prefix(F.btrim(hit, F.lit("- "))))


def card_number(path: Column | str) -> Column:
    """Card number of a file name, by falling specificity."""
    b = stem(path)
    full = F.regexp_extract(b, f"(?iu)^({CARD_NUMBER})", 1)
    return F.coalesce(
        _some(fix_card_prefix(F.btrim(full, F.lit("- ")))),
        _some(F.btrim(F.regexp_extract(b, f"(?i)^({PREFIX_AS})", 1), F.lit("- "))),
        _some(F.regexp_extract(b, "^([A-Za-z]{1,3}[0-9]{2,})", 1)),
        _some(F.regexp_extract(b, rf"^[-_{WS}]?([0-9]{{2,}})(?:[-_{WS}]|\z)", 1)),
        b,
    )


def format_group(path: Column | str) -> Column:
    """Naming family of a file: through the last -AS-, else without trailing digits."""
    b = stem(path)
    return F.coalesce(
        _some(F.regexp_extract(b, "(?is)^(.*-AS-)", 1)),
        _some(F.regexp_replace(b, r"[0-9]+\z", "")),
        b,
    )


def decode_config_cell(marker: Column | str, qty_cell: Column | str, has_qty: Column | bool = True) -> Column:
    """Quantity meant by a configuration cell; null where the part is absent."""
    m = strip(F.coalesce(_col(marker), F.lit("")))
    has_qty = F.lit(has_qty) if isinstance(has_qty, bool) else has_qty
    return (
        F.when((F.upper(m) == "S") & has_qty, quantity(qty_cell))
        .when(m.isin("-", "–", "—", ""), F.lit(None).cast("double"))
        .otherwise(quantity(m))
    )


def is_service_sheet(c: Column | str) -> Column:
    return has_any(F.lower(_col(c)), K.SERVICE_SHEET)


def false_part_header(c: Column | str) -> Column:
    """The short part word preceded by a word that changes its meaning."""
    at = F.instr(_col(c), K.FALSE_PART_WORD)
    hits = [
        (F.instr(_col(c), p) > 0) & (F.instr(_col(c), p) < at) for p in K.FALSE_PART_PREFIX
    ]
    return F.coalesce((at > 0) & reduce(lambda a, b: a | b, hits), F.lit(False))


def part_header_hit(c: Column | str) -> Column:
    """Contains a part word that is not a false positive."""
    others = [w for w in K.PART_NO if w != K.FALSE_PART_WORD]
    return has_any(c, others) | (F.contains(_col(c), F.lit(K.FALSE_PART_WORD)) & ~false_part_header(c))


def part_header_rank(c: Column | str) -> Column:
    """Position in the word list of the first part word contained; null without one."""
    v = _col(c)
    words = F.array(*[F.lit(w) for w in K.PART_NO])
    usable = F.filter(
        words, lambda w: F.contains(v, w) & ((w != K.FALSE_PART_WORD) | ~false_part_header(v))
    )
    return F.nullif(F.array_position(words, F.try_element_at(usable, F.lit(1))), F.lit(0))


def safe_filename(c: Column | str) -> Column:
    s = F.regexp_replace(_col(c), r'[<>:"/\\|?*\x00-\x1f]', "_")
    s = F.regexp_replace(F.regexp_replace(s, DECORATIVE, ""), "[_ .]{2,}", "_")
    return F.btrim(s, F.lit("_ ."))


def utf8_prefix(c: Column, size: Column) -> Column:
    """Longest prefix of at most ``size`` bytes that ends on a character."""
    raw = F.encode(c, "UTF-8")

    def continues(at: Column) -> Column:
        return F.hex(F.substring(raw, at, F.lit(1))).between("80", "BF")

    cut = (
        F.when(~continues(size + 1) | (F.octet_length(c) <= size), size)
        .when(~continues(size), size - 1)
        .when(~continues(size - 1), size - 2)
        .otherwise(size - 3)
    )
    return F.decode(F.substring(raw, F.lit(1), F.greatest(cut, F.lit(0))), "UTF-8")


def safe_name(c: Column | str, max_bytes: int = 200) -> Column:
    """Name within ``max_bytes``: cut base, eight digest characters, extension kept."""
    s = _col(c)
    base = F.regexp_replace(s, r"(?s)^(.*[^./][^/]*)\.[^./]*\z", "$1")
    ext = F.substr(s, F.length(base) + 1)
    room = F.lit(max_bytes) - F.octet_length(ext) - 9
    digest = F.concat(F.lit("_"), F.substring(F.md5(F.encode(s, "UTF-8")), 1, 8))
    return (
        F.when(F.octet_length(s) <= max_bytes, s)
        .when(room <= 0, utf8_prefix(s, F.lit(max_bytes)))
        .otherwise(F.concat(utf8_prefix(base, room), digest, ext))
    )


def short_label(c: Column | str, n: int) -> Column:
    s = _col(c)
    return F.when(F.length(s) > n, F.concat(F.substring(s, 1, n - 3), F.lit("..."))).otherwise(s)


def percent(processed: Column | str, failed: Column | str, total: Column | str) -> Column:
    share = (_col(processed) + _col(failed)) / _col(total) * 100
    return F.when(_col(total) > 0, F.bround(share, 1)).otherwise(0.0)


def formats_equal(a: Column | str, b: Column | str) -> Column:
    return part_key(a) == part_key(b)
