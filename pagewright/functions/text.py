"""Text cleaners and extractors as Column functions. All are null for null input.

Java's ``\\s`` is ASCII and Spark's ``trim`` strips blanks only, hence ``(?U)`` and ``strip`` wherever white space may
be Unicode's.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

BULLET_POINTS = (0x2D, 0x2A, 0x95, 0xB7, 0x2022, 0x2023, 0x2043, 0x204C, 0x204D, 0x2219, 0x25CB, 0x25CF, 0x25D8, 0x25E6, 0x2619, 0x2765, 0x2767, 0x29BE, 0x29BF, 0x3164, 0xF0B7)
BULLET = "[" + "".join(f"\\u{c:04X}" for c in BULLET_POINTS) + "]"
LEADING_BULLET = f"^{BULLET}(?!{BULLET})"
E_BULLET = r"(?m)^e(?=\s)"
PARAGRAPH = r"(?U)\s*\n\s*"
EMAIL = r"[a-z0-9.\-+_]+@[a-z0-9.\-+_]+\.[a-z]+"
OCTETS = r"[0-9]{1,2}(?:\.[0-9]{1,2}){3}"
IP_ADDRESS = rf"(?:{OCTETS}|[a-z0-9]{{4}}:(?::[a-z0-9]{{4}}){{4}}%?[0-9]*)"
IP_NAME = r"[a-zA-Z0-9-]*(?:\.[a-zA-Z]*){2}"
MAPI_ID = r"[0-9]*(?:\.[0-9]*){3};"
MAIL_DATE = r"[A-Za-z]{3},\s(\d{1,2}\s[A-Za-z]{3}\s\d{4}\s\d{2}:\d{2}:\d{2}\s[+-]\d{4})"
PHONE = r"(?:\+?(\d{1,3}))?[-. (]*(\d{3})?[-. )]*(\d{3})[-. ]*(\d{4})(?: *x(\d+))?\s*\z"


def strip(t: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(t, r"(?U)^\s+|\s+$", "")


def clean_non_ascii_chars(t: Column) -> Column:
    return F.regexp_replace(t, r"[^\x00-\x7F]", "")


def clean_bullets(t: Column) -> Column:
    """Without one bullet at the very start; text that starts otherwise is left as it is."""
    return F.when(t.rlike(LEADING_BULLET), strip(F.regexp_replace(t, LEADING_BULLET, ""))).otherwise(t)


def clean_ordered_bullets(t: Column) -> Column:
    """Without a leading section mark such as ``1.1`` or ``a.``: a first word with a dot, no two dots in a row, and two
    characters at most before the first dot. Words are joined by single blanks then."""
    words = F.filter(F.split(strip(t), r"(?U)\s+"), lambda w: w != "")
    head = F.get(words, F.lit(0))
    rest = F.array_join(F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), " ")
    return F.when(head.contains(".") & ~head.contains("..") & (F.length(F.substring_index(head, ".", 1)) <= 2), rest).otherwise(t)


def clean_extra_whitespace(t: Column) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(t, r"[ \n]", " "), " {2,}", " "))


def clean_dashes(t: Column) -> Column:
    return strip(F.regexp_replace(t, r"[-–]", " "))


def clean_trailing_punctuation(t: Column) -> Column:
    return F.regexp_replace(strip(t), r"[.,:;]+\z", "")


def clean(t: Column, extra_whitespace: bool = False, dashes: bool = False, bullets: bool = False, trailing_punctuation: bool = False, lowercase: bool = False) -> Column:
    """The chosen cleaners, always in this order: case, trailing punctuation, dashes, white space, bullets."""
    for wanted, step in ((lowercase, F.lower), (trailing_punctuation, clean_trailing_punctuation), (dashes, clean_dashes), (extra_whitespace, clean_extra_whitespace), (bullets, clean_bullets)):
        if wanted:
            t = step(t)
    return strip(t)


def clean_prefix(t: Column, pattern: str, ignore_case: bool = False, strip_after: bool = True) -> Column:
    out = F.regexp_replace(t, f"{'(?i)' if ignore_case else ''}^(?:{pattern})", "")
    return F.regexp_replace(out, r"(?U)^\s+", "") if strip_after else out


def clean_postfix(t: Column, pattern: str, ignore_case: bool = False, strip_after: bool = True) -> Column:
    out = F.regexp_replace(t, f"{'(?i)' if ignore_case else ''}(?:{pattern})$", "")
    return F.regexp_replace(out, r"(?U)\s+$", "") if strip_after else out


def remove_punctuation(t: Column) -> Column:
    return F.regexp_replace(t, r"\p{P}", "")


#: Windows-1252 quotes, and UTF-8 punctuation that was read as another encoding; the order matters.
_E2 = "â\u0080"
_QUOTES = [
    *zip("\u0091\u0092\u0093\u0094", "‘’“”"),
    ("&apos;", "'"),
    (_E2 + "\u0099", "'"),
    *((_E2 + a, b) for a, b in zip("“”˜¦™œ?ťś¨łŽ‚‰‹", [*"—–‘…’“””“—″", "", "", "", ""])),
    (_E2, ""),
]


def replace_unicode_quotes(t: Column) -> Column:
    for wrong, right in _QUOTES:
        t = F.replace(t, F.lit(wrong), F.lit(right))
    return t


@F.pandas_udf(StringType())
def _quoted_printable(s):  # noqa: ANN001, ANN202
    import quopri

    return s.map(lambda x: None if x is None else quopri.decodestring(x.encode()).decode("utf-8", "replace"))


def replace_mime_encodings(t: Column) -> Column:
    """Quoted-printable decoding; the one scalar here that leaves the JVM, for rows with an equals sign only."""
    return F.when(t.contains("="), _quoted_printable(F.when(t.contains("="), t))).otherwise(t)


def bytes_string_to_string(t: Column, encoding: str = "UTF-8") -> Column:
    """Text whose characters are byte values, decoded as those bytes; null where a character isn't one or where the bytes
    don't fit the encoding."""
    fits = t.rlike(r"\A[\x00-\xFF]*\z")
    raw = F.encode(F.when(fits, t), "ISO-8859-1")
    if encoding.upper().replace("_", "-") in ("UTF-8", "UTF8"):
        return F.try_validate_utf8(raw.cast("string"))

    @F.pandas_udf(StringType())
    def decoded(s):  # noqa: ANN001, ANN202
        def one(x):  # noqa: ANN001, ANN202
            try:
                return None if x is None else bytes(x).decode(encoding)
            except UnicodeDecodeError:
                return None

        return s.map(one)

    return decoded(raw)


def norm_text(t: Column) -> Column:
    return strip(F.regexp_replace(t, r"(?U)\s+", " "))


def extract_text_before(t: Column, pattern: str, index: int = 0, strip_after: bool = True) -> Column:
    """Text before the match of that number; null where there is none."""
    out = _around(t, pattern, index, 1)
    return F.regexp_replace(out, r"(?U)\s+$", "") if strip_after else out


def extract_text_after(t: Column, pattern: str, index: int = 0, strip_after: bool = True) -> Column:
    """Text after the match of that number; null where there is none."""
    out = _around(t, pattern, index, 2)
    return F.regexp_replace(out, r"(?U)^\s+", "") if strip_after else out


def _around(t: Column, pattern: str, index: int, group: int) -> Column:
    plain = pattern.replace("(?:", "(").replace("\\(", "")
    if "(" in plain.replace("(?", ""):
        raise ValueError("write groups as (?:...)")
    whole = rf"(?s)\A((?:.*?(?:{pattern})){{{index}}}.*?)(?:{pattern})(.*)\z"
    return F.when(t.rlike(whole), F.regexp_extract(t, whole, group))


def nth_match(t: Column, pattern: str, index: int = 0) -> Column:
    """The match of that number, from 0; null where there is none."""
    return F.get(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), F.lit(index))


def extract_email_address(t: Column) -> Column:
    return F.regexp_extract_all(F.lower(t), F.lit(EMAIL), F.lit(0))


def extract_ip_address(t: Column) -> Column:
    """Octets have two digits at most, as in received-headers written so."""
    return F.regexp_extract_all(t, F.lit(IP_ADDRESS), F.lit(0))


def extract_ip_address_name(t: Column) -> Column:
    return F.regexp_extract_all(t, F.lit(IP_NAME), F.lit(0))


def extract_mapi_id(t: Column) -> Column:
    return F.transform(F.regexp_extract_all(t, F.lit(MAPI_ID), F.lit(0)), lambda x: F.replace(x, F.lit(";"), F.lit("")))


def extract_datetimetz(t: Column) -> Column:
    """The first mail date, as a timestamp. The weekday is matched but not parsed."""
    return F.try_to_timestamp(F.nullif(F.regexp_extract(t, MAIL_DATE, 1), F.lit("")), F.lit("d MMM yyyy HH:mm:ss Z"))


def convert_to_iso_8601(t: Column) -> Column:
    return F.date_format(extract_datetimetz(t), "yyyy-MM-dd'T'HH:mm:ssXXX")


def extract_us_phone_number(t: Column) -> Column:
    """A number at the end of the text; empty where there is none."""
    return strip(F.regexp_extract(t, PHONE, 0))


def contains_us_phone_number(t: Column) -> Column:
    return t.rlike(PHONE)


def extract_ordered_bullets(t: Column) -> Column:
    """A struct of up to three levels of a leading section mark: ``a.1 text`` gives (a, 1, null)."""
    head = F.get(F.split(strip(t), r"(?U)\s+"), F.lit(0))
    parts = F.filter(F.split(head, r"\."), lambda p: p != "")
    good = head.contains(".") & ~head.contains("..") & (F.length(F.get(parts, F.lit(0))) <= 2)
    level = lambda i: F.when(good, F.get(parts, F.lit(i)))
    return F.struct(level(0).alias("section"), level(1).alias("sub_section"), level(2).alias("sub_sub_section"))


def half_to_full_width(lines: Column) -> Column:
    """Lines (an array) with full-width punctuation and without blanks; straight quotes alternate between opening and
    closing over all lines."""
    flat = F.translate(F.array_join(lines, "\n"), ",!() ", "，！（）")
    for mark, pair in (('"', "“”"), ("'", "‘’")):
        flat = _alternate(flat, mark, *pair)
    return F.split(flat, "\n")


def _alternate(t: Column, mark: str, opening: str, closing: str) -> Column:
    def put(part: Column, i: Column) -> Column:
        return F.when(i == 0, part).otherwise(F.concat(F.when(i % 2 == 1, F.lit(opening)).otherwise(F.lit(closing)), part))

    return F.array_join(F.transform(F.split(t, mark), put), "")


def join_lines(lines: Column, language: str = "eng", is_table: bool = False) -> Column:
    """Lines of a block as one text. Table lines keep their breaks. English: a hyphen at a line's end is dropped with
    the break, otherwise a blank goes between. Chinese: nothing goes between."""
    if is_table:
        return F.array_join(lines, "\n")
    if language == "zh":
        return F.array_join(lines, "")
    fold = F.aggregate(
        lines,
        F.lit(""),
        lambda acc, x: F.when(acc == "", x)
        .when(acc.rlike(r"[A-Za-z]-$") & x.rlike("^[a-z]"), F.concat(F.substring(acc, F.lit(1), F.length(acc) - 1), x))
        .when(acc.rlike(r"[\p{L}\p{N}\p{P}]$") & x.rlike(r"^[\p{L}\p{N}\p{P}]"), F.concat(acc, F.lit(" "), x))
        .otherwise(F.concat(acc, x)),
    )
    return F.when(lines.isNotNull(), fold)


def normalize_encoding(t: Column) -> Column:
    """An encoding's name in lower case with underscores, ``-i`` and ``-e`` taken off the ISO-8859-6 and -8 variants."""
    low = F.replace(F.lower(t), F.lit("_"), F.lit("-"))
    return F.replace(F.regexp_replace(low, r"^(iso-8859-[68])-[ie]$", "$1"), F.lit("-"), F.lit("_"))


def is_zh_char_share(t: Column) -> Column:
    """The number of CJK characters."""
    return F.length(F.regexp_replace(t, r"[^一-龥]", ""))
