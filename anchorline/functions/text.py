"""Text columns: trimming and lengths by UTF-16 units, XML text and attributes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .base import let

#: White space that is trimmed, beyond ASCII also Unicode spaces and the byte-order mark.
SPACE = r" \t\n\x0B\f\r\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"
SPACES = " \t\n\x0b\f\r\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"


def js_trim(text: Column) -> Column:
    """``text`` without white space at its ends."""
    return F.btrim(text, F.lit(SPACES))


def collapse(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, f"[{SPACE}]+", " "))


def js_length(text: Column) -> Column:
    """Length in UTF-16 units."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def js_left(text: Column, units: Column | int) -> Column:
    """The first ``units`` UTF-16 units; half a surrogate pair at the end is left out."""
    units = F.lit(units) if isinstance(units, int) else units
    coded = F.encode(text, "UTF-16BE")
    split_pair = F.hex(F.substring(coded, 2 * units - 1, F.lit(1))).between("D8", "DB")
    cut = F.decode(F.substring(coded, F.lit(1), 2 * F.when(split_pair, units - 1).otherwise(units)), "UTF-16BE")
    return F.when(units <= 0, "").when(F.length(text) == js_length(text), F.substring(text, F.lit(1), units)).otherwise(cut)


def _numeric(text: Column, pattern: str, to_hex) -> Column:
    """Character references that match ``pattern`` (digits in group 1) decoded; ones that name no character stay."""
    def decoded(part: Column) -> Column:
        digits = F.regexp_replace(F.regexp_extract(part, f"(?i)^{pattern}", 1), "^0+(?=.)", "")
        return let(F.struct(digits.alias("digits"), to_hex(digits).alias("code")), lambda d: named(part, d["digits"], d["code"]))

    def named(part: Column, digits: Column, code: Column) -> Column:
        good = (digits != "") & (F.length(code) <= 6) & (F.lpad(code, 6, "0") <= "10FFFF") & ~F.lpad(code, 6, "0").between("00D800", "00DFFF")
        return F.when(good, F.concat(F.decode(F.unhex(F.lpad(code, 8, "0")), "UTF-32"), F.regexp_replace(part, f"(?i)^{pattern}", ""))).otherwise(part)

    return let(text, lambda t: F.when(F.contains(t, F.lit("&#")), F.array_join(F.transform(F.split(t, f"(?i)(?={pattern})"), decoded), "")).otherwise(t))


def unescaped(text: Column) -> Column:
    """As :func:`xml_unescape`, for a ``text`` that costs nothing to name more than once, as a column."""

    def decoded(text: Column) -> Column:
        for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'")):
            text = F.replace(text, F.lit(name), F.lit(char))
        text = _numeric(text, "&#x([0-9a-f]+);", F.upper)
        text = _numeric(text, "&#([0-9]+);", lambda digits: F.when(F.length(digits) <= 7, F.conv(digits, 10, 16)).otherwise("FFFFFFF"))
        return F.replace(text, F.lit("&amp;"), F.lit("&"))

    return F.when(F.contains(text, F.lit("&")), decoded(text)).otherwise(text)


def xml_unescape(text: Column) -> Column:
    """Named, hexadecimal, then decimal references; ``&amp;`` last. Text without any stays as it is."""
    return let(text, unescaped)


def xml_strip(text: Column) -> Column:
    """Text of markup: tags as spaces, white space folded."""
    return xml_unescape(collapse(F.regexp_replace(text, "<[^>]+>", " ")))


def xml_runs(xml: Column) -> Column:
    """The joined text of all run elements, of word-processing, drawing and spreadsheet parts."""
    return xml_unescape(F.array_join(F.regexp_extract_all(xml, F.lit(r"(?is)<(a:t|w:t|t)(?:\s[^>]*)?>(.*?)</\1>"), F.lit(2)), ""))


def xml_elements(xml: Column, tag: str, group: int = 0) -> Column:
    """All elements of one name, shortest first end tag; ``group`` 1 gives what is inside."""
    return F.regexp_extract_all(xml, F.lit(rf"(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>"), F.lit(group))


def raw_attr(tag: Column, key: str) -> Column:
    """First value of ``key`` in ``tag`` as it is written, wherever the name ends so; empty where there is none."""
    return F.regexp_extract(tag, rf"(?i){key}\s*=\s*[\"']([^\"']*)[\"']", 1)


def xml_attr(tag: Column, key: str) -> Column:
    """First value of ``key`` in ``tag``, wherever the name ends so; empty where there is none."""
    return xml_unescape(raw_attr(tag, key))


def number_of(text: Column, fallback: float = 0) -> Column:
    """As :func:`xml_number`, for a ``text`` that costs nothing to name more than once, as a column."""
    number = js_trim(text).try_cast("double")
    return F.when(js_trim(text) == "", F.lit(0.0)).otherwise(F.coalesce(F.when(~F.isnan(number), number), F.lit(float(fallback))))


def xml_number(value: Column, fallback: float = 0) -> Column:
    """An attribute as a number: empty is 0, no number is ``fallback``."""
    return let(value, lambda v: number_of(v, fallback))


def part_text(content: Column) -> Column:
    """Bytes of a part as text; bytes that are no UTF-8 become replacement characters."""
    return F.make_valid_utf8(content.cast("string"))
