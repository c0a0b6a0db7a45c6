"""String functions as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: ASCII white space.
WHITE = " \t\n\x0b\x0c\r"


def trim_white(s: Column) -> Column:
    return F.btrim(s, F.lit(WHITE))


def _quote(s: str) -> str:
    return "".join(rf"\x{ord(c):02x}" if ord(c) < 128 and not c.isalnum() else c for c in s)


def split_string(s: Column, sep: str, trim: bool = True) -> Column:
    """Fields between ``sep``, trimmed; a source without separator whose field is empty gives no fields at all."""
    fields = F.split(s, _quote(sep), -1)
    if trim:
        fields = F.transform(fields, trim_white)
    return F.when((F.size(fields) == 1) & (fields[0] == ""), F.array().cast("array<string>")).otherwise(fields)


def split_substring(s: Column, sep: str) -> Column:
    """Fields between whole separators, trimmed, at least one."""
    return F.transform(F.split(s, _quote(sep), -1), trim_white)


def split_white(s: Column) -> Column:
    return F.filter(F.split(s, "[ \\t\\n\\x0B\\f\\r]+", -1), lambda x: x != "")


def tokenize(s: Column, delims: str) -> Column:
    """Non-empty stretches between any of the delimiters."""
    return F.filter(F.split(s, "[" + _quote(delims) + "]", -1), lambda x: x != "")


def key_value_pairs(s: Column, kv: str, pair: str) -> Column:
    """Array of (key, value, ok): the first ``kv`` character divides, repeats of it after the key are skipped."""
    k = _quote(kv)

    def one(p: Column) -> Column:
        at = F.instr(p, kv)
        value = F.regexp_replace(F.substring(p, at, F.length(p)), f"^{k}+", "")
        split = at > 0
        return F.struct(
            F.when(split, F.substring(p, F.lit(1), at - 1)).otherwise(F.lit("")).alias("key"),
            F.when(split, value).otherwise(F.lit("")).alias("value"),
            (split & (value != "")).alias("ok"),
        )

    return F.transform(F.filter(split_string(s, pair), lambda p: p != ""), one)


def remove_chars(s: Column, chars: str) -> Column:
    return F.regexp_replace(s, "[" + _quote(chars) + "]", "")


def replace_chars(s: Column, chars: str, by: str) -> Column:
    return F.regexp_replace(s, "[" + _quote(chars) + "]", by.replace("\\", "\\\\").replace("$", "\\$"))


def collapse_white(s: Column, trim_breaks: bool = False) -> Column:
    """Runs of white space to one space; with ``trim_breaks`` runs that hold a line break vanish. Ends are trimmed."""
    if trim_breaks:
        s = F.regexp_replace(s, "[ \\t\\x0B\\f]*[\\n\\r][ \\t\\n\\x0B\\f\\r]*", "")
    return F.btrim(F.regexp_replace(s, "[ \\t\\n\\x0B\\f\\r]+", " "))


def contains_only(s: Column, chars: str) -> Column:
    return s.rlike("^[" + _quote(chars) + "]*$") if chars else s == ""


def is_ascii(s: Column) -> Column:
    return s.rlike("^[\\x00-\\x7F]*$")


def truncate_utf8(s: Column, size: int) -> Column:
    """The longest prefix of whole characters within ``size`` bytes.

    Bytes are cut first; then the bytes of a character that the cut divides are dropped: a cut that
    falls before a continuation byte leaves its character incomplete.
    """
    raw = s.cast("binary")
    cut = F.hex(F.substring(raw, 1, size))
    divided = F.hex(F.substring(raw, size + 1, 1)).rlike("^[89AB]")
    whole = F.when(divided, F.regexp_replace(cut, "(?:F.|E.|[CD].)(?:[89AB].)*$", "")).otherwise(cut)
    return F.decode(F.unhex(whole), "UTF-8")


def starts_with(s: Column, prefix: str, case: bool = True) -> Column:
    return s.startswith(prefix) if case else F.lower(s).startswith(prefix.lower())


def ends_with(s: Column, suffix: str, case: bool = True) -> Column:
    return s.endswith(suffix) if case else F.lower(s).endswith(suffix.lower())


def replace_after(s: Column, offset: int, find: str, by: str, every: bool = True) -> Column:
    """``find`` replaced from a character offset on, everywhere or once."""
    head, tail = F.substring(s, F.lit(1), F.lit(offset)), F.substring(s, F.lit(offset + 1), F.length(s))
    if every:
        return F.concat(head, F.replace(tail, F.lit(find), F.lit(by)))
    at = F.instr(tail, find)
    once = F.concat(F.substring(tail, F.lit(1), at - 1), F.lit(by), F.substring(tail, at + len(find), F.length(tail)))
    return F.concat(head, F.when(at > 0, once).otherwise(tail))


def placeholders(template: str, *args: Column) -> Column:
    """$1 to $9 by argument; $$ is a dollar sign for each dollar but the first; missing arguments are empty."""
    parts: list[Column] = []
    for text, dollars, digit in re.findall(r"([^$]+)|\$(\$+)|\$([1-9])", template):
        if text or dollars:
            parts.append(F.lit(text or dollars))
        elif int(digit) <= len(args):
            parts.append(args[int(digit) - 1].cast("string"))
    return F.concat(*parts) if parts else F.lit("")


def format_bytes(n: Column) -> Column:
    """Bytes with a unit: whole below 1 kB, one decimal below 100 of a unit, else whole."""
    units = ("B", "kB", "MB", "GB", "TB", "PB")
    out = None
    for k in range(len(units) - 1, 0, -1):
        x = n / float(1024**k)
        text = F.when(x < 100, F.format_string("%.1f", F.bround(x, 1))).otherwise(F.format_string("%.0f", F.bround(x, 0)))
        branch = F.concat(text, F.lit(" " + units[k]))
        out = F.when(n >= 1024**k, branch) if out is None else out.when(n >= 1024**k, branch)
    return out.otherwise(F.concat(n.cast("string"), F.lit(" B")))


def underscored(s: Column) -> Column:
    """CamelCase and anything but letters and digits to words joined by single underscores, lower case."""
    s = F.regexp_replace(s, "([a-z0-9])([A-Z])", "$1_$2")
    s = F.regexp_replace(s, "([A-Z])([A-Z][a-z])", "$1_$2")
    return F.btrim(F.lower(F.regexp_replace(s, "[^A-Za-z0-9]+", "_")), F.lit("_"))


def wildcard_regex(pattern: str, question: str = ".") -> str:
    """A glob as an anchored regex; ``question`` is what ? stands for."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            out += ".*"
        elif c == "?":
            out += question
        elif c == "\\" and question != "." and i + 1 < len(pattern):
            i += 1
            out += _quote(pattern[i])
        else:
            out += _quote(c)
        i += 1
    return f"^(?s:{out})$"


def wildcard_list(s: Column, patterns: str, on_both_empty: bool = False) -> Column:
    """Any of the patterns separated by , or ; matches; names without wildcards are looked up by equality."""
    found = [p for p in re.split("[,;]", patterns) if p]
    if not found:
        return F.lit(on_both_empty)
    names = [p for p in found if not set(p) & set("*?")]
    test = s.isin(names) if names else F.lit(False)
    for p in found:
        if set(p) & set("*?"):
            test = test | s.rlike(wildcard_regex(p))
    return test


def match_pattern(s: Column, pattern: str) -> Column:
    """Glob where ? is at most one character and a backslash escapes."""
    return s.rlike(wildcard_regex(pattern, ".?"))


def to_int(s: Column, kind: str = "int") -> Column:
    """(ok, value) of a strict decimal conversion; null value if it fails."""
    value = F.when(s.rlike("^[+-]?[0-9]+$"), s.try_cast(kind))
    return F.struct(value.isNotNull().alias("ok"), value.alias("value"))


def uri_parts(s: Column) -> Column:
    """scheme, user_info, host, port (-1 if unset), path, query, fragment."""
    p = r"^(?:([A-Za-z][A-Za-z0-9+.-]*)://)?(?:([^@/?#]*)@)?([^:/?#]*)(?::([0-9]+))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
    part = lambda i: F.regexp_extract(s, p, i)
    return F.struct(
        part(1).alias("scheme"),
        part(2).alias("user_info"),
        part(3).alias("host"),
        F.coalesce(part(4).try_cast("int"), F.lit(-1)).alias("port"),
        part(5).alias("path"),
        part(6).alias("query"),
        part(7).alias("fragment"),
    )


def query_without(query: Column, *keys: str) -> Column:
    """A query string without the pairs of some keys; order is kept."""
    keep = F.filter(F.split(query, "&", -1), lambda p: ~F.split(p, "=", -1)[0].isin(list(keys)) & (p != ""))
    return F.array_join(keep, "&")


def quoted_tokens(s: Column, delims: str, quotes: str = "", keep_delims: bool = False) -> Column:
    """Tokens between delimiters; within quotes these are ordinary and a backslash escapes. An open quote runs to the end.

    With ``keep_delims`` every delimiter is a token too. A character that is both counts as a delimiter.
    """
    quotes = "".join(q for q in quotes if q not in delims)
    parts = [f"[^{_quote(delims + quotes)}]++"] + [rf"{_quote(q)}(?:\\.|[^{_quote(q)}\\])*+(?:{_quote(q)}|\\?\z)" for q in quotes]
    token = f"(?s)(?:{'|'.join(parts)})++" + (f"|[{_quote(delims)}]" if keep_delims else "")
    return F.regexp_extract_all(s, F.lit(token), F.lit(0))


#: Code points that are no characters.
_NO_CHARACTER = "[\\x{FDD0}-\\x{FDEF}" + "".join(f"\\x{{{p:X}FFFE}}\\x{{{p:X}FFFF}}" for p in range(17)) + "]"


def is_utf8_text(raw: Column) -> Column:
    """Whether bytes are UTF-8 of characters; code points set aside as no characters fail."""
    text = F.try_validate_utf8(raw.cast("string"))
    return F.coalesce(~text.rlike(_NO_CHARACTER), F.lit(False))


def _ascii_lower(s: Column) -> Column:
    return F.translate(s, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def equals_ignoring_case(a: Column, b: Column, first: int | None = None) -> Column:
    """Equal but for the case of ASCII letters, as a whole or over the ``first`` characters."""
    if first is not None:
        a, b = F.substring(a, 1, first), F.substring(b, 1, first)
    return _ascii_lower(a) == _ascii_lower(b)


def hex_digit(c: Column) -> Column:
    """Value of a hexadecimal digit, null of anything else."""
    return F.when(c.rlike("^[0-9A-Fa-f]$"), F.conv(c, 16, 10).cast("int"))


def find(s: Column, what: Column, start: int = 0) -> Column:
    """Place, from 0, of the first occurrence at or after ``start``; -1 if there is none."""
    at = F.position(what, s, F.lit(start + 1))
    return at - 1


def rfind(s: Column, what: Column) -> Column:
    """Place of the last occurrence; -1 if there is none."""
    at = F.position(F.reverse(what), F.reverse(s))
    return F.when(at > 0, F.char_length(s) - F.char_length(what) - at + 1).otherwise(F.lit(-1))


def find_first_of(s: Column, chars: str, negated: bool = False) -> Column:
    """Place of the first character that is one of ``chars``, or isn't; -1 if there is none."""
    head = F.regexp_extract(s, f"(?s)^[{'' if negated else '^'}{_quote(chars)}]*", 0)
    return F.when(F.char_length(head) < F.char_length(s), F.char_length(head)).otherwise(F.lit(-1))


def find_last_of(s: Column, chars: str, negated: bool = False) -> Column:
    at = find_first_of(F.reverse(s), chars, negated)
    return F.when(at >= 0, F.char_length(s) - 1 - at).otherwise(F.lit(-1))


def without_ends(s: Column, prefix: int = 0, suffix: int = 0) -> Column:
    """The string less its first and last characters."""
    return F.substring(s, F.lit(prefix + 1), F.greatest(F.lit(0), F.char_length(s) - prefix - suffix))


def compare(a: Column, b: Column) -> Column:
    """-1, 0 or 1 by the order of bytes."""
    return F.when(a < b, -1).when(a > b, 1).otherwise(0)


def to_double(s: Column) -> Column:
    """(ok, value) of a strict decimal number; null value if it isn't one or isn't finite."""
    value = F.when(s.rlike(r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"), s.try_cast("double"))
    value = F.when(F.abs(value) < float("inf"), value)
    return F.struct(value.isNotNull().alias("ok"), value.alias("value"))


def to_unsigned(s: Column) -> Column:
    """(ok, value) of a strict unsigned 64-bit number."""
    value = F.when(s.rlike(r"^\+?[0-9]+$"), s.try_cast("decimal(20,0)"))
    value = F.when(value <= F.lit("18446744073709551615").cast("decimal(20,0)"), value)
    return F.struct(value.isNotNull().alias("ok"), value.alias("value"))


def hex_to_int(s: Column, bits: int = 64) -> Column:
    """(ok, value) of a hexadecimal number with or without sign and 0x, within so many bits with sign."""
    digits = F.ltrim(F.regexp_extract(s, "^[+-]?(?:0[xX])?([0-9A-Fa-f]+)$", 1), F.lit("0"))
    good = s.rlike("^[+-]?(?:0[xX])?[0-9A-Fa-f]+$") & (F.char_length(digits) <= 16)
    size = F.conv(F.when(good & (digits != ""), digits).otherwise("0"), 16, 10).cast("decimal(20,0)")
    value = F.when(s.startswith("-"), -size).otherwise(size)
    inside = (value >= F.lit(str(-(1 << bits - 1))).cast("decimal(20,0)")) & (value <= F.lit(str((1 << bits - 1) - 1)).cast("decimal(20,0)"))
    value = F.when(good & inside, value.cast("long"))
    return F.struct(value.isNotNull().alias("ok"), value.alias("value"))


def hex_to_bytes(s: Column) -> Column:
    """Bytes of an even, not empty number of hexadecimal digits; else null."""
    return F.when(s.rlike("^(?:[0-9A-Fa-f]{2})+$"), F.unhex(s))


def to_utf16(s: Column) -> Column:
    return F.encode(s, "UTF-16LE")


def from_utf16(raw: Column) -> Column:
    return F.decode(raw, "UTF-16LE")


def from_latin1(raw: Column) -> Column:
    return F.decode(raw, "ISO-8859-1")


def utf16_offset(s: Column, at: Column) -> Column:
    """Place in UTF-16 units of the character at place ``at``, from 0."""
    return (F.octet_length(to_utf16(F.substring(s, F.lit(1), at))) / 2).cast("int")


def utf8_offset(s: Column, at: Column) -> Column:
    """Place in bytes of the character at place ``at``, from 0."""
    return F.octet_length(F.substring(s, F.lit(1), at))


def encode_name(s: Column) -> Column:
    """A name of letters, digits and underscores only, no digit first: other bytes become ``_Zddd_``."""

    def one(h: Column, i: Column) -> Column:
        n = F.conv(h, 16, 10).cast("int")
        c = F.char(n)
        plain = (n < 128) & c.rlike("^[A-Za-z0-9_]$") & ~((i == 0) & c.rlike("^[0-9]$"))
        return F.when(plain, c).otherwise(F.concat(F.lit("_Z"), F.lpad(n.cast("string"), 3, "0"), F.lit("_")))

    return F.array_join(F.transform(F.regexp_extract_all(F.hex(s), F.lit("(..)"), F.lit(1)), one), "")


def decode_name(s: Column) -> Column:
    """The string that ``encode_name`` was given; ``_Zddd_`` above 255 stays as it is."""
    p = "_Z(25[0-5]|2[0-4][0-9]|[01][0-9][0-9])_"
    codes = F.transform(F.regexp_extract_all(s, F.lit(p), F.lit(1)), lambda c: F.lpad(F.hex(c.cast("int")), 2, "0"))
    rest = F.transform(F.split(s, p, -1), F.hex)
    return F.decode(F.unhex(F.array_join(F.zip_with(rest, codes, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")), "UTF-8")


def fields_as(s: Column, sep: str, kinds: dict[str, str], keep_empty: bool = False) -> Column:
    """A struct of named, typed fields of a string; what isn't of its type, or isn't there, is null."""
    parts = F.split(s, _quote(sep), -1) if keep_empty else F.filter(F.split(s, _quote(sep), -1), lambda x: x != "")
    return F.struct(*[(F.get(parts, i) if kind == "string" else F.get(parts, i).try_cast(kind)).alias(name) for i, (name, kind) in enumerate(kinds.items())])


def with_flag(before: Column, after: Column) -> Column:
    """(value, changed) of an edit."""
    return F.struct(after.alias("value"), (before != after).alias("changed"))
