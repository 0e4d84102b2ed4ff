"""Scalar text functions as Column expressions; all stay inside code generation."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# The white space that JavaScript's trim() removes, as a regular expression class.
WHITE = r"[\s\x0B\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
TRIM = rf"\A{WHITE}+|{WHITE}+\z"
# Bounds in characters.
REPLY_LIMIT, RECALL_LIMIT, ERROR_LIMIT = 1900, 6000, 200
MENTION = rf"<@!?\d+>{WHITE}*"


def js_trim(s: Column) -> Column:
    return F.regexp_replace(s, TRIM, "")


def bounded(s: Column, limit: int = REPLY_LIMIT) -> Column:
    """The text, or its first ``limit`` characters and an ellipsis."""
    return F.when(F.length(s) <= limit, s).otherwise(F.concat(F.substring(s, 1, limit), F.lit("…")))


def bounded_error(s: Column) -> Column:
    return F.substring(s, 1, ERROR_LIMIT)


def clean_mentions(s: Column) -> Column:
    """Without mention tokens and the white space after them, trimmed."""
    return js_trim(F.regexp_replace(s, MENTION, ""))


def flatten_content(blocks: Column) -> Column:
    """Text of the blocks of type ``text`` on end; bare strings come as blocks of that type."""
    return F.array_join(F.transform(F.filter(blocks, lambda b: b["type"] == "text"), lambda b: b["text"]), "")


def strip_quotes(s: Column) -> Column:
    """Without one quote at each end, which need not match."""
    return F.regexp_replace(s, r"""\A["']|["']\z""", "")


def split_list(s: Column) -> Column:
    """Parts between commas, trimmed, unquoted, without empty ones."""
    return F.filter(F.transform(F.split(s, ","), lambda p: strip_quotes(js_trim(p))), lambda p: F.length(p) > 0)


def coerce_scalar(s: Column) -> Column:
    """(kind, value) of a bare configuration value: quoted strings, then booleans and integers, else strings."""
    raw = js_trim(s)
    quoted = (F.length(raw) >= 2) & raw.rlike(r"""\A(?:"[\s\S]*"|'[\s\S]*')\z""")
    value = strip_quotes(raw)
    kind = F.when(quoted, "string").when(value.isin("true", "false"), "boolean").when(value.rlike(r"\A-?\d+\z"), "number").otherwise("string")
    return F.struct(kind.alias("kind"), value.alias("value"))


def fixed3(x: Column) -> Column:
    """Three decimals of the exact binary value, ties up; ``?`` if absent.

    x * 1000 is taken with its rounding error (a split product), so a tie is told from a near tie.
    """
    a = F.abs(x)
    p = a * F.lit(1000.0)
    c = a * F.lit(134217729.0)
    high = c - (c - a)
    err = (high * F.lit(1000.0) - p) + (a - high) * F.lit(1000.0)
    part = p - F.floor(p)
    n = F.floor(p) + F.when((part > 0.5) | ((part == 0.5) & (err >= 0)), 1).otherwise(0)
    digits = F.concat(F.when(x < 0, "-").otherwise(""), F.floor(n / 1000).cast("string"), F.lit("."), F.lpad((n % 1000).cast("string"), 3, "0"))
    return F.coalesce(digits, F.lit("?"))


def date_prefix(s: Column) -> Column:
    return F.coalesce(F.substring(s, 1, 10), F.lit("?"))


def octal_mode(mode: Column) -> Column:
    return F.lpad(F.conv(mode.bitwiseAND(511).cast("string"), 10, 8), 3, "0")


def not_executable(mode: Column) -> Column:
    return mode.bitwiseAND(0o111) == 0


def not_private(mode: Column) -> Column:
    return mode.bitwiseAND(0o777) != 0o600


def pad_right(s: Column, width: Column) -> Column:
    """Padded to a width, never cut."""
    return F.concat(s, F.repeat(F.lit(" "), F.greatest(width - F.length(s), F.lit(0)).cast("int")))


def iso_millis(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def memory_id(agent: Column, ms: Column) -> Column:
    return F.concat(agent, F.lit("-"), ms.cast("string"))


def env_var_name(name: Column, prefix: str) -> Column:
    return F.concat(F.lit(prefix), F.regexp_replace(F.upper(name), "[^A-Z0-9]", "_"))


def capitalised(s: Column) -> Column:
    return F.concat(F.upper(F.substring(s, 1, 1)), s.substr(F.lit(2), F.length(s)))


def xml_escape(s: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        s = F.replace(s, F.lit(raw), F.lit(safe))
    return s


def without_trailing_slashes(s: Column) -> Column:
    return F.rtrim(s, F.lit("/"))


def url_component(s: Column) -> Column:
    """Percent encoding of all but letters, digits and -_.!~*'()."""
    s = F.replace(F.url_encode(s), F.lit("+"), F.lit("%20"))
    for code, raw in (("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        s = F.replace(s, F.lit(code), F.lit(raw))
    return s


def content_hash(s: Column) -> Column:
    """SHA-256 in hex; the empty string where there is no content."""
    return F.coalesce(F.sha2(s, 256), F.lit(""))


def expand_home(s: Column, home: Column) -> Column:
    return F.when(s.startswith("~/"), F.concat(home, s.substr(F.lit(2), F.length(s)))).otherwise(s)


def rest_of_words(words: Column) -> Column:
    """All but the first on end with spaces; null if that is empty."""
    return F.nullif(F.array_join(F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), " "), F.lit(""))


def mapped(name: Column, table: Mapping[str, str]) -> Column:
    """The table's value, or the name itself."""
    out = F.when(F.lit(False), name)
    for k, v in table.items():
        out = out.when(name == k, v)
    return out.otherwise(name)


def override(chosen: Column, default: Column) -> Column:
    return F.coalesce(chosen, default)


def only_if(flag: Column, value: Column) -> Column:
    return F.when(flag, value)
