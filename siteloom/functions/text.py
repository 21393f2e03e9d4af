"""Text expressions with the white space and trimming of web scripts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of web scripts (fixed values), as a character class without its brackets.
SPACES = r"\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
WS = f"[{SPACES}]"


def let(value: Column, use) -> Column:
    """``use(value)``, with the value reckoned once however often it is named."""
    return F.element_at(F.transform(F.array(value), use), 1)


def trim(c: Column) -> Column:
    return F.regexp_replace(c, f"^{WS}+|{WS}+$", "")


def blank_to_null(c: Column) -> Column:
    return let(trim(c), lambda t: F.when(t != "", t))


def strip_html(c: Column) -> Column:
    """Text without scripts, styles and tags; white space runs become one space. Lazy patterns: they cannot overflow the stack on long scripts."""
    for pattern in (r"(?is)<script\b.*?</script>", r"(?is)<style\b.*?</style>", r"<[^>]+>", f"{WS}+"):
        c = F.regexp_replace(c, pattern, " ")
    return trim(c)


def word_count(c: Column) -> Column:
    return let(strip_html(c), lambda text: F.when(text == "", 0).otherwise(F.size(F.split(text, " "))))


def extract(c: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match, null where nothing matches.  The text is scanned once; the group is read from the match."""
    return let(F.regexp_extract(c, pattern, 0), lambda m: F.when(m != "", F.regexp_extract(m, pattern, group)))


def first_of(c: Column, *patterns: str) -> Column:
    """Group 1 of the first pattern that matches, trimmed; blank is null."""
    return blank_to_null(F.coalesce(*(extract(c, p) for p in patterns)))


def truncate(c: Column, n: int) -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def attribute(tag: Column, name: str) -> Column:
    """An attribute's value, null if absent; the name may end a longer one (data-src holds src)."""
    return extract(tag, f"(?i){name}=[\"']([^\"']*)[\"']")


def leading_int(c: Column) -> Column:
    """The integer a string begins with; null if none or zero."""
    n = F.regexp_extract(c, r"^\s*([+-]?\d+)", 1).try_cast("int")
    return F.nullif(n, F.lit(0))
