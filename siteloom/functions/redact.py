"""Masking of sensitive text as chains of replacements; apply once, a second pass is not harmless."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteloom.functions.text import let

#: Words before a value that is masked, in the order they are applied (fixed values).
KEYWORDS = ["token", "secret", "apikey", "api_key", "password", "passwd", "auth", "authorization", "bearer", "credential", "private_key", "access_key", "session", "csrf", "xsrf"]
_OCTET = "(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)"
_UUID = "[a-f0-9]{8}-[a-f0-9]{4}-[a-f0-9]{4}-[a-f0-9]{4}-[a-f0-9]{12}"
_HEX4 = "[0-9a-fA-F]{1,4}"
#: Patterns in order, with what takes the place of a match (fixed values; word edges are those of ASCII).
STEPS = [
    (r"(?i)(https?://[^\s\"'<>\[\]]+)(\?[^\s\"'<>\[\]]*)", "$1"),
    (r"eyJ[A-Za-z0-9_-]*\.eyJ[A-Za-z0-9_-]*(?:\.[A-Za-z0-9_-]*)", "[REDACTED_JWT]"),
    (r"(?i)(?<![A-Za-z0-9_])(?:0x)?[a-f0-9]{16,}(?![A-Za-z0-9_])", "[REDACTED_HEX]"),
    (rf"(?i)((?:token|secret|key|auth)[=:]\s*[\"']?){_UUID}", "$1[REDACTED_UUID]"),
    (r"(?<![A-Za-z0-9_])[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}(?![A-Za-z0-9_])", "[REDACTED_EMAIL]"),
    (rf"(?<![A-Za-z0-9_])(?:{_OCTET}\.){{3}}{_OCTET}(?![A-Za-z0-9_])", "[REDACTED_IP]"),
    (rf"(?<![A-Za-z0-9_])(?:{_HEX4}:){{2,7}}{_HEX4}(?![A-Za-z0-9_])|(?<=[A-Za-z0-9_])::(?:{_HEX4}:){{0,5}}{_HEX4}(?![A-Za-z0-9_])|(?<![A-Za-z0-9_]){_HEX4}::(?:{_HEX4}:){{0,5}}{_HEX4}(?![A-Za-z0-9_])", "[REDACTED_IP]"),
]
_SENSITIVE = "(?i)token|secret|key|auth|passw|bearer|credential|session|csrf|xsrf"
#: What a text must hold for a step to find anything, a cheap test before the step's own scan.
_GATES = [
    lambda t: t.contains("?"), lambda t: t.contains("eyJ"), None, lambda t: t.rlike("(?i)(token|secret|key|auth)[=:]"),
    lambda t: t.contains("@"), lambda t: t.rlike(r"[0-9]\.[0-9]"), lambda t: t.contains(":"),
]
_PLAIN = r"(?!(?:true|false|null|undefined|yes|no)(?:[\s\"',;}\]<>]|$))"


def redact(text: Column) -> Column:
    """URL queries, tokens, hex strings, addresses and values after sensitive words masked; short and plain values stay."""
    for (pattern, put), gate in zip(STEPS, _GATES, strict=True):
        text = _step(text, lambda t, pattern=pattern, put=put: F.regexp_replace(t, pattern, put), gate)

    def words(t: Column) -> Column:
        for word in KEYWORDS:
            t = F.regexp_replace(t, rf"(?i)({word})\s*[=:]\s*[\"']?{_PLAIN}([^\s\"',;}}\]<>]{{4,}})", "$1=[REDACTED]")
        return t

    return _step(text, words, lambda t: t.rlike(_SENSITIVE))


def _step(text: Column, change, gate) -> Column:
    return let(text, lambda t: F.when(gate(t), change(t)).otherwise(t)) if gate else change(text)


def redact_map(values: Column) -> Column:
    """A map without keys that name something private or secret, its values masked."""
    return F.transform_values(F.map_filter(values, lambda k, _: ~F.lower(k).rlike("private|secret")), lambda _, v: redact(v))


def redact_rows(df: DataFrame, *columns: str) -> DataFrame:
    """Retained context: the named columns (strings or arrays of strings) masked, everything else as it is; nothing is dropped."""
    kinds = dict(df.dtypes)
    return df.withColumns({c: F.transform(c, redact) if kinds[c].startswith("array") else redact(F.col(c)) for c in columns})


def likely_secret(value: Column) -> Column:
    """Whether a string looks like a credential: points for length, mixed case, digits, signs, known beginnings and words
    (patterns and points are fixed values); four are enough."""
    n = F.length(value)
    points = (
        F.when(n > 32, 2).when(n > 20, 1).otherwise(0)
        + F.when(value.rlike("[a-z]") & value.rlike("[A-Z]"), 1).otherwise(0)
        + F.when(value.rlike("[0-9]"), 1).otherwise(0)
        + F.when(value.rlike(r"[_\-+=/.]"), 1).otherwise(0)
        + F.when(value.rlike("[A-Za-z0-9+/=]") & ~value.rlike("(?i)[a-f0-9]"), 1).otherwise(0)
        + F.when(value.rlike(r"(?i)^(sk-|pk-|Bearer\s|Basic\s|eyJ)"), 3).otherwise(0)
        + F.when(F.lower(value).rlike("secret|token|key|password|credential|private"), 2).otherwise(0)
    )
    return F.coalesce((n >= 12) & (points >= 4), F.lit(False))


def mask_console(text: Column) -> Column:
    """Browser console lines: 500 characters at most, addresses, long hex, tokens and keys masked (patterns are fixed values)."""
    text = F.regexp_replace(F.substring(text, 1, 500), r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}", "[EMAIL]")
    text = F.regexp_replace(text, r"(?i)[a-f0-9]{32,}", "[TOKEN]")
    return F.regexp_replace(F.regexp_replace(text, r"(?i)token[=:]\S+", "token=[REDACTED]"), r"(?i)key[=:]\S+", "key=[REDACTED]")


def mask_scan(text: Column) -> Column:
    """Security-scan output: addresses, hashes and values of keys masked (patterns are fixed values)."""
    text = F.regexp_replace(text, r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}", "[EMAIL]")
    for n in (64, 40, 32):
        text = F.regexp_replace(text, rf"(?i)[a-f0-9]{{{n}}}", f"[HASH{n}]")
    for word, put in ((r"api[_-]?key", "api_key"), ("token", "token"), ("password", "password"), ("secret", "secret")):
        text = F.regexp_replace(text, rf"(?i){word}[:=][^\s]+", f"{put}=[REDACTED]")
    return text
