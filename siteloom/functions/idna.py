"""International host names in ASCII: each label by Bootstring (RFC 3492, punycode), as a fold over its code points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siteloom.functions.text import let

#: Parameters of the encoding (fixed values of RFC 3492).
BASE, T_MIN, T_MAX, SKEW, DAMP, FIRST_BIAS, FIRST = 36, 1, 26, 38, 700, 72, 128
#: Digits of a number and steps of a bias that 64-bit deltas can need.
DIGITS, STEPS = 14, 12
_LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789"


def _struct(**fields: Column) -> Column:
    return F.struct(*(v.alias(k) for k, v in fields.items()))


def _whole(c: Column) -> Column:
    return c.cast("long")


def _adapt(delta: Column, points: Column, first: Column) -> Column:
    """The bias after a delta, by the number of code points handled so far."""
    start = _whole(F.floor(F.when(first, delta / DAMP).otherwise(delta / 2)))
    start = start + _whole(F.floor(start / points))
    limit = ((BASE - T_MIN) * T_MAX) // 2
    step = lambda s, _: F.when(s["d"] > limit, _struct(d=_whole(F.floor(s["d"] / (BASE - T_MIN))), k=s["k"] + BASE)).otherwise(s)
    done = lambda s: s["k"] + _whole(F.floor((BASE - T_MIN + 1) * s["d"] / (s["d"] + SKEW)))
    return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), _struct(d=start, k=F.lit(0).cast("long")), step, done)


def _number(delta: Column, bias: Column) -> Column:
    """A delta as digits of variable length."""
    letter = lambda d: F.substr(F.lit(_LETTERS), (d + 1).cast("int"), F.lit(1))

    def step(s: Column, i: Column) -> Column:
        t = F.least(F.greatest(_whole(i) * BASE - bias, F.lit(T_MIN).cast("long")), F.lit(T_MAX).cast("long"))
        more = _struct(q=_whole(F.floor((s["q"] - t) / (BASE - t))), out=F.concat(s["out"], letter(t + (s["q"] - t) % (BASE - t))), done=F.lit(False))
        return F.when(s["done"], s).when(s["q"] < t, _struct(q=s["q"], out=F.concat(s["out"], letter(s["q"])), done=F.lit(True))).otherwise(more)

    start = _struct(q=_whole(delta), out=F.lit(""), done=F.lit(False))
    return F.aggregate(F.sequence(F.lit(1), F.lit(DIGITS)), start, step, lambda s: s["out"])


def _code(char: Column) -> Column:
    """A character's code point."""
    return F.conv(F.hex(F.encode(char, "UTF-32")), 16, 10).cast("long")


def punycode(label: Column) -> Column:
    """A label's Bootstring form, without the prefix that marks it in host names."""
    codes = F.transform(F.filter(F.split(label, ""), lambda c: c != ""), _code)
    basic = F.array_join(F.filter(F.split(label, ""), lambda c: (c != "") & (_code(c) < FIRST)), "")
    higher = F.array_sort(F.array_distinct(F.filter(codes, lambda c: c >= FIRST)))
    n_basic = _whole(F.length(basic))

    def point(s: Column, m: Column) -> Column:
        """All places of code point m, the least not handled yet."""
        delta = s["delta"] + (m - s["n"]) * (s["h"] + 1)

        def place(t: Column, c: Column) -> Column:
            hit = _struct(
                delta=F.lit(0).cast("long"), bias=_adapt(t["delta"], t["h"] + 1, t["h"] == n_basic), h=t["h"] + 1, out=F.concat(t["out"], _number(t["delta"], t["bias"]))
            )
            return F.when(c < m, t.withField("delta", t["delta"] + 1)).when(c == m, hit).otherwise(t)

        walked = F.aggregate(codes, _struct(delta=delta, bias=s["bias"], h=s["h"], out=s["out"]), place)
        return F.transform(F.array(walked), lambda t: _struct(n=m + 1, delta=t["delta"] + 1, bias=t["bias"], h=t["h"], out=t["out"]))[0]

    start = _struct(n=F.lit(FIRST).cast("long"), delta=F.lit(0).cast("long"), bias=F.lit(FIRST_BIAS).cast("long"), h=n_basic, out=F.when(basic != "", F.concat(basic, F.lit("-"))).otherwise(""))
    return F.aggregate(higher, start, point, lambda s: s["out"])


def ascii_host(host: Column) -> Column:
    """A host in ASCII: lower case, the dots of other scripts as dots, each label beyond ASCII encoded.  Hosts in ASCII are lower-cased only.

    Compatibility forms of letters are not folded together; hosts come as browsers and feeds write them.
    """
    one = lambda label: F.when(label.rlike(r"[^\x00-\x7F]"), F.concat(F.lit("xn--"), punycode(label))).otherwise(label)
    labels = lambda h: F.split(F.regexp_replace(h, "[\u3002\uFF0E\uFF61]", "."), r"\.")
    return let(F.lower(host), lambda h: F.when(h.rlike(r"[^\x00-\x7F]"), F.array_join(F.transform(labels(h), one), ".")).otherwise(h))
