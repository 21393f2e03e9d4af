"""URL expressions: parts, normal form, resolution, comparison keys, cleaning of typed input."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siteloom.functions.idna import ascii_host
from siteloom.functions.text import WS, let, trim

PARTS = r"^(?i)(https?):/+([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"
ABSOLUTE = r"^(?i)https?://"


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, PARTS, 1))


def host(url: Column) -> Column:
    """Lower-case host without port; empty for what is no web URL."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, PARTS, 2)), r":\d*$", "")


#: A web URL with a host beyond ASCII.
FOREIGN = r"^(?i)https?:/+[^/?#]*[^\x00-\x7F]"


def _ascii_authority(authority: Column) -> Column:
    return F.concat(ascii_host(F.regexp_replace(authority, r":\d*$", "")), F.regexp_extract(authority, r"(:\d*)$", 1))


def to_ascii(url: Column) -> Column:
    """A web URL whose host is written in ASCII; other text stays.  Tables of URLs are brought into this form when they are read, so that hosts compare."""

    def written(u: Column) -> Column:
        rest = (F.regexp_extract(u, PARTS, k) for k in (3, 4, 5))
        return F.when(u.rlike(FOREIGN), F.concat(scheme(u), F.lit("://"), let(F.regexp_extract(u, PARTS, 2), _ascii_authority), *rest)).otherwise(u)

    return let(url, written)


def path(url: Column) -> Column:
    p = F.regexp_extract(url, PARTS, 3)
    return F.when(p == "", "/").otherwise(p)


def query(url: Column) -> Column:
    """Without the question mark."""
    return F.regexp_replace(F.regexp_extract(url, PARTS, 4), r"^\?", "")


def _each_char(c: Column, plain: str) -> Column:
    encode = lambda x: F.when(x.rlike(plain), x).when(x == " ", "%20").otherwise(F.url_encode(x))
    return F.when(c.rlike(f"^({plain[1:-1]})*$"), c).otherwise(F.array_join(F.transform(F.split(c, ""), encode), ""))


def encode_path(p: Column) -> Column:
    """Percent-encodes what may not stand in a path; percent signs stay."""
    return _each_char(p, r"^[!$-;=@-\]_a-z|~]$".replace("^[", "^(?:[").replace("]$", "])$"))


def _decoded(p: Column) -> Column:
    return F.coalesce(F.try_url_decode(F.replace(p, F.lit("+"), F.lit("%2B"))), p)


def _sorted_query(q: Column) -> Column:
    """Parameters decoded, sorted by name (stable) and encoded as a form."""
    parts = F.filter(F.split(q, "&"), lambda x: x != "")
    decode = lambda x: F.coalesce(F.try_url_decode(x), x)
    entry = lambda x, i: F.struct(
        decode(F.substring_index(x, "=", 1)).alias("name"), i.alias("i"), F.when(F.instr(x, "=") > 0, decode(F.regexp_replace(x, "^[^=]*=", ""))).otherwise("").alias("value")
    )
    entries = F.array_sort(F.transform(parts, entry))
    return F.array_join(F.transform(entries, lambda e: F.concat(F.url_encode(e["name"]), F.lit("="), F.url_encode(e["value"]))), "&")


def normalise(url: Column) -> Column:
    """Scheme added, host lower-cased and in ASCII, default port, fragment and one trailing slash dropped, path decoded where safe, parameters sorted."""
    u = trim(url)
    full = to_ascii(F.when(u.rlike(ABSOLUTE), u).otherwise(F.concat(F.lit("https://"), u)))

    def form(full: Column) -> Column:
        authority = F.lower(F.regexp_extract(full, PARTS, 2))
        s = scheme(full)
        authority = F.when(s == "https", F.regexp_replace(authority, ":(443)?$", "")).otherwise(F.regexp_replace(authority, ":(80)?$", ""))
        p = encode_path(_decoded(path(full)))
        p = F.when((F.length(p) > 1) & p.endswith("/"), F.regexp_replace(p, "/$", "")).otherwise(p)
        q = _sorted_query(query(full))
        whole = F.concat(s, F.lit("://"), authority, p, F.when(q == "", "").otherwise(F.concat(F.lit("?"), q)))
        return F.when(full.rlike(PARTS) & authority.rlike(r"^[^\s<>^|%\\]+$"), whole)

    plain = F.regexp_replace(F.regexp_replace(F.lower(u), "/+$", ""), "^https?://", "https://")
    return F.when(u.isNotNull(), F.coalesce(let(full, form), plain))


def _dots(p: Column) -> Column:
    """Dot segments taken out; a final one leaves a slash."""
    ends = p.rlike(r"/\.{1,2}$")
    drop = lambda acc: F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))
    step = lambda acc, s: F.when(s == "..", drop(acc)).when(s == ".", acc).otherwise(F.concat(acc, F.array(s)))
    parts = F.aggregate(F.split(F.regexp_replace(p, "^/", ""), "/"), F.array().cast("array<string>"), step)
    out = F.concat(F.lit("/"), F.array_join(parts, "/"), F.when(ends & (F.size(parts) > 0), "/").otherwise(""))
    return F.when(p.rlike(r"(^|/)\.{1,2}(/|$)"), out).otherwise(p)


def resolve(base: Column, ref: Column) -> Column:
    """An absolute URL for a reference found on a page; null where none results."""
    # each part is bound before it is used: written out, the cases hold more than a hundred matches
    origin = F.concat(scheme(base), F.lit("://"), F.lower(F.regexp_extract(base, PARTS, 2)))
    placed = lambda p: let(let(p, _dots), encode_path)

    def relative(r: Column) -> Column:
        rest = F.regexp_extract(r, r"^[^?#]*(.*)$", 1)

        def of(target: Column) -> Column:
            folder = F.regexp_replace(path(base), r"[^/]*$", "")
            return (
                F.when(target.startswith("/"), F.concat(origin, placed(target), rest))
                .when(target != "", F.concat(origin, placed(F.concat(folder, target)), rest))
                .when(rest.startswith("?"), F.concat(origin, path(base), rest))
                .otherwise(F.concat(origin, path(base), F.regexp_extract(base, PARTS, 4), rest))
            )

        return let(F.regexp_extract(r, r"^([^?#]*)", 1), of)

    def full(r: Column) -> Column:
        absolute = F.concat(scheme(r), F.lit("://"), F.lower(F.regexp_extract(r, PARTS, 2)), placed(path(r)), F.regexp_extract(r, PARTS, 4), F.regexp_extract(r, PARTS, 5))
        rest = F.regexp_extract(r, r"^[^?#]*(.*)$", 1)
        scheme_relative = F.concat(scheme(base), F.lit(":"), F.regexp_extract(r, r"^(//[^/?#]*)", 1), let(path(F.concat(F.lit("http:"), r)), encode_path), rest)
        return F.when(r.rlike(ABSOLUTE), to_ascii(absolute)).when(r.startswith("//"), to_ascii(scheme_relative)).when(r.rlike(r"^(?i)[a-z][a-z0-9+.\-]*:"), None).otherwise(relative(r))

    return let(F.regexp_replace(trim(ref), r"[\t\n\r]", ""), full)


def link_key(url: Column) -> Column:
    """What tells link targets apart: host and path without a trailing slash; query and fragment do not count."""
    return F.concat(host(url), F.regexp_replace(path(url), "/$", ""))


def clean_input(text: Column) -> Column:
    """A URL typed by hand: quotes, brackets and white space dropped, an embedded URL kept, the scheme always https, .com for a bare word."""
    t = F.regexp_replace(F.regexp_replace(trim(text), r"^[\"'<(\[{]+|[\"'>)\]}]+$", ""), f"{WS}+", "")
    t = F.coalesce(F.nullif(F.regexp_extract(t, r"(?i)(https?://.*)$", 1), F.lit("")), t)
    t = F.regexp_replace(F.regexp_replace(t, r"(?i)^((https?|htp|http|htps|ttps?):?/+)+", ""), "^/+", "")
    t = F.when((t != "") & ~t.contains(".") & ~t.contains(":"), F.concat(t, F.lit(".com"))).otherwise(t)
    return F.when(t == "", "").otherwise(F.concat(F.lit("https://"), t))
