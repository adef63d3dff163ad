"""References resolved against base URLs, by column expressions only (RFC 3986, section 5, as the usual libraries read it).

Empty queries and fragments are dropped, equal schemes count as none, and a path that climbs too far stays at the root. A reference whose
authority has unbalanced brackets is none: null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lyceum.functions.rx import let

#: Schemes whose references can be relative; "" stands for no scheme.
RELATIVE = ("", "ftp", "http", "gopher", "nntp", "imap", "wais", "file", "https", "shttp", "mms", "prospero", "rtsp", "rtsps", "rtspu", "sftp", "svn", "svn+ssh", "ws", "wss")
#: Of these, the ones in which a semicolon without anything behind it is dropped.
WITH_PARAMS = ("", "ftp", "http", "imap", "https", "shttp", "mms", "prospero", "rtsp", "rtsps", "rtspu", "sftp")
PARTS = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def _cleaned(url: Column) -> Column:
    """Without line ends and tabs, and control characters and blanks before it."""
    return F.regexp_replace(F.regexp_replace(url, r"^[\x00-\x20]+", ""), r"[\t\r\n]", "")


def _parts(url: Column) -> Column:
    def of(u: Column) -> Column:
        names = ("scheme", "authority", "whole", "query", "fragment")
        found = [F.regexp_extract(u, PARTS, k) for k in range(1, 6)]
        return F.struct(F.lower(found[0]).alias(names[0]), *(c.alias(n) for c, n in zip(found[1:], names[1:], strict=True)))

    return let(_cleaned(url), of)


def _cut(parts: Column, scheme: Column) -> Column:
    """The parts with the whole path cut into path and params, in schemes that have these."""
    has = scheme.isin(*WITH_PARAMS)
    path = F.when(has, F.regexp_replace(parts["whole"], r";[^/]*$", "")).otherwise(parts["whole"])
    params = F.when(has, F.regexp_extract(parts["whole"], r";([^/]*)$", 1)).otherwise("")
    return F.struct(path.alias("path"), params.alias("params"), parts["authority"].alias("authority"), parts["query"].alias("query"), parts["fragment"].alias("fragment"))


def without_dots(segments: Column) -> Column:
    """The path of segments once . and .. are gone: a fold with a stack."""

    def step(stack: Column, s: Column) -> Column:
        up = F.slice(stack, F.lit(1), F.greatest(F.size(stack) - 1, F.lit(0)))
        return F.when(s == "..", up).when(s == ".", stack).otherwise(F.concat(stack, F.array(s)))

    def whole(all_: Column) -> Column:
        kept = F.aggregate(all_, F.array().cast("array<string>"), step)
        last = F.element_at(all_, -1)
        return F.array_join(F.when(last.isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept), "/")

    return let(segments, whole)


def _merged(base: Column, path: Column) -> Column:
    """Segments of a path against that of its base: the base's last one goes, empty ones inside go."""
    parts = F.split(base, "/", -1)
    folder = F.when(base.endswith("/") | (base == ""), parts).otherwise(F.slice(parts, F.lit(1), F.size(parts) - 1))

    def inside(all_: Column) -> Column:
        return F.filter(all_, lambda s, i: (i == 0) | (i == F.size(all_) - 1) | (s != ""))

    return F.when(path.startswith("/"), F.split(path, "/", -1)).otherwise(let(F.concat(folder, F.split(path, "/", -1)), inside))


def _written(scheme: Column, authority: Column, path: Column, params: Column, query: Column, fragment: Column) -> Column:
    def marked(sign: str, value: Column) -> Column:
        return F.when(value != "", F.concat(F.lit(sign), value)).otherwise("")

    def of(p: Column) -> Column:
        rooted = F.when((p != "") & ~p.startswith("/"), F.concat(F.lit("/"), p)).otherwise(p)
        slashes = F.lit("//")
        empty = p.startswith("//") | (scheme != "") & ((p == "") | p.startswith("/"))
        body = F.when(authority != "", F.concat(slashes, authority, rooted)).when(empty, F.concat(slashes, p)).otherwise(p)
        before = F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise("")
        return F.concat(before, body, marked("?", query), marked("#", fragment))

    return let(F.concat(path, marked(";", params)), of)


def resolved(base: Column, url: Column) -> Column:
    """The reference url against base; null if one of them is null."""

    def unbalanced(authority: Column) -> Column:
        return authority.contains("[") != authority.contains("]")

    def of(all_: Column) -> Column:
        b, u, scheme = all_["b"], all_["u"], all_["scheme"]
        bare = (u["path"] == "") & (u["params"] == "")
        query = F.when(u["query"] == "", b["query"]).otherwise(u["query"])
        path = without_dots(_merged(b["path"], u["path"]))
        path = F.when(path == "", F.lit("/")).otherwise(path)
        own = _written(scheme, u["authority"], u["path"], u["params"], u["query"], u["fragment"])
        here = _written(scheme, b["authority"], b["path"], b["params"], query, u["fragment"])
        below = _written(scheme, b["authority"], path, u["params"], u["query"], u["fragment"])
        found = F.when(u["authority"] != "", own).when(bare, here).otherwise(below)
        broken = unbalanced(u["authority"]) | unbalanced(b["authority"])
        return F.when(broken, F.lit(None)).when(all_["same"], found).otherwise(url)

    def cut(both: Column) -> Column:
        b, u = both["b"], both["u"]
        scheme = F.when(u["scheme"] != "", u["scheme"]).otherwise(b["scheme"])
        same = (scheme == b["scheme"]) & scheme.isin(*RELATIVE)
        return let(F.struct(_cut(b, scheme).alias("b"), _cut(u, scheme).alias("u"), scheme.alias("scheme"), same.alias("same")), of)

    joined = let(F.struct(_parts(base).alias("b"), _parts(url).alias("u")), cut)
    return F.when(base.isNull() | url.isNull(), F.lit(None)).when(base == "", url).when(url == "", base).otherwise(joined)
