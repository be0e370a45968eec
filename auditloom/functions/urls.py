"""URL parts and predicates as column expressions. An address without scheme and host gives empty parts, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Extensions of files that are no pages (fixed values).
NON_PAGE = (
    "pdf", "docx?", "xlsx?", "pptx?", "csv", "rtf", "zip", "rar", "7z", "tar", "gz", "jpe?g", "png", "gif", "svg", "webp", "ico", "bmp", "tiff?",
    "mp4", "mp3", "wav", "avi", "mov", "webm", "ogg", "woff2?", "ttf", "eot", "xml", "json",
)
NON_PAGE_PATTERN = r"(?i)\.(" + "|".join(NON_PAGE) + r")(\?|#|$)"
STAGING_PATTERN = r"(^|\.)(staging|stage|dev|test|uat|preprod|qa)(\.|-)"
#: Query parameters of campaigns (fixed values); names that begin with utm_ count as well.
TRACKING = ("fbclid", "gclid", "msclkid", "mc_cid", "mc_eid")
_AUTHORITY = r"^\s*[A-Za-z][A-Za-z0-9+.-]*://([^/?#\s]*)"


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^\s*([A-Za-z][A-Za-z0-9+.-]*)://", 1))


def host(url: Column) -> Column:
    """Lower-case host with a port that isn't the scheme's own; '' if there is none."""
    name = F.lower(F.regexp_replace(F.regexp_extract(url, _AUTHORITY, 1), r"^.*@", ""))
    name = F.when(scheme(url) == "http", F.regexp_replace(name, r":80$", "")).when(scheme(url) == "https", F.regexp_replace(name, r":443$", "")).otherwise(name)
    return F.coalesce(name, F.lit(""))


def path(url: Column) -> Column:
    """Path, '/' where it is empty; '' without a host."""
    found = F.regexp_extract(url, r"^\s*[A-Za-z][A-Za-z0-9+.-]*://[^/?#\s]*([^?#]*)", 1)
    return F.when(host(url) == "", F.lit("")).otherwise(F.when(found == "", F.lit("/")).otherwise(found))


def query(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1), F.lit(""))


def path_depth(url: Column) -> Column:
    return F.size(F.filter(F.split(path(url), "/"), lambda s: s != ""))


def param_keys(url: Column) -> Column:
    """Names of the query's parameters, repeats kept."""
    pieces = F.filter(F.split(query(url), "&"), lambda s: s != "")
    return F.transform(pieces, lambda s: F.url_decode(F.regexp_replace(F.split(s, "=")[0], r"%(?![0-9A-Fa-f]{2})", "%25")))


def is_tracking(name: Column) -> Column:
    return name.isin(*TRACKING) | name.startswith("utm_")


def is_non_page(url: Column) -> Column:
    return path(url).rlike(NON_PAGE_PATTERN)


def is_staging(url: Column) -> Column:
    return host(url).rlike(STAGING_PATTERN)


def extension(url: Column) -> Column:
    """The first extension before a query or the end, in lower case; 'unknown' without one."""
    found = F.lower(F.regexp_extract(url, r"(?i)\.([a-z0-9]+)(?:\?|$)", 1))
    return F.when(found == "", F.lit("unknown")).otherwise(found)


def same_site(a: Column, b: Column) -> Column:
    """Equal hosts but for a leading www."""
    return F.regexp_replace(a, r"^www\.", "") == F.regexp_replace(b, r"^www\.", "")


#: Schemes whose addresses have an authority and a path of segments, with their own port (fixed values).
SPECIAL_PORTS = {"http": "80", "https": "443", "ws": "80", "wss": "443", "ftp": "21"}
_SPECIAL = "(?:" + "|".join(SPECIAL_PORTS) + ")"
_OWN_PORT = "|".join(f"{s}://(?=.*:{port}$)" for s, port in SPECIAL_PORTS.items())


def _let(value: Column, body) -> Column:
    """body of a value that is computed once, however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _without_dots(path: Column) -> Column:
    """A rooted path with its ``.`` and ``..`` segments (also percent-encoded) resolved."""
    plain = lambda s: F.replace(F.lower(s), F.lit("%2e"), F.lit("."))

    def join(pieces: Column) -> Column:
        kept = F.aggregate(
            pieces,
            F.expr("CAST(array() AS array<string>)"),
            lambda acc, s: F.when(plain(s) == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).when(plain(s) == ".", acc).otherwise(F.concat(acc, F.array(s))),
        )
        ended = F.when(plain(F.element_at(pieces, -1)).isin(".", ".."), F.array(F.lit(""))).otherwise(F.expr("CAST(array() AS array<string>)"))
        return _let(kept, lambda k: F.concat(F.lit("/"), F.array_join(F.when(F.size(k) > 0, F.concat(k, ended)).otherwise(k), "/")))

    return F.when(path.rlike(r"(?i)/(\.|%2e)"), _let(F.split(F.substring(path, F.lit(2), F.length(path)), "/"), join)).otherwise(path)


def resolve(base: Column, href: Column) -> Column:
    """A link on a page as browsers resolve it; null where neither the link nor the page has an authority that it needs.

    White space around the link, tabs and line ends in it don't count; backslashes are slashes; dot segments are resolved; scheme and host
    are in lower case. A link that is empty or only a query or a fragment stays on the page's own path.
    """
    page = r"\A\s*([A-Za-z][A-Za-z0-9+.-]*)://([^/?#\\\s]*)([^?#]*)(\?[^#]*)?"
    empty = F.lit("")

    def of_link(link: Column) -> Column:
        stated = F.lower(F.regexp_extract(link, r"\A([A-Za-z][A-Za-z0-9+.-]*):", 1))
        parts = F.struct(link.alias("link"), stated.alias("stated"), F.lower(F.regexp_extract(base, page, 1)).alias("own"))
        return _let(parts, of_scheme)

    def of_scheme(a: Column) -> Column:
        special = a["stated"].rlike(rf"\A{_SPECIAL}\z")
        rest = F.when(special, F.substring(a["link"], F.length(a["stated"]) + 2, F.length(a["link"]))).otherwise(a["link"])
        # another scheme than those of pages stays as it is
        other = F.concat(a["stated"], F.substring(a["link"], F.length(a["stated"]) + 1, F.length(a["link"])))
        return F.when((a["stated"] != "") & ~special, other).otherwise(_let(F.struct(rest.alias("rest"), special.alias("special"), a["stated"].alias("stated"), a["own"].alias("own")), of_rest))

    def of_rest(b: Column) -> Column:
        head = F.replace(F.regexp_extract(b["rest"], r"\A([^?#]*)", 1), F.lit("\\"), F.lit("/"))
        return _let(F.struct(head.alias("head"), F.regexp_extract(b["rest"], r"\A[^?#]*(.*)\z", 1).alias("tail"), b["special"].alias("special"), b["stated"].alias("stated"), b["own"].alias("own")), of_head)

    def of_head(c: Column) -> Column:
        head = c["head"]
        relative = (c["stated"] == "") | (c["special"] & (c["stated"] == c["own"]) & ~head.startswith("/"))
        alone = F.when(relative, head.startswith("//")).otherwise(True)
        return _let(F.struct(head.alias("head"), c["tail"].alias("tail"), alone.alias("alone"), F.when(c["special"], c["stated"]).otherwise(c["own"]).alias("scheme")), of_parts)

    def of_parts(c: Column) -> Column:
        head, tail, alone = c["head"], c["tail"], c["alone"]
        own_path = F.regexp_extract(base, page, 3)
        below = F.regexp_extract(head, r"\A/*[^/]*(.*)\z", 1)
        path = (
            F.when(alone, F.concat(F.when(below == "", F.lit("/")).otherwise(empty), below))
            .when(head.startswith("/"), head)
            .when(head == "", F.regexp_replace(own_path, r"\A\z", "/"))
            .otherwise(F.concat(F.lit("/"), F.regexp_extract(own_path, r"\A/(.*/)", 1), head))
        )
        raw = F.when(alone, F.regexp_extract(head, r"\A/*([^/]*)", 1)).otherwise(F.regexp_extract(base, page, 2))
        # user info as it is, the host in lower case, no port that is the scheme's own
        host_of = F.lower(F.regexp_extract(raw, r"([^@]*)\z", 1))
        ported = F.regexp_replace(F.concat(c["scheme"], F.lit("://"), host_of), rf"\A({_OWN_PORT})([^:]*):\d+\z|\A(.*):\z", "$1$2$3")
        name = F.concat(F.regexp_extract(raw, r"\A(.*@)", 1), F.regexp_extract(ported, r"://(.*)\z", 1))
        kept = F.when(~alone & (head == "") & ~tail.startswith("?"), F.coalesce(F.regexp_extract(base, page, 4), empty)).otherwise(empty)
        return _let(name, lambda n: F.when(n != "", F.concat(c["scheme"], F.lit("://"), n, _let(path, _without_dots), kept, tail)))

    return _let(F.regexp_replace(F.regexp_replace(href, r"\A[\x00-\x20]+|[\x00-\x20]+\z", ""), r"[\t\n\r]", ""), of_link)


def robots_allow(robots: Column, url: Column) -> Column:
    """Whether no Disallow line (of any agent) is a prefix of the path; no text allows all."""
    lines = F.filter(F.transform(F.split(F.coalesce(robots, F.lit("")), "\n"), lambda s: F.trim(s)), lambda s: F.lower(s).startswith("disallow:"))
    rules = F.transform(lines, lambda s: F.trim(F.regexp_replace(s, r"^[^:]*:", "")))
    return ~F.exists(rules, lambda r: (r != "") & path(url).startswith(r))
