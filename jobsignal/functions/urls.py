"""URL expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_ABSOLUTE = r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#\s]+[^\s]*$"


def valid(url: Column) -> Column:
    """The URL if it is absolute and has a host, with its host lower-cased and a path."""
    url = F.trim(url)
    head = F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]+)", 1)
    rest = F.substring(url, F.length(head) + 1, F.length(url))
    path = F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest))
    return F.when(url.rlike(_ABSOLUTE), F.concat(F.lower(head), path))


def host(url: Column) -> Column:
    """Lower-cased host without user, port and trailing dot; null without one."""
    h = F.lower(F.regexp_extract(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1))
    return F.nullif(F.regexp_replace(h, r"\.$", ""), F.lit(""))


def bare_host(url: Column) -> Column:
    return F.regexp_replace(host(url), r"^www\.", "")


def port(url: Column) -> Column:
    return F.nullif(F.regexp_extract(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?(?:\[[^\]]*\]|[^/?#:]*):([0-9]+)", 1), F.lit(""))


def has_credentials(url: Column) -> Column:
    return F.trim(url).rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*@")


def base_parts(base: Column) -> dict[str, Column]:
    """What hrefs of a page are resolved against: its scheme, root, folder, and URL without fragment or query."""
    return {
        "scheme": F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*:)", 1),
        "root": F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]+)", 1),
        "folder": F.regexp_extract(F.regexp_replace(base, r"[?#].*$", ""), r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/]+/(?:.*/)?)", 1),
        "plain": F.regexp_replace(base, r"#.*$", ""),
    }


def resolved(h: Column, scheme: Column, root: Column, folder: Column, plain: Column) -> Column:
    """A trimmed href without fragment against the parts of its page's URL; ``valid`` tells whether it is one."""
    return (
        F.when(h.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), h).when(h.startswith("//"), F.concat(scheme, h)).when(h.startswith("/"), F.concat(root, h))
        .when(h.startswith("?"), F.concat(F.regexp_replace(plain, r"[?].*$", ""), h)).when(h == "", plain)
        .otherwise(F.concat(F.when(folder == "", F.concat(root, F.lit("/"))).otherwise(folder), h))
    )


# Hosts that never leave a private network.
PRIVATE_HOST = r"^\[?(localhost|.*\.localhost|.*\.local|::1|f[cd][0-9a-f]{0,2}:.*|fe80:.*|10\..*|127\..*|169\.254\..*|192\.168\..*|172\.(1[6-9]|2\d|3[01])\..*|0\..*)\]?$"
