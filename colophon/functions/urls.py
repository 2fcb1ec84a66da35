"""URL checks as single regular expressions, so that a check is one pass over the text.

White space, control characters and back slashes never match: a URL that needs browser
repair is treated as invalid.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from colophon.functions.codes import _col, blank_to_null

_TAIL = "(?:[/?#][^\\s\\\\]*)?$"
HTTP_PATTERN = "(?i)^https?://(?:[^/?#\\s\\\\]*@)?[^/?#:@\\s\\\\]+(?::[0-9]*)?" + _TAIL


def allowed_pattern(
    hosts: tuple[str, ...],
    *,
    subdomains: bool = True,
    schemes: str = "https",
    any_port: bool = False,
    userinfo: bool = False,
    path: str | None = None,
    query: bool = True,
    fragment: bool = True,
) -> str:
    """Pattern for: scheme, no user info, default port, host (or below a host) in the list.

    ``path`` is a regular expression for the whole path; without it any path is fine.
    """
    names = "|".join(h.replace(".", "[.]") for h in hosts)
    return "".join(
        (
            "(?i)^(?:", schemes, ")://",
            "(?:[^/?#\\s\\\\]*@)?" if userinfo else "(?::?@)?",
            "(?:[^/?#:@\\s\\\\]+[.])?" if subdomains else "",
            "(?:", names, ")",
            "(?::[0-9]*)?" if any_port else "(?::(?:443)?)?",
            "(?:/[^?#\\s\\\\]*)?" if path is None else path,
            "(?:[?][^#\\s\\\\]*)?" if query else "[?]?",
            "(?:#[^\\s\\\\]*)?$" if fragment else "#?$",
        )
    )


def matches(c, pattern: str) -> Column:
    """Null-safe match."""
    return F.coalesce(_col(c).rlike(pattern), F.lit(False))


def url_allowed(c, hosts: tuple[str, ...], **rules) -> Column:
    return matches(F.trim(_col(c)), allowed_pattern(hosts, **rules))


def url_or_null(c) -> Column:
    """The trimmed text when it is an http(s) URL."""
    t = blank_to_null(c)
    return F.when(t.rlike(HTTP_PATTERN), t)


def sales_url(affiliate, official, hosts: tuple[str, ...]) -> Column:
    """Struct ``url, is_affiliate``: the first of the two links on a sales host; null when none is."""
    pattern = allowed_pattern(hosts, schemes="https?", any_port=True, userinfo=True)
    return F.when(
        matches(affiliate, pattern), F.struct(_col(affiliate).alias("url"), F.lit(True).alias("is_affiliate"))
    ).when(matches(official, pattern), F.struct(_col(official).alias("url"), F.lit(False).alias("is_affiliate")))


_SIGNED = "(?i)[?&](?:[^=&#]*(?:token|signature|credential|expires|policy|key-pair-id|x-amz-)[^=&#]*)="


def canonical_url(
    c, hosts: tuple[str, ...], *, subdomains: bool = False, allow_root: bool = True, reject_signed: bool = True
) -> Column:
    """``https://host/path`` without query, fragment, repeated or trailing slashes; else null."""
    t = blank_to_null(c)
    host = F.lower(F.regexp_extract(t, "(?i)^https://(?::?@)?([^/?#:@\\s\\\\]+)", 1))
    path = F.regexp_extract(t, "(?i)^https://[^/?#]*([^?#]*)", 1)
    path = F.regexp_replace(F.regexp_replace(path, "/+", "/"), "/$", "")
    ok = matches(t, allowed_pattern(hosts, subdomains=subdomains))
    if not allow_root:
        ok = ok & (path != "")
    if reject_signed:
        ok = ok & ~matches(t, _SIGNED)
    return F.when(ok, F.concat(F.lit("https://"), host, F.when(path == "", F.lit("/")).otherwise(path)))


def literal(text: str) -> str:
    """Escape a text for use inside a pattern of either engine."""
    return re.sub(r"([.?+*()\[\]{}|^$\\])", r"[\1]", text).replace("[\\]", "\\\\").replace("[^]", "\\^")
