"""Hosts and registrable domains as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPACE = r"[\s\u00a0]+"


def _trimmed(source: Column) -> Column:
    return F.regexp_replace(source, rf"^{_SPACE}|{_SPACE}$", "")


def host_of(source: Column) -> Column:
    """Host of a hand-written URL in lower case, without user, port and trailing dot; null where there is none.

    A missing scheme means https; values with a scheme other than http and https have no host. Null, blank and
    malformed values give null.
    """
    s = _trimmed(source)
    has_scheme = s.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://")
    web = s.rlike(r"(?i)^https?://")
    # scheme:rest without slashes, unless what follows the colon is a port
    other = s.rlike(r"^[A-Za-z][A-Za-z0-9+\-]*:(?!\d+(?:[/?#]|$))") & ~has_scheme
    rest = F.regexp_replace(s, r"^[A-Za-z][A-Za-z0-9+.\-]*://", "")
    authority = F.regexp_extract(rest, r"^([^/?#\\]*)", 1)
    no_user = F.regexp_replace(authority, r"^.*@", "")
    no_port = F.regexp_replace(no_user, r":\d*$", "")
    host = F.lower(F.regexp_replace(no_port, r"\.+$", ""))
    good = (web | ~has_scheme) & ~other & host.rlike(r"^[^\s:\[\]]+$")
    return F.when(good, host)


def is_ip(host: Column) -> Column:
    return host.rlike(r"^\d{1,3}(\.\d{1,3}){3}$") | host.contains(":")


def last_two_labels(source: Column) -> Column:
    """The last two labels of the host; null for IP addresses and hosts without a dot."""
    h = host_of(source)
    return F.when(~is_ip(h) & h.contains("."), F.regexp_extract(h, r"([^.]+\.[^.]+)$", 1)).otherwise(None)


#: Second-level labels under which country registries give out names (co.uk, com.au, ac.jp).
REGISTRY_LABELS = ("ac", "co", "com", "edu", "go", "gob", "gouv", "gov", "gv", "mil", "ne", "net", "nom", "or", "org", "sch")


def root_domain(source: Column, more: tuple[str, ...] = ()) -> Column:
    """The registrable domain: one label before the public suffix; null for IP addresses and hosts that are a suffix.

    A suffix is the last label, or the last two where a registry label stands before a country's two letters; further
    suffixes of two labels, as private registries have them, can be given.
    """
    h = host_of(source)
    two = F.regexp_extract(h, r"([^.]+\.[^.]+)$", 1)
    three = F.regexp_extract(h, r"([^.]+\.[^.]+\.[^.]+)$", 1)
    suffix = two.rlike(rf"^(?:{'|'.join(REGISTRY_LABELS)})\.[a-z]{{2}}$")
    if more:
        suffix = suffix | two.isin(*more)
    return F.when(is_ip(h) | ~h.contains("."), None).when(suffix, F.when(three != "", three)).otherwise(two)
