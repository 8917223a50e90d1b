"""URL columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Query parameters that only track a reader.
TRACKING = ["_hsenc", "_hsmi", "fbclid", "from", "gclid", "igshid", "mkt_tok", "mc_cid", "mc_eid", "ref", "ref_src", "share_from", "share_source", "si", "spm", "yclid"]
TRACKING_PATTERN = r"^(utm_.*|session|sessionid|jsessionid|phpsessid)$"
#: URLs that are canonical as they stand, told by one look: lower-case host, plain path, nothing behind it.
_PLAIN = r"^https?://[a-z0-9][a-z0-9.-]*(?:/[^\s?#/&]+)*$"
_PARTS = r"^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def part(url: Column, n: int) -> Column:
    """1 scheme, 2 authority, 3 path, 4 query, 5 fragment; empty where absent."""
    return F.regexp_extract(url, _PARTS, n)


def host(url: Column) -> Column:
    """Lower-case host without user and port."""
    return F.lower(F.regexp_replace(F.regexp_replace(part(url, 2), "^.*@", ""), ":[0-9]*$", ""))


def _recoded(text: Column) -> Column:
    """Form-encoded anew after decoding, as it stands if it can't be decoded."""
    return F.replace(F.replace(F.url_encode(F.coalesce(F.try_url_decode(text), text)), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def canonical(url: Column, keep_virtual: bool = True) -> Column:
    """Canonical URL: trimmed, entities undone, scheme and host in lower case, no user and default port, single slashes,
    no last slash, no tracking parameters, parameters in order, and no fragment but virtual items'."""
    raw = F.replace(F.trim(F.coalesce(url, F.lit(""))), F.lit("&amp;"), F.lit("&"))
    scheme = F.lower(part(raw, 1))
    port = F.regexp_extract(part(raw, 2), ":([0-9]+)$", 1)
    plain = (port == "") | ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443"))
    where = F.when(plain, host(raw)).otherwise(F.concat(host(raw), F.lit(":"), port))
    path = F.regexp_replace(part(raw, 3), "/{2,}", "/")
    path = F.when((path != "/") & path.endswith("/"), F.substring(path, 1, F.length(path) - 1)).otherwise(path)
    pairs = F.transform(F.filter(F.split(part(raw, 4), "&"), lambda x: x != ""), lambda x: F.struct(F.regexp_extract(x, "^([^=]*)", 1).alias("k"), F.regexp_extract(x, "=(.*)$", 1).alias("v")))
    kept = F.filter(pairs, lambda x: ~F.lower(x["k"]).isin(TRACKING) & ~F.lower(x["k"]).rlike(TRACKING_PATTERN))
    ordered = F.array_sort(F.transform(kept, lambda x: F.struct(F.lower(x["k"]).alias("o"), x["v"].alias("v"), x["k"].alias("k"))))
    query = F.array_join(F.transform(ordered, lambda x: F.concat(_recoded(x["k"]), F.lit("="), _recoded(x["v"]))), "&")
    fragment = part(raw, 5)
    virtual = F.lower(fragment).rlike("^(item-|virtual-)") if keep_virtual else F.lit(False)
    return F.when(raw == "", "").when(raw.rlike(_PLAIN), raw).otherwise(
        F.concat(
            F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(""),
            F.when(where != "", F.concat(F.lit("//"), where)).otherwise(""),
            path,
            F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""),
            F.when(virtual & (fragment != ""), F.concat(F.lit("#"), fragment)).otherwise(""),
        )
    )


def registrable(host_: Column) -> Column:
    """The last two labels of a host, three under two-part public suffixes."""
    labels = F.split(host_, "\\.")
    n = F.when(host_.rlike(r"\.(com|edu|gov|org|net|ac)\.[a-z]{2}$"), 3).otherwise(2)
    return F.array_join(F.slice(labels, F.greatest(F.lit(1), F.size(labels) - n + 1), n), ".")
