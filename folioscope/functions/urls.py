"""URL functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Query parameters that only track, beside those that begin with utm_. Fixed values.
TRACKING = (
    "ref", "ref_src", "ref_url", "fbclid", "gclid", "gclsrc", "dclid", "gbraid", "wbraid", "msclkid", "yclid", "twclid",
    "mc_cid", "mc_eid", "mkt_tok", "_hsenc", "_hsmi", "oly_anon_id", "oly_enc_id", "s_cid", "smid", "si", "guccounter",
    "cmpid", "igshid", "vero_id", "wickedid", "__twitter_impression", "smprod",
)
#: Query parameters that only ask for the AMP form of a page. Fixed values.
AMP = ("amp", "_amp", "amp_js_v", "usqp")


def domain(url: Column) -> Column:
    """The host: lower case, without schemes, user, port, trailing dots and www."""
    c = F.regexp_replace(F.lower(F.trim(url)), r"^([a-z][a-z0-9+.-]*:)?/+", "")
    c = F.regexp_replace(c, r"[/?#].*$", "")
    c = F.regexp_replace(c, r"^.*@", "")
    c = F.regexp_replace(c, r":[0-9]+$", "")
    return F.regexp_replace(F.regexp_replace(c, r"\.+$", ""), r"^www\.", "")


def _one_spelling(part: Column) -> Column:
    """A path segment with its percent escapes written one way; one that doesn't decode stays."""
    plain = F.try_url_decode(F.replace(part, F.lit("+"), F.lit("%2B")))
    coded = F.replace(F.url_encode(plain), F.lit("+"), F.lit("%20"))
    for code, char in (("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        coded = F.replace(coded, F.lit(code), F.lit(char))
    return F.coalesce(coded, part)


def url_key(url: Column) -> Column:
    """One key for the spellings of a page: no scheme, www/m/mobile/amp prefix, trailing slash, fragment, AMP wrapper or
    switch, tracking parameter or default port; escapes of the path written one way; other parameters stay."""
    once = F.regexp_replace(F.trim(url), r"(?i)^(?:[a-z][a-z0-9+.-]*://)+([a-z][a-z0-9+.-]*://)", "$1")
    scheme = F.lower(F.regexp_extract(once, r"(?i)^([a-z][a-z0-9+.-]*)://", 1))
    rest = F.regexp_replace(F.regexp_replace(once, r"(?i)^[a-z][a-z0-9+.-]*://+", ""), r"#.*$", "")
    site = F.regexp_replace(F.regexp_extract(rest, r"^([^/?]*)", 1), r"^.*@", "")
    path, query = F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1), F.regexp_extract(rest, r"\?(.*)$", 1)
    host = F.lower(F.regexp_replace(site, r":[0-9]*$", ""))
    wrapped = F.when(host.endswith(".cdn.ampproject.org"), F.regexp_extract(path, r"(?i)^/[a-z](?:/s)?/(.+)$", 1))
    wrapped = F.coalesce(wrapped.when(host.rlike(r"^(www\.)?google\.[a-z.]+$"), F.regexp_extract(path, r"(?i)^/amp/(?:s/)?(.+)$", 1)), F.lit(""))
    inside = wrapped != ""
    site = F.when(inside, F.regexp_extract(wrapped, r"^([^/]*)", 1)).otherwise(site)
    path = F.when(inside, F.regexp_extract(wrapped, r"^[^/]*(.*)$", 1)).otherwise(path)
    host = F.regexp_replace(F.lower(F.regexp_replace(site, r":[0-9]*$", "")), r"^(?:www[0-9]*|m|mobile|amp)\.([^.]+\.)", "$1")
    port = F.regexp_extract(site, r":([0-9]+)$", 1)
    usual = (port == "") | ((port == "443") & (scheme.isin("https", "") | inside)) | ((port == "80") & (scheme == "http") & ~inside)
    path = F.regexp_replace(F.regexp_replace(F.regexp_replace(path, r"(?i)/amp(/|$)", "$1"), r"(?i)\.amp(\.html?)$", "$1"), r"/+$", "")
    path = F.array_join(F.transform(F.split(path, "/"), _one_spelling), "/")
    form = lambda x: F.coalesce(F.url_encode(F.try_url_decode(x)), x)
    dropped = r"^(?:utm_.*|" + "|".join([*TRACKING, *AMP]) + ")$"

    def kept(p: Column) -> Column:
        name = F.lower(F.regexp_extract(p, r"^([^=]*)", 1))
        return (p != "") & ~name.rlike(dropped) & ~((name == "s") & host.rlike(r"^(twitter|x)\.com$")) & (p != "outputType=amp")

    pairs = F.transform(F.filter(F.split(query, "&"), kept), lambda p: F.concat(form(F.regexp_extract(p, r"^([^=]*)", 1)), F.lit("="), form(F.regexp_replace(p, r"^[^=]*=?", ""))))
    key = F.concat(host, F.when(usual, F.lit("")).otherwise(F.concat(F.lit(":"), port)), path, F.when(F.size(pairs) > 0, F.concat(F.lit("?"), F.array_join(pairs, "&"))).otherwise(""))
    return F.when(F.trim(url) == "", F.lit("")).otherwise(key)


def in_domain(host: Column, wanted: str) -> Column:
    """The domain itself or one below it."""
    return (host == wanted) | host.endswith("." + wanted)
