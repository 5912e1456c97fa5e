"""Names, URLs, references and content addresses as column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

#: Query keys that only track, besides all that begin with utm_.  Fixed values.
TRACKING = ["fbclid", "gclid", "gclsrc", "dclid", "msclkid", "mc_cid", "mc_eid", "igsh", "si"]
#: Hosts that serve the same as another.  Fixed values.
HOST_ALIASES = {
    "www.twitter.com": "twitter.com", "mobile.twitter.com": "twitter.com", "m.twitter.com": "twitter.com", "x.com": "twitter.com", "www.x.com": "twitter.com",
    "www.instagram.com": "instagram.com", "m.instagram.com": "instagram.com", "www.youtube.com": "youtube.com", "m.youtube.com": "youtube.com",
    "www.imgur.com": "imgur.com", "m.imgur.com": "imgur.com", "i.imgur.com": "imgur.com", "www.flickr.com": "flickr.com", "m.flickr.com": "flickr.com",
    "en.m.wikipedia.org": "en.wikipedia.org",
}
#: File extensions that browsers show.  Fixed values.
SHOWN = ["jpg", "jpeg", "png", "gif", "webp", "avif", "svg"]


@pandas_udf(StringType())
def normalize_nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFC", x))


def normalize_name(name: Column) -> Column:
    """Trimmed, lower case, NFC."""
    return normalize_nfc(F.lower(F.trim(name)))


_URL = r"^(?i)(https?)://(?:[^/?#@]*@)?([^/?#:]+)(?::(\d*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def _part(url: Column, k: int) -> Column:
    return F.regexp_extract(url, _URL, k)


def host(url: Column) -> Column:
    """Lower-case host under its canonical name; null unless the scheme is http or https."""
    lower = F.lower(_part(url, 2))
    return F.when(lower != "", F.coalesce(F.create_map(*[F.lit(v) for kv in HOST_ALIASES.items() for v in kv])[lower], lower))


def normalize_url(url: Column) -> Column:
    """A URL's form for storage and dedup; null unless http or https.

    Lower-case scheme and host, host aliases resolved, default port, fragment, tracking parameters, an empty
    query and a trailing slash of the path dropped.  Other query pairs keep their spelling and order.
    """
    url = F.trim(url)
    scheme, port, path = F.lower(_part(url, 1)), _part(url, 3), _part(url, 4)
    usual = (port == "") | ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443"))
    key = lambda p: F.lower(F.split(p, "=", 2)[0])
    kept = F.filter(F.split(_part(url, 5), "&"), lambda p: (p != "") & ~key(p).startswith("utm_") & ~key(p).isin(TRACKING))
    path = F.when(path == "", "/").when((F.length(path) > 1) & path.endswith("/"), F.regexp_replace(path, "/$", "")).otherwise(path)
    query = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    return F.when(host(url).isNotNull(), F.concat(scheme, F.lit("://"), host(url), F.when(usual, "").otherwise(F.concat(F.lit(":"), port)), path, query))


def media_key(url: Column) -> Column:
    """web/ and the SHA-256 of the URL without fragment, user info and empty query; null unless http or https."""
    scheme, port = F.lower(_part(url, 1)), _part(url, 3)
    usual = (port == "") | ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443"))
    path = F.when(_part(url, 4) == "", "/").otherwise(_part(url, 4))
    query = F.when(_part(url, 5) != "", F.concat(F.lit("?"), _part(url, 5))).otherwise("")
    identity = F.concat(scheme, F.lit("://"), F.lower(_part(url, 2)), F.when(usual, "").otherwise(F.concat(F.lit(":"), port)), path, query)
    return F.when(scheme != "", F.concat(F.lit("web/"), F.sha2(identity, 256)))


def displayable(url: Column) -> Column:
    """Whether the last path segment of an http(s) URL has an extension that browsers show."""
    return (_part(url, 1) != "") & F.lower(F.regexp_extract(F.element_at(F.split(_part(url, 4), "/"), -1), r"\.([^.]*)$", 1)).isin(SHOWN)


def reference_from_url(url: Column) -> Column:
    """struct<system, key> of a recognised reference URL; any other http(s) URL is system ``url``."""
    h = F.regexp_replace(F.lower(_part(url, 2)), r"^www\.", "")
    seg = F.filter(F.split(_part(url, 4), "/"), lambda s: s != "")
    at = lambda k: F.coalesce(F.get(seg, k), F.lit(""))
    ref = lambda system, key: F.struct(F.lit(system).alias("system"), key.alias("key"))
    plain = lambda s: F.regexp_replace(F.url_decode(F.regexp_replace(s, r"\+", "%2B")), "_", " ")
    element = at(0).isin("node", "way", "relation") & at(1).rlike(r"^\d+$")
    language = F.regexp_extract(h, r"^([a-z][a-z-]*)\.wikipedia\.org$", 1)
    return (
        F.when((h == "pleiades.stoa.org") & (at(0) == "places") & at(1).rlike(r"^\d+$"), ref("pleiades", at(1)))
        .when((h == "commons.wikimedia.org") & (at(0) == "wiki") & at(1).startswith("Category:"), ref("commons_category", F.regexp_replace(plain(at(1)), "^Category:", "")))
        .when((h == "wikidata.org") & at(0).isin("wiki", "entity") & at(1).rlike(r"^Q[1-9]\d*$"), ref("wikidata", at(1)))
        .when((h == "openstreetmap.org") & element, ref("osm", F.concat_ws("/", at(0), at(1))))
        .when((h == "openhistoricalmap.org") & element, ref("ohm", F.concat_ws("/", at(0), at(1))))
        .when((h == "geonames.org") & at(0).rlike(r"^\d+$"), ref("geonames", at(0)))
        .when((h == "vocab.getty.edu") & (at(0) == "tgn") & at(1).rlike(r"^\d+$"), ref("tgn", at(1)))
        .when((language != "") & (at(0) == "wiki") & (at(1) != ""), ref("wikipedia", F.concat(language, F.lit(":"), plain(at(1)))))
        .when(_part(url, 1) != "", ref("url", url))
    )


def reference_to_url(system: Column, key: Column) -> Column:
    """The canonical URL of a reference (titles with spaces as underscores)."""
    under = F.regexp_replace(key, " ", "_")
    title = F.regexp_replace(key, "^[a-z-]+:", "")
    return (
        F.when(system == "wikidata", F.concat(F.lit("https://www.wikidata.org/wiki/"), key))
        .when(system == "osm", F.concat(F.lit("https://www.openstreetmap.org/"), key))
        .when(system == "ohm", F.concat(F.lit("https://www.openhistoricalmap.org/"), key))
        .when(system == "geonames", F.concat(F.lit("https://www.geonames.org/"), key))
        .when(system == "tgn", F.concat(F.lit("https://vocab.getty.edu/tgn/"), key))
        .when(system == "pleiades", F.concat(F.lit("https://pleiades.stoa.org/places/"), key))
        .when(system == "nrhp", F.concat(F.lit("https://npgallery.nps.gov/NRHP/AssetDetail?assetID="), key))
        .when(system == "commons_category", F.concat(F.lit("https://commons.wikimedia.org/wiki/Category:"), under))
        .when(system == "wikipedia", F.concat(F.lit("https://"), F.regexp_extract(key, "^([a-z-]+):", 1), F.lit(".wikipedia.org/wiki/"), F.regexp_replace(title, " ", "_")))
        .when(system == "url", key)
    )


def reference_from_sitelink(site: Column, title: Column) -> Column:
    """struct<system, key> of a site link: xxwiki is Wikipedia in that language, commonswiki a category; else null."""
    language = F.regexp_replace(F.regexp_extract(site, "^([a-z_]+)wiki$", 1), "_", "-")
    other = language.isin("", "commons", "species", "wikidata", "meta", "simple-commons")
    return F.when((site == "commonswiki") & title.startswith("Category:"), F.struct(F.lit("commons_category").alias("system"), F.regexp_replace(title, "^Category:", "").alias("key"))).when(~other, F.struct(F.lit("wikipedia").alias("system"), F.concat(language, F.lit(":"), title).alias("key")))


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def commit_id(author: Column, recorded_at: Column, facts: Column) -> Column:
    """SHA-256 of a bundle's canonical JSON: author, whole-second time, facts in sorted order."""
    return F.sha2(F.to_json(F.struct(author.alias("author"), F.date_format(F.date_trunc("second", recorded_at), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("recorded_at"), F.sort_array(facts).alias("facts"))), 256)


def era_label(year: Column) -> Column:
    """A year as a time slider says it: 2000 BCE, 1 CE, 1500."""
    return F.when(year < 0, F.concat((-year).cast("string"), F.lit(" BCE"))).when(year < 1500, F.concat(year.cast("string"), F.lit(" CE"))).otherwise(year.cast("string"))


def timeline_unit(year: Column, end_year: int) -> Column:
    """Track position of a year: 20 years a unit from -2000, 2 from 1500, 1 from 1850, held inside the axis."""
    end = max(end_year, 1850)
    last = 350 + end - 1850
    return (
        F.when(year <= -2000, 0)
        .when(year >= end, last)
        .when(year <= 1500, F.floor((year + 2000 + 10) / 20))
        .when(year <= 1850, F.floor((year - 1500 + 1) / 2) + 175)
        .otherwise(year - 1850 + 350)
        .cast("int")
    )


def is_item_id(s: Column) -> Column:
    return s.rlike(r"^Q[1-9]\d*$")


def is_property_id(s: Column) -> Column:
    return s.rlike(r"^P[1-9]\d*$")


def isbn_ok(s: Column) -> Column:
    """Whether a spelling, hyphens and spaces aside, is an ISBN-10 or ISBN-13 with the right check digit."""
    d = F.upper(F.regexp_replace(s, "[- ]", ""))
    digit = lambda k: F.when(F.substring(d, k, 1) == "X", F.lit(10)).otherwise(F.try_to_number(F.substring(d, k, 1), F.lit("9")).cast("int"))
    ten = sum((digit(k) * (11 - k) for k in range(1, 11)), F.lit(0)) % 11 == 0
    thirteen = sum((digit(k) * (1 if k % 2 else 3) for k in range(1, 14)), F.lit(0)) % 10 == 0
    return F.when(d.rlike(r"^\d{9}[\dX]$"), ten).when(d.rlike(r"^97[89]\d{10}$"), thirteen).otherwise(F.lit(False))


def language_subtag(tag: Column) -> Column:
    """Lower-case primary subtag (2 to 8 letters) of a BCP-47 tag; else null."""
    found = F.lower(F.regexp_extract(tag, r"^([A-Za-z]{2,8})(?:-[A-Za-z0-9]{1,8})*$", 1))
    return F.when(found != "", found)


def parse_published(s: Column) -> Column:
    """UTC timestamp of an RFC 3339, RFC 2822 or naive ISO spelling; else null."""
    s = F.trim(s)
    rfc2822 = F.regexp_extract(s, r"^(?:[A-Za-z]{3}, )?(\d{1,2} [A-Za-z]{3} \d{4} \d{2}:\d{2}:\d{2}) (?:GMT|UTC|[+-]\d{4})$", 1)
    offset = F.regexp_extract(s, r" ([+-]\d{4})$", 1)
    minutes = F.when(offset != "", (F.substring(offset, 2, 2).cast("int") * 60 + F.substring(offset, 4, 2).cast("int")) * F.when(offset.startswith("-"), -1).otherwise(1)).otherwise(0)
    iso = F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})?$"), F.try_to_timestamp(s))
    mail = F.when(rfc2822 != "", F.try_to_timestamp(rfc2822, F.lit("d MMM yyyy HH:mm:ss")))
    return F.coalesce(iso, mail - F.make_interval(mins=minutes))
