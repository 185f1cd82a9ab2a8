"""Url functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The second letters of the hash alphabet.
SECOND = "acegikmoqs"


def _hash_codes() -> list[str]:
    """The code of each byte value: letter n mod 26, then the second letter n div 26, where byte 0 counts as 255 and bytes from 128 as one less."""
    numbers = [255, *range(1, 128), *range(127, 255)]
    return [chr(97 + n % 26) + SECOND[n // 26] for n in numbers]


def url_hash(url: Column) -> Column:
    """The 40-letter key of a url, made from the bytes of its SHA-1."""
    codes = F.array(*[F.lit(c) for c in _hash_codes()])
    digest = F.sha1(url)
    byte = lambda i: F.conv(F.substr(digest, i, F.lit(2)), 16, 10).cast("int")
    return F.when(url.isNotNull(), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(39), F.lit(2)), lambda i: F.element_at(codes, byte(i) + 1)), ""))


def host_of(url: Column) -> Column:
    """The host without leading www., "Unknown" where the url has none."""
    host = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)", 1)
    return F.coalesce(F.nullif(F.regexp_replace(host, r"^www\.", ""), F.lit("")), F.lit("Unknown"))


def top_domain(url: Column) -> Column:
    """The last two labels of the host."""
    bare = F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://)?([^/:?#]*)", 1)
    return F.substring_index(bare, ".", -2)


def root_url(url: Column) -> Column:
    """Protocol, host and path without the query."""
    return F.regexp_extract(url, r"^[^?#]*", 0)


def url_parts(url: Column) -> Column:
    """A struct of protocol, host, port and path; empty parts are null."""
    part = lambda i: F.nullif(F.regexp_extract(url, r"^(?:([A-Za-z][A-Za-z0-9+.-]*)://)?([^/:?#]*)(?::([0-9]+))?(/.*)?$", i), F.lit(""))
    return F.struct(part(1).alias("protocol"), part(2).alias("host"), part(3).cast("int").alias("port"), part(4).alias("path"))


def crawlable(url: Column) -> Column:
    """http or https, and not the address of an image or text file."""
    return url.rlike(r"^https?://") & ~F.lower(url).rlike(r"\.(jpg|jpeg|gif|png|txt)$")


# What marks links of advertisers, one news site's shopping pages, and protocols that lead to no page.
AD_WORDS = "ad track utm promo sponsored".split()
SHOP_PAGES = r"^https?://(?:www\.)?nbcnews\.com(?::[0-9]+)?/select"
NO_PAGE = "mailto: javascript: tel:".split()
LONGEST_LINK = 200


def unwanted_link(url: Column) -> Column:
    """Links that the frontier drops: overlong, advertising and tracking, other protocols; letter case does not matter."""
    low = F.lower(url)
    return (F.length(low) > LONGEST_LINK) | low.rlike(SHOP_PAGES) | low.rlike("|".join(AD_WORDS)) | low.rlike("|".join(NO_PAGE))


def normalized_link(link: Column, base: Column) -> Column:
    """A link made absolute against its page, with port; null where it can't be.

    The fragment goes, spaces are escaped, ``..`` steps up from the page's folder, missing protocol, host and port come from the page or the protocol.
    """
    protocol = F.lower(F.regexp_extract(base, r"^([A-Za-z]+)://", 1))
    authority = F.regexp_extract(base, r"^[A-Za-z]+://([^/?#]*)", 1)
    path = F.regexp_replace(F.regexp_extract(base, r"^[A-Za-z]+://[^/?#]*([^?#]*)", 1), r"[^/]*$", "")
    folder = F.when(path == "", F.lit("/")).otherwise(path)
    parent = F.regexp_replace(folder, r"[^/]+/$", "")
    raw = F.regexp_replace(F.trim(F.regexp_replace(link, r"#.*$", "")), r"\\+$", "")
    usable = (raw != "") & ~raw.rlike(r"""[<>"'{}|^\[\]\\]""") & ~F.lower(raw).rlike(r"^(mailto|javascript|tel|data|ftp):")
    spaced = F.replace(raw, F.lit(" "), F.lit("%20"))
    absolute = F.when(spaced.rlike(r"^[A-Za-z]+://"), spaced).when(spaced.startswith("//"), F.concat(protocol, F.lit(":"), spaced)).when(
        spaced.startswith("/"), F.concat(protocol, F.lit("://"), authority, spaced)
    ).when(spaced.startswith("../"), F.concat(protocol, F.lit("://"), authority, parent, F.substr(spaced, F.lit(4)))).otherwise(F.concat(protocol, F.lit("://"), authority, folder, spaced))
    scheme = F.lower(F.regexp_extract(absolute, r"^([A-Za-z]+)://", 1))
    host = F.regexp_extract(absolute, r"^[A-Za-z]+://([^/:?#]*)", 1)
    port = F.coalesce(F.nullif(F.regexp_extract(absolute, r"^[A-Za-z]+://[^/:?#]*:([0-9]+)", 1), F.lit("")), F.when(scheme == "https", F.lit("443")).otherwise(F.lit("80")))
    rest = F.regexp_replace(F.regexp_extract(absolute, r"^[A-Za-z]+://[^/?#]*(.*)$", 1), r"/{2,}", "/")
    rest = F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest))
    return F.when(usable & scheme.isin("http", "https") & host.rlike(r"^[A-Za-z0-9.-]+$"), F.concat(scheme, F.lit("://"), host, F.lit(":"), port, rest))


def wildcard_regex(pattern: Column) -> Column:
    """A blacklist pattern, where * stands for anything, as a regular expression."""
    return F.concat(F.lit("^"), F.replace(F.replace(pattern, F.lit("."), F.lit("\\.")), F.lit("*"), F.lit(".*")), F.lit("$"))


def short_id(n: Column, letters: int = 5) -> Column:
    """A number as letters, the least significant first, base 26."""
    return F.array_join(F.array(*[F.chr(97 + (F.floor(n / 26**i) % 26).cast("int")) for i in range(letters)]), "")


def depth_drop_share(url: Column) -> Column:
    """The share of links as deep as this one that a thinned crawl drops: logistic in the number of path segments, a half at eight."""
    depth = F.size(F.filter(F.split(F.regexp_extract(url, r"^[A-Za-z]+://[^/?#]*([^?#]*)", 1), "/"), lambda p: p != ""))
    return 1 / (1 + F.exp(-0.5 * (depth - 8)))


# The shares of links that a thinned crawl drops by the end of their host.
DROP_SHARES = ((("edu", "org", "com", "net"), 0.1), (("gov", "tv", "io"), 0.3))
OTHER_DROP_SHARE = 0.8


def domain_drop_share(url: Column) -> Column:
    """The share of links to hosts of this ending that a thinned crawl drops."""
    host = F.regexp_extract(F.lower(url), r"^[a-z]+://([^/:?#]*)", 1)
    out = F.lit(OTHER_DROP_SHARE)
    for ends, share in reversed(DROP_SHARES):
        out = F.when(host.rlike(f"(?:{'|'.join(ends)})$"), F.lit(share)).otherwise(out)
    return out


def random_looking(url: Column) -> Column:
    """Whether a path of more than four segments has one of ten or more letters and digits only."""
    parts = F.split(F.regexp_extract(url, r"^[A-Za-z]+://(.*)$", 1), "/")
    return (F.size(parts) > 5) & F.exists(parts, lambda p: p.rlike("^[a-zA-Z0-9]{10,}$"))


def thinned(url: Column, seed: int = 0, by_domain: bool = False) -> Column:
    """Whether a link stays, by a seeded hash of it against its share; with ``by_domain`` also by the share of its host's ending, and never if its path looks random."""
    drawn = lambda k: F.pmod(F.xxhash64(url, F.lit(seed + k)), F.lit(1_000_000)) / 1_000_000
    stays = drawn(0) >= depth_drop_share(url)
    return stays & (drawn(1) >= domain_drop_share(url)) & ~random_looking(url) if by_domain else stays
