"""URL columns.  All take and give string columns; null stays null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extensions that aren't pages, path words to skip, tracking parameters.
NON_PAGE_EXTENSIONS = ("jpg jpeg png gif svg webp ico pdf zip rar 7z doc docx xls xlsx csv ppt pptx mp3 mp4 mov avi xml json rss atom txt").split()
ASSET_EXTENSIONS = ("xml json pdf jpg jpeg png gif webp mp3 mp4 wav avi mov mkv webm woff woff2 ttf eot css js ico svg").split()
SKIP_KEYWORDS = ("/login /logout /signin /signup /register /privacy /terms /contact /search /cart /checkout /wp-json /wp-admin /wp-login mailto: tel: javascript: /tag/ /tags/ /category/ /categories/ /author/ /page/ ?s= /events /videos").split()
TRACKING = ("utm_source utm_campaign utm_medium utm_term utm_content fbclid gclid mc_cid mc_eid ref igshid").split()
# Fixed value: paths of navigation and utility pages.
UTILITY_PATHS = r"(?i)\b(about|contact|privacy|terms|legal|disclaimer|copyright|accessibility|cookie|gdpr|login|logout|signin|signup|register|profile|dashboard|settings|password|account|subscribe|newsletter|donate|membership|pricing|plans|trial|advertise|sponsorship|sponsor|jobs|careers|support|faq|help|cart|checkout|share|follow|facebook|linkedin|twitter|instagram|youtube|whatsapp|telegram|search|feed|rss|sitemap|author|wp-login|wp-admin|page/\d|#|events|videos)\b"
PRIVATE_HOSTS = r"^(localhost|.*\.localhost|0\..*|10\..*|127\..*|169\.254\..*|192\.168\..*|172\.(1[6-9]|2[0-9]|3[01])\..*|\[?(::1?|f[cd][0-9a-f]{2}:.*|fe[89ab][0-9a-f]:.*)\]?)$"

SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*://"


def url_authority(url: Column) -> Column:
    """Host with port and user, as written; '' where there is none."""
    return F.regexp_extract(url, SCHEME + r"([^/?#]*)", 1)


def url_host(url: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(url_authority(url), r"^.*@", ""), r":[0-9]*$", ""))


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, SCHEME + r"[^/?#]*([^?#]*)", 1)


def url_query(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*(\?[^#]*)", 1)


def url_source(url: Column) -> Column:
    """The host as a source name, with its port."""
    return url_authority(url)


def normalize_url(url: Column) -> Column:
    """Without fragment; without trailing slashes unless that leaves a bare host."""
    plain = F.regexp_replace(url, r"#.*$", "")
    slashes = F.length(plain) - F.length(F.replace(plain, F.lit("/"), F.lit("")))
    return F.when(slashes > 2, F.regexp_replace(plain, r"/+$", "")).otherwise(plain)


def drop_tracking(url: Column, names: list[str] = TRACKING) -> Column:
    """Without the tracking parameters of the query."""
    query = F.substring(url_query(url), 2, 1_000_000)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: ~F.substring_index(p, "=", 1).isin(names)), "&")
    before = F.regexp_extract(url, r"^([^?#]*)", 1)
    return F.concat(before, F.when(kept == "", "").otherwise(F.concat(F.lit("?"), kept)), F.regexp_extract(url, r"(#.*)$", 1))


def url_slug(url: Column) -> Column:
    """The last non-empty path segment, lower case; '' for a home page."""
    return F.coalesce(F.lower(F.try_element_at(F.filter(F.split(url_path(url), "/"), lambda s: s != ""), F.lit(-1))), F.lit(""))


def choose_canonical(candidate: Column, url: Column) -> Column:
    """The page's own canonical link if its slug and the url's are equal or one holds the other; else the url."""
    own, other = url_slug(url), url_slug(normalize_url(candidate))
    same = (own != "") & (other != "") & (other.contains(own) | own.contains(other))
    return F.when(candidate.isNotNull() & same, normalize_url(candidate)).otherwise(normalize_url(url))


def url_date(url: Column) -> Column:
    """The first 20yy-m-d in the url as a date, if it is one."""
    part = [F.regexp_extract(url, r"(20[0-9]{2})[/_-]([0-9]{1,2})[/_-]([0-9]{1,2})", i) for i in (1, 2, 3)]
    return F.try_to_timestamp(F.concat_ws("-", part[0], F.lpad(part[1], 2, "0"), F.lpad(part[2], 2, "0")), F.lit("yyyy-MM-dd")).cast("date")


def url_looks_like_article(url: Column) -> Column:
    """A dated path, or a slug of at least three words."""
    dated = url.rlike(r"/(19|20)[0-9]{2}[/-](0?[1-9]|1[0-2])[/-]")
    words = F.size(F.filter(F.split(url_slug(url), "[-_]"), lambda w: w != ""))
    home = F.regexp_replace(url_path(url), r"^/+|/+$", "") == ""
    return ~home & (dated | (words >= 3))


def _any(words: list[str]) -> str:
    import re

    return "|".join(re.escape(w) for w in words)


def is_page_url(url: Column, extensions: list[str] = NON_PAGE_EXTENSIONS, keywords: list[str] = SKIP_KEYWORDS) -> Column:
    """Neither a file nor a utility address; the extension is looked for before the query."""
    path = F.lower(F.regexp_replace(url, r"[?#].*$", ""))
    return ~path.rlike(rf"\.({_any(extensions)})$") & ~F.lower(url).rlike(_any(keywords))


def same_host(a: Column, b: Column, ignore_www: bool = False) -> Column:
    plain = (lambda u: F.regexp_replace(url_host(u), r"^www\.", "")) if ignore_www else url_host
    return plain(a) == plain(b)


def is_article_link(url: Column, base: Column) -> Column:
    """A link of the same site that isn't its home, an asset, a utility page or a category list."""
    path = url_path(url)
    return same_host(url, base, True) & ~path.isin("/", "", "/index.html") & ~path.rlike(rf"(?i)\.({_any(ASSET_EXTENSIONS)})$") & ~path.rlike(UTILITY_PATHS) & ~path.rlike(r"(?i)^/(category|tag|tags|categories)/[^/]+/?$")


def is_public_host(url: Column) -> Column:
    """http or https with a host that isn't private, loopback or link-local; names aren't looked up."""
    return url.rlike(r"(?i)^https?://") & (url_host(url) != "") & ~url_host(url).rlike(PRIVATE_HOSTS)
