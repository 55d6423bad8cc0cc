"""URLs, tags and links as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import any_of, c, extract, js_trim, lookup, number

# fixed values: file extension -> media type
MIME = {
    ".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".png": "image/png", ".gif": "image/gif", ".webp": "image/webp",
    ".pdf": "application/pdf",
}

# fixed values: parts of an image address that mark it as decoration, per rule set
SKIP_IMAGE = {
    "strict": ["icon", "logo", "pixel", "tracking", "avatar", "badge", "flag", "payment", "social", "share",
               "spinner", "loading", "placeholder", "blank", "1x1", "spacer", "transparent", "consent", "cookie"],
    "small": ["pixel", "tracking", "icon"],
    "page": ["pixel", "tracking", "icon", "logo", "avatar", "placeholder"],
}

# fixed values: words of a product page
# fixed values, in their natural order
PRODUCT_WORDS = ["hoist", "capacity", "load", "kg", "lifting", "product", "specifications"]

# fixed values, in their natural order
DOC_TYPES = [("datasheet", "datasheet"), ("manual", "manual"), ("brochure", "brochure"), ("spec", "specification")]


def url_key(x) -> Column:
    return F.regexp_replace(F.lower(c(x)), "/$", "")


def doc_type(href, text=None) -> Column:
    h = F.lower(F.coalesce(c(href), F.lit("")))
    t = F.lower(F.coalesce(c(text), F.lit(""))) if text is not None else None
    out = None
    for word, name in DOC_TYPES:
        hit = h.contains(word) if t is None else h.contains(word) | t.contains(word)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("document")


def mime_type(path) -> Column:
    ext = F.lower(F.regexp_extract(c(path), r"[^/.](\.[^./]*)$", 1))
    return F.coalesce(lookup(ext, MIME), F.lit("application/octet-stream"))


def file_name(path) -> Column:
    return F.substring_index(F.regexp_replace(c(path), "/+$", ""), "/", -1)


def has_product_content(html, words=tuple(PRODUCT_WORDS), need: int = 3, min_len: int = 0) -> Column:
    low = F.lower(c(html))
    hits = sum((low.contains(w).cast("int") for w in words), F.lit(0))
    return F.coalesce((F.length(c(html)) >= min_len) & (hits >= need), F.lit(False))


def video_ref(src) -> Column:
    """Struct(type, url, embed, id) of a video address; NULL when it is none."""
    s = c(src)
    yt = extract(s, r"(?:embed/|v=|v/|youtu\.be/)([a-zA-Z0-9_-]{11})")
    vm = extract(s, r"vimeo\.com/(?:video/)?(\d+)")
    none = F.lit(None).cast("string")

    def ref(kind, url, embed, vid):
        return F.struct(F.lit(kind).alias("type"), url.alias("url"), embed.alias("embed"), vid.alias("id"))

    return (
        F.when(s.contains("youtu") & yt.isNotNull(),
               ref("youtube", F.concat(F.lit("https://www.youtube.com/watch?v="), yt),
                   F.concat(F.lit("https://www.youtube.com/embed/"), yt), yt))
        .when(s.contains("vimeo") & vm.isNotNull(),
              ref("vimeo", F.concat(F.lit("https://vimeo.com/"), vm),
                  F.concat(F.lit("https://player.vimeo.com/video/"), vm), vm))
        .when(F.lower(s).rlike(r"\.(mp4|webm|ogg)(\?|$)"), ref("mp4", s, none, none)))


def skip_image(src, width=None, height=None, mode: str = "strict") -> Column:
    s = c(src)
    low = F.lower(s) if mode == "strict" else s
    hit = any_of([low.contains(p) for p in SKIP_IMAGE[mode]])
    if mode == "strict":
        hit = hit | low.endswith(".gif")
    else:
        limit = 50 if mode == "small" else 80
        for d in (width, height):
            if d is not None:
                v = F.coalesce(c(d).cast("double"), F.lit(0.0))
                hit = hit | ((v > 0) & (v < limit))
    return F.coalesce(hit, F.lit(False))


def percent_encode(url) -> Column:
    """Percent-encode blanks and non-ASCII characters, leave URL punctuation as it is."""
    x = F.replace(F.url_encode(c(url)), F.lit("+"), F.lit("%20"))
    for code, ch in [("%2F", "/"), ("%3F", "?"), ("%3D", "="), ("%26", "&"), ("%23", "#"), ("%3A", ":"), ("%40", "@"),
                     ("%21", "!"), ("%24", "$"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%2B", "+"), ("%2C", ","),
                     ("%3B", ";"), ("%7E", "~"), ("%5B", "["), ("%5D", "]"), ("%25", "%")]:
        x = F.replace(x, F.lit(code), F.lit(ch))
    return F.when(c(url).rlike(r"[^!-~]"), x).otherwise(c(url))


def absolute_url(href, base) -> Column:
    """Resolve a link against its page: absolute, scheme-relative, root-relative, query, fragment and ``..`` paths.
    An address without a usable base becomes NULL."""
    h, b = js_trim(href), c(base)
    scheme = extract(b, r"^([a-zA-Z][a-zA-Z0-9+.-]*):", 1)
    origin = extract(b, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+)", 1)
    path = F.regexp_replace(F.regexp_replace(b, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*", ""), r"[?#].*$", "")
    folder = F.regexp_replace(F.when(path == "", F.lit("/")).otherwise(path), r"[^/]*$", "")
    target = F.regexp_extract(h, r"^([^?#]*)", 1)
    rest = F.substr(h, F.length(target) + 1)
    full = F.when(target.startswith("/"), target).otherwise(F.concat(folder, target))
    empty = F.array().cast("array<string>")
    steps = F.aggregate(
        F.split(full, "/"), empty,
        lambda acc, s: F.when(s == ".", acc)
        .when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(1))))
        .otherwise(F.array_append(acc, s)))
    # a path that ends in '.' or '..' names the folder itself
    resolved = F.when(full.rlike(r"(^|/)\.\.?(/|$)"),
                      F.concat(F.array_join(steps, "/"), F.when(full.rlike(r"/\.\.?$"), "/").otherwise(""))
                      ).otherwise(full)
    relative = (
        F.when(h.startswith("//"), F.concat(scheme, F.lit(":"), h))
        .when(h.startswith("#"), F.concat(F.regexp_replace(b, "#.*$", ""), h))
        .when(h.startswith("?"), F.concat(origin, F.when(path == "", F.lit("/")).otherwise(path), h))
        .when(h == "", F.regexp_replace(b, "#.*$", ""))
        .otherwise(F.concat(origin, resolved, rest)))
    return (F.when(c(href).startswith("http"), c(href))
            .when(h.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), h)
            .otherwise(percent_encode(relative)))


def unescape(x) -> Column:
    """The character references that occur in links and link texts."""
    x = c(x)
    for ref, ch in [("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " "),
                    ("&amp;", "&")]:
        x = F.replace(x, F.lit(ref), F.lit(ch))
    return x


def visible_html(html) -> Column:
    """Markup without comments, scripts and styles."""
    return F.regexp_replace(c(html), r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>", " ")


def tag_text(fragment) -> Column:
    return js_trim(unescape(F.regexp_replace(c(fragment), r"(?s)<[^>]*>", "")))


def body_text(html) -> Column:
    return F.regexp_replace(tag_text(visible_html(html)), r"\s+", " ")


def attr(tag, name: str) -> Column:
    """Value of an attribute inside one start tag; NULL when absent or empty."""
    pat = rf"(?is)[\s<\"']{name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))"
    t = F.concat(F.lit(" "), c(tag))
    return unescape(F.coalesce(extract(t, pat, 1), extract(t, pat, 2), extract(t, pat, 3)))


def tags(html, name: str) -> Column:
    """All start tags of an element, in document order."""
    return F.regexp_extract_all(visible_html(html), F.lit(rf"(?is)<{name}\b[^>]*>"), F.lit(0))


def anchors(html) -> Column:
    """All links with their content, in document order."""
    return F.regexp_extract_all(visible_html(html), F.lit(r"(?is)<a\b[^>]*>.*?(?=</a\s*>|<a\b|$)"), F.lit(0))


def parse_int(x) -> Column:
    return F.coalesce(number(x, r"^\s*(\d+)"), F.lit(0.0))
