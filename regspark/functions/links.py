"""Link extraction from listing pages and URL / path expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regspark.functions.keys import _col

# --- fixed values: patterns and entities ------------------------------------------------
# an <a> tag's href, any case, with a double-quoted, single-quoted or bare value; attributes
# before it are read whole, so data-href and a ">" inside quotes do not confuse it
ANCHOR_HREF = (r"""(?i)<a(?:\s+[^\s"'<>/=]+(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'>]+))?)*?"""
               r"""\s+href\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)""")
QUOTED_VALUE = r"""^("[^"]*"|'[^']*')$"""
# markup an HTML parser does not read anchors from: comments, scripts, styles
NON_CONTENT = r"(?is)<(?:!--.*?-->|script\b.*?</script>|style\b.*?</style>)"
URL_ORIGIN = r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)"
URL_SCHEME = r"^([A-Za-z][A-Za-z0-9+.-]*):"
URL_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)"
# the XML entities besides &amp;
HTML_ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'")]
# ---------------------------------------------------------------------------------------


def attribute_value(c) -> Column:
    """A raw attribute value without its quotes; XML entities and numeric references decoded once."""
    c = _col(c)
    inner = F.regexp_replace(c, r"""^["']|["']$""", "")
    v = F.when(c.rlike(QUOTED_VALUE), inner).otherwise(c)
    for entity, ch in HTML_ENTITIES:
        v = F.replace(v, F.lit(entity), F.lit(ch))
    # &amp; waits as a mark, so that what it yields is not decoded again
    v = F.replace(v, F.lit("&amp;"), F.lit("\u0001"))
    v = F.when(F.contains(v, F.lit("&#")), numeric_references(v)).otherwise(v)
    return F.replace(v, F.lit("\u0001"), F.lit("&"))


def numeric_references(c) -> Column:
    """``&#39;`` and ``&#x27;`` as the characters they stand for; others are left alone."""
    parts = F.split(_col(c), "&#")

    def decoded(part):
        digits = F.regexp_extract(part, r"^([xX][0-9a-fA-F]{1,6}|[0-9]{1,7});", 1)
        code = F.when(digits.rlike("^[xX]"), F.conv(F.substring(digits, 2, 6), 16, 10)).otherwise(digits).try_cast("int")
        valid = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
        char = F.decode(F.unhex(F.lpad(F.hex(F.when(valid, code).otherwise(F.lit(32))), 8, "0")), "UTF-32")
        rest = F.regexp_replace(part, r"^[xX0-9a-fA-F]+;", "")
        return F.when(F.coalesce(valid, F.lit(False)), F.concat(char, rest)).otherwise(F.concat(F.lit("&#"), part))
    return F.concat(parts[0], F.array_join(F.transform(F.slice(parts, 2, F.size(parts)), decoded), ""))


def extract_links(pages: DataFrame, html_col: str = "html", keep: list[str] | None = None,
                  out_col: str = "href") -> DataFrame:
    """One row per anchor ``href`` of each page; null and empty links are dropped.

    Tags match in any case; values may be double-quoted, single-quoted or bare; the five
    XML entities and numeric references are decoded (``&amp;`` -> ``&``); anchors inside comments, scripts and
    styles are ignored — as an HTML parser would.
    """
    keep = keep if keep is not None else [c for c in pages.columns if c != html_col]
    content = F.regexp_replace(F.col(html_col), NON_CONTENT, "")
    raw = F.regexp_extract_all(content, F.lit(ANCHOR_HREF), 1)
    out = pages.select(*keep, F.explode(raw).alias(out_col))
    out = out.select(*keep, attribute_value(out_col).alias(out_col))
    return out.where(is_present(out_col))


def is_present(c) -> Column:
    """Truthy test of an extracted value: not null and not empty."""
    c = _col(c)
    return c.isNotNull() & (c != "")


def starts_with_any(c, prefixes: list[str]) -> Column:
    c = _col(c)
    return reduce(lambda a, b: a | b, [c.startswith(p) for p in prefixes])


def ends_with(c, suffix: str, negate: bool = False) -> Column:
    cond = _col(c).endswith(suffix)
    return ~cond if negate else cond


def contains_keyword(c, keyword: str, case_sensitive: bool = True) -> Column:
    c = _col(c)
    if case_sensitive:
        return c.contains(keyword)
    return F.lower(c).contains(keyword.lower())


def strip_query(c) -> Column:
    """URL or path without ``?query`` and ``#fragment``."""
    return F.regexp_replace(_col(c), r"[?#].*$", "")


def base_name(c, url: bool = False) -> Column:
    """Last path segment (``os.path.basename``); empty for a trailing slash.

    In a file name ``#`` and ``?`` are ordinary characters; with ``url=True`` they start the
    fragment and the query, which do not belong to the name.
    """
    return F.regexp_extract(strip_query(c) if url else _col(c), r"([^/]*)$", 1)


# the last dot starts the extension only after a non-dot character (leading dots belong
# to the name, as in os.path.splitext)
_EXTENSION = r"^\.*[^.].*(\.[^.]*)$"


def extension(c, url: bool = False) -> Column:
    """Extension including the dot, or empty (``os.path.splitext(...)[1]``)."""
    return F.regexp_extract(base_name(c, url), _EXTENSION, 1)


def stem(c, url: bool = False) -> Column:
    """Base name without its extension (``os.path.splitext(...)[0]``)."""
    b = base_name(c, url)
    return F.when(extension(c, url) == "", b).otherwise(F.regexp_replace(b, r"\.[^.]*$", ""))


def url_host(c) -> Column:
    return F.regexp_extract(_col(c), URL_HOST, 1)


def resolve_link(base, link) -> Column:
    """Resolve ``link`` against the page URL ``base`` (the ``urljoin`` cases).

    * absolute (``scheme:...``)  -> link
    * network-path (``//h/x``)   -> base scheme + link
    * root-relative (``/x``)     -> base origin + link
    * empty                      -> base, unchanged (as ``urljoin`` does)
    * query only (``?q``)        -> base without its query and fragment + link
    * fragment only (``#f``)     -> base without its fragment + link
    * relative (``x``)           -> base directory + link

    ``.`` and ``..`` segments of root-relative and relative results are resolved.
    """
    base, link = _col(base), _col(link)
    origin = F.regexp_extract(base, URL_ORIGIN, 1)
    scheme = F.regexp_extract(base, URL_SCHEME, 1)
    base_path = strip_query(base)
    # an origin without a path ("http://h") resolves relative links under "/"
    directory = F.when(F.length(base_path) == F.length(origin), F.concat(origin, F.lit("/"))) \
        .otherwise(F.regexp_replace(base_path, r"[^/]*$", ""))
    return (
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), link)
        .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
        .when(link.startswith("/"), without_dot_segments(F.concat(origin, link)))
        .when(link == "", base)
        .when(link.startswith("?"), F.concat(base_path, link))
        .when(link.startswith("#"), F.concat(F.regexp_replace(base, r"#.*$", ""), link))
        .otherwise(without_dot_segments(F.concat(directory, link)))
    )


def without_dot_segments(url) -> Column:
    """The URL with ``.`` and ``..`` path segments resolved; ``..`` above the root is dropped."""
    url = _col(url)
    pattern = r"^([^:/?#]+://[^/?#]*)([^?#]*)(.*)$"
    head, path, tail = (F.regexp_extract(url, pattern, i) for i in (1, 2, 3))
    segments = F.split(path, "/", -1)
    empty = F.array().cast("array<string>")

    def step(done, s):
        up = F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(1)))
        return F.when(s == "..", F.when(F.size(done) > 0, up).otherwise(done)).when(s == ".", done) \
            .otherwise(F.concat(done, F.array(s)))
    last = F.element_at(segments, -1)
    kept = F.concat(F.aggregate(segments, empty, step), F.when(last.isin(".", ".."), F.array(F.lit(""))).otherwise(empty))
    resolved = F.array_join(kept, "/")
    resolved = F.when(resolved == "", F.lit("/")).otherwise(resolved)
    return F.when(path.rlike(r"(^|/)\.\.?(/|$)"), F.concat(head, resolved, tail)).otherwise(url)
