"""URL expressions: canonical forms, predicates and rule classification, all as columns.

There are five canonical forms, and they differ on purpose: what one keeps apart, another joins.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import has_any, partial_similarity, sequence_similarity, strip

#: Rules (substring of the lower-cased url, value), the first that fits decides.
CONTENT_TYPES = (
    ("/webinars/", "webinar"), ("/videos/", "video"), ("/video/", "video"), ("/guides-tools/", "guide"),
    ("/pension-calculator", "tool"), ("/retirement-planner", "tool"), ("/lump-sum-calculator", "tool"), ("/risk-profiler", "tool"),
    ("/calculator", "tool"), ("/planner", "tool"), ("/existing-customers/", "faq"), ("/help-and-support/", "faq"),
    ("/pensions-explained", "faq"), ("/about-us/", "corporate"), ("/media/", "news"), ("/press-release", "news"), ("/news/", "news"), ("/agm/", "corporate"),
)
PRODUCTS = (
    ("/pension", "pensions"), ("/retirement", "retirement"), ("/life-insurance", "life_insurance"), ("/life-cover", "life_insurance"),
    ("/whole-of-life", "life_insurance"), ("/income-protection", "income_protection"), ("/critical-illness", "critical_illness"),
    ("/illness-income", "income_protection"), ("/isa", "isa"), ("/investments", "investments"), ("/investment", "investments"),
    ("/fund", "investments"), ("/funeral", "funeral"), ("/financial-adviser", "financial_advice"), ("/find-a-financial", "financial_advice"),
    ("/about-us", "corporate"), ("/media", "corporate"), ("/existing-customers", "customer_support"),
)
SECTIONS = {
    "existing-customers": "Existing Customers", "insurance": "Insurance", "pensions": "Pensions", "guides-tools": "Guides and Tools",
    "retirement-planning": "Retirement Planning", "isa": "ISA", "about-us": "About Us",
    "find-a-financial-adviser": "Find a Financial Adviser", "accessibility": "Accessibility", "informational-pages": "Information",
}
CATEGORIES = {"brand": "article", "guidance": "guide", "other": "article", "product": "article", "tool": "tool"}
STRONG_TYPES = ("webinar", "video", "tool", "faq", "news")
DEDICATED = (
    "/pensions/", "/insurance/", "/life-insurance/", "/income-protection/", "/critical-illness/", "/isa/", "/investments/", "/funeral/",
    "/pension-guides/", "/life-insurance-guides/", "/isa-guides/", "/existing-customers/",
)
GENERAL = ("/about-us/", "/our-purpose/", "/our-performance/", "/agm/", "/life-events/", "/cost-of-living/", "/planning-ahead/", "/money-guides/")
VARIANT_MARKS = ("#state=", "#policy=")


def _url(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def blank_to_null(c: Column) -> Column:
    return F.nullif(strip(c), F.lit(""))


def _bare(url: Column) -> Column:
    """Without query and fragment."""
    return F.regexp_replace(_url(url), r"(?s)[?#].*$", "")


def _head(url: Column) -> Column:
    """Scheme and host."""
    return F.regexp_extract(url, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/]*)", 1)


def canonical_url(url: Column) -> Column:
    """Without outer blanks, query and fragment, without trailing slashes, path in lower case; scheme and host stay. The scraper's form."""
    bare = _bare(strip(_url(url)))
    head = _head(bare)
    return F.regexp_replace(F.concat(head, F.lower(F.substring(bare, F.length(head) + 1, F.length(bare)))), "/+$", "")


def lowered_url(url: Column) -> Column:
    """All in lower case, without outer blanks and trailing slashes; query and fragment stay. The freshness job's form."""
    return F.lower(F.regexp_replace(strip(_url(url)), "/+$", ""))


def url_path(url: Column) -> Column:
    """Lower-case url without query and fragment."""
    return F.lower(_bare(url))


def compared_url(url: Column) -> Column:
    """url_path without trailing slashes: the form in which redirects are told."""
    return F.regexp_replace(url_path(url), "/+$", "")


def lowered_without_params(url: Column) -> Column:
    """Scheme, host and path in lower case, without trailing slashes, parameters of the path, query and fragment. The list checker's form."""
    return F.lower(F.regexp_replace(F.regexp_replace(_bare(strip(_url(url))), r";[^/]*$", ""), "/+$", ""))


def host_lowered(url: Column) -> Column:
    """Scheme and host in lower case, the path as it is, without trailing slashes, query and fragment. The evaluation's form."""
    bare = _bare(strip(_url(url)))
    head = _head(bare)
    return F.regexp_replace(F.concat(F.lower(head), F.substring(bare, F.length(head) + 1, F.length(bare))), "/+$", "")


def has_fragment(url: Column) -> Column:
    return F.coalesce(url.contains("#"), F.lit(False))


def is_variant(url: Column, marks=VARIANT_MARKS) -> Column:
    """Whether the url is that of a state of a page, by its fragment."""
    return has_any(_url(url), marks)


def base_url(url: Column) -> Column:
    return F.substring_index(url, "#", 1)


def identity(url: Column, variant: Column) -> Column:
    """The variant's url if there is one, else the base url; without trailing slashes."""
    return F.regexp_replace(F.coalesce(blank_to_null(variant), url), "/+$", "")


def citation_url(url: Column, parent: Column) -> Column:
    """The parent's url if there is one, else the url."""
    return F.coalesce(blank_to_null(parent), url, F.lit(""))


def segments(url: Column) -> Column:
    """The parts of the path that aren't empty."""
    path = F.regexp_extract(_bare(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]*(/.*)?$", 1)
    return F.filter(F.split(path, "/"), lambda s: s != "")


def first_segment(url: Column) -> Column:
    return F.regexp_extract(_url(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*/([^/?#]*)", 1)


def section(url: Column, known: dict[str, str] = SECTIONS, default: str = "General") -> Column:
    """The section of the first part of the path."""
    names = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    return F.coalesce(F.try_element_at(names, F.lower(first_segment(url))), F.lit(default))


def by_first_rule(text: Column, rules, default: str) -> Column:
    """The value of the first rule (substring, value) whose substring text contains."""
    out = None
    for part, value in rules:
        hit = text.contains(part)
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return F.lit(default) if out is None else out.otherwise(default)


def content_type(url: Column, rules=CONTENT_TYPES) -> Column:
    return by_first_rule(F.lower(_url(url)), rules, "article")


def product(url: Column, rules=PRODUCTS) -> Column:
    return by_first_rule(F.lower(_url(url)), rules, "general")


def audience(url: Column, kinds=("adviser", "employer"), default: str = "customer") -> Column:
    """The kind that has a host of its own, or a part of the path."""
    out, low = F.lit(default), F.lower(_url(url))
    for kind in reversed(kinds):
        out = F.when(low.rlike(rf"(://|^){kind}\.|/{kind}/"), kind).otherwise(out)
    return out


def categorised_type(category: Column, url: Column, known: dict[str, str] = CATEGORIES, strong=STRONG_TYPES) -> Column:
    """The type of a category that was given, if it is known and the url says nothing stronger; else that of the url."""
    names = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    own = content_type(url)
    mapped = F.try_element_at(names, F.lower(strip(_url(category))))
    return F.when(mapped.isNull() | own.isin(*strong), own).otherwise(mapped)


def is_dedicated(url: Column, parts=DEDICATED) -> Column:
    return has_any(F.lower(_url(url)), parts)


def is_general(url: Column, parts=GENERAL) -> Column:
    return has_any(F.lower(_url(url)), parts)


def slug(url: Column) -> Column:
    """The name of a page's file: its canonical url with everything but letters and digits as one underscore."""
    return F.regexp_replace(F.regexp_replace(canonical_url(url), "[^a-zA-Z0-9]+", "_"), "^_+|_+$", "")


def host(url: Column) -> Column:
    """The host in lower case, without user, password and port; "" if there is none."""
    place = F.regexp_extract(_url(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)
    return F.lower(F.regexp_replace(F.regexp_replace(place, "^.*@", ""), ":[0-9]*$", ""))


def link_problem(url: Column, suffixes: list[str]) -> Column:
    """not https, or host not allowed; null if the url is absolute, https, and its host is, or is under, one of suffixes."""
    names = "|".join(s.lower().replace(".", r"\.") for s in suffixes)
    secure = _url(url).rlike(r"^(?i)https://[^/?#]")
    fine = host(url).rlike(rf"^(?:.*\.)?(?:{names})$") if suffixes else F.lit(True)
    return F.when(~secure, "must be an absolute https url").when(~fine, "host is not allowed")


def allowed_host(url: Column, suffixes: list[str]) -> Column:
    return link_problem(url, suffixes).isNull()


def estimated_chunks(length: Column, size: int = 1600, overlap: int = 200) -> Column:
    """1 up to size, else whole steps after the overlap."""
    return F.when(length <= size, F.lit(1)).otherwise(F.greatest(F.lit(1), F.floor((length - overlap) / (size - overlap)).cast("int")))


def rough_chunks(length: Column, size: int = 1600, overlap: int = 200) -> Column:
    """Whole steps after the overlap, at least 1."""
    return F.greatest(F.lit(1), F.floor((length - overlap) / (size - overlap)).cast("int"))


def size_flag(n_chunks: Column, warn: int = 20, critical: int = 50) -> Column:
    return F.when(n_chunks > critical, "CRITICAL").when(n_chunks > warn, "WARN").otherwise("OK")


def health(code: Column, final_url: Column, url: Column, own: str, failure: Column | None = None) -> Column:
    """live, internal_redirect, external_redirect, dead_404, error or timeout, of a request's outcome. Only 404 and 410 are dead; failure
    is timeout, error or null."""
    failure = F.lit(None).cast("string") if failure is None else failure
    same = compared_url(final_url) == compared_url(url)
    ok = F.when(same, "live").when(final_url.contains(own), "internal_redirect").otherwise("external_redirect")
    return F.when(failure.isNotNull(), failure).when(code.isNull(), "error").when(code < 300, ok).when(code.isin(404, 410), "dead_404").otherwise("error")


def redirect_reason(url: Column, final_url: Column, title: Column | None = None, live_title: Column | None = None) -> Column:
    """How a url differs from where it led: parent, slug, restructured, title (of titles that are given, less than 60 % of the shorter is found in
    the other) or other; null if the paths are the same. Any difference counts; the reason only says which."""
    a, b = (F.regexp_replace(F.regexp_extract(_bare(F.lower(_url(u))), r"^[a-z][a-z0-9+.-]*://[^/]*(/.*)?$", 1), "/+$", "") for u in (url, final_url))
    x, y = (F.filter(F.split(p, "/"), lambda s: s != "") for p in (a, b))
    last = lambda s: F.coalesce(F.try_element_at(s, F.lit(-1)), F.lit(""))
    kept = F.size(F.filter(y, lambda s: F.array_contains(x, s)))
    moved = (F.size(x) > 0) & (F.bround(kept / F.when(F.size(x) > 0, F.size(x)) * 100) < 100)
    other_slug = (last(x) != "") & (last(y) != "") & (last(x) != last(y))
    out = F.when(a == b, None).when(a.startswith(F.concat(b, F.lit("/"))), "parent").when(other_slug, "slug").when(moved, "restructured")
    if title is not None and live_title is not None:
        some = (_url(title) != "") & (_url(live_title) != "")
        out = out.when(some & (F.round(partial_similarity(title, live_title) * 100) < 60), "title")
    return out.otherwise("other")


def slug_likeness(url: Column, final_url: Column) -> Column:
    """How alike the last parts of two paths are, in percent: context for whoever looks at a redirect, no gate."""
    last = lambda u: F.coalesce(F.try_element_at(segments(F.lower(u)), F.lit(-1)), F.lit(""))
    return F.round(sequence_similarity(last(url), last(final_url)) * 100)
