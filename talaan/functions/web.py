"""Websites, e-mails, social pages, and facts in HTML. All are JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from talaan.functions import dims

_URL = r"^([a-z]+)://(?:[^/?#@]*@)?([^/?#:]+)(:\d+)?([^?#]*)(?:\?([^#]*))?"


def _typed(raw: Column) -> Column:
    t = F.regexp_replace(F.trim(raw), "^[<>\"']+|[<>\"']+$", "")
    bad = (t == "") | F.contains(t, F.lit(" ")) | t.rlike("(?i)^(mailto|tel|javascript):")
    whole = F.when(t.startswith("//"), F.concat(F.lit("https:"), t)).when(F.contains(t, F.lit("://")), t).otherwise(F.concat(F.lit("https://"), t))
    return F.when(~bad, whole)


def normal_url(raw: Column) -> Column:
    """An http(s) address in one spelling: lower scheme and host, no tracking, fragment, user or trailing slash; else null.

    Query values keep the encoding they have.
    """
    u = _typed(raw)
    scheme, host = F.lower(F.regexp_extract(u, "(?i)" + _URL, 1)), F.regexp_replace(F.lower(F.regexp_extract(u, "(?i)" + _URL, 2)), r"\.+$", "")
    port, path, query = (F.regexp_extract(u, "(?i)" + _URL, i) for i in (3, 4, 5))
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(p).startswith("utm_") & ~F.lower(F.regexp_extract(p, "^([^=]*)", 1)).isin(*dims.TRACKING))
    path = F.regexp_replace(path, "/+$", "")
    tail = F.when(F.size(kept) > 0, F.concat(F.when(path == "", "/").otherwise(path), F.lit("?"), F.array_join(kept, "&"))).otherwise(path)
    return F.when(scheme.isin("http", "https") & F.contains(host, F.lit(".")), F.concat(scheme, F.lit("://"), host, port, tail))


def url_host(url: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(url, r"^[a-zA-Z]+://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def platform(url: Column) -> Column:
    """The social platform whose host this is, or a subdomain of it."""
    h = url_host(url)
    out = F.lit(None).cast("string")
    for name, hosts in reversed(dims.SOCIAL):
        out = F.when(h.rlike(r"(^|\.)(" + "|".join(x.replace(".", r"\.") for x in hosts) + ")$"), name).otherwise(out)
    return out


def website_only(raw: Column) -> Column:
    """The normal address if it isn't a social page."""
    u = normal_url(raw)
    return F.when(platform(u).isNull(), u)


def registered_domain(host_or_url: Column) -> Column:
    """The suffix and one label before it; null for a bare suffix or an address of numbers."""
    h = F.regexp_replace(F.lower(F.when(F.contains(host_or_url, F.lit("://")), url_host(host_or_url)).otherwise(host_or_url)), r"\.+$", "")
    two = F.array_join(F.slice(F.split(h, r"\."), -2, 2), ".")
    three = F.array_join(F.slice(F.split(h, r"\."), -3, 3), ".")
    n = F.size(F.split(h, r"\."))
    return F.when((n < 2) | h.rlike(r"^[\d.]+$"), None).when(two.isin(*dims.SUFFIXES) | two.rlike(f"^{dims.COUNTRY_SUFFIX}$"), F.when(n >= 3, three)).otherwise(two)


def is_shared(domain: Column) -> Column:
    return F.coalesce(domain.isin(*dims.SHARED_HOSTS), F.lit(False))


def site_key(url: Column) -> Column:
    h = url_host(url)
    return F.coalesce(registered_domain(h), h)


def messenger(url: Column) -> Column:
    """The chat address of a page, if the address names a page."""
    page = F.regexp_extract(F.regexp_extract(url, r"^[a-zA-Z]+://[^/?#]+([^?#]*)", 1), r"^/([A-Za-z0-9.]{5,})/?$", 1)
    ok = (platform(url) == "facebook") & (page != "") & ~F.lower(page).isin(*dims.NOT_PAGES) & ~F.endswith(page, F.lit(".php"))
    return F.when(ok, F.concat(F.lit("https://m.me/"), page))


def normal_email(raw: Column) -> Column:
    e = F.lower(F.trim(F.regexp_extract(F.regexp_replace(F.trim(raw), "^mailto:", ""), r"^([^?]*)", 1)))
    return F.when(e.rlike(r"^[a-z0-9._%+\-]+@[a-z0-9.\-]+\.[a-z]{2,}$"), e)


def mail_host(email: Column) -> Column:
    return F.substring_index(email, "@", -1)


def clean_email(raw: Column) -> Column:
    """A normal e-mail that isn't an image name, a pixel density or a junk domain."""
    e = normal_email(F.coalesce(F.try_url_decode(F.replace(raw, F.lit("+"), F.lit("%2B"))), raw))
    h = mail_host(e)
    bad = e.rlike(r"\.(png|jpe?g|gif|webp|svg|bmp|ico|avif)$|@\d+x\.") | h.isin(*dims.JUNK_MAIL) | F.coalesce(registered_domain(h).isin(*dims.JUNK_MAIL), F.lit(False))
    return F.when(~bad, e)


def emails_in(text: Column) -> Column:
    """All clean e-mails of a text, first seen first; bracketed [at] and (dot) forms included."""
    plain = F.regexp_extract_all(text, F.lit(r"([A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,24})"), F.lit(1))
    hidden = F.regexp_extract_all(
        text, F.lit(r"(?i)([A-Za-z0-9._%+\-]+\s*[\[({]\s*at\s*[\])}]\s*[A-Za-z0-9\-]+(?:\s*[\[({]\s*dot\s*[\])}]\s*[A-Za-z0-9\-]+)+)"), F.lit(1)
    )
    open_ = F.transform(hidden, lambda x: F.regexp_replace(F.regexp_replace(x, r"(?i)\s*[\[({]\s*at\s*[\])}]\s*", "@"), r"(?i)\s*[\[({]\s*dot\s*[\])}]\s*", "."))
    return F.array_distinct(F.filter(F.transform(F.concat(plain, open_), clean_email), lambda e: e.isNotNull()))


def ranked_emails(emails: Column, domain: Column) -> Column:
    """Own domain, then free providers, then others; preferred mailboxes first; then the order given."""
    pref = F.create_map(*(x for i, p in enumerate(dims.PREFERRED) for x in (F.lit(p), F.lit(i))))

    def rank(e: Column, i: Column) -> Column:
        tier = F.when(F.coalesce(registered_domain(mail_host(e)) == domain, F.lit(False)), 0).when(mail_host(e).isin(*dims.FREE_MAIL), 1).otherwise(2)
        return F.struct(tier.alias("t"), F.coalesce(F.try_element_at(pref, F.substring_index(e, "@", 1)), F.lit(99)).alias("p"), i.alias("i"), e.alias("e"))

    return F.transform(F.array_sort(F.transform(F.array_distinct(emails), rank)), lambda s: s["e"])


def visible_text(html: Column) -> Column:
    """Text without scripts, styles and tags, squeezed."""
    x = F.regexp_replace(html, r"(?is)<(script|style|noscript|template|svg)\b.*?</\1\s*>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(x, r"(?s)<[^>]*>", " "), r"\s+", " "))


def tech(html: Column, headers: Column | None = None) -> Column:
    """Platforms by marks in the page or, if given, in the answer's headers (a map with lower-case names)."""
    seen = {n: F.coalesce(html.rlike("(?i)" + p), F.lit(False)) for n, p in dims.PLATFORMS}
    if headers is not None:
        for n, name, p in dims.PLATFORM_HEADERS:
            seen[n] = seen[n] | F.coalesce(F.try_element_at(headers, F.lit(name)).rlike("(?i)" + p), F.lit(False))
    return F.array_compact(F.array(*(F.when(hit, n) for n, hit in seen.items())))


def has_viewport(html: Column) -> Column:
    tags = F.regexp_extract_all(html, F.lit(r"(?i)(<meta\b[^>]*\bname\s*=\s*[\"']?viewport\b[^>]*>)"), F.lit(1))
    return F.exists(tags, lambda t: t.rlike(r"(?i)width\s*=\s*device-width"))


def site_facts(html: Column, year: int) -> Column:
    """copyright:YYYY first (the latest year from 1990 to ``year``), then analytics, pixels and booking platforms."""
    years = F.regexp_extract_all(html, F.lit(r"(?i)(?:©|&copy;|&#169;|\bcopyright\b)\s*(?:\d{4}\s*(?:-|–|&ndash;|to)\s*)?(\d{4})"), F.lit(1))
    top = F.array_max(F.filter(F.transform(years, lambda y: y.cast("int")), lambda y: y.between(1990, year)))
    return F.array_compact(F.array(F.concat(F.lit("copyright:"), top.cast("string")), *(F.when(html.rlike("(?i)" + p), n) for n, p in dims.FACTS)))


def redact(text: Column) -> Column:
    for p in dims.SECRETS:
        text = F.regexp_replace(text, p, "$1[REDACTED]")
    return text


def escape_cell(column: str, value: Column) -> Column:
    """A guard against formulas in spreadsheets; phones and numbers stay as they are."""
    if column in ("phone", "phones_extra", "lat", "lon", "score"):
        return value
    return F.when(value.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), value)).otherwise(value)


def escape_query(value: Column) -> Column:
    return F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
