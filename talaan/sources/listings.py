"""Directory pages: HTML to listing rows by a declarative adapter of CSS selectors."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import quote, urljoin, urlsplit

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talaan.functions.html import domain, parse

FIELDS = ["name", "phone", "email", "website", "address", "street", "city", "facebook", "detail_url", "opening_hours"]
CHECKS = ["terms_allow", "robots_allow", "public_pages", "contact_given", "rate_limited"]


@dataclass
class Adapter:
    """A directory: ``fields`` maps a field to a selector or to {selector, attr, multiple}."""

    label: str
    base_url: str
    item: str
    fields: dict
    start_urls: list[str] = field(default_factory=list)
    next_page: str | None = None
    max_pages: int = 5
    checklist: dict = field(default_factory=dict)

    def __post_init__(self):
        if not all(self.checklist.get(c) is True for c in CHECKS):
            raise ValueError("every point of the checklist must be true")
        if unknown := set(self.fields) - set(FIELDS):
            raise ValueError(f"unknown fields: {sorted(unknown)}")
        if not 1 <= self.max_pages <= 50 or "name" not in self.fields:
            raise ValueError("max_pages is 1 to 50, and a name is needed")
        if any(not same_site(u, self.base_url) for u in self.start_urls):
            raise ValueError("start addresses must be on the directory's site")

    def starts(self, **values: str) -> list[str]:
        return [u.format(**{k: quote(v) for k, v in values.items()}) for u in self.start_urls]


def same_site(a: str, b: str) -> bool:
    x, y = urlsplit(a).hostname, urlsplit(b).hostname
    return (domain(x) or x) == (domain(y) or y)


def rows_of(html: str | None, url: str, a: Adapter) -> list[dict]:
    """The listings of a page; items without a name are skipped. The ref is the detail page, else a hash of name and place."""
    out = []
    for item in parse(html).select(a.item):
        row: dict = {}
        for f, spec in a.fields.items():
            spec = {"selector": spec} if isinstance(spec, str) else spec
            attr = spec.get("attr")
            hits = [n.attrs.get(attr, "").strip() if attr else n.text() for n in item.select(spec["selector"])]
            hits = [h.split(":", 1)[1] if h.lower().startswith(("mailto:", "tel:")) else urljoin(url, h) if attr in ("href", "src") else h for h in hits if h]
            if hits:
                row[f] = "; ".join(hits) if spec.get("multiple") else hits[0]
        if row.get("name"):
            place = row.get("address") or row.get("street") or ""
            ref = row.get("detail_url") or "h:" + hashlib.sha1(f"{row['name']}|{place}".lower().encode()).hexdigest()[:16]
            out.append({**{f: row.get(f) for f in FIELDS}, "source_ref": ref})
    return out


def next_page(html: str | None, url: str, a: Adapter) -> str | None:
    hits = parse(html).select(a.next_page) if a.next_page else []
    to = urljoin(url, hits[0].attrs.get("href", "")) if hits else None
    return to if to and same_site(to, a.base_url) else None


def read_listings(pages: DataFrame, a: Adapter, html: str = "html", url: str = "url") -> DataFrame:
    """Listings of all pages; of repeats of a ref the one on the first page, then the first in it."""

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [{**r, "page": u, "pos": i} for u, h in zip(pdf["url"], pdf["html"]) for i, r in enumerate(rows_of(h, u, a))]
            yield pd.DataFrame(rows, columns=[*FIELDS, "source_ref", "page", "pos"], dtype=object)

    schema = ", ".join(f"{c} string" for c in [*FIELDS, "source_ref", "page"]) + ", pos int"
    rows = pages.select(F.col(url).alias("url"), F.col(html).alias("html")).mapInPandas(go, schema)
    one = rows.groupBy("source_ref").agg(F.min_by(F.struct(*FIELDS), F.struct("page", "pos")).alias("r"))
    return one.select("source_ref", "r.*")


def crawl(fetch, a: Adapter, limit: int, **values: str) -> list[dict]:
    """Pages in order from ``fetch(url) -> html``, each once, until ``limit`` listings; the first of a ref wins."""
    found: dict[str, dict] = {}
    seen: set[str] = set()
    for start in a.starts(**values):
        url, n = start, 0
        while url and url not in seen and n < a.max_pages and len(found) < limit:
            seen.add(url)
            n += 1
            html = fetch(url)
            for r in rows_of(html, url, a):
                found.setdefault(r["source_ref"], r)
            url = next_page(html, url, a)
    return list(found.values())[:limit]
