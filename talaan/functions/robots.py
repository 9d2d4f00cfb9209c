"""Politeness rules: robots.txt groups, the longest matching rule, public addresses, retry times, request streaks."""

from __future__ import annotations

import ipaddress
import re
from urllib.parse import quote, unquote

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def rules(text: str | None, product: str) -> list[tuple[bool, str]]:
    """(allow, pattern) of the product's group, else of *. Agents in consecutive lines share a group."""
    groups: dict[str, list] = {}
    agents: list[str] = []
    open_ = False
    for line in (text or "").splitlines():
        key, sep, value = line.split("#")[0].partition(":")
        key, value = key.strip().lower(), value.strip()
        if not sep:
            continue
        if key == "user-agent":
            agents = [*agents, value.lower()] if open_ else [value.lower()]
            open_ = True
            groups.setdefault(value.lower(), [])
        elif key in ("allow", "disallow"):
            open_ = False
            for a in agents:
                if value:
                    groups[a].append((key == "allow", value))
    return groups.get(product.lower(), groups.get("*", []))


def one_spelling(path: str) -> str:
    """A path or pattern with every character percent-encoded that has to be, and no other."""
    return quote(unquote(path), safe="/?=&%*$:@!,;~+-._")


def allows(found: list[tuple[bool, str]], path: str) -> bool:
    """The longest matching pattern decides; of equal ones an allowing rule; without any, yes. Encoded and plain characters are the same."""
    best, path = (-1, True), one_spelling(path or "/")
    for allow, pattern in found:
        body = pattern.removesuffix("$")
        form = "".join(".*" if c == "*" else re.escape(c) for c in one_spelling(body)) + ("$" if pattern.endswith("$") else "")
        if re.match(form, path):
            best = max(best, (len(pattern), allow))
    return best[1]


def origin(url: Column) -> Column:
    """Scheme and host of an http(s) address, with the port if one is given, where its robots.txt is; else null."""
    return F.nullif(F.lower(F.regexp_extract(url, r"(?i)^(https?://[^/?#@\s]+)(?:[/?#]|$)", 1)), F.lit(""))


def is_public(address: str | None) -> bool:
    try:
        ip = ipaddress.ip_address(address or "")
    except ValueError:
        return False
    ip = getattr(ip, "ipv4_mapped", None) or ip
    return ip.is_global and not (ip.is_multicast or ip.is_reserved)


def allowed_column(text: Column, path: Column, product: str) -> Column:
    @F.pandas_udf("boolean")
    def go(t: pd.Series, p: pd.Series) -> pd.Series:
        return pd.Series([allows(rules(x, product), y or "/") for x, y in zip(t, p)])

    return go(text, path)


def is_public_column(address: Column) -> Column:
    @F.pandas_udf("boolean")
    def go(a: pd.Series) -> pd.Series:
        return a.map(is_public)

    return go(address)


def access_of_status(status: Column) -> Column:
    """What a robots.txt answer means: parse it, allow all, or disallow all."""
    return F.when(status.between(200, 299), "parse").when(status.between(400, 499) & (status != 429), "allow").otherwise("disallow")


def retry_after(value: Column, now: Column) -> Column:
    """Seconds to wait, at most 60: digits or an HTTP date."""
    at = F.try_to_timestamp(F.regexp_replace(value, r"^\w+, | GMT$", ""), F.lit("dd MMM yyyy HH:mm:ss"))
    seconds = F.coalesce(value.try_cast("int"), F.greatest(F.lit(0), (F.unix_seconds(at) - F.unix_seconds(now)).cast("int")))
    return F.least(seconds, F.lit(60))


def blocked_hosts(log: DataFrame, host: str, at: list[str], status: str, streak: int = 3) -> DataFrame:
    """Hosts that answered 403 or 429 ``streak`` times in a row: gaps and islands over each host's log."""
    bad = F.col(status).isin(403, 429)
    island = F.sum(F.when(bad, 0).otherwise(1)).over(W.partitionBy(host).orderBy(*at))
    runs = log.withColumn("island_", island).where(bad).groupBy(host, "island_").agg(F.count("*").alias("n_"))
    return runs.where(F.col("n_") >= streak).select(host).distinct()
