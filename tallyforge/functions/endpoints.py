"""Strict endpoint identity: one normal form per address, computed over distinct addresses only."""

from __future__ import annotations

import ipaddress
import re
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.runtime import fresh

_LABEL = re.compile(r"[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?")
_OWN_PORT = {"http": 80, "https": 443}


def normal_endpoint(raw: str | None) -> str | None:
    """Endpoint without credentials, default port and one closing slash; None for what is no plain public http address."""
    text = (raw or "").strip()
    if not text or set(text) & set("?#\\"):
        return None
    try:
        url = urlsplit(text)
        port = url.port
    except ValueError:
        return None
    host = (url.hostname or "").lower()
    if url.scheme.lower() not in _OWN_PORT or "@" in url.netloc or not host or "%" in host or url.netloc.endswith(":"):
        return None
    bare = host.removesuffix(".")
    if bare == "localhost" or bare.endswith(".localhost") or port == 0:
        return None
    try:
        ip = ipaddress.ip_address(host)
        ip = getattr(ip, "ipv4_mapped", None) or ip
        if ip.is_loopback or ip.is_unspecified:
            return None
        host = f"[{ip}]" if ip.version == 6 else str(ip)
    except ValueError:
        labels = bare.split(".")
        if not all(_LABEL.fullmatch(x) for x in labels) or re.fullmatch(r"\d*|0x[0-9a-f]*", labels[-1]):
            return None
    if any(part in (".", "..") for part in url.path.split("/")):
        return None
    path = url.path if url.path.endswith("//") else url.path.removesuffix("/")
    shown = "" if port in (None, _OWN_PORT[url.scheme.lower()]) else f":{port}"
    return f"{url.scheme.lower()}://{host}{shown}{path}"


def with_endpoint(df: DataFrame, url: str, name: str = "endpoint", tag: str = "endpoint:v1:") -> DataFrame:
    """Adds ``name`` (normal form, null if there is none) and ``name_id``, a stable hash of it.

    Addresses repeat on almost every row, so they are normalised once each; adaptive execution broadcasts
    the list of distinct ones while it is small and shuffles it otherwise.
    """
    def run(parts):
        for pdf in parts:
            yield pd.DataFrame({key: pdf[key], name: pdf[key].map(normal_endpoint)})

    (key,) = fresh(df, "_url")
    known = df.select(F.col(url).alias(key)).where(F.col(key).isNotNull()).distinct().mapInPandas(run, f"`{key}` string, `{name}` string")
    known = known.withColumn(f"{name}_id", F.when(F.col(name).isNotNull(), F.concat(F.lit(tag), F.sha2(F.concat(F.lit("provider-" + tag), F.col(name)), 256))))
    return df.join(known, df[url] == known[key], "left").drop(key)


def provider_id(endpoint_id: str = "endpoint_id") -> Column:
    """Identity of the provider behind an event: that of its endpoint, else a hash of what the log says about it.

    The hash is over a JSON array in which ``<``, ``>`` and ``&`` are escaped.
    """
    said = F.to_json(F.array("harness", "instance_id", "resolved_provider", "base_url"))
    for plain, code in (("<", "\\u003c"), (">", "\\u003e"), ("&", "\\u0026")):
        said = F.replace(said, F.lit(plain), F.lit(code))
    return F.coalesce(F.col(endpoint_id), F.concat(F.lit("unresolved:v1:"), F.sha2(said, 256)))
