"""Scalar expressions over canonical columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyforge.schema import TOKENS

LONG_MAX = 2**63 - 1


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def total(prefix: str = "") -> Column:
    """All five disjoint token classes; the one-hour share of cache writes is part of ``cache_write``."""
    return reduce(lambda a, b: a + b, [F.col(prefix + t) for t in TOKENS])


def hit_rate(read: Column, fresh: Column, write: Column) -> Column:
    """Share of the prompt that came from the cache; 0 without prompt."""
    whole = fresh + read + write
    return F.when(whole > 0, read / whole).otherwise(F.lit(0.0))


def cost_source(log_cost: Column, priced: Column) -> Column:
    return F.when(log_cost.isNotNull(), "log").when(priced, "estimate").otherwise("unpriced")


def saturating_sum(c: Column | str) -> Column:
    """Sum of a bigint that stays at the largest value instead of overflowing."""
    return F.coalesce(F.try_sum(_c(c)), F.when(F.count(_c(c)) > 0, F.lit(LONG_MAX)))


def clamp_subset(part: Column, whole: Column) -> Column:
    """``part`` limited to [0, ``whole``]."""
    return F.greatest(F.lit(0).cast("bigint"), F.least(part, whole))


def subtract_if_proved(inp: Column, cached: Column, stated: Column, rest: Column) -> Column:
    """Input without its cached part, but only where the stated total proves that the cached part is inside."""
    return F.when((cached > 0) & (stated == inp + rest), F.greatest(inp - cached, F.lit(0).cast("bigint"))).otherwise(inp)


def title(text: Column | str, limit: int = 60) -> Column:
    """White space collapsed, at most ``limit`` code points."""
    return F.substring(F.trim(F.regexp_replace(_c(text), r"(?U)\s+", " ")), 1, limit)


def is_wrapper(text: Column | str) -> Column:
    """Text that a tool put around the user's words: markup, caveats and agent files."""
    t = F.ltrim(_c(text))
    return t.startswith("<") | t.startswith("Caveat:") | t.startswith("# AGENTS.md")


def generic_provider(name: Column | str) -> Column:
    """Provider names that only say that there is some gateway."""
    return F.coalesce(F.lower(F.trim(_c(name))), F.lit("")).isin("", "custom", "openai-compatible", "default", "proxy")


_URL = r"(?i)^(https?)://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/:?#]*)(?::(\d+))?(?:[/?#].*)?$"


def host_of(url: Column | str) -> Column:
    """Lower-case host of an http address with its port unless it is the scheme's own; null for anything else."""
    u = F.trim(_c(url))
    scheme, host, port = F.lower(F.regexp_extract(u, _URL, 1)), F.lower(F.regexp_extract(u, _URL, 2)), F.regexp_extract(u, _URL, 3)
    own = ((scheme == "https") & (port == "443")) | ((scheme == "http") & (port == "80"))
    return F.when(host != "", F.when((port == "") | own, host).otherwise(F.concat(host, F.lit(":"), port)))


def is_local(url: Column | str) -> Column:
    """The address is a proxy on the same machine."""
    host = F.regexp_replace(F.coalesce(host_of(url), F.lit("")), r":\d+$", "")
    return (host == "localhost") | host.startswith("127.") | host.isin("[::1]", "0.0.0.0")


# fixed values: prefixes of model names and the providers they stand for
MODEL_PREFIXES = (
    ("claude-", "anthropic"), ("gpt-", "openai"), ("chatgpt-", "openai"), ("o1", "openai"), ("o3", "openai"), ("o4", "openai"), ("gemini-", "google"),
    ("deepseek-", "deepseek"), ("kimi-", "moonshot"), ("moonshot-", "moonshot"), ("glm-", "zhipu"), ("qwen", "alibaba"), ("mistral", "mistral"), ("codestral", "mistral"),
)
# fixed values: domains of endpoints and the providers behind them
DOMAINS = (
    ("anthropic.com", "anthropic"), ("openai.com", "openai"), ("googleapis.com", "google"), ("deepseek.com", "deepseek"), ("moonshot.cn", "moonshot"),
    ("moonshot.ai", "moonshot"), ("bigmodel.cn", "zhipu"), ("aliyuncs.com", "alibaba"), ("openrouter.ai", "openrouter"), ("siliconflow.cn", "siliconflow"),
    ("siliconflow.com", "siliconflow"), ("volces.com", "bytedance"), ("mistral.ai", "mistral"),
)


def base_name(model: Column | str) -> Column:
    """Model name in lower case without its vendor path."""
    return F.substring_index(F.lower(_c(model)), "/", -1)


def infer_provider(model: Column | str) -> Column:
    name = base_name(model)
    return reduce(lambda out, p: out.when(name.startswith(p[0]), p[1]), MODEL_PREFIXES[1:], F.when(name.startswith(MODEL_PREFIXES[0][0]), MODEL_PREFIXES[0][1])).otherwise("unknown")


def provider_of_url(url: Column | str) -> Column:
    """Provider behind an endpoint by domain suffix; unknown gateways keep their host name."""
    host = F.regexp_replace(F.coalesce(host_of(url), F.lit("")), r":\d+$", "")
    hit = lambda d: (host == d) | host.endswith("." + d)
    return reduce(lambda out, p: out.when(hit(p[0]), p[1]), DOMAINS[1:], F.when(hit(DOMAINS[0][0]), DOMAINS[0][1])).otherwise(host)


def display_provider(provider: Column | str, url: Column | str) -> Column:
    """The named provider; a generic one is told by the host of its endpoint unless that is a local proxy."""
    return F.when(generic_provider(provider) & ~is_local(url) & host_of(url).isNotNull(), host_of(url)).otherwise(_c(provider))


def resolved_provider(provider: Column | str, url: Column | str, model: Column | str) -> Column:
    shown = display_provider(provider, url)
    return F.when(~generic_provider(shown), shown).otherwise(infer_provider(model))


def normal_model(name: Column | str) -> Column:
    """Spelling under which a model is looked up: no vendor path, no ``latest``, no date, dots as hyphens."""
    n = F.substring_index(F.lower(F.trim(_c(name))), "/", -1)
    n = F.regexp_replace(F.regexp_replace(n, r":latest$", ""), r"-latest$", "")
    return F.translate(F.regexp_replace(n, r"[-:]\d{4}-?\d{2}-?\d{2}$", ""), ".", "-")


def search_name(name: Column | str) -> Column:
    """Spelling for catalog search: tails such as ``-high`` and all separators removed."""
    cut = F.regexp_replace(normal_model(name), r"-(?:high|medium|low|preview|expires).*$", "")
    return F.translate(cut, "-._:", "")
