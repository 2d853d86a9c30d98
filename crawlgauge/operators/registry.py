"""Named analyses: pick modules by name, add your own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from . import core, quality

# Core modules: each takes (files, signals) and returns findings.
CORE_MODULES: dict[str, Callable[..., DataFrame]] = {
    "ai_files": lambda files, signals: core.ai_files(files),
    "robots": lambda files, signals: core.robots(files),
    "structured_data": lambda files, signals: core.structured_data(signals),
    "sitemap": lambda files, signals: core.sitemap(files),
    "security": lambda files, signals: core.security_from_htaccess(files),
    "pwa": lambda files, signals: core.pwa(files),
    "fonts": lambda files, signals: core.fonts(signals),
    "content_marks": lambda files, signals: core.content_marks(signals),
}

# Quality modules: each takes page signals and returns findings.
QUALITY_MODULES: dict[str, Callable[[DataFrame], DataFrame]] = {
    "performance": lambda signals: quality.performance_findings(quality.performance(signals)),
    "a11y": lambda signals: quality.accessibility_findings(quality.accessibility(signals)),
    "content": lambda signals: quality.content_findings(quality.content_quality(signals)),
}


def select_modules(registry: dict, names: str | list[str] = "all") -> list[str]:
    """Module names from a comma-separated text, a list or 'all'; unknown names are an error."""
    if names == "all":
        return list(registry)
    wanted = [n.strip() for n in names.split(",") if n.strip()] if isinstance(names, str) else list(names)
    unknown = [n for n in wanted if n not in registry]
    if unknown:
        raise ValueError(f"unknown modules {unknown}; there are {sorted(registry)}")
    return wanted


def run(registry: dict, names, *args) -> DataFrame:
    """Findings of the chosen modules together."""
    tables = [registry[name](*args) for name in select_modules(registry, names)]
    out = tables[0]
    for table in tables[1:]:
        out = out.unionByName(table)
    return out
