"""Source registry, trust rules and run parameters."""

from dataclasses import dataclass

from noticeflow import fixed


@dataclass(frozen=True)
class RunConfig:
    """Parameters of a run; every one but the input locations has a default."""

    pages_path: str = ""
    documents_path: str = ""
    responses_path: str = ""
    store_path: str = "data/store"
    report_path: str = "reports"
    document_dir: str = "data/documents"
    sources: tuple = fixed.SOURCES
    trusted_domains: tuple = fixed.TRUSTED_DOMAINS
    trusted_suffixes: tuple = fixed.TRUSTED_SUFFIXES
    keywords: tuple = fixed.KEYWORDS
    links_per_page: int = fixed.LINKS_PER_PAGE
    lookback_hours: int = fixed.LOOKBACK_HOURS
    apply_lookback: bool = False
    overlay_enabled: bool = False
    snapshots_kept: int = 7
    store_parts: int = 64
    report_format: str = "parquet"
    report_date: str = ""


def sources_df(spark, sources=fixed.SOURCES):
    """The registry as a table, in order."""
    rows = [
        (i, name, url, kind, list(domains)) for i, (name, url, kind, domains) in enumerate(sources)
    ]
    return spark.createDataFrame(
        rows,
        "source_ord int, source_name string, source_url string, type string, "
        "trusted_domains array<string>",
    )


def trust_rules_df(spark, domains=fixed.TRUSTED_DOMAINS, suffixes=fixed.TRUSTED_SUFFIXES):
    rows = [("domain", d) for d in domains] + [("suffix", s) for s in suffixes]
    return spark.createDataFrame(rows, "kind string, value string")


def trust_rules(settings):
    """(domains, suffixes) of a settings mapping; a missing key is an empty list."""
    return (
        tuple(settings.get("additional_trusted_domains") or ()),
        tuple(settings.get("trusted_suffixes") or ()),
    )
