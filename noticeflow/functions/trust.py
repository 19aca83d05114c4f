"""Trust verdict of a URL by its domain."""

from pyspark.sql import functions as F

from noticeflow.functions.text import let
from noticeflow.functions.urls import domain_of


def in_domains(domain, domains):
    """The domain is one of `domains` or below one of them."""
    hit = F.lit(False)
    for known in domains:
        hit = hit | (domain == known) | domain.endswith("." + known)
    return hit


def has_suffix(domain, suffixes):
    hit = F.lit(False)
    for suffix in suffixes:
        hit = hit | domain.endswith(suffix)
    return hit


def is_trusted_domain(domain, domains, suffixes):
    return in_domains(domain, domains) | has_suffix(domain, suffixes)


def is_trusted(url, domains, suffixes):
    return let(domain_of(url), lambda d: is_trusted_domain(d, domains, suffixes))
