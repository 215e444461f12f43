"""The whole extraction: pages and requested fields in, validated records out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.http import html_gate
from ..operators import matching as m
from ..operators.discovery import discover, warning_rows
from ..operators.extractors import Extractor, run_all
from ..operators.jobs import requested_fields
from ..operators.network import Limits, network_properties
from ..sources.elements import elements
from ..sources.staging import stage


def extract(
    jobs: DataFrame, pages: DataFrame, responses: DataFrame | None = None, limits: Limits = Limits(), extractors: Sequence[Extractor] = (), totals: Observation | None = None,
    whole_references: bool = False,
) -> dict[str, DataFrame]:
    """All stage tables. jobs: job_id, requested_fields. pages: job_id, html, and perhaps content_type and body_truncated.

    responses, if any: job_id, id, sequence, body; their properties compete with those of the
    pages. A page whose stated type isn't HTML gives none. A truncated page gives a warning.
    extractors are users' own. totals, if given, gets total, valid, partial and invalid of the
    validation as its rows go by, so they cost no pass of their own. whole_references: see elements().
    """
    if "content_type" in pages.columns:
        pages = pages.where(html_gate(F.col("content_type"), F.octet_length("html")))
    fields = requested_fields(jobs)
    parsed = stage(elements(pages, "html", "job_id", whole_references), "elements")  # pages are parsed once for all extractors
    properties, warnings = discover(parsed, "job_id")
    if "body_truncated" in pages.columns:
        warnings = warnings.unionByName(warning_rows(pages.where("body_truncated"), "job_id", "dom", F.lit("DOM_SOURCE_TRUNCATED")))
    for found in (more := run_all(extractors, pages, parsed))[0]:
        properties = properties.unionByName(found)
    for left_out in more[1]:
        warnings = warnings.unionByName(left_out)
    if responses is not None:
        found, left_out = network_properties(responses, "job_id", limits)
        properties, warnings = properties.unionByName(found), warnings.unionByName(left_out)
    tables = from_properties(jobs, fields, stage(properties, "properties")) | {"warnings": warnings}
    if totals is not None:
        status = F.col("status")
        counts = [F.count_if(status == s).alias(s.lower()) for s in ("VALID", "PARTIAL", "INVALID")]
        tables["validation"] = tables["validation"].observe(totals, F.count(F.lit(1)).alias("total"), *counts)
    return tables


def from_properties(jobs: DataFrame, fields: DataFrame, properties: DataFrame) -> dict[str, DataFrame]:
    candidates = stage(m.match(fields, properties), "candidates")
    resolved = stage(m.resolve(candidates), "resolved")
    normalized, issues = m.normalize(fields, resolved)
    validation, found = m.validate(jobs, fields, normalized, issues)
    return {
        "properties": properties, "candidates": candidates, "extraction": m.extraction(jobs, fields, candidates), "resolved": resolved,
        "normalized": normalized, "normalization_issues": issues, "validation": validation, "validation_issues": found, "outcome": m.outcome(validation),
    }
