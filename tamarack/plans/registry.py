"""All queries outside the llm subpackage."""

from __future__ import annotations

from . import general, metrics, pipeline, read_api, text, vectors

PARTS = (general, read_api, metrics, text, vectors, pipeline)


def flagship(spark, sf):
    return read_api.QUERIES["opportunity_candidates"](spark, sf)


def queries() -> dict:
    return {k: v for p in PARTS for k, v in p.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: v for p in PARTS for k, v in p.ORACLE.items()}
