"""All core queries and their SQL counterparts."""

from __future__ import annotations

from filamento.plans import core_p, q_index, q_panel, q_pipeline, q_quality, q_sections, q_similarity, q_sources, q_text, template

MODULES = (core_p, template, q_text, q_panel, q_index, q_sections, q_similarity, q_quality, q_sources, q_pipeline)


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.oracle_sql().items()}
