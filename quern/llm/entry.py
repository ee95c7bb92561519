"""Queries of this subpackage, by name; ``__spark_entry__`` adds them where this folder exists."""

from __future__ import annotations

from collections.abc import Callable

from quern.llm import clusters, conversations, leaks, neardup, neighbours, personal, reference_sql, spam, tokens


def queries() -> dict[str, Callable]:
    return {
        "p1_found": neardup.p1_found,
        "p1_classes": neardup.p1_classes,
        "p2_found": neighbours.p2_found,
        "p3_found": conversations.p3_found,
        "p3_stray_links": conversations.p3_stray_links,
        "p3_threads": conversations.p3_threads,
        "p4_found": clusters.p4_found,
        "p4_clusters": clusters.p4_clusters,
        "p5_found": personal.p5_found,
        "p5_redacted": personal.p5_redacted,
        "p5_surrogates": personal.p5_surrogates,
        "p6_ids": tokens.p6_ids,
        "p7_found": leaks.p7_found,
        "p7_paraphrased": leaks.p7_paraphrased,
        "p8_found": spam.p8_found,
    }


def oracle_sql() -> dict[str, str]:
    return {"p1_found": reference_sql.P1_FOUND, "p3_found": reference_sql.P3_FOUND, "p4_found": reference_sql.P4_FOUND, "p7_found": reference_sql.P7_FOUND}
