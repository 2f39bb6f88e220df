"""Coverage audit of a snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerloom.operators import audit as op
from offerloom.session import cut_lineage


def run_audit(
    benchmarks: DataFrame,
    offers: DataFrame,
    health: DataFrame,
    state: DataFrame,
    disabled: DataFrame,
    generated_at: Column,
) -> op.AuditResult:
    """All audit tables; nothing is raised here.

    ``state``: streaks of the sources and of the aggregate check before this run.
    """
    # One row per source, read by six outputs: computed once.
    audited = cut_lineage(op.next_streaks(op.recall_per_source(benchmarks, offers), state))
    total = op.aggregate_recall(audited)
    fixture = op.fixture_rate(health)
    rows = op.breaches(audited, fixture, total, op.aggregate_streak(state) + 1)
    return op.AuditResult(
        retailers=audited,
        total=total,
        fixture=fixture,
        breaches=rows,
        state=op.next_state(audited, state, total),
        disabled=op.next_disabled(audited, disabled),
        tickets=op.tickets(
            rows, generated_at, total.select("aggregate_recall").scalar(), fixture.select("fixture_usage_rate").scalar()
        ),
        generated_at=generated_at,
    )
