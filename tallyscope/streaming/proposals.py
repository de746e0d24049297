"""Governance of proposals: a proposal is drafted, validated or rejected, and released after two different approvals.

The events of a proposal are replayed in batch, as a few facts for each proposal that all its events are held against, or
followed as a stream, whose state is a proposal's status and approvers. Both say the same about every event.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENT = "proposal string, seq long, action string, actor string, complete boolean, passed boolean"
DECIDED = "proposal string, seq long, action string, accepted boolean, reason string, status string, n_approvers int"
APPROVERS = 2


def decide(status: str | None, approvers: list[str], action: str, actor: str | None, complete: bool | None, passed: bool | None) -> tuple[str | None, list[str], str | None]:
    """The status and approvers after an event, and why it was refused."""
    if action == "create":
        if status is not None:
            return status, approvers, "EXISTS"
        return ("DRAFT", approvers, None) if complete else (None, approvers, "INCOMPLETE")
    if action not in ("validate", "approve"):
        return status, approvers, "UNKNOWN_ACTION"
    if status is None:
        return status, approvers, "NO_PROPOSAL"
    if action == "validate":
        if status != "DRAFT":
            return status, approvers, "NOT_DRAFT"
        return ("VALIDATED" if passed else "REJECTED", approvers, None) if complete else (status, approvers, "INCOMPLETE")
    if not (actor or "").strip():
        return status, approvers, "BLANK_APPROVER"
    if status not in ("VALIDATED", "APPROVED"):
        return status, approvers, "NOT_VALIDATED"
    approvers = list(dict.fromkeys([*approvers, actor]))
    return "APPROVED" if len(approvers) < APPROVERS else "RELEASE_CANDIDATE", approvers, None


def replay_proposals(events: DataFrame) -> DataFrame:
    """DECIDED for every row of `events` (EVENT): whether it was accepted, why not, and the status after it.

    The events of a proposal take effect by seq, which tells them apart. Only a complete creation makes a draft, once; only
    a draft is validated, by a complete report, and rejected for good if that hasn't passed; repeats by one approver count
    once, and the second approver makes a release candidate, after which nothing is approved. An unknown action, a blank
    approver or an event before the creation changes nothing. A proposal of any number of events is a few facts: the
    places of its creation, validation, first approval and release. Null flags count as false.
    """
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    rows = events.select("proposal", "seq", "action", "actor", yes("complete").alias("complete"), yes("passed").alias("passed"))
    same = lambda other: F.col("e.proposal").eqNullSafe(F.col(f"{other}.proposal"))
    born = rows.where("action = 'create' and complete").groupBy("proposal").agg(F.min("seq").alias("c"))
    held = rows.alias("e").join(born.alias("b"), same("b"))
    checks = held.where("action = 'validate' and complete and seq > c").select("e.*").groupBy("proposal").agg(F.min_by(F.struct("seq", "passed"), "seq").alias("v"))
    named = F.trim(F.coalesce("actor", F.lit(""))) != ""
    held = rows.where((F.col("action") == "approve") & named).alias("e").join(checks.where("v.passed").alias("b"), same("b")).where("e.seq > b.v.seq")
    first = held.groupBy("e.proposal", "e.actor").agg(F.min("e.seq").alias("seq"))
    nth = F.row_number().over(Window.partitionBy("proposal").orderBy("seq"))
    first = first.withColumn("nth", nth).where(F.col("nth") <= APPROVERS)  # Spark keeps no more of a proposal in a task
    signed = first.groupBy("proposal").agg(F.min("seq").alias("a"), F.max(F.when(F.col("nth") == APPROVERS, F.col("seq"))).alias("r"))
    facts = born.alias("e").join(checks.alias("k"), same("k"), "left").select("e.*", "k.v").alias("e").join(signed.alias("s"), same("s"), "left").select("e.*", "s.a", "s.r")
    told = rows.alias("e").join(facts.alias("f"), same("f"), "left").select("e.*", "f.c", F.col("f.v.seq").alias("v"), F.coalesce("f.v.passed", F.lit(False)).alias("ok"), "f.a", "f.r")
    at = F.col("seq")
    since = lambda c: F.coalesce(at >= F.col(c), F.lit(False))
    after = lambda c: F.coalesce(at > F.col(c), F.lit(False))

    def status(past) -> Column:
        return (
            F.when(past("r"), "RELEASE_CANDIDATE").when(past("a"), "APPROVED").when(past("v") & F.col("ok"), "VALIDATED").when(past("v"), "REJECTED").when(past("c"), "DRAFT")
        )

    action = F.col("action")
    reason = (
        F.when(action == "create", F.when(after("c"), "EXISTS").when(~F.col("complete"), "INCOMPLETE"))
        .when(~F.coalesce(action.isin("validate", "approve"), F.lit(False)), "UNKNOWN_ACTION")
        .when(~after("c"), "NO_PROPOSAL")
        .when(action == "validate", F.when(after("v"), "NOT_DRAFT").when(~F.col("complete"), "INCOMPLETE"))
        .when(~named, "BLANK_APPROVER")
        .when(~after("v") | ~F.col("ok") | after("r"), "NOT_VALIDATED")
    )
    return told.select(
        "proposal", "seq", "action", reason.isNull().alias("accepted"), reason.alias("reason"), status(since).alias("status"), (since("a").cast("int") + since("r").cast("int")).alias("n_approvers")
    )


def stream_proposals(events: DataFrame) -> DataFrame:
    """The same over a stream (EVENT). Events of a proposal may come in any number of batches; one that comes after a later
    one has been decided is refused as LATE, for what was said stands."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, approvers, last = state.get if state.exists else (None, [], None)
        approvers, out = list(approvers or []), []
        # a proposal's events of one trigger are put in order here
        for row in sorted((r for batch in batches for r in batch.itertuples(index=False)), key=lambda r: r.seq):
            if last is not None and row.seq <= last:
                reason = "LATE"
            else:
                flag = lambda x: bool(x) and not pd.isna(x)
                actor = None if pd.isna(row.actor) else row.actor
                status, approvers, reason = decide(status, approvers, row.action, actor, flag(row.complete), flag(row.passed))
                last = row.seq
            out.append((row.proposal, row.seq, row.action, reason is None, reason, status, len(approvers)))
        state.update((status, approvers, last))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in DECIDED.split(", ")])

    columns = [c.split()[0] for c in EVENT.split(", ")]
    return events.select(*columns).groupBy("proposal").applyInPandasWithState(
        step, DECIDED, "status string, approvers array<string>, last long", "append", GroupStateTimeout.NoTimeout
    )
