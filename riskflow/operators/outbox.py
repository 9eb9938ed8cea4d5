"""Alert outbox: enqueue, due tasks, state transition, status counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from riskflow import schemas as S

#: What a task carries besides its id, status, attempts and retry time; null until a step sets it.
TASK_RECORD = {
    "payload": "string", "explanation": "string", "mail": "string", "error_message": "string",
    "last_attempt_at": "timestamp_ntz", "created_at": "timestamp_ntz", "completed_at": "timestamp_ntz",
}


def high_risk(scored: DataFrame) -> DataFrame:
    return scored.filter(F.col("risk_level") == "HIGH")


def without_queued(scored: DataFrame, tasks: DataFrame) -> DataFrame:
    """Rows whose transaction has no task yet."""
    return scored.join(tasks.select("transaction_id"), "transaction_id", "left_anti")


def enqueue_alerts(
    scored: DataFrame, tasks: DataFrame, now: Column, payload: Column | None = None, due: Column | None = None
) -> DataFrame:
    """New tasks: one per HIGH transaction not queued before, due at once, or at a time of the row's own.

    The payload (all columns as JSON unless given) is what the alert is rendered from; of a
    transaction delivered more than once the smallest payload stays.
    """
    body = F.to_json(F.struct("*")) if payload is None else payload
    at = F.lit(None).cast("timestamp_ntz") if due is None else due
    high = high_risk(scored).select("transaction_id", body.alias("payload"), at.alias("_due")).groupBy("transaction_id").agg(
        F.min("payload").alias("payload"), F.min("_due").alias("_due"))
    return without_queued(high, tasks).select(
        "transaction_id", F.lit("PENDING_LLM").alias("status"), F.lit(0).alias("attempts"),
        (now if due is None else F.col("_due")).alias("next_retry_at"), now.alias("created_at"), "payload",
    )


def due_tasks(tasks: DataFrame, now: Column, n: int = S.DUE_BATCH) -> DataFrame:
    """The first n pending tasks whose retry time has come, oldest first."""
    return (
        tasks.filter(F.col("status").isin("PENDING_LLM", "PENDING_EMAIL") & (F.col("next_retry_at") <= now))
        .orderBy("next_retry_at", "transaction_id").limit(n)
    )


def advance_tasks(tasks: DataFrame, outcomes: DataFrame, now: Column) -> DataFrame:
    """The task snapshot after one pass.

    A due task takes its explanation step, then in the same pass its mail step. A failed step adds
    an attempt and doubles the delay; the last attempt ends in DEAD_LETTER. Tasks that are not due
    or have no outcome stay as they are. Every column of a task stays; those of TASK_RECORD are
    added where missing. Outcomes may bring `explanation`, `mail` and `error`: texts are kept once
    their step succeeds, the error is that of the last failure and is cleared by success.
    """
    record = {c: F.lit(None).cast(t) for c, t in TASK_RECORD.items() if c not in tasks.columns}
    brought = [F.col(c).alias(f"_{c}") if c in outcomes.columns else F.lit(None).cast("string").alias(f"_{c}") for c in ("explanation", "mail", "error")]
    out = tasks.withColumns(record).join(outcomes.select("transaction_id", "llm_ok", "email_ok", *brought), "transaction_id", "left")
    first = F.col("status") == "PENDING_LLM"
    acts = (
        F.col("status").isin("PENDING_LLM", "PENDING_EMAIL") & (F.col("next_retry_at") <= now)
        & F.col("llm_ok").isNotNull()
    )
    explained = ~first | F.col("llm_ok")
    reached = F.when(first & ~F.col("llm_ok"), "PENDING_LLM").when(~F.col("email_ok"), "PENDING_EMAIL").otherwise("COMPLETED")
    failed = acts & ~(explained & F.col("email_ok"))
    attempts = F.col("attempts") + failed.cast("int")
    dead = failed & (attempts >= S.MAX_ATTEMPTS)
    delay = F.lit(S.BASE_DELAY_SECONDS) * F.pow(F.lit(2), attempts - 1)
    retry = now + F.make_dt_interval(secs=delay)
    done = acts & (reached == "COMPLETED")
    message = F.coalesce("_error", F.when(first & ~F.col("llm_ok"), "explanation failed").otherwise("mail failed"))
    kept = [c for c in tasks.withColumns(record).columns if c not in ("status", "attempts", "next_retry_at", *TASK_RECORD)]
    return out.select(
        *kept,
        F.when(dead, "DEAD_LETTER").when(acts, reached).otherwise(F.col("status")).alias("status"),
        F.when(acts, attempts).otherwise(F.col("attempts")).cast("int").alias("attempts"),
        F.when(failed & ~dead, retry).otherwise(F.col("next_retry_at")).alias("next_retry_at"),
        "payload",
        F.when(acts & explained, F.coalesce("_explanation", "explanation")).otherwise(F.col("explanation")).alias("explanation"),
        F.when(done, F.coalesce("_mail", "mail")).otherwise(F.col("mail")).alias("mail"),
        F.when(failed, message).when(acts, F.lit(None)).otherwise(F.col("error_message")).alias("error_message"),
        F.when(acts, now).otherwise(F.col("last_attempt_at")).alias("last_attempt_at"),
        "created_at",
        F.when(done, now).otherwise(F.col("completed_at")).alias("completed_at"),
    )


def tasks_by_status(tasks: DataFrame) -> DataFrame:
    """Task count per known status, zero included: one pass, four conditional counts."""
    counts = tasks.agg(*[F.count_if(F.col("status") == s).alias(s) for s in S.TASK_STATUSES])
    return counts.unpivot([], S.TASK_STATUSES, "status", "tasks")


def latest_state(history: DataFrame, updated_at: str = "updated_at") -> DataFrame:
    """Current row per task from an append-only history of snapshots."""
    others = [c for c in history.columns if c not in ("transaction_id", updated_at)]
    latest = history.groupBy("transaction_id").agg(F.max(F.struct(updated_at, *others)).alias("_r"))
    return latest.select("transaction_id", f"_r.{updated_at}", *[F.col(f"_r.{c}").alias(c) for c in others])
