"""State machines replayed as ordered folds, index versions, deletion receipts, immutable upserts, integrity constraints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

#: The evolution run's transitions, state -> event -> state.
EVOLUTION_RUN = {
    "observed": {"finding_created": "diagnosed", "cancel": "canceled", "request_human": "needs_human"},
    "diagnosed": {"plan_created": "planned", "cancel": "canceled", "request_human": "needs_human"},
    "planned": {"approval_requested": "awaiting_approval", "cancel": "canceled", "request_human": "needs_human"},
    "awaiting_approval": {"plan_approved": "executing", "plan_rejected": "rejected", "cancel": "canceled", "request_human": "needs_human"},
    "executing": {"change_built": "verifying", "execution_failed": "failed", "cancel": "canceled", "request_human": "needs_human"},
    "verifying": {"verification_passed": "canary", "verification_failed": "failed", "cancel": "canceled", "request_human": "needs_human"},
    "canary": {"canary_started": "canary", "canary_succeeded": "released", "canary_degraded": "rolled_back", "cancel": "canceled", "request_human": "needs_human"},
    "released": {"outcome_recorded": "learned", "canary_degraded": "rolled_back", "request_human": "needs_human"},
    "rolled_back": {"outcome_recorded": "learned"},
    "needs_human": {"plan_approved": "executing", "plan_rejected": "rejected", "cancel": "canceled"},
}
#: The transitions of learning journeys, missions and plugin releases.
JOURNEY = {
    "onboarding": {"start_diagnosis": "diagnosing", "withdraw": "withdrawn"},
    "diagnosing": {"complete_diagnosis": "planning", "withdraw": "withdrawn"},
    "planning": {"activate_plan": "active", "wait_for_teacher": "waiting_teacher", "wait_for_consent": "waiting_consent", "withdraw": "withdrawn"},
    "active": {"start_reflection": "reflecting", "pause": "paused", "wait_for_teacher": "waiting_teacher", "wait_for_consent": "waiting_consent", "withdraw": "withdrawn"},
    "reflecting": {"schedule_delayed_review": "delayed_review", "withdraw": "withdrawn"},
    "delayed_review": {"start_transfer": "transferring", "withdraw": "withdrawn"},
    "transferring": {"complete_journey": "completed", "withdraw": "withdrawn"},
    "paused": {"resume": "active", "withdraw": "withdrawn"},
    "waiting_teacher": {"teacher_resolved": "active", "withdraw": "withdrawn"},
    "waiting_consent": {"consent_granted": "active", "withdraw": "withdrawn"},
}
MISSION = {
    "draft": {"mark_ready": "ready", "abandon": "abandoned"},
    "ready": {"activate": "active", "abandon": "abandoned"},
    "active": {"submit_for_assessment": "assessing", "request_support": "waiting_support", "abandon": "abandoned"},
    "assessing": {"confirm_mastery": "mastered", "require_remediation": "remediation", "request_support": "waiting_support", "abandon": "abandoned"},
    "remediation": {"retry": "active", "request_support": "waiting_support", "abandon": "abandoned"},
    "waiting_support": {"support_resolved": "active", "abandon": "abandoned"},
}
PLUGIN_RELEASE = {
    "proposed": {"sandbox_passed": "sandboxed", "sandbox_failed": "failed", "reject": "rejected"},
    "sandboxed": {"verification_passed": "verified", "verification_failed": "failed"},
    "verified": {"request_approval": "awaiting_approval"},
    "awaiting_approval": {"approve": "canary", "reject": "rejected"},
    "canary": {"canary_succeeded": "active", "canary_degraded": "rolled_back", "rollback": "rolled_back"},
    "active": {"rollback": "rolled_back", "retire": "retired"},
    "rolled_back": {"retire": "retired"},
}
ORDER = {"created": {"pay": "paid", "cancel": "closed"}, "paid": {"ship": "shipped", "refund": "refunding"}, "shipped": {"receive": "done", "refund": "refunding"}, "refunding": {"refunded": "closed"}}


def replay(events: DataFrame, machine: dict[str, dict[str, str]], start: str) -> DataFrame:
    """Per entity, the state and version after its events in order of `seq`.

    events: entity_id, event_id, event, expected_version (null: any), seq. A repeated event_id changes nothing, and is looked at
    before the version; a stale version or an event that the state does not allow is counted and changes nothing.
    """
    table = F.create_map(*(F.lit(x) for a, out in sorted(machine.items()) for e, b in sorted(out.items()) for x in (f"{a}|{e}", b)))
    first = events.groupBy("entity_id", "event_id").agg(F.min_by(F.struct("seq", "event", "expected_version"), "seq").alias("e"), (F.count(F.lit(1)) - 1).alias("again"))
    listed = first.groupBy("entity_id").agg(F.array_sort(F.collect_list(F.struct("e.seq", "e.event", "e.expected_version"))).alias("es"), F.sum("again").alias("repeated"))
    zero = F.struct(F.lit(start).alias("state"), F.lit(0).cast("long").alias("version"), F.lit(0).cast("long").alias("stale"), F.lit(0).cast("long").alias("illegal"))

    def step(acc: Column, e: Column) -> Column:
        stale = F.coalesce(e["expected_version"] != acc["version"], F.lit(False))
        to = F.when(~stale, F.try_element_at(table, F.concat_ws("|", acc["state"], e["event"])))
        return F.struct(
            F.coalesce(to, acc["state"]).alias("state"),
            (acc["version"] + F.when(to.isNotNull(), 1).otherwise(0)).cast("long").alias("version"),
            (acc["stale"] + stale.cast("long")).alias("stale"),
            (acc["illegal"] + (~stale & to.isNull()).cast("long")).alias("illegal"),
        )

    return listed.withColumn("r", F.aggregate("es", zero, step)).select("entity_id", "r.state", "r.version", "r.stale", "r.illegal", "repeated")


def active_as_of(activations: DataFrame, now: str) -> DataFrame:
    """The version that is active at `now` for each (tenant_id, logical_name): the latest activation retires the one before."""
    rows = activations.where(F.col("activated_at") <= F.lit(now).cast("timestamp_ntz"))
    return rows.groupBy("tenant_id", "logical_name").agg(F.max_by("index_version_id", F.struct("activated_at", "index_version_id")).alias("index_version_id"))


def collectable(versions: DataFrame, holds: DataFrame, now: str, days: int = 7, limit: int = 100) -> DataFrame:
    """Retired versions beyond retention without an active hold, oldest first, at most `limit` a cycle (the limit is the feature)."""
    t = F.lit(now).cast("timestamp_ntz")
    held = holds.where(F.col("released_at").isNull() & (F.col("expires_at").isNull() | (F.col("expires_at") > t))).select("index_version_id").distinct()
    old = versions.where((F.col("status") == "retired") & (F.col("retired_at") < F.timestamp_add("DAY", F.lit(-days), t)))
    return old.join(held, "index_version_id", "left_anti").orderBy("retired_at", "index_version_id").limit(limit)


def fold_acknowledgements(acks: DataFrame) -> DataFrame:
    """Status of each (deletion_id, target): attempts must rise, and completed is final."""
    first_done = F.min(F.when(F.col("status") == "completed", F.col("attempt")))
    rows = acks.withColumn("_done", first_done.over(W.Window.partitionBy("deletion_id", "target")))
    rows = rows.where(F.col("_done").isNull() | (F.col("attempt") <= F.col("_done")))
    return rows.groupBy("deletion_id", "target").agg(F.max_by("status", "attempt").alias("status"), F.max("attempt").alias("attempt"))


def deletion_status(targets: DataFrame) -> DataFrame:
    """failed if any target failed, else pending if any is pending, else completed."""
    failed, pending = F.bool_or(F.col("status") == "failed"), F.bool_or(F.col("status") == "pending")
    return targets.groupBy("deletion_id").agg(F.when(failed, "failed").when(pending, "pending").otherwise("completed").alias("status"), F.count(F.lit(1)).alias("targets"))


def cascade_counts(deleted: DataFrame, chunks: DataFrame, facts: DataFrame) -> DataFrame:
    """Per deleted memory_id: chunks that go, and facts that come from it (source_memory_ids)."""
    c = chunks.groupBy("memory_id").agg(F.count(F.lit(1)).alias("chunks"))
    f = facts.select(F.explode(F.array_distinct("source_memory_ids")).alias("memory_id")).groupBy("memory_id").agg(F.count(F.lit(1)).alias("facts"))
    return deleted.select("memory_id").join(c, "memory_id", "left").join(f, "memory_id", "left").na.fill(0, ["chunks", "facts"])


def upsert(stored: DataFrame, incoming: DataFrame, key: str, immutable: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows to append, and rows that contradict an immutable column of a stored row with the same key."""
    new = incoming.dropDuplicates([key]).join(stored.select(key), key, "left_anti")
    same = F.lit(True)
    for c in immutable:
        same = same & F.col(f"i.{c}").eqNullSafe(F.col(f"s.{c}"))
    return new, incoming.alias("i").join(stored.alias("s"), key).where(~same).select(key)


def broken(rows: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """key, rule of every rule that a row breaks; a rule that is null is broken."""
    each = F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()))
    return rows.select(key, F.explode(F.filter(each, lambda r: r.isNotNull())).alias("rule"))


def chain_breaks(transitions: DataFrame) -> DataFrame:
    """Transitions (entity_id, seq, from_version, to_version) that do not follow on the one before."""
    w = W.Window.partitionBy("entity_id").orderBy("seq")
    rows = transitions.withColumn("_last", F.lag("to_version").over(w))
    return rows.where((F.col("to_version") != F.col("from_version") + 1) | (F.col("_last").isNotNull() & (F.col("_last") != F.col("from_version")))).drop("_last")


#: The shares of traffic that a rollout goes through.
CANARY_STAGES = (5, 50, 100)


def due_plans(plans: DataFrame, now: str) -> DataFrame:
    """plan_id, emergency, place: plans to start now. Emergencies in draft or scheduled come first; then scheduled ones whose time has come.

    plans: plan_id, mode, status, scheduled_at.
    """
    emergency = (F.col("mode") == "emergency") & F.col("status").isin("draft", "scheduled")
    due = (F.col("status") == "scheduled") & (F.col("scheduled_at") <= F.lit(now).cast("timestamp_ntz"))
    rows = plans.where(emergency | due).select("plan_id", emergency.alias("emergency"), "scheduled_at")
    return rows.withColumn("place", F.row_number().over(W.Window.partitionBy("emergency").orderBy("scheduled_at", "plan_id")).cast("long")).drop("scheduled_at")


def rollouts(observations: DataFrame, stages: tuple[int, ...] = CANARY_STAGES) -> DataFrame:
    """subject_id, share, outcome: how far a rollout came; it stops at the first stage that was observed as degraded.

    observations: subject_id, share, ok. A stage without an observation is where the rollout stands (`observing`).
    """
    each = F.transform(F.array(*map(F.lit, stages)), lambda s: F.struct(s.alias("share"), F.try_element_at("seen", s).alias("ok")))
    rows = observations.groupBy("subject_id", "share").agg(F.bool_and("ok").alias("ok")).groupBy("subject_id").agg(F.map_from_entries(F.collect_list(F.struct("share", "ok"))).alias("seen"))
    stop = F.get(F.filter(each, lambda x: ~F.coalesce(x["ok"], F.lit(False))), 0)
    return rows.withColumn("_s", stop).select("subject_id", F.coalesce(F.col("_s.share"), F.lit(stages[-1])).alias("share"), F.when(F.col("_s").isNull(), "released").when(F.col("_s.ok").isNull(), "observing").otherwise("rolled_back").alias("outcome"))


def release_evidence(commands: DataFrame, sandboxes: DataFrame, verifications: DataFrame, canaries: DataFrame) -> DataFrame:
    """release_id, event, allowed: whether the evidence that a transition of a release asks for is there.

    commands: release_id, version, event; sandboxes: release_id, passed; verifications: release_id, version, passed; canaries:
    release_id, decided_at, decision. Leaving the sandbox needs a passed run, verification one of this very version, and what ends a
    canary needs the latest decision to say the same. Other events need nothing.
    """
    last = canaries.groupBy("release_id").agg(F.max_by("decision", "decided_at").alias("_decision"))
    box = sandboxes.where("passed").select("release_id", F.lit(True).alias("_box")).distinct()
    proof = verifications.where("passed").select("release_id", "version", F.lit(True).alias("_proof")).distinct()
    rows = commands.join(box, "release_id", "left").join(proof, ["release_id", "version"], "left").join(last, "release_id", "left")
    allowed = (
        F.when(F.col("event") == "sandbox_passed", F.col("_box")).when(F.col("event") == "verification_passed", F.col("_proof"))
        .when(F.col("event") == "canary_succeeded", F.col("_decision") == "promote").when(F.col("event") == "canary_degraded", F.col("_decision") == "rollback").otherwise(True)
    )
    return rows.select("release_id", "event", F.coalesce(allowed, F.lit(False)).alias("allowed"))
