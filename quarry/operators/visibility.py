"""Who may read or delete what: owner by scope, or a grant. One join for all rows, never a check per row."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Principal:
    tenant_id: str
    user_id: str | None = None
    agent_id: str | None = None
    session_id: str | None = None
    role_ids: tuple[str, ...] = field(default=())

    def identities(self) -> list[tuple[str, str]]:
        own = [("tenant", self.tenant_id), ("user", self.user_id), ("agent", self.agent_id), ("session", self.session_id)]
        return [(k, v) for k, v in own if v] + [("role", r) for r in self.role_ids]


def in_tenant(p: Principal) -> Column:
    """The tenant wall, which only public rows pass."""
    return (F.col("scope") == "public") | (F.col("tenant_id") == p.tenant_id)


def owns(p: Principal) -> Column:
    """Owner by scope; public rows have every reader as owner."""
    out = (F.col("scope") == "public") | ((F.col("scope") == "tenant") & (F.col("owner_id") == p.tenant_id))
    for scope, who in (("user_private", p.user_id), ("agent_private", p.agent_id), ("session", p.session_id)):
        if who:
            out = out | ((F.col("scope") == scope) & (F.col("owner_id") == who))
    return out


def readable_facts(facts: DataFrame, p: Principal) -> DataFrame:
    """Events and edges: by owner only, grants do not count."""
    return facts.where(in_tenant(p) & owns(p))


def granted(acl: DataFrame, p: Principal, permission: str) -> DataFrame:
    who = F.lit(False)
    for kind, name in p.identities():
        who = who | ((F.col("principal_type") == kind) & (F.col("principal_id") == name))
    return acl.where((F.col("permission") == permission) & who).select(F.col("memory_id").alias("_granted")).distinct()


def readable_memories(memories: DataFrame, acl: DataFrame, p: Principal, scopes: tuple[str, ...] | None = None) -> DataFrame:
    rows = memories.where((F.col("status") == "active") & in_tenant(p))
    if scopes:
        rows = rows.where(F.col("scope").isin(*scopes))
    return rows.join(granted(acl, p, "read"), F.col("memory_id") == F.col("_granted"), "left").where(owns(p) | F.col("_granted").isNotNull()).drop("_granted")


def deletable_memories(memories: DataFrame, acl: DataFrame, p: Principal) -> DataFrame:
    """Owner by scope, but nobody owns a public memory for deletion; or a grant to delete, within the tenant."""
    rows = memories.where((F.col("status") == "active") & (F.col("tenant_id") == p.tenant_id))
    return rows.join(granted(acl, p, "delete"), F.col("memory_id") == F.col("_granted"), "left").where(((F.col("scope") != "public") & owns(p)) | F.col("_granted").isNotNull()).drop("_granted")


#: How broad a scope is; a fact may not be broader than any memory it comes from.
BREADTH = {"session": 0, "agent_private": 1, "user_private": 1, "tenant": 2, "public": 3}


def broader_than_source(facts: DataFrame, memories: DataFrame) -> DataFrame:
    """Facts (fact_id, scope, source_memory_ids) with a source that is missing, inactive or narrower than the fact."""
    rank = F.create_map(*(F.lit(x) for k, v in BREADTH.items() for x in (k, v)))
    each = facts.select("fact_id", F.col("scope").alias("_scope"), F.explode("source_memory_ids").alias("memory_id"))
    known = memories.where("status = 'active'").select("memory_id", F.col("scope").alias("_source"))
    bad = each.join(known, "memory_id", "left").where(F.col("_source").isNull() | (rank[F.col("_source")] < rank[F.col("_scope")]))
    return bad.groupBy("fact_id").agg(F.count(F.lit(1)).alias("violations"))
