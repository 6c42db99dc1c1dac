"""Trunks, dispatch rules and bindings seen together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwell.functions.jsonops import bound_agent_name
from tarnwell.operators.ranking import latest_per_key


def union_trunks(inbound: DataFrame, outbound: DataFrame) -> DataFrame:
    """All trunks tagged with their kind; an outbound trunk replaces an inbound one of the same id."""
    both = inbound.withColumn("trunk_kind", F.lit("inbound")).unionByName(outbound.withColumn("trunk_kind", F.lit("outbound")))
    return latest_per_key(both.where(F.coalesce("sip_trunk_id", F.lit("")) != ""), ["sip_trunk_id"], [F.desc("trunk_kind")])


def trunk_inventory(inbound: DataFrame, outbound: DataFrame, rules: DataFrame) -> DataFrame:
    """One row per (trunk, rule): rules without trunks and trunks without rules are kept.

    ``rules``: sip_dispatch_rule_id, name, trunk_ids, room_prefix, agent_names, hide_phone_number.
    """
    trunks = union_trunks(inbound, outbound).select(
        F.col("sip_trunk_id").alias("trunk_id"), F.col("name").alias("trunk_name"), "trunk_kind",
        F.array_join("numbers", ", ").alias("phone_numbers"),
    )
    ids = F.filter("trunk_ids", lambda t: F.trim(t) != "")
    ruled = rules.select(
        F.explode_outer(ids).alias("trunk_id"), F.col("sip_dispatch_rule_id").alias("dispatch_rule_id"),
        F.col("name").alias("dispatch_rule_name"), "room_prefix",
        F.array_join(F.filter("agent_names", lambda a: F.trim(a) != ""), ", ").alias("agent_names"), "hide_phone_number",
    )
    joined = trunks.join(ruled, "trunk_id", "full_outer")
    blanks = ["trunk_id", "phone_numbers", "dispatch_rule_id", "agent_names"]
    return joined.na.fill("", blanks)


def bound_trunks(trunks: DataFrame, rules: DataFrame, bindings: DataFrame) -> DataFrame:
    """Trunk listing with rule and agent, found by trunk id and by rule id; '-' for the missing.

    ``rules``: sip_dispatch_rule_id, name, trunk_ids, agent_name, metadata (of the first agent).
    """
    active = bindings.where("is_active")
    by_trunk = latest_per_key(active.where(F.coalesce("trunk_id", F.lit("")) != ""), ["trunk_id"], [F.asc("updated_at"), F.asc("id")])
    by_rule = latest_per_key(active.where(F.coalesce("dispatch_rule_id", F.lit("")) != ""), ["dispatch_rule_id"], [F.asc("updated_at"), F.asc("id")])
    t = trunks.select(F.col("sip_trunk_id").alias("trunk_id"), F.col("name").alias("_name"), F.array_join("numbers", ", ").alias("_numbers"))
    r = rules.select(
        F.explode("trunk_ids").alias("trunk_id"), F.col("sip_dispatch_rule_id").alias("dispatch_rule_id"), F.col("name").alias("_rule"),
        F.col("agent_name").alias("_own"), "metadata",
    )
    joined = (
        t.join(by_trunk.select("trunk_id", F.col("trunk_name").alias("_b_name"), F.col("dispatch_rule_name").alias("_b_rule"),
                               F.col("agent_name").alias("_b_agent")), "trunk_id", "left")
        .join(r, "trunk_id", "left")
        .join(by_rule.select("dispatch_rule_id", F.col("agent_name").alias("_r_agent")), "dispatch_rule_id", "left")
    )

    def or_dash(*options: Column) -> Column:
        return F.coalesce(*[F.nullif(o, F.lit("")) for o in options], F.lit("-"))

    ruled = F.col("dispatch_rule_id").isNotNull()
    return joined.select(
        or_dash(F.col("trunk_id")).alias("trunk_id"),
        or_dash(F.col("_name"), F.col("_b_name")).alias("trunk_name"),
        or_dash(F.col("_numbers")).alias("phone_numbers"),
        F.when(ruled, or_dash(F.col("_rule"))).otherwise(F.coalesce("_b_rule", F.lit("-"))).alias("dispatch_rule"),
        F.when(ruled, or_dash(bound_agent_name("_r_agent", "metadata", "_own"))).otherwise(F.coalesce("_b_agent", F.lit("-"))).alias("agent_name"),
    ).orderBy("trunk_name", "phone_numbers", "dispatch_rule")


def active_bindings(bindings: DataFrame) -> DataFrame:
    return bindings.where("is_active").orderBy(F.desc("updated_at"), F.desc("id"))


def binding_conflicts(requests: DataFrame, bindings: DataFrame) -> DataFrame:
    """Requests that clash with an active binding: the number has another agent, or the agent another number.

    Two equi-joins with a residual inequality; a hot number or agent is split by AQE.
    """
    active = bindings.where("is_active").select(F.col("agent_name").alias("_agent"), F.col("phone_number").alias("_phone"))
    phone_taken = requests.join(
        active, (F.col("phone_number") == F.col("_phone")) & (F.col("agent_name") != F.col("_agent")), "left_semi"
    ).withColumn("conflict", F.lit("number has another agent"))
    agent_taken = requests.join(
        active, (F.col("agent_name") == F.col("_agent")) & (F.col("phone_number") != F.col("_phone")), "left_semi"
    ).withColumn("conflict", F.lit("agent has another number"))
    return phone_taken.unionByName(agent_taken)


def cascade_delete(children: DataFrame, removed_parents: DataFrame, key: str) -> DataFrame:
    return children.join(removed_parents.select(key), key, "left_anti")
