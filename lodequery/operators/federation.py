"""Merging results of peers, reputation, and matching of capabilities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodequery.functions.text import fingerprint, has_injection, is_banned_capability, sanitize
from lodequery.operators.folds import clamped_totals

DISCOUNT, UNSCORED, LOCAL_K, PEER_K = 0.9, 0.5, 5, 3
#: What an event adds to a peer's reputation, which starts at 50 and stays within 0 and 100.
DELTAS = {
    "SUCCESSFUL_REQUEST": 2.0,
    "FAILED_REQUEST": -5.0,
    "TIMEOUT": -8.0,
    "INVALID_SIGNATURE": -20.0,
    "POLICY_VIOLATION": -25.0,
    "MALFORMED_MESSAGE": -10.0,
    "REPLAY_ATTEMPT": -30.0,
    "USER_REPORT": -15.0,
}
#: The counters of a reputation and the events that each counts.
COUNTERS = {
    "successful_requests": ("SUCCESSFUL_REQUEST",),
    "failed_requests": ("FAILED_REQUEST",),
    "timeouts": ("TIMEOUT",),
    "policy_violations": ("POLICY_VIOLATION",),
    "invalid_messages": ("INVALID_SIGNATURE", "MALFORMED_MESSAGE", "REPLAY_ATTEMPT"),
    "user_reports": ("USER_REPORT",),
}
START = 50.0


def merge_results(local: DataFrame, remote: DataFrame | None = None, k: int = LOCAL_K, per_peer: int = PEER_K) -> DataFrame:
    """``source, id, content, score, sanitized``: local results as they are, each peer's best with 0.9 of their score (of 0.5
    where there is none) and without injected instructions; the k best of all, local ones first among equals. Without
    remote results (local search only) all local ones come out, neither sorted nor limited."""
    ours = local.select(F.lit("local").alias("source"), "id", "content", "score", F.lit(False).alias("sanitized"), F.lit(0).alias("_far"))
    if remote is None:
        return ours.drop("_far")
    best = Window.partitionBy("source").orderBy(F.col("score").desc_nulls_last(), "id")
    theirs = remote.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= per_peer)
    # A missing score and a score of 0 both count as none.
    discounted = F.when(F.coalesce("score", F.lit(0.0)) == 0, UNSCORED).otherwise(F.col("score")) * DISCOUNT
    theirs = theirs.select("source", "id", sanitize(F.col("content")).alias("content"), discounted.alias("score"), has_injection(F.col("content")).alias("sanitized"), F.lit(1).alias("_far"))
    return ours.unionByName(theirs).orderBy(F.col("score").desc(), "_far", "source", "id").limit(k).drop("_far")


def reputation(events: DataFrame, order: list[str]) -> DataFrame:
    """``peer, score, events, unknown_events`` and the six counters: scores after each peer's last event, of ``peer, kind``
    and, if there, ``custom_delta``. An event of an unknown kind changes no score (but by a custom delta) and is counted
    as unknown. ``order`` are the columns that tell a peer's events apart in their order."""
    known = F.create_map(*[F.lit(x) for pair in DELTAS.items() for x in pair])[F.col("kind")]
    delta = F.coalesce(*([F.col("custom_delta").cast("double")] if "custom_delta" in events.columns else []), known, F.lit(0.0))
    scores = clamped_totals(events.withColumn("_change", delta), "peer", "_change", order, START, 0.0, 100.0)
    counted = [F.count_if(F.col("kind").isin(*kinds)).alias(name) for name, kinds in COUNTERS.items()]
    counts = events.groupBy("peer").agg(F.count("*").alias("events"), F.count_if(known.isNull()).alias("unknown_events"), *counted)
    return scores.join(counts, "peer")


def trusted(peers: DataFrame, mode: str) -> DataFrame:
    """Peers that may be asked: never blocked ones; in mode ``local_and_trusted`` only trusted and verified ones."""
    out = peers.where("trust <> 'BLOCKED'")
    return out.where(F.col("trust").isin("TRUSTED", "VERIFIED")) if mode == "local_and_trusted" else out


def compatible(version: Column, wanted: str | None) -> Column:
    """Without a wanted version any fits; else the same one, or one of the same major version."""
    if not wanted:
        return F.lit(True)
    return (version == wanted) | (F.split_part(version, F.lit("."), F.lit(1)) == wanted.split(".")[0])


def match_capability(capabilities: DataFrame, request: str) -> DataFrame:
    """The first fit for "id-or-name[@version]": by id or, in any case, by name; equal versions before compatible ones."""
    name, _, version = request.partition("@")
    hit = capabilities.where((F.col("capability_id") == name) | (F.lower("name") == name.lower())).where(compatible(F.col("version"), version))
    return hit.orderBy(F.col("version") != F.lit(version), "seq").limit(1)


def find_capabilities(capabilities: DataFrame, text: str | None = None, risk: str | None = None, provider: str | None = None) -> DataFrame:
    """Capabilities by part of their id, name or description, by risk and by provider."""
    out = capabilities
    if text:
        out = out.where(F.contains(F.lower(F.concat_ws(" ", "capability_id", "name", "description")), F.lit(text.lower())))
    if risk is not None:
        out = out.where(F.col("risk") == risk)
    return out if provider is None else out.where(F.col("provider") == provider)


def valid_capabilities(capabilities: DataFrame) -> DataFrame:
    """``capability_id, problem``: why a capability may not be registered (null: it may): no id, name, version or provider,
    or a name or description with a banned word."""
    missing = [F.when(F.coalesce(F.trim(c), F.lit("")) == "", f"no {c}") for c in ("capability_id", "name", "version", "provider")]
    banned = F.when(is_banned_capability(F.concat_ws(" ", "name", "description")), "banned")
    return capabilities.select("capability_id", F.coalesce(*missing, banned).alias("problem"))


def peers_with_capability(peers: DataFrame, capabilities: DataFrame, name: str, mode: str = "network_wide") -> DataFrame:
    """``agent_id, capability_id``: peers that may be asked, each with the first of its capabilities of that name."""
    first = capabilities.where(F.col("name") == name).groupBy(F.col("provider").alias("agent_id")).agg(F.min_by("capability_id", "seq").alias("capability_id"))
    return trusted(peers, mode).select("agent_id").join(first, "agent_id")


def merge_peers(peers: DataFrame, seen: DataFrame) -> DataFrame:
    """``agent_id, addresses, trust, seq``: known peers with what was seen of them since: addresses are joined, a blocked
    peer stays blocked, an unknown one is added. Where ``seen`` has a ``public_key``, whoever isn't named by its
    fingerprint is passed over (see :func:`forged`)."""
    if "public_key" in seen.columns:
        seen = seen.where(F.col("agent_id") == fingerprint(F.col("public_key"))).drop("public_key")
    both = peers.withColumn("_at", F.lit(0)).unionByName(seen.withColumn("trust", F.lit("UNKNOWN")).withColumn("_at", F.lit(1)))
    each = F.explode_outer("addresses")
    addresses = both.select("agent_id", each.alias("address")).where("address is not null").distinct().groupBy("agent_id").agg(F.array_sort(F.collect_list("address")).alias("addresses"))
    state = both.groupBy("agent_id").agg(F.min_by("trust", F.struct("_at", "seq")).alias("trust"), F.min("seq").alias("seq"))
    return state.join(addresses, "agent_id", "left").select("agent_id", F.coalesce("addresses", F.array().cast("array<string>")).alias("addresses"), "trust", "seq")


def forged(seen: DataFrame) -> DataFrame:
    """Announcements ``agent_id, public_key`` whose id isn't the fingerprint of the key."""
    return seen.where(~F.coalesce(F.col("agent_id") == fingerprint(F.col("public_key")), F.lit(False)))


def block(peers: DataFrame, ids: DataFrame) -> DataFrame:
    """Peers with those of ``ids (agent_id)`` blocked."""
    gone = ids.select("agent_id", F.lit(True).alias("_blocked")).distinct()
    return peers.join(gone, "agent_id", "left").withColumn("trust", F.when(F.col("_blocked"), "BLOCKED").otherwise(F.col("trust"))).select(*peers.columns)


def unblock(peers: DataFrame, ids: DataFrame) -> DataFrame:
    """Peers with those of ``ids`` that are blocked unknown again: never trusted at once."""
    back = ids.select("agent_id", F.lit(True).alias("_back")).distinct()
    return peers.join(back, "agent_id", "left").withColumn("trust", F.when(F.col("_back") & (F.col("trust") == "BLOCKED"), "UNKNOWN").otherwise(F.col("trust"))).select(*peers.columns)


def network_status(peers: DataFrame, capabilities: DataFrame, reputations: DataFrame) -> DataFrame:
    """One row: ``peers, blocked, capabilities, reputations``."""
    p = peers.agg(F.count("*").alias("peers"), F.count_if(F.col("trust") == "BLOCKED").alias("blocked"))
    return p.join(capabilities.agg(F.count("*").alias("capabilities"))).join(reputations.agg(F.count("*").alias("reputations")))  # one row each
