"""Limits on incoming requests, and approvals that hold once and for a time."""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodequery.operators.folds import fold

TOO_LARGE, BUSY, PEER_LIMIT, CAPABILITY_LIMIT = "PAYLOAD_TOO_LARGE", "CONCURRENCY_LIMIT", "RATE_LIMIT", "CAPABILITY_LIMIT"
#: Bytes of a request, requests at a time, and in a minute of a peer and for a capability.
MOST_BYTES, MOST_AT_ONCE, PER_PEER, PER_CAPABILITY = 1_048_576, 20, 60, 30
MINUTE_MS = 60_000


@dataclass(frozen=True)
class Limits:
    most_bytes: int = MOST_BYTES
    at_once: int = MOST_AT_ONCE
    per_peer: int = PER_PEER
    per_capability: int = PER_CAPABILITY


def guard(requests: DataFrame, order: list[str], limits: Limits = Limits(), by: str | None = None) -> DataFrame:
    """``requests`` (``peer, capability, bytes, at_ms`` and, if there, ``took_ms``) with ``refused``: why, or null.

    The checks come in order: size, requests under way, the peer's last minute, the capability's last minute. A request
    that fails at the capability has used up its peer's turn; one that fails before has not. All of them share the state
    of one node, so rows are folded in order, one task for each value of ``by`` (the node), or one in all without it.
    """
    rows = requests.withColumn("_node", F.col(by) if by else F.lit("")).withColumn("_took", F.coalesce("took_ms", F.lit(0)).cast("bigint") if "took_ms" in requests.columns else F.lit(0).cast("bigint"))

    def recent(times: deque, at: int) -> deque:
        while times and at - times[0] >= MINUTE_MS:
            times.popleft()
        return times

    def step(state: tuple, peer: str, capability: str, size: int, at: int, took: int):
        peers, capabilities, under_way = state
        under_way[:] = [t for t in under_way if t > at]
        if (size or 0) > limits.most_bytes:
            return state, TOO_LARGE
        if len(under_way) >= limits.at_once:
            return state, BUSY
        mine = recent(peers.setdefault(peer, deque()), at)
        if len(mine) >= limits.per_peer:
            return state, PEER_LIMIT
        mine.append(at)
        theirs = recent(capabilities.setdefault(capability, deque()), at)
        if len(theirs) >= limits.per_capability:
            return state, CAPABILITY_LIMIT
        theirs.append(at)
        if took > 0:
            under_way.append(at + took)
        return state, None

    out = fold(rows, ["_node"], order, ["peer", "capability", "bytes", "at_ms", "_took"], lambda *_: ({}, {}, []), step, "refused", "string")
    return out.drop("_node", "_took")


def action_digest(canonical_action: Column) -> Column:
    """The SHA-256 of an action's canonical JSON."""
    return F.sha2(canonical_action, 256)


def approval_token(action_id: Column, digest: Column, decision: Column, approved_at: Column, expires_at: Column, secret: Column) -> Column:
    """What proves an approval: the SHA-256 of its parts and a secret, put together with ":"."""
    return F.sha2(F.concat_ws(":", action_id, digest, decision, approved_at, expires_at, secret), 256)


def redeem(uses: DataFrame, tokens: DataFrame) -> DataFrame:
    """``use_id, problem``: uses ``use_id, token, digest, at`` of ``tokens (token, digest, expires_at)``: ``unknown``,
    ``changed`` (another action than the approved one), ``expired``, ``used`` (a token holds once, for the first use that is
    none of these), or null."""
    held = tokens.select("token", F.col("digest").alias("_approved"), "expires_at").dropDuplicates(["token"]).withColumn("_known", F.lit(True))
    each = uses.join(held, "token", "left")
    wrong = F.when(F.col("_known").isNull(), "unknown").when(~F.col("digest").eqNullSafe(F.col("_approved")), "changed").when(F.col("at") > F.col("expires_at"), "expired")
    each = each.withColumn("_wrong", wrong)
    place = F.row_number().over(Window.partitionBy("token", F.col("_wrong").isNull()).orderBy("at", "use_id"))
    return each.withColumn("_place", place).select("use_id", F.coalesce("_wrong", F.when(F.col("_place") > 1, "used")).alias("problem"))
