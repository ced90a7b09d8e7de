"""Tamper-evident event logs: hash chains, their verification, queries and session replay.

A log is ``chain, seq, event_id, payload, prev_hash, hash`` and any other columns; ``seq`` counts from 1 in each chain.
An entry's hash is the SHA-256 of its predecessor's hash, ":" and its canonical payload. Verification is parallel: each
entry is checked against the stored hash of the one before, which a join on (chain, seq) brings along, so that even one
chain over all rows is spread over the cluster.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodequery.functions.text import redact
from lodequery.operators.folds import fold

GENESIS = "0" * 64
SEQUENCE, LINK, HASH = "sequence", "link", "hash"


def canonical_json(columns: Sequence[str]) -> Column:
    """A JSON object of columns with sorted keys, without null values."""
    return F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]))


def canonical(text: Column) -> Column:
    """JSON with sorted keys at every depth and no white space, null values kept; what isn't JSON stays as it is."""
    return F.coalesce(F.to_json(F.try_parse_json(text)), text)


#: Keys of an entry that aren't hashed.
UNHASHED = ("hash", "prev_hash", "sequence_number")


def hashable(entry: Column) -> Column:
    """The canonical JSON of an entry (a JSON object) without what its place in the chain gives it."""
    held = F.map_filter(F.from_json(entry, "map<string,variant>"), lambda k, _: ~k.isin(*UNHASHED))
    name = lambda k: F.to_json(F.to_variant_object(F.struct(k.alias("k"))))
    pairs = F.transform(F.array_sort(F.map_keys(held)), lambda k: F.concat(name(k).substr(F.lit(6), F.length(name(k)) - 6), F.lit(":"), F.coalesce(F.to_json(F.element_at(held, k)), F.lit("null"))))
    return F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))


def chain_ends(stored: DataFrame) -> DataFrame:
    """``chain, last_seq, last_hash``: where each stored chain goes on."""
    return stored.groupBy("chain").agg(F.max("seq").alias("last_seq"), F.max_by("hash", "seq").alias("last_hash"))


def append_hashes(log: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """``chain, seq, payload`` and other columns, with ``prev_hash`` and ``hash``.

    Without ``stored`` each chain begins with the genesis hash. With it, the new entries go on from the last stored one
    of their chain: they are numbered on from it in the order of their own ``seq``, and linked to its hash. Of ``stored``
    only ``chain, seq, hash`` are read, one row a chain is kept.
    """

    def step(state: tuple, payload: str, *_):
        n, last = state
        made = hashlib.sha256(f"{last}:{payload}".encode()).hexdigest()
        return (n + 1, made), f"{n + 1}|{last}|{made}"

    if stored is None:
        both = fold(log, ["chain"], ["seq"], ["payload"], lambda *_: (0, GENESIS), step, "both", "string")
    else:
        at = log.join(chain_ends(stored), "chain", "left").withColumn("last_seq", F.coalesce("last_seq", F.lit(0)).cast("bigint")).withColumn("last_hash", F.coalesce("last_hash", F.lit(GENESIS)))
        both = fold(at, ["chain"], ["seq"], ["payload", "last_seq", "last_hash"], lambda _, n, last: (n, last), step, "both", "string")
        both = both.withColumn("seq", F.split_part("both", F.lit("|"), F.lit(1)).cast(dict(log.dtypes)["seq"])).drop("last_seq", "last_hash")
    part = lambda i: F.split_part("both", F.lit("|"), F.lit(i))
    return both.withColumn("prev_hash", part(2)).withColumn("hash", part(3)).drop("both")


def append(log: DataFrame, stored: DataFrame | None = None, text_columns: Sequence[str] = ("payload",)) -> DataFrame:
    """Entries as they are stored: secrets in their text columns masked, numbered, linked and hashed."""
    for c in text_columns:
        log = log.withColumn(c, redact(F.col(c)))
    return append_hashes(log, stored)


def rotate(log: DataFrame, now, most_bytes: int = 0, most_days: int = 0) -> bool:
    """Whether a log is due to be archived: its entries as JSON lines pass ``most_bytes``, or the first one is older than
    ``most_days`` (0: no such limit). Entries keep their prev_hash, and the next chain goes on from the last hash."""
    size = F.coalesce(F.sum(F.length(F.to_json(F.struct(*log.columns)).cast("binary")) + 1), F.lit(0))
    first = F.min_by("ts", "seq") if "seq" in log.columns else F.min("ts")
    row = log.agg(size.alias("bytes"), first.alias("first")).first()
    old = most_days > 0 and row["first"] is not None and (now - row["first"]).total_seconds() > most_days * 86_400
    return bool(most_bytes and row["bytes"] > most_bytes or old)


def check_entries(log: DataFrame, partial: bool = False) -> DataFrame:
    """``chain, seq, event_id, broken``: what is wrong with each entry (null: nothing). The first entry of a whole chain
    follows the genesis hash; that of a ``partial`` one (a session's export) may follow any.

    Deleted, reordered and repeated entries show as a sequence or link that doesn't fit.
    """
    place = log.withColumn("at", F.row_number().over(Window.partitionBy("chain").orderBy("seq", "event_id"))) if partial else log
    here = place.withColumn("before", (F.col("at") if partial else F.col("seq")) - 1)
    prev = place.select("chain", (F.col("at") if partial else F.col("seq")).alias("before"), F.col("hash").alias("last_hash")).dropDuplicates(["chain", "before"])
    both = here.join(prev, ["chain", "before"], "left")
    first = F.col("before") == 0
    expected = F.when(first, F.col("prev_hash") if partial else F.lit(GENESIS)).otherwise(F.col("last_hash"))
    recomputed = F.sha2(F.concat(F.col("prev_hash"), F.lit(":"), F.col("payload")), 256)
    broken = F.when(~first & F.col("last_hash").isNull(), SEQUENCE).when(F.col("prev_hash") != expected, LINK).when(recomputed != F.col("hash"), HASH)
    return both.select("chain", "seq", "event_id", broken.alias("broken"))


def verify(log: DataFrame, partial: bool = False) -> DataFrame:
    """``chain, valid, entries, verified, broken_at, broken_event, reason``: the first broken entry of each chain."""
    checked = check_entries(log, partial)
    bad = F.col("broken").isNotNull()
    first = F.min_by(F.struct("seq", "event_id", "broken"), F.when(bad, F.col("seq")))
    each = checked.groupBy("chain").agg((F.count_if(bad) == 0).alias("valid"), F.count("*").alias("entries"), first.alias("f"), F.min(F.when(bad, F.col("seq"))).alias("broken_at"))
    return each.select("chain", "valid", "entries", F.coalesce(F.col("broken_at") - 1, F.col("entries")).alias("verified"), "broken_at", F.when(~F.col("valid"), F.col("f.event_id")).alias("broken_event"), F.when(~F.col("valid"), F.col("f.broken")).alias("reason"))


def query(log: DataFrame, sessions: Sequence | None = None, types: Sequence[str] | None = None, severities: Sequence[str] | None = None, start=None, end=None, text: str | None = None, text_columns: Sequence[str] = ("action", "target", "reason", "error"), offset: int = 0, limit: int = 0) -> DataFrame:
    """Entries by session, type (or stage), severity, time (both ends included) and part of their text, in log order."""
    out = log
    if sessions is not None:
        out = out.where(F.col("session_id").isin(list(sessions)))
    if types is not None:
        hit = F.col("event_type").isin(list(types))
        out = out.where(hit | F.coalesce(F.col("stage").isin(list(types)), F.lit(False)) if "stage" in log.columns else hit)
    if severities is not None:
        out = out.where(F.col("severity").isin(list(severities)))
    if start is not None:
        out = out.where(F.col("ts") >= F.lit(start))
    if end is not None:
        out = out.where(F.col("ts") <= F.lit(end))
    if text:
        out = out.where(F.contains(F.lower(F.concat_ws(" ", *[F.col(c).cast("string") for c in text_columns if c in log.columns])), F.lit(text.lower())))
    if offset or limit:
        out = out.orderBy("ts", "event_id").offset(offset)
        out = out.limit(limit) if limit else out
    return out


def session_bounds(log: DataFrame) -> DataFrame:
    """``session_id, entries, root_hash, leaf_hash``: what a session's export is named by."""
    return log.groupBy("session_id").agg(F.count("*").alias("entries"), F.min_by("prev_hash", "seq").alias("root_hash"), F.max_by("hash", "seq").alias("leaf_hash"))


def export_session(log: DataFrame, session_id) -> tuple[dict, DataFrame]:
    """A session's bundle: a header (version, session, entries, root and leaf hash, whether the entries are whole as a part
    of their chain) and the entries."""
    rows = log.where(F.col("session_id") == session_id)
    bounds = session_bounds(rows).first()
    found = verify(rows, partial=True).agg(F.count_if(~F.col("valid")).alias("bad")).first()
    header = {"version": "1.0.0", "session_id": session_id, "entries": bounds["entries"] if bounds else 0, "root_hash": bounds["root_hash"] if bounds else GENESIS, "leaf_hash": bounds["leaf_hash"] if bounds else GENESIS}
    return header | {"integrity_valid": not found["bad"]}, rows


def verify_bundle(header: dict, entries: DataFrame) -> DataFrame:
    """``valid, entries, verified, broken_event, reason``: a bundle by itself, its first entry following the root hash, each
    other the one before. A number or leaf hash other than the header's is broken, too."""
    checked = check_entries(entries.withColumn("chain", F.lit("bundle")), partial=True)
    rows = entries.agg(F.count("*").alias("n"), F.min_by("prev_hash", "seq").alias("root"), F.max_by("hash", "seq").alias("leaf"))
    place = checked.withColumn("_at", F.row_number().over(Window.partitionBy("chain").orderBy("seq", "event_id")))
    bad = F.col("broken").isNotNull()
    first = place.agg(F.min(F.when(bad, F.col("_at"))).alias("at"), F.min_by("event_id", F.when(bad, F.col("_at"))).alias("event"), F.min_by("broken", F.when(bad, F.col("_at"))).alias("why"))
    both = rows.join(first)  # one row and one row
    root = (F.col("n") > 0) & ~F.col("root").eqNullSafe(F.lit(header["root_hash"]))
    other = (F.col("n") != header["entries"]) | ((F.col("n") > 0) & ~F.col("leaf").eqNullSafe(F.lit(header["leaf_hash"])))
    reason = F.when(root, "root").when(F.col("at").isNotNull(), F.col("why")).when(other, "header")
    return both.select(reason.isNull().alias("valid"), F.col("n").alias("entries"), F.when(root, 0).otherwise(F.coalesce(F.col("at") - 1, F.col("n"))).cast("bigint").alias("verified"), F.when(~root, F.col("event")).alias("broken_event"), reason.alias("reason"))


def timeline(log: DataFrame) -> DataFrame:
    """Each session's entries numbered in order."""
    return log.withColumn("step", F.row_number().over(Window.partitionBy("session_id").orderBy("ts", "event_id")))


def replay_summary(log: DataFrame) -> DataFrame:
    """``session_id, entries, first_at, last_at, duration_ms, proposed, executed, blocked, alerts, status``, and, where the log
    has an ``agent_id`` or a ``task``, the first agent and the last task.

    The last completion, stop or failure decides the status; without one a session is running. A log may name what was
    done in ``stage`` and ``result``, too.
    """
    order = F.struct("ts", "event_id")
    also = lambda c, x: F.coalesce(F.col(c) == x, F.lit(False)) if c in log.columns else F.lit(False)
    event = F.col("event_type")
    decided = F.when(event == "SESSION_COMPLETED", "COMPLETED").when((event == "SESSION_STOPPED") | also("stage", "SESSION_STOPPED"), "STOPPED").when((event == "ACTION_FAILED") | also("result", "failure"), "FAILED")
    named = [F.min_by("agent_id", F.when(F.col("agent_id").isNotNull(), order)).alias("agent_id")] if "agent_id" in log.columns else []
    named += [F.max_by("task", F.when(F.col("task").isNotNull(), order)).alias("task")] if "task" in log.columns else []
    each = log.groupBy("session_id").agg(
        F.count("*").alias("entries"),
        F.min("ts").alias("first_at"),
        F.max("ts").alias("last_at"),
        F.count_if((event == "ACTION_PROPOSED") | also("stage", "ACTION_PROPOSED")).alias("proposed"),
        F.count_if((event == "ACTION_EXECUTED") | also("stage", "ACTION_EXECUTED")).alias("executed"),
        F.count_if((event == "ACTION_BLOCKED") | also("stage", "ACTION_DENIED") | also("result", "blocked")).alias("blocked"),
        F.count_if(F.col("severity").isin("HIGH", "CRITICAL")).alias("alerts"),
        F.max_by(decided, F.when(decided.isNotNull(), order)).alias("status"),
        *named,
    )
    span = F.unix_millis(F.col("last_at").cast("timestamp")) - F.unix_millis(F.col("first_at").cast("timestamp"))
    return each.withColumn("duration_ms", span).withColumn("status", F.coalesce("status", F.lit("RUNNING")))


def report(log: DataFrame, session_id) -> str:
    """One session as text: its summary, its alerts, its steps and its browser actions, if there are any. The entries of
    the session are gathered."""
    rows = log.where(F.col("session_id") == session_id)
    found = replay_summary(rows).first()
    if found is None:
        return f"Session {session_id}: no entries"
    s = found.asDict()
    parts = [f"Session:  {session_id}", f"Agent:    {s.get('agent_id') or 'unknown'}", f"Status:   {s['status']}", f"Task:     {s.get('task') or 'none'}", f"Time:     {s['first_at']} to {s['last_at']} ({s['duration_ms']} ms)"]
    parts.append(f"Entries:  {s['entries']}, of which {s['proposed']} proposed, {s['executed']} executed, {s['blocked']} blocked")
    wanted = lambda df, columns: df.select(*[F.col(c) if c in df.columns else F.lit(None).alias(c) for c in columns])
    marked = wanted(alerts(rows).orderBy("ts", "event_id"), ("ts", "severity", "event_type", "reason")).collect()
    if marked:
        parts += ["", f"Alerts ({len(marked)})", *(f"  [{r['severity']}] {r['event_type']}: {r['reason'] or ''} at {r['ts']}" for r in marked)]
    steps = wanted(timeline(rows).orderBy("step"), ("step", "ts", "event_type", "action", "target", "policy_decision", "result", "severity", "reason")).collect()
    parts += ["", f"Steps ({len(steps)})"]
    for r in steps:
        notes = [f"{n} {r[c]}" for n, c in (("decision", "policy_decision"), ("result", "result"), ("severity", "severity"), ("reason", "reason")) if r[c] and r[c] != "INFO"]
        parts.append(f"  {r['step']}. {r['ts']} {r['event_type']}: {r['action'] or 'none'} {r['target'] or ''}".rstrip() + (f" ({', '.join(notes)})" if notes else ""))
    trace = wanted(browser_trace(rows).orderBy("ts", "event_id"), ("ts", "action", "target", "result")).collect() if "action" in rows.columns else []
    if trace:
        parts += ["", f"Browser actions ({len(trace)})", *(f"  {r['ts']} {r['action']} {r['target'] or ''} ({r['result'] or 'proposed'})" for r in trace)]
    return "\n".join(parts)


#: Actions of a browser.
BROWSER_ACTIONS = "navigate click fill submit read evaluate hover pressKey".split()


def alerts(log: DataFrame) -> DataFrame:
    """Entries of high or critical severity, or marked as alerts."""
    marked = F.coalesce(F.col("alert"), F.lit(False)) if "alert" in log.columns else F.lit(False)
    return log.where(F.col("severity").isin("HIGH", "CRITICAL") | marked)


def policy_audit(log: DataFrame) -> DataFrame:
    return log.where("policy_decision is not null")


def browser_trace(log: DataFrame) -> DataFrame:
    """Browser actions that were proposed or executed."""
    return log.where(F.col("action").isin(BROWSER_ACTIONS) & F.col("event_type").isin("ACTION_PROPOSED", "ACTION_EXECUTED"))


#: Parts of an error that tell a violation, and a capability that nobody registered.
VIOLATIONS = ("[SecurityViolation]", "forged approval token")
UNREGISTERED = "not registered in capability registry"


def classify(event_type: Column, decision: Column, error: Column, sensitive: Column, indicators: Column, tampered: Column) -> Column:
    """Severity, the first that applies."""
    failed = F.coalesce(error, F.lit(""))
    has = lambda s: F.contains(failed, F.lit(s))
    yes = lambda c: F.coalesce(c, F.lit(False))
    return (
        F.when(yes(tampered), "CRITICAL")
        .when(has(VIOLATIONS[0]) | has(VIOLATIONS[1]), "CRITICAL")
        .when(yes(F.array_contains(indicators, "PROMPT_INJECTION")), "HIGH")
        .when((event_type == "ACTION_BLOCKED") & yes(sensitive), "HIGH")
        .when(event_type == "SESSION_STOPPED", "HIGH")
        .when(yes(decision == "LIMITED"), "MEDIUM")
        .when(has(UNREGISTERED), "MEDIUM")
        .when(event_type == "ACTION_BLOCKED", "MEDIUM")
        .when(event_type == "USER_DENIED", "LOW")
        .when((event_type == "ACTION_FAILED") | (failed != ""), "LOW")
        .otherwise("INFO")
    )
