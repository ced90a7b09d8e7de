"""Ordered rules over rows: the first that fits decides. Rules are data; none is built in."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodequery.functions.text import domain_matches, domain_of, target_matches
from lodequery.operators.folds import sliding_admissions

ALLOW, DENY, ASK_USER, LIMITED = DECISIONS = "ALLOW", "DENY", "ASK_USER", "LIMITED"
#: Action types that no default may allow.
SENSITIVE_ACTIONS = (
    "execute_code file_write file_delete shell_exec download_file read_credentials input_password submit_payment "
    "network_exfiltrate remote_execution sensitive_data_transfer"
).split()
MINUTE_MS = 60_000


class InvalidPolicy(ValueError):
    """A policy that can't be evaluated."""


@dataclass(frozen=True)
class Rule:
    id: str
    action: str  # an action type, or * for any
    decision: str
    pattern: str | None = None
    per_minute: int = 0  # actions that the rule lets through in a minute; 0: any number


@dataclass(frozen=True)
class Policy:
    id: str
    name: str
    version: str
    rules: Sequence[Rule] = ()
    allowed: Sequence[str] = ()
    denied: Sequence[str] = ()
    sensitive: Sequence[str] = ()
    default: str = DENY

    def check(self) -> None:
        for c in ("id", "name", "version"):
            if not isinstance(getattr(self, c), str) or not getattr(self, c).strip():
                raise InvalidPolicy(f"a policy has a non-empty {c}")
        for i, r in enumerate(self.rules):
            if not r.id.strip() or not r.action.strip():
                raise InvalidPolicy(f"rule {i} has a non-empty id and action")
            if r.decision not in DECISIONS:
                raise InvalidPolicy(f"rule {i}: {r.decision!r} is none of {', '.join(DECISIONS)}")


def action_problem(action: Column, target: Column | None = None, **required: Column) -> Column:
    """Why a row is no action (null: it is one): no type, or an empty one of the ``required`` columns."""
    blank = lambda c: F.coalesce(F.trim(c.cast("string")), F.lit("")) == ""
    named = {"type": action} | ({"target": target} if target is not None else {}) | required
    return F.coalesce(*[F.when(blank(c), f"no {n}") for n, c in named.items()])


def decide(action: Column, target: Column, rules: Sequence[Rule], allowed: Sequence[str] = (), denied: Sequence[str] = (), default: str = DENY, sensitive: Column | None = None) -> Column:
    """``struct(decision, rule)``: a denied domain, one that isn't among the allowed ones, the first fitting rule, the denial
    of a sensitive action, or the default, in this order. A rule's pattern is passed over where there is no target. A few
    rules make one CASE expression, which needs no join with a table of rules."""
    domain = domain_of(target)
    any_of = lambda patterns: _any([domain_matches(domain, p) for p in patterns])
    pair = lambda d, r: F.struct(F.lit(d).alias("decision"), F.lit(r).alias("rule"))
    out = F.when(domain.isNotNull() & any_of(denied), pair(DENY, "denied_domain"))
    if allowed:
        out = out.when(domain.isNotNull() & ~any_of(allowed), pair(DENY, "not_allowed_domain"))
    for r in rules:
        fits = F.lit(True) if r.action == "*" else action == r.action
        if r.pattern:
            fits = fits & (target.isNull() | (target == "") | F.coalesce(target_matches(target, r.pattern), F.lit(False)))
        out = out.when(fits, pair(r.decision, r.id))
    if sensitive is not None:
        out = out.when(F.coalesce(sensitive, F.lit(False)), pair(DENY, "sensitive"))
    return out.otherwise(pair(default, "default"))


def evaluate(actions: DataFrame, policy: Policy, at_ms: str, order: list[str]) -> DataFrame:
    """``actions`` (``action, target`` and, if there, ``is_sensitive``) with ``decision`` and ``rule``.

    An action whose rule has let through its number of actions in the minute before is LIMITED; only rows of such rules
    are folded in order, one task a rule, all others are decided where they lie. An action without a type fails the job.
    """
    policy.check()
    sensitive = F.lower("action").isin(SENSITIVE_ACTIONS) | F.col("action").isin(list(policy.sensitive))
    if "is_sensitive" in actions.columns:
        sensitive = sensitive | F.coalesce("is_sensitive", F.lit(False))
    typed = F.when(action_problem(F.col("action")).isNotNull(), F.raise_error(F.lit("an action without a type")).cast("string")).otherwise(F.col("action"))
    made = actions.withColumn("_d", decide(typed, F.col("target"), policy.rules, policy.allowed, policy.denied, policy.default, sensitive))
    made = made.withColumn("decision", F.col("_d.decision")).withColumn("rule", F.col("_d.rule")).drop("_d")
    limits = {r.id: r.per_minute for r in policy.rules if r.per_minute > 0}
    if not limits:
        return made
    some = F.col("rule").isin(list(limits))
    most = F.create_map(*[F.lit(x) for p in limits.items() for x in p])[F.col("rule")]
    counted = sliding_admissions(made.where(some).withColumn("_most", most), "rule", at_ms, "_most", order, MINUTE_MS, "_admitted")
    counted = counted.withColumn("decision", F.when(F.col("_admitted"), F.col("decision")).otherwise(LIMITED)).drop("_most", "_admitted")
    return made.where(~some).unionByName(counted)


def _any(hits: Sequence[Column]) -> Column:
    out = F.lit(False)
    for h in hits:
        out = out | F.coalesce(h, F.lit(False))
    return out
