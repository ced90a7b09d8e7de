"""Resolution of mentioned names against known entities: equal names, then names without legal forms, then close names.

The first two steps are equi-joins. Close names (a Levenshtein similarity of 0.9 or more) are compared only within
blocks that such a pair must share: the similarity allows one edit for each ten characters, so of ``parts`` cut pieces
of the known name at least one stands unchanged in the other, shifted by no more than the edits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodequery.functions.similarity import levenshtein_similarity
from lodequery.functions.text import normalize_name, strip_company

SIMILARITY = 0.9
SUFFIXED = ("ORGANIZATION", "PRODUCT")


def _piece(text: str, n: str, i: str, shift: str = "0") -> str:
    """SQL of piece i of a text, were it n long: with up to n / 9 edits one of n / 9 + 1 equal pieces stands unchanged."""
    width = f"cast(floor({n} / (floor({n} / 9) + 1)) as int)"
    at = f"{i} * {width} + 1 + {shift}"
    return f"struct({i} as i, {n} as n, case when {at} > 0 then substring({text}, {at}, {width}) end as piece)"


def _blocks(df: DataFrame, name: str, probe: bool) -> DataFrame:
    """Keys of a normalised name: its pieces; a probe has the pieces of every length and shift that a close name may have.

    A known name of n characters and one of m are close with at most max(n, m) / 10 edits, and so with at most n / 9.
    """
    if probe:
        m = f"length({name})"
        shifts = f"transform(sequence(-cast(floor(n / 9) as int), cast(floor(n / 9) as int)), s -> {_piece(name, 'n', 'i', 's')})"
        keys = f"flatten(transform(sequence(greatest(1, {m} - cast(floor({m} / 9) as int)), {m} + cast(floor({m} / 9) as int)), n -> flatten(transform(sequence(0, cast(floor(n / 9) as int)), i -> {shifts}))))"
    else:
        n = f"length({name})"
        keys = f"transform(sequence(0, cast(floor({n} / 9) as int)), i -> {_piece(name, n, 'i')})"
    return df.withColumn("b", F.explode(F.array_distinct(F.expr(keys))))


def resolve(candidates: DataFrame, entities: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``candidate_id, entity_id, step``: for ``candidate_id, name, entity_type`` the first entity (by seq) of the same type
    found by step 1 (name or alias), 2 (without legal forms) or 3 (close name); null and step 4 where there is none."""
    c = candidates.select("candidate_id", "entity_type", F.col("name").alias("raw"), normalize_name(F.col("name")).alias("name"))
    e = entities.select("entity_id", "entity_type", "seq", "canonical_name", "aliases")
    names = e.select("entity_id", "entity_type", "seq", F.explode(F.array_distinct(F.concat(F.array(normalize_name(F.col("canonical_name"))), F.transform(F.coalesce("aliases", F.array().cast("array<string>")), normalize_name)))).alias("name"))
    exact = c.join(names, ["entity_type", "name"]).select("candidate_id", "entity_id", "seq", F.lit(1).alias("step"))
    firm = c.where(F.col("entity_type").isin(*SUFFIXED)).select("candidate_id", "entity_type", strip_company(F.col("raw")).alias("name")).where(F.length("name") >= 3)
    bare = e.select("entity_id", "entity_type", "seq", strip_company(F.col("canonical_name")).alias("name"))
    stripped = firm.join(bare, ["entity_type", "name"]).select("candidate_id", "entity_id", "seq", F.lit(2).alias("step"))
    done = exact.unionByName(stripped)
    open_ = c.join(done.select("candidate_id").distinct(), "candidate_id", "left_anti").where(F.length("name") >= 1)
    stored = e.select("entity_id", "entity_type", "seq", normalize_name(F.col("canonical_name")).alias("known")).where(F.length("known") >= 1)
    near = _blocks(open_, "name", True).join(_blocks(stored, "known", False), ["entity_type", "b"])
    close = near.select("candidate_id", "entity_id", "seq", "name", "known").distinct().where(levenshtein_similarity(F.col("name"), F.col("known")) >= similarity)
    found = done.unionByName(close.select("candidate_id", "entity_id", "seq", F.lit(3).alias("step")))
    first = found.withColumn("place", F.row_number().over(Window.partitionBy("candidate_id").orderBy("step", "seq", "entity_id"))).where("place = 1")
    return candidates.select("candidate_id").join(first, "candidate_id", "left").select("candidate_id", "entity_id", F.coalesce("step", F.lit(4)).alias("step"))
