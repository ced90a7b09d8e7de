"""The subpackage's queries by name, and the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodequery.llm.leakage import leaks
from lodequery.llm.names import entity_groups, same_entities
from lodequery.llm.neardup import NearDuplicates, near_pairs
from lodequery.llm.packing import CAPACITY, packed, packing_report, packing_search
from lodequery.llm.reading import reading_levels
from lodequery.llm.similar import similar_pairs
from lodequery.llm.split import LIMIT, OVERLAP, contents, oversized, pieces
from lodequery.sources.tables import table

_CURRENT = """cur as (select * from vector_records where id is not null
  qualify row_number() over (partition by id order by updated_at desc nulls last, seq desc nulls last) = 1)"""

ORACLE = {
    "p4_found": f"""with {_CURRENT},
content as (
  select id, trim(case when trim(coalesce(text, ''), E' \\t\\r\\n') <> '' then text else body end, E' \\t\\r\\n') as content
  from cur left join raw_contents using (content_ref))
select id, case when regexp_matches(content, '[^ \\t\\r\\n]{{501}}') then 'forced' else 'natural' end as kind
from content where length(content) > 500""",
    "p4_rebuilt": f"""with {_CURRENT},
content as (
  select id, trim(case when trim(coalesce(text, ''), E' \\t\\r\\n') <> '' then text else body end, E' \\t\\r\\n') as content
  from cur left join raw_contents using (content_ref))
select id, case when regexp_matches(content, '[^ \\t\\r\\n]{{501}}') then 'forced' else 'natural' end as kind,
  length(content) as n_chars, md5(content) as digest, true as within, true as overlaps
from content where length(content) > 0""",
    "p6_checks": "select doc_id, true as whole, true as fits from documents where doc_id is not null and text <> ''",
    "p5_found": f"""with {_CURRENT},
w as (select id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') as w from cur where text is not null),
g as (select distinct id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) as g from w where len(w) >= 25),
n as (select id, count(*) as n from g group by id),
p as (select a.id as id_a, b.id as id_b, count(*) as k from g a join g b on a.g = b.g and a.id < b.id group by all)
select id_a, id_b from p join n x on x.id = id_a join n y on y.id = id_b where k >= 0.6 * (x.n + y.n - k) - 1e-9""",
}


#: Characters of the compatibility forms that are told in SQL: full-width forms, ligatures, and numbers set high or as fractions.
_WIDE = "".join(chr(i) for i in range(0xFF01, 0xFF5F))
_NARROW = "".join(chr(i - 0xFEE0) for i in range(0xFF01, 0xFF5F))
_HIDDEN = "[\u00ad\u200b-\u200f\u2060-\u206f\ufeff]"


def _plain_sql(text: str) -> str:
    for a, b in (("ﬁ", "fi"), ("¼", "1⁄4"), ("³", "3"), ("º", "o")):
        text = f"replace({text}, '{a}', '{b}')"
    quoted = lambda x: x.replace("'", "''")
    return f"lower(nfc_normalize(regexp_replace(translate({text}, '{quoted(_WIDE)}', '{quoted(_NARROW)}'), '{_HIDDEN}', '', 'g')))"


def _words_sql(text: str) -> str:
    return f"regexp_extract_all({_plain_sql(text)}, '[\\p{{L}}\\p{{N}}]+')"


ORACLE["p7_found"] = f"""with d as (select doc_id, {_words_sql('text')} as w from documents where doc_id is not null and text is not null),
i as (select item_id, {_words_sql('text')} as w from eval_items where item_id is not null and text is not null),
x as (select distinct item_id, array_to_string(w[k:k + 9], ' ') as g from i, unnest(range(1, greatest(len(w) - 8, 1))) t(k) where len(w) >= 10),
y as (select doc_id, array_to_string(w[k:k + 9], ' ') as g from d, unnest(range(1, greatest(len(w) - 8, 1))) t(k) where len(w) >= 10)
select distinct doc_id, item_id from y join x using (g)"""
_NEAR, _, _PAIRS = ORACLE["p5_found"].rpartition("\nselect id_a, id_b from")
ORACLE["p5_groups"] = f"""{_NEAR.replace('with cur', 'with recursive cur', 1)},
near as (select id_a, id_b from{_PAIRS}),
c as (select id, md5(array_to_string(list_sort(list(g)), '|')) as key from g group by id),
k as (select id, min(id) over (partition by key) as class_id from c),
links as (select distinct a.class_id as a, b.class_id as b from near join k a on a.id = id_a join k b on b.id = id_b where a.class_id <> b.class_id),
both_ways as (select a, b from links union select b, a from links),
reached as (select class_id as a, class_id as b from k union select r.a, w.b from reached r join both_ways w on w.a = r.b),
grouped as (select a as class_id, min(b) as group_id from reached group by 1),
counted as (select a as class_id, count(*) as n_links from both_ways group by 1)
select id, class_id, group_id, coalesce(n_links, 0) as n_links from k join grouped using (class_id) left join counted using (class_id)"""


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_pairs(table(spark, sf_dir, "vector_records"), table(spark, sf_dir, "collections"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_pairs(table(spark, sf_dir, "vector_records"))


def p5_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return NearDuplicates(table(spark, sf_dir, "vector_records")).groups()


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return same_entities(table(spark, sf_dir, "entities"))


def p2_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entity_groups(table(spark, sf_dir, "entities"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return oversized(table(spark, sf_dir, "vector_records"), table(spark, sf_dir, "raw_contents"))


def p4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces(contents(table(spark, sf_dir, "vector_records"), table(spark, sf_dir, "raw_contents")))


def p4_rebuilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each content put together again from its pieces, whether all are within the limit, and whether they overlap by 50
    characters (fewer only before a stretch of more than 450 characters without white space)."""
    each = p4_pieces(spark, sf_dir).groupBy("id", "kind").agg(F.array_sort(F.collect_list(F.struct("piece", "start", "end", "text"))).alias("p"))  # one text's pieces
    shared = F.transform("p", lambda x, i: F.when(i == 0, 0).otherwise(F.get("p", i - 1)["end"] - x["start"]))
    whole = F.array_join(F.transform(F.arrays_zip("p", shared.alias("shared")), lambda x: F.substring(x["p"]["text"], x["shared"] + 1, F.lit(LIMIT))), "")
    fits = F.forall("p", lambda x: (F.length(x["text"]) <= LIMIT) & (F.length(x["text"]) == x["end"] - x["start"]))
    long = f"[^ \\t\\r\\n]{{{LIMIT - OVERLAP + 1}}}"
    meet = F.forall(F.arrays_zip("p", shared.alias("shared")), lambda x: (x["p"]["piece"] == 0) | (x["shared"] == OVERLAP) | x["shared"].between(0, OVERLAP) & x["p"]["text"].rlike(long))
    return each.select("id", "kind", F.length(whole).cast("bigint").alias("n_chars"), F.md5(whole).alias("digest"), fits.alias("within"), meet.alias("overlaps"))


def p6_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))


def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing_report(p6_packed(spark, sf_dir))


def p6_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each document with a text: whether its pieces are its tokens in order, all but the last of a context's size, and
    whether none of its contexts holds more than it may."""
    rows = p6_packed(spark, sf_dir)
    load = F.sum("tokens").over(Window.partitionBy("context_id"))
    placed = rows.withColumn("load", load)
    whole = (F.sum("tokens") == F.max(F.col("start_token") + F.col("tokens"))) & (F.min("start_token") == 0) & (F.count("*") == F.max("piece") + 1) & F.bool_and((F.col("start_token") == F.col("piece") * CAPACITY) & (F.col("tokens") <= CAPACITY))
    return placed.groupBy("doc_id").agg(whole.alias("whole"), (F.max("load") <= CAPACITY).alias("fits"))


def p6_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: blocks, contexts of the search and of best fit, the lower bounds' sum, and the blocks in which the search
    needs fewer contexts than best fit, or as many as its bound."""
    each = packing_search(table(spark, sf_dir, "documents"))
    return each.agg(F.count("*").alias("blocks"), F.sum("contexts").alias("contexts"), F.sum("best_fit").alias("best_fit"), F.sum("least").alias("least"), F.count_if(F.col("contexts") < F.col("best_fit")).alias("better"), F.count_if(F.col("contexts") == F.col("least")).alias("proven"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading_levels(table(spark, sf_dir, "documents"), table(spark, sf_dir, "reading_labels")).select("doc_id", "level")


def p8_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    levels = reading_levels(table(spark, sf_dir, "documents"), table(spark, sf_dir, "reading_labels"))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.lower("lang").alias("lang"))
    return levels.join(docs, "doc_id").groupBy("lang", "level").agg(F.count("*").alias("documents"), F.round(F.avg("median_grade"), 4).alias("mean_grade"))


QUERIES = (p1_found, p2_found, p2_groups, p4_found, p4_pieces, p4_rebuilt, p5_found, p5_groups, p6_packed, p6_report, p6_checks, p6_search, p7_found, p8_found, p8_profile)


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return ORACLE
