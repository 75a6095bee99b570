"""Queries of the training-data problems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattloom.llm.answers import defects
from wattloom.llm.mixing import mix, mix_report
from wattloom.llm.overlap import coverage, pairs, texts
from wattloom.llm.packing import pack
from wattloom.llm.spans import shared_coverage, shared_pairs, shared_spans
from wattloom.llm.splits import assign_splits, leaks
from wattloom.llm.tables import split_name, state_key
from wattloom.session import cut_table
from wattloom.llm.tokens import token_counts
from wattloom.sources.tables import table


def _sft(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "public_state_v1_sft")
    return d.select("sft_row_id", "example_id", state_key(F.col("physical_state_id")).alias("state"), split_name(F.col("split")).alias("split"), "provenance", F.get_json_object("target_json", "$.a").alias("action"))


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    """Records of related groups that the present split tears apart."""
    return leaks(_sft(spark, sf), "sft_row_id", ["state", "example_id"], "split").select("group_first_id", F.col("row_id").alias("sft_row_id"))


def _new_splits(spark: SparkSession, sf: str) -> DataFrame:
    return assign_splits(_sft(spark, sf), "sft_row_id", ["state", "example_id"], ["provenance", "action"])


def p1_splits(spark: SparkSession, sf: str) -> DataFrame:
    """Every record's new split."""
    return _new_splits(spark, sf).select(F.col("row_id").alias("sft_row_id"), "component", "new_split")


def p1_balance(spark: SparkSession, sf: str) -> DataFrame:
    """Records per new split and provenance."""
    d = _new_splits(spark, sf).join(_sft(spark, sf).select(F.col("sft_row_id").alias("row_id"), "provenance"), "row_id")
    return d.groupBy("new_split", "provenance").agg(F.count("*").alias("n_records"), F.countDistinct("component").alias("n_components"))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    """Answers that are no proper answer to their prompt, with the defect."""
    d = defects(table(spark, sf, "t45_k4_free_candidates"), "candidate_row_id", "prompt", "raw_output")
    return d.select(F.col("row_id").alias("candidate_row_id"), "defect_type")


def p2_defects_per_prompt(spark: SparkSession, sf: str) -> DataFrame:
    """Answers and defects per split and defect type, with how many of the defects the recorded flags miss."""
    c = table(spark, sf, "t45_k4_free_candidates")
    d = defects(c, "candidate_row_id", "prompt", "raw_output").withColumnRenamed("row_id", "candidate_row_id")
    j = c.select("candidate_row_id", split_name(F.col("split")).alias("split"), "eos_completed", "truncated").join(d, "candidate_row_id")
    said_fine = F.coalesce("eos_completed", F.lit(True)) & ~F.coalesce("truncated", F.lit(False))
    return j.groupBy("split", "defect_type").agg(F.count("*").alias("n_defects"), F.count_if(said_fine).alias("n_flags_say_fine"))


def _sides(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "public_state_v1_sft")
    return texts(d, "sft_row_id", "prompt", "target_json", _side(), [split_name(F.col("split")).alias("split"), F.col("provenance")])


def _side():
    split = split_name(F.col("split"))
    return F.when(split == "TRAIN", "T").when(split.isin("DEV", "HOLDOUT"), "E")


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of a TRAIN record and a DEV or HOLDOUT record that are the same or nearly so."""
    d = pairs(_sides(spark, sf))
    return d.select(F.least("train_id", "eval_id").alias("sft_row_id_a"), F.greatest("train_id", "eval_id").alias("sft_row_id_b"))


def p6_overlap_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Evaluation records with a counterpart in TRAIN, and pairs, per split and provenance."""
    return pairs(_sides(spark, sf), kept=True).groupBy("split", "provenance").agg(F.countDistinct("eval_id").alias("n_records"), F.count("*").alias("n_pairs"))


def p6_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Characters of each split and provenance, of whole prompts and targets as written, in runs of 100 or more that the other side has too."""
    d = table(spark, sf, "public_state_v1_sft")
    text = F.concat_ws("\n", "prompt", "target_json")
    d = coverage(d, "sft_row_id", text, _side(), [split_name(F.col("split")).alias("split"), F.col("provenance")])
    return d.groupBy("split", "provenance").agg(F.sum("covered_chars").alias("covered_chars"), F.sum("n_chars").alias("n_chars"), F.count_if(F.col("covered_chars") > 0).alias("n_records"))


def _placements(spark: SparkSession, sf: str) -> DataFrame:
    items = cut_table(token_counts(table(spark, sf, "documents"), "text", [F.col("doc_id")]))
    return pack(items, table(spark, sf, "container_specs"))


def p7_containers(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's pieces and their containers, for each container kind."""
    return _placements(spark, sf)


def p7_fill(spark: SparkSession, sf: str) -> DataFrame:
    """Containers, tokens and filled share per container kind."""
    per = _placements(spark, sf).groupBy("container_kind", "shard", "container_no").agg(F.sum("n_tokens").alias("used"), F.count("*").alias("n_pieces"))
    d = per.join(table(spark, sf, "container_specs"), "container_kind")
    return d.groupBy("container_kind").agg(F.count("*").alias("n_containers"), F.sum("used").alias("tokens"), F.max("used").alias("fullest"), (F.sum("used") / F.sum("capacity_tokens")).alias("filled_share"))


def _sizes(spark: SparkSession, sf: str) -> DataFrame:
    return cut_table(token_counts(table(spark, sf, "documents"), "text", [F.col("doc_id"), F.col("source")]))


def p8_selection(spark: SparkSession, sf: str) -> DataFrame:
    """The records chosen to mix the sources to their targets, and how often each is used."""
    return mix(_sizes(spark, sf), table(spark, sf, "mix_targets"))


def p8_shares(spark: SparkSession, sf: str) -> DataFrame:
    """Reached shares per source."""
    targets = table(spark, sf, "mix_targets")
    return mix_report(mix(_sizes(spark, sf), targets), targets)


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of documents with a common run of 200 characters or more."""
    return shared_pairs(table(spark, sf, "documents"))


def p9_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """How much of each document is shared with others."""
    return shared_coverage(table(spark, sf, "documents"))


def p9_spans(spark: SparkSession, sf: str) -> DataFrame:
    """The spans of 200 characters or more that several documents have, one row per occurrence."""
    return shared_spans(table(spark, sf, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p1_splits, p1_balance, p2_found, p2_defects_per_prompt, p6_found, p6_overlap_counts, p6_coverage, p7_containers, p7_fill, p8_selection, p8_shares, p9_found, p9_coverage, p9_spans)}
_SPLIT = r"nullif(upper(regexp_replace(split, '^\s+|\s+$', '', 'g')), '')"
_P1 = rf"""WITH RECURSIVE d AS (SELECT sft_row_id id, example_id e, {_SPLIT} split, nullif(array_to_string(list_transform(regexp_extract_all(lower(physical_state_id), '\p{{L}}+|\p{{Nd}}+'), lambda x: regexp_replace(x, '^0+(\d)', '\1')), '|'), '') s FROM public_state_v1_sft),
 e AS (SELECT id a, min(id) OVER (PARTITION BY s) b FROM d WHERE s IS NOT NULL UNION SELECT id, min(id) OVER (PARTITION BY e) FROM d WHERE e IS NOT NULL), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
 r AS (SELECT id n, id m FROM d UNION SELECT r.n, u.b FROM r JOIN u ON r.m = u.a), root AS (SELECT n, min(m) root FROM r GROUP BY 1),
 mixed AS (SELECT root FROM root JOIN d ON n = id GROUP BY 1 HAVING count(DISTINCT split) > 1)
 SELECT root AS group_first_id, n AS sft_row_id FROM root WHERE root IN (SELECT root FROM mixed)"""
_WINDOWS = "w AS (SELECT doc_id, i, md5(substr(text, i, 200)) h FROM (SELECT doc_id, text, unnest(range(1, length(text) - 198)) i FROM documents WHERE length(text) >= 200)), m AS (SELECT h FROM w GROUP BY 1 HAVING count(DISTINCT doc_id) > 1)"
SQL: dict[str, str] = {
    "p1_found": _P1,
    "p9_found": f"WITH {_WINDOWS}, x AS (SELECT DISTINCT doc_id, h FROM w WHERE h IN (SELECT h FROM m)) SELECT DISTINCT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM x a JOIN x b ON a.h = b.h AND a.doc_id < b.doc_id",
    "p9_coverage": f"""WITH {_WINDOWS}, x AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) p FROM w WHERE h IN (SELECT h FROM m)), c AS (SELECT doc_id, count_if(p IS NULL OR i > p + 200)::INT n, sum(CASE WHEN p IS NULL THEN 200 ELSE least(200, i - p) END)::INT k FROM x GROUP BY 1)
 SELECT d.doc_id, coalesce(n, 0) AS n_spans, coalesce(k, 0) AS shared_chars, coalesce(length(text), 0) AS n_chars FROM documents d LEFT JOIN c ON d.doc_id = c.doc_id""",
}
