"""Registered queries of the problems on texts (p7 to p9)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm import leakage, mixing, sentences
from tallyforge.runtime import cut, table


def _leaks(spark: SparkSession, sf: str, near: bool = True) -> DataFrame:
    return leakage.leaks(table(spark, sf, "documents"), table(spark, sf, "eval_items"), near=near)


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with exact passages of evaluation items."""
    return _leaks(spark, sf, near=False).where("windows > 0").select("doc_id", "item_id")


def p7_leaked_items(spark: SparkSession, sf: str) -> DataFrame:
    """Items that leaked: documents with exact and with near passages."""
    return _leaks(spark, sf).groupBy("item_id").agg(
        F.count_if(F.col("windows") > 0).alias("exact_docs"), F.count_if(F.col("windows") == 0).alias("near_docs"), F.max("windows").alias("most_windows"))


def p7_recall(spark: SparkSession, sf: str) -> DataFrame:
    """Recall of near passages: edited copies of all items, by kind of edit, against a comparison of every pair of texts."""
    return leakage.edit_recall(table(spark, sf, "eval_items"))


def _planned(spark: SparkSession, sf: str, counted: DataFrame) -> DataFrame:
    sizes = cut(mixing.leaf_sizes(counted))  # used twice, and counting tokens is what costs
    return mixing.plan(table(spark, sf, "mix_targets"), sizes)


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    """Targets whose source is too small even with all repeats."""
    planned = _planned(spark, sf, mixing.with_tokens(table(spark, sf, "documents")))
    return planned.where("short").select("mix_id", "source_label").distinct()


def _mixed(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    counted = cut(mixing.with_tokens(table(spark, sf, "documents")))
    planned = cut(_planned(spark, sf, counted))
    return planned, mixing.select_documents(counted, planned)


def p8_mix(spark: SparkSession, sf: str) -> DataFrame:
    """The documents of every mix, with their number of copies."""
    return _mixed(spark, sf)[1]


def p8_report(spark: SparkSession, sf: str) -> DataFrame:
    """Shares wanted and reached of every mix and source."""
    return mixing.mix_report(*_mixed(spark, sf))


def p8_languages(spark: SparkSession, sf: str) -> DataFrame:
    """Budgets of the languages within the sources of every mix: by weight alone, and after shortages were passed on."""
    return _mixed(spark, sf)[0].groupBy("mix_id", "source_label", "lang").agg(
        F.sum("tokens").alias("tokens"), F.sum("entitled").alias("entitled_tokens"), F.sum("leaf_budget").alias("planned_tokens"))


def _sentences(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return sentences.split_sentences(docs, sentences.fit(docs))


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    """End of every sentence."""
    return _sentences(spark, sf).select("doc_id", "end_char")


def p9_lengths(spark: SparkSession, sf: str) -> DataFrame:
    """Sentences per document and their longest and mean length in characters."""
    return _sentences(spark, sf).groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("sentences"), F.max(F.length("sentence")).alias("longest"), F.round(F.avg(F.length("sentence")), 6).alias("mean_chars"))


QUERIES = {f.__name__: f for f in (p7_found, p7_leaked_items, p7_recall, p8_found, p8_mix, p8_report, p8_languages, p9_found, p9_lengths)}
# sizes in characters: no case of this query depends on the tokenizer
ORACLE = {"p8_found": r"""
with d as (select nullif(regexp_replace(lower(source), '[\s_-]', '', 'g'), '') as k, length(text) as n from documents),
t as (select k, sum(n) as n from d where k is not null group by 1),
m as (select *, nullif(regexp_replace(lower(source_label), '[\s_-]', '', 'g'), '') as k, weight / sum(weight) over (partition by mix_id) as share from mix_targets)
select distinct mix_id, source_label from m left join t using (k) where coalesce(n, 0) * max_repeats < share * budget_ratio * (select sum(n) from t)"""}
