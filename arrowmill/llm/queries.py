"""The registered queries of this package and their SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontaminate, dedup, html_text, lang_id, licenses, mixing, quality, sharding, toxicity
from .common import table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base limits and verdict of every document, a row each; a null text has no words and fails. Cutoffs come from `labels` by language."""
    return quality.assess(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and benchmark item that it holds, with the best window's first word and similarity; documents without any have no row, nor have those without an id."""
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and prediction of every document; null and empty texts get the score of a text without a matched clause. Labels of the held-out fifth are never seen."""
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_chat_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The canonical turns of all conversations; a row gives one turn or, where its lines change roles, several (`part`). Roles are learned outside the held-out fifth."""
    return chat.format_chats(table(spark, sf_dir, "conversations"))


def op5_minhash_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size, component and verdict of every document; texts without words, and null ids, are linked with nothing and kept."""
    return dedup.classes(table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language and cosine of every document; `und` and 0 for a null text or one without letters."""
    return lang_id.identify(table(spark, sf_dir, "documents"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base places and labels of every document, with the method's labels and score; a null text is an empty one."""
    return licenses.scan(table(spark, sf_dir, "documents"))


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size, target of its source and words taken of every document; a null text has size 0 and takes 0, a null source is a source."""
    return mixing.mix(table(spark, sf_dir, "documents"))


def op9_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document under the law `bytes`; a null text weighs 16 bytes."""
    return sharding.shard(table(spark, sf_dir, "documents"))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page; null and empty html, and pages without text, give an empty string."""
    return html_text.extract(table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_quality_rules, op2_benchmark_leaks, op3_toxicity, op4_chat_turns, op5_minhash_classes, op6_language_id, op7_license_scan, op8_source_mix, op9_kd_shards, op10_html_text)}

ORACLES: dict[str, str] = {"op1_quality_rules": quality.SQL, "op8_source_mix": mixing.SQL}
