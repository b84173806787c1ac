"""Queries of subscription detection and its reports over the derived bank rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rebill.functions import text
from rebill.operators import detect, merge, report
from rebill.sources.statements import AS_OF, bank_rows

GROUP = detect.GROUP


def _keys(s: SparkSession, d: str) -> DataFrame:
    return merge.final_keys(_vocab(s, d))


def _fine(s: SparkSession, d: str) -> DataFrame:
    """Items of the groups that pass the filters."""
    keys = _keys(s, d)
    return merge.with_keys(detect.counted(bank_rows(s, d)), keys.join(detect.verdicts(keys).where("rejected IS NULL").select(*GROUP), GROUP, "left_semi"))


def _vocab(s: SparkSession, d: str) -> DataFrame:
    return merge.vocabulary(detect.counted(bank_rows(s, d)))


def _subs(s: SparkSession, d: str) -> DataFrame:
    return detect.detect_subscriptions(bank_rows(s, d), AS_OF)


def merchant_text(s: SparkSession, d: str) -> DataFrame:
    names = bank_rows(s, d).select("description").distinct()
    return names.select(
        "description", text.translit("description").alias("latin"), text.normalize_description("description").alias("norm"),
        text.canonical_brand("description")["name"].alias("brand"), text.clean_merchant("description")["name"].alias("cleaned"))


def glued(s: SparkSession, d: str) -> DataFrame:
    led = merge.fuzzy_leader_merge(_vocab(s, d)).withColumn("brand", merge.glue_to_brand("leader"))
    return led.where("brand IS NOT NULL").select("account_id", "key", "leader", "brand")


QUERIES = {
    "drop_micro": lambda s, d: detect.drop_micro(bank_rows(s, d)),
    "charge_gaps": lambda s, d: detect.charge_gaps(_fine(s, d)),
    "newest_charge": lambda s, d: detect.newest_charge(_fine(s, d)),
    "cadence": lambda s, d: detect.cadence(detect.stable_charges(_fine(s, d))).select(*GROUP, "charges", "last_charge", "period", "months"),
    "bank_rows": bank_rows,
    "merchant_text": merchant_text,
    "group_key": lambda s, d: _vocab(s, d).select("account_id", "description", "kind", "key"),
    "fuzzy_leader_merge": lambda s, d: merge.fuzzy_leader_merge(_vocab(s, d)),
    "glue_to_brand": glued,
    "group_items": lambda s, d: detect.items(bank_rows(s, d)),
    "group_sample": lambda s, d: detect.group_sample(_keys(s, d)),
    "reject_groups": lambda s, d: detect.verdicts(_keys(s, d)),
    "price_clusters": lambda s, d: detect.price_clusters(_fine(s, d)),
    "stable_charges": lambda s, d: detect.stable_charges(_fine(s, d)).select(*GROUP, "row_no", "date", "amount", "main", "cluster", "price", "gap"),
    "price_change": lambda s, d: detect.price_change(_fine(s, d)),
    "subscriptions": lambda s, d: _subs(s, d).withColumn("merchants", F.array_join("merchants", "|")),
    "totals": lambda s, d: report.totals(_subs(s, d)),
    "duplicates": lambda s, d: report.duplicates(_subs(s, d)),
    "growth": lambda s, d: report.growth(_subs(s, d)),
    "monthly_from_txs": lambda s, d: report.monthly_from_txs(bank_rows(s, d), _subs(s, d), AS_OF),
    "monthly_model": lambda s, d: report.monthly_model(_subs(s, d), AS_OF),
    "upcoming": lambda s, d: report.upcoming(_subs(s, d)),
    "enrich_links": lambda s, d: report.enrich_links(_subs(s, d)).select("account_id", "rank", "name", "cancel_url", "included_in"),
}
