"""Which market a domestically listed holding is really exposed to."""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

EXPOSURES = ("domestic_direct", "overseas_direct", "overseas_indirect", "cash", "unknown")


class Keywords(NamedTuple):
    """Name fragments, matched anywhere in the name without regard to case. Fixed values."""

    etf_brands: tuple[str, ...] = (
        "KODEX", "TIGER", "ACE", "RISE", "TIME", "KoAct", "KOACT", "PLUS", "SOL", "HANARO", "KBSTAR",
        "ARIRANG", "WOORI",
    )
    overseas: tuple[str, ...] = (
        "미국", "나스닥", "S&P", "글로벌", "GLOBAL", "해외", "선진국", "신흥국", "중국", "일본", "인도", "베트남",
    )
    domestic: tuple[str, ...] = (
        "KOREA", "코리아", "코스피", "코스닥", "K수출", "K제조업", "제조업", "삼성전자", "SK하이닉스", "밸류업",
    )
    reit: tuple[str, ...] = ("REIT", "리츠", "부동산")


# Warning texts.
REIT_UNCLEAR = "REIT 상품의 투자지역이 모호합니다."
ETF_UNCLEAR = "ETF/REIT 해외노출 분류가 애매합니다."

_FIELDS = ("exposure_type", "exposure_region", "asset_subtype", "confidence", "source", "warning")

# Outcome of each rule below, by position.
_OUTCOMES = (
    ("overseas_indirect", "global", "etf", "high", "instrument_master", None),
    ("overseas_indirect", "global", "reit", "medium", "heuristic", None),
    ("domestic_direct", "kr", "reit", "medium", "heuristic", None),
    ("unknown", "kr", "reit", "low", "heuristic", REIT_UNCLEAR),
    ("overseas_indirect", "global", "etf", "medium", "heuristic", None),
    ("domestic_direct", "kr", "etf", "medium", "heuristic", None),
    ("unknown", None, "etf", "low", "heuristic", ETF_UNCLEAR),
    ("domestic_direct", "kr", "equity", "high", "default", None),
)


def contains_any(text: Column, words: tuple[str, ...]) -> Column:
    """Whether upper-cased `text` holds one of the words: one pass over the text for the whole list."""
    return F.rlike(text, F.lit("|".join(re.escape(word) for word in dict.fromkeys(w.upper() for w in words))))


def _outcome_array() -> Column:
    return F.array(*[
        F.struct(*[F.lit(value).cast("string").alias(name) for name, value in zip(_FIELDS, outcome)])
        for outcome in _OUTCOMES
    ])


def _rule_number(name: Column, group: Column, words: Keywords) -> Column:
    upper = F.upper(name)
    overseas = contains_any(upper, words.overseas)
    domestic = contains_any(upper, words.domestic)

    def by_hints(abroad: int, home: int, unclear: int) -> Column:
        # Nested so that each word list is searched once at most.
        return F.when(overseas, F.when(domestic, unclear).otherwise(abroad)).otherwise(
            F.when(domestic, home).otherwise(unclear)
        )

    fund = group.isin("E", "EF") | contains_any(upper, words.etf_brands + words.reit)
    return (
        F.when(group == "FE", 1)
        .when(group.isin("R", "RT"), by_hints(2, 3, 4))
        .when(fund, by_hints(5, 6, 7))
        .otherwise(8)
    )


def classify(name: Column, group_code: Column, override: Column | None = None,
             words: Keywords = Keywords()) -> Column:
    """Struct of exposure type and region, asset subtype, confidence, source and warning.

    `override` is a struct with `exposure_type`, `exposure_region` and `asset_subtype`, NULL where there is
    none; it wins over the master's group code, which wins over the name. An override outside the five
    exposures counts as unknown.
    """
    name = F.coalesce(F.trim(name), F.lit(""))
    group = F.coalesce(F.trim(group_code), F.lit(""))
    by_rule = F.element_at(_outcome_array(), _rule_number(name, group, words))
    if override is None:
        return by_rule
    known = F.when(override["exposure_type"].isin(*EXPOSURES), override["exposure_type"]).otherwise("unknown")
    by_hand = F.struct(
        known.alias("exposure_type"),
        override["exposure_region"].alias("exposure_region"),
        override["asset_subtype"].alias("asset_subtype"),
        F.lit("high").alias("confidence"),
        F.lit("override").alias("source"),
        F.lit(None).cast("string").alias("warning"),
    )
    return F.when(override.isNotNull(), by_hand).otherwise(by_rule)
