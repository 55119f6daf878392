"""Identifier, label and rule-matching column expressions. All JVM-side."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from marketloom import spec


def market_from_flag(flag: Column) -> Column:
    """Exchange of a numeric flag; unknown flags pass through."""
    f = F.trim(flag)
    return F.when(f == "0", "sz").when(f == "1", "sh").when(f == "2", "bj").otherwise(f)


def starts_with_any(text: Column, prefixes: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [text.startswith(p) for p in prefixes])


def market_from_prefix(symbol: Column, table: str = "default") -> Column:
    out: Column | None = None
    for market, prefixes in spec.MARKET_PREFIXES[table]:
        if prefixes is None:
            return out.otherwise(F.lit(market)) if out is not None else F.lit(market)
        hit = starts_with_any(symbol, prefixes)
        out = F.when(hit, market) if out is None else out.when(hit, market)
    return out


def is_a_share_eligible(symbol: Column, name: Column) -> Column:
    nm = F.coalesce(name, F.lit(""))
    return (
        (F.length(symbol) == 6)
        & starts_with_any(symbol, ("6", "00", "30", "92"))
        & ~starts_with_any(symbol, ("999", "399", "8", "4"))
        & ~nm.contains("ST")
        & ~nm.startswith("S ")
        & (nm != "S")
    )


def canonical_code(raw: Column, width: int = 6) -> Column:
    """Drop exchange prefixes and restore the leading zeros a numeric code has lost."""
    bare = F.regexp_replace(F.lower(F.trim(raw)), "(sh|sz|bj):", "")
    return F.when(F.length(bare) < width, F.lpad(bare, width, "0")).otherwise(bare)


def key_of(market: Column, symbol: Column) -> Column:
    return F.concat_ws(":", market, symbol)


def key_market(key: Column) -> Column:
    return F.lower(F.trim(F.split_part(key, F.lit(":"), F.lit(1))))


def key_symbol(key: Column) -> Column:
    return F.trim(F.split_part(key, F.lit(":"), F.lit(2)))


def normalize_text(value: Column) -> Column:
    return F.trim(F.coalesce(value, F.lit("")))


def normalize_query(value: Column) -> Column:
    return F.lower(F.trim(value))


def blank_to_null(value: Column) -> Column:
    return F.nullif(F.trim(value), F.lit(""))


# Unicode white space as one explicit class, so every regex engine agrees on it.
WHITE_SPACE = r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def normalize_concept(name: Column) -> Column:
    return F.trim(F.regexp_replace(name, WHITE_SPACE, " "))


def split_concepts(raw: Column) -> Column:
    """Ordered distinct concept names of one raw list."""
    parts = F.transform(F.split(raw, "[,，]"), normalize_concept)
    return F.array_distinct(F.filter(parts, lambda x: x != ""))


def concept_id(name: Column, source: str = spec.CONCEPT_ID_SOURCE) -> Column:
    return F.sha1(F.concat(F.lit(source + ":"), name))


def industry_code_level(code: Column, level: int) -> Column:
    need, take = {1: (3, 3), 2: (5, 5), 3: (7, None)}[level]
    part = code if take is None else F.substring(code, 1, take)
    return F.when(F.length(code) >= need, part).otherwise(F.lit(""))


def industry_display(*levels: Column) -> Column:
    return F.concat_ws(" / ", *[blank_to_null(c) for c in levels])


def rule_matches(name: Column, match_type: str, patterns: tuple[str, ...]) -> Column:
    if match_type == "exact":
        return name.isin(*patterns)
    if match_type == "contains":
        return reduce(lambda a, b: a | b, [name.contains(p) for p in patterns])
    return reduce(lambda a, b: a | b, [name.rlike(p) for p in patterns])


def concept_rule(name: Column, rules=spec.CONCEPT_RULES, default=spec.CONCEPT_DEFAULT) -> Column:
    """First matching rule by priority as struct(rule_id, bucket, decision).

    The rule table is a fixed dozen rows, so it is folded into one CASE instead of a join.
    """
    out: Column | None = None
    for rule_id, _priority, bucket, match_type, patterns in sorted(rules, key=lambda r: r[1]):
        row = F.struct(F.lit(rule_id).alias("rule_id"), F.lit(bucket).alias("bucket"), F.lit(spec.HIDE).alias("decision"))
        hit = rule_matches(name, match_type, patterns)
        out = F.when(hit, row) if out is None else out.when(hit, row)
    fallback = F.struct(F.lit(default[0]).alias("rule_id"), F.lit(default[1]).alias("bucket"), F.lit(default[2]).alias("decision"))
    return out.otherwise(fallback) if out is not None else fallback


def keyword_tags(text: Column, table=spec.INDUSTRY_TAGS) -> Column:
    """All tags whose word list hits the text."""
    hits = [F.when(reduce(lambda a, b: a | b, [text.contains(w) for w in words]), F.lit(tag)) for tag, words in table]
    return F.filter(F.array(*hits), lambda x: x.isNotNull())


def match_tier(symbol: Column, name: Column, initials: Column, query: Column) -> Column:
    """0 = exact symbol ... 5 = name contains; NULL = no match."""
    q, nm = normalize_query(query), F.lower(name)
    return (
        F.when(q == "", None)
        .when(symbol == q, 0)
        .when(symbol.startswith(q), 1)
        .when(initials == q, 2)
        .when(initials.startswith(q), 3)
        .when(nm == q, 4)
        .when(nm.contains(q), 5)
    )


def class_label(classification: Column, sub: Column) -> Column:
    high_risk = F.upper(F.coalesce(sub, F.lit(""))).isin("C3", "C4", "C3_NO_REVENUE_CONCEPT", "C4_LIQUIDATION_RISK")
    return (
        F.when(classification == "A_NORMAL_EARNING", spec.CLASS_LABELS["A_NORMAL_EARNING"])
        .when(classification == "B_THIN_PROFIT_DISTORTED", spec.CLASS_LABELS["B_THIN_PROFIT_DISTORTED"])
        .when((classification == "C_LOSS") & high_risk, spec.CLASS_LABELS["D"])
        .when(classification == "C_LOSS", spec.CLASS_LABELS["C_LOSS"])
        .otherwise(classification)
    )
