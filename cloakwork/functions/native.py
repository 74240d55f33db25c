"""Detection and single-rule rewriting in Spark's own functions: no Python in the plan."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.storage import spread
from . import grammar as g
from .dialect import group_number, to_java

_edge = re.compile(r"\(\?:\^\|\[\^([^\]\\]+)\]\)").match
SIMPLE_TEMPLATES = {k: v for k, v in g.TEMPLATES.items() if "mask" not in v}


def matches(text: Column, rule: str, patterns: dict[str, str] | None = None) -> Column:
    """All matches of a rule's pattern (of `patterns`, if it has one) in order: the value that the rule stands for."""
    pattern = (patterns or {}).get(rule, g.PATTERNS[rule])
    group = group_number(pattern, "value") if "(?P<value>" in pattern else 0
    java = to_java(pattern)
    if group and (edge := _edge(pattern)):  # looks back at the edge instead; \G: an edge that the last match took isn't free. Java is several times faster so
        java = to_java(rf"(?:^|(?!\G)(?<![{edge[1]}]))" + pattern[edge.end() :])
    found = F.regexp_extract_all(text, F.lit(java), F.lit(group))
    gates = g.GATES.get(rule)
    if gates:  # a cheap test of a substring spares the regex on most texts
        lower = F.lower(text)
        found = F.when(reduce(lambda a, b: a | b, [F.contains(lower, F.lit(x)) for x in gates]), found).otherwise(F.array().cast("array<string>"))
    return F.filter(found, valid_of(rule)) if rule in VALID else found


def is_token(value: Column) -> Column:
    return value.rlike(to_java(rf"^{g.TYPED_TOKEN}\Z"))


def luhn_valid(value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    return (F.length(digits) >= 13) & F.call_function("luhn_check", digits)


def plain_ipv4(value: Column) -> Column:
    special = reduce(lambda a, b: a | b, [F.startswith(value, F.lit(p)) for p in g.SKIP_IPV4_PREFIXES])
    return ~(value.isin(*sorted(g.SKIP_IPV4)) | special)


def real_account(value: Column) -> Column:
    domain = F.upper(F.substring_index(value, "\\", 1))
    user = F.upper(F.substring_index(F.substring_index(value, "\\", -1), ":", 1))
    starts = reduce(lambda a, b: a | b, [F.startswith(domain, F.lit(p)) for p in g.SKIP_DOMAIN_STARTS])
    return ~(domain.isin(*sorted(g.SKIP_DOMAINS)) | user.isin(*sorted(g.SKIP_USERS)) | starts)


VALID = {"credit_card": luhn_valid, "ipv4": plain_ipv4, "ad_domain_user": real_account, "context_secret": lambda v: ~F.lower(v).isin(*sorted(g.SAFE_LITERALS)) & (v != "")}


def valid_of(rule: str):
    return lambda v: VALID[rule](v) & ~is_token(v)


def identity_key(value: Column, rule: str) -> Column:
    """What two spellings of one identity share."""
    if rule == "mac":
        return F.lower(F.regexp_replace(value, "[:.-]", ""))
    return F.lower(value) if rule in ("hostname_internal", *g.SHORT_HOST_RULES) else value


def detections(docs: DataFrame, rules: list[str], *, id_col: str = "doc_id", text_col: str = "text", patterns: dict[str, str] | None = None) -> DataFrame:
    """A row per match of each rule on the original text: id, rule, pos (from 0 within the rule), value, map_key. No shuffle."""
    each = F.array(*[F.struct(F.lit(r).alias("rule"), matches(F.col(text_col), r, patterns).alias("values")) for r in rules])
    found = spread(docs.select(id_col, text_col)).select(F.col(id_col), F.explode(each).alias("d")).filter(F.size("d.values") > 0)
    rows = found.select(id_col, F.col("d.rule").alias("rule"), F.posexplode("d.values").alias("pos", "value"))
    key = reduce(lambda c, r: c.when(F.col("rule") == r, identity_key(F.col("value"), r)), rules[1:], F.when(F.col("rule") == rules[0], identity_key(F.col("value"), rules[0])))
    return rows.withColumn("map_key", key)


def rewrite(text: Column, rule: str, category: str, prefix: str, width: int, suffix: str = "") -> Column:
    """One whole-match rule on its own: texts split and zipped with tokens, numbered by first appearance in the text."""
    pattern = to_java(g.PATTERNS[rule])
    hit = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    seg = F.split(text, pattern, -1)
    good = (lambda v: valid_of(rule)(v)) if rule in VALID else (lambda v: ~is_token(v))
    keys = F.array_distinct(F.transform(F.filter(hit, good), lambda v: identity_key(v, rule)))

    def shown(v: Column) -> Column:
        n = F.array_position(keys, identity_key(v, rule))
        return F.when(good(v), F.concat(F.lit(prefix), F.lpad(n.cast("string"), width, "0"), F.lit(suffix))).otherwise(v)

    whole = F.concat(F.element_at(seg, 1), F.array_join(F.zip_with(F.transform(hit, shown), F.slice(seg, 2, F.greatest(F.size(seg), F.lit(1))), lambda a, b: F.concat(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit("")))), ""))
    return F.when(F.size(hit) > 0, whole).otherwise(text)
