"""Scores, bands, labels and verdicts as Spark columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tightness(mad: Column, scale: float = 50.0) -> Column:
    return 1 / (1 + mad / scale)


def length_consistency(mad: Column, median: Column) -> Column:
    return F.when(median == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), 1 - mad / median))


def breadth(n: Column, reference: float, floor: float) -> Column:
    """Logarithmic share of a reference size, from ``floor`` to 1."""
    return F.lit(floor) + F.lit(1 - floor) * F.least(F.lit(1.0), F.log10(F.greatest(n, F.lit(1))) / F.log10(F.lit(float(reference))))


def test_strength(passed: Column, partial: Column, n: Column, full: int = 6) -> Column:
    return F.when(passed, 1.0).when(partial, 0.35).otherwise(0.0) * F.least(F.lit(1.0), n / full)


def tier(tested: Column, strong: Column) -> Column:
    """A and B: tested, by strength of the signal; D and C: not tested."""
    return F.when(tested, F.when(strong, "A").otherwise("B")).otherwise(F.when(strong, "D").otherwise("C"))


def safe_int(x: Column, default: int) -> Column:
    return F.coalesce(x.try_cast("int"), F.lit(default))


def safe_double(x: Column, default: float) -> Column:
    return F.coalesce(x.try_cast("double"), F.lit(default))


def band(x: Column, edges: Sequence[float], names: Sequence) -> Column:
    """The name of the first edge above ``x``; the last name beyond all edges."""
    out = F.when(x < edges[0], names[0])
    for edge, name in zip(edges[1:], names[1:], strict=False):
        out = out.when(x < edge, name)
    return out.otherwise(names[-1])


def power_band(expected: Column, missing: Column, low: float, adequate: float) -> Column:
    return F.when(missing, "unknown").when(expected == 0, "none_no_variation").when(expected < low, "none").when(expected < adequate, "low").otherwise("adequate")


def covariation_verdict(expected: Column, true_positives: Column, ppv: Column) -> Column:
    """Supported needs expected and found pairs of 3 or more and a precision of 0.80."""
    supported = (expected >= 3) & (true_positives >= 3) & (ppv >= 0.8)
    return F.when((true_positives == 0) & (expected < 1), "no_signal").when(supported, "supported").when(expected < 3, "underpowered").when(true_positives >= 1, "borderline").otherwise("failed")


def relabelled(old: Column, expected: Column) -> Column:
    """A failure without power is no failure."""
    return F.when((old == "failed") & (expected < 3), "underpowered").otherwise(old)


def lane(tags: Column, lanes: Sequence[tuple[str, Sequence[str]]]) -> Column:
    """The first lane one of whose tags is present."""
    out = None
    for name, words in lanes:
        hit = F.arrays_overlap(tags, F.array(*[F.lit(w) for w in words]))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("unknown")


def matched_labels(tags: Column, words: Sequence[str]) -> Column:
    return F.array_join(F.array_sort(F.array_intersect(tags, F.array(*[F.lit(w) for w in words]))), "+")


def single_family(rows: DataFrame, key: str, word: str, vocabulary: dict[str, str]) -> DataFrame:
    """Keys whose words name exactly one family of a fixed vocabulary; a vocabulary has a few hundred words at most."""
    pairs = [x for kv in sorted(vocabulary.items()) for x in map(F.lit, kv)]
    named = rows.withColumn("_family", F.create_map(*pairs)[F.col(word)]).where("_family is not null")
    return named.groupBy(key).agg(F.min("_family").alias("family"), F.max("_family").alias("_last")).where("family = _last").select(key, "family")


def file_name(x: Column) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(x, "^[a-z]+://", ""), "[^A-Za-z0-9._-]+", "_"), 1, 80)


def safe_name(x: Column) -> Column:
    return F.substring(F.regexp_replace(x, "[^A-Za-z0-9._-]", "_"), 1, 80)


def anchor_id(contig: Column, start: Column, end: Column, strand: Column) -> Column:
    return F.concat(contig.cast("string"), F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string"), F.lit(":"), F.when(strand < 0, "-").otherwise("+"))


def parse_anchor_id(x: Column) -> Column:
    pattern = "^(.*):([0-9]+)-([0-9]+):([+-])$"
    get = lambda i: F.regexp_extract(x, pattern, i)
    return F.struct(get(1).alias("contig"), get(2).cast("long").alias("start_pos"), get(3).cast("long").alias("end_pos"), get(4).alias("strand"))


def slug(header: Column) -> Column:
    words = F.split(F.lower(header), " ")
    return F.when(F.size(words) >= 2, F.concat(F.element_at(words, 1), F.lit("_"), F.element_at(words, 2))).otherwise(F.lower(header))


def resolve_label(first: Column, second: Column, missing: Sequence[str]) -> Column:
    """The first label unless it stands for missing, else the second, else ``unknown``."""
    return F.coalesce(F.when(~first.isin(list(missing)), first), F.nullif(second, F.lit("")), F.lit("unknown"))


def style(x: Column, styles: Sequence[tuple[str, str]]) -> Column:
    out = F.when(x.rlike(styles[0][1]), styles[0][0])
    for name, pattern in styles[1:]:
        out = out.when(x.rlike(pattern), name)
    return out.otherwise("other")


def decoy_mode(clade: Column) -> Column:
    return F.when(clade.startswith("DECOY_"), F.regexp_extract(clade, "^DECOY_([^_]+)__", 1)).otherwise("real")


def decoy_bag(clade: Column) -> Column:
    return F.when(clade.startswith("DECOY_"), F.regexp_extract(clade, "__(.*)__rep[0-9]+$", 1)).otherwise(clade)


def reasons(rules: Sequence[tuple[str, Column]], separator: str = "; ") -> Column:
    """Texts of all rules that hold, joined; empty if none does."""
    return F.concat_ws(separator, *[F.when(rule, F.lit(text)) for text, rule in rules])


def first_reason(rules: Sequence[tuple[str, Column]]) -> Column:
    """The first rule that holds; null if none does."""
    out = F.when(rules[0][1], rules[0][0])
    for text, rule in rules[1:]:
        out = out.when(rule, text)
    return out
