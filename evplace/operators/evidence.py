"""Evidence sets: union, variants, personas and domain predicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import category_key

# The topics of each target persona. Any other persona has none, so it counts as unknown.
PERSONA_DOMAINS = {
    "persona_1": ["technology"],
    "persona_2": ["business", "technology"],
    "persona_3": ["sports"],
}
PERSONA_ORDER = ["persona_1", "persona_2", "persona_3", "persona_4", "tbd"]
VARIANTS = ("memory_only", "document_only", "integrated")


def domains_of(persona: Column) -> Column:
    """The domains of a persona; null if it is unknown."""
    table = F.create_map(*[x for p, d in PERSONA_DOMAINS.items() for x in (F.lit(p), F.array(*[F.lit(v) for v in d]))])
    return table[persona]


def evidence_union(df: DataFrame, group: str, key: str, order: str) -> DataFrame:
    """Evidence of each group once per key: the first position, the last value. Null or blank keys are dropped."""
    rest = [c for c in df.columns if c not in (group, key, order)]
    kept = df.where(F.col(key).isNotNull() & (F.trim(F.col(key)) != ""))
    out = kept.groupBy(group, key).agg(F.min(order).alias("first_position"), F.max_by(F.struct(*rest), order).alias("r"))
    return out.select(group, key, "first_position", *[F.col(f"r.{c}").alias(c) for c in rest])


def evidence_for(first: Column, second: Column) -> Column:
    """The first set, or the second if the first is null or empty."""
    return F.when(F.size(F.coalesce(first, F.array())) > 0, first).otherwise(F.coalesce(second, F.array()))


def evidence_domains(*categories: Column) -> Column:
    """Sorted distinct categories of arrays of categories, without case, blanks and nulls."""
    every = F.concat(*[F.coalesce(c, F.expr("cast(array() as array<string>)")) for c in categories])
    return F.array_sort(F.array_distinct(F.array_compact(F.transform(every, category_key))))


def persona_for_domains(domains: Column) -> Column:
    """Persona by exact equality of the domain set; no domain is tbd, any other set is persona_4."""
    one = lambda *names: domains == F.array(*[F.lit(n) for n in names])
    return F.when(F.size(domains) == 0, "tbd").when(one("technology"), "persona_1").when(one("business", "technology"), "persona_2").when(one("sports"), "persona_3").otherwise("persona_4")


def is_in_domain(variant: Column, categories: Column, persona: Column) -> Column:
    """document_only is in domain; so are runs without categories; else the categories must be the persona's."""
    known = F.coalesce(domains_of(persona), F.expr("cast(array() as array<string>)"))
    return (variant == "document_only") | (F.size(categories) == 0) | (F.size(F.array_except(categories, known)) == 0)


def topical_relevance(categories: Column, persona: Column) -> Column:
    """in_domain (subset), out_of_domain (disjoint or either side empty) or partial."""
    known = F.coalesce(domains_of(persona), F.expr("cast(array() as array<string>)"))
    return (
        F.when((F.size(categories) == 0) | (F.size(known) == 0) | ~F.arrays_overlap(categories, known), "out_of_domain")
        .when(F.size(F.array_except(categories, known)) == 0, "in_domain")
        .otherwise("partial")
    )


def evidence_in_domain(category: Column, persona: Column) -> Column:
    """One piece of evidence: false without category or for an unknown persona."""
    return F.coalesce(F.array_contains(domains_of(persona), category_key(category)), F.lit(False))


def session_in_domain(category: Column, persona: Column) -> Column:
    """One session: true for an unknown persona, false without category."""
    return F.when(domains_of(persona).isNull(), True).otherwise(F.coalesce(F.array_contains(domains_of(persona), category_key(category)), F.lit(False)))


def is_off_topic(categories: Column, persona: Column) -> Column:
    """No overlap with the persona's domains; false for an unknown persona, true without categories."""
    return F.when(domains_of(persona).isNull(), False).otherwise(~F.coalesce(F.arrays_overlap(categories, domains_of(persona)), F.lit(False)))


def matches_wanted_domain(category: Column, persona: Column, want_in_domain: bool) -> Column:
    """Supplement candidates: inside or outside the persona's domains; no category matches only 'outside'."""
    key = category_key(category)
    inside = F.coalesce(F.array_contains(domains_of(persona), key), F.lit(False))
    return F.when(key.isNull(), F.lit(not want_in_domain)).otherwise(inside == F.lit(want_in_domain))


def persona_rank(persona: Column) -> Column:
    """Place in the fixed order of personas, unknown ones last."""
    at = F.array_position(F.array(*[F.lit(p) for p in PERSONA_ORDER]), persona)
    return F.when(F.coalesce(at, F.lit(0)) == 0, len(PERSONA_ORDER) + 1).otherwise(at)


def evidence_urls(df: DataFrame) -> DataFrame:
    """evidence_id to url, one row per id, with the number of urls seen (more than one is a conflict)."""
    ok = df.where((F.trim("evidence_id") != "") & (F.trim("url") != ""))
    return ok.groupBy("evidence_id").agg(F.min("url").alias("url"), F.count_distinct("url").alias("n_urls"))


def persona_domain_table(tagged: DataFrame) -> DataFrame:
    """persona to its pipe-joined domains, in the fixed order, empty personas included. ``tagged``: persona, domains."""
    spark = tagged.sparkSession
    every = spark.range(1).select(F.posexplode(F.array(*[F.lit(p) for p in PERSONA_ORDER])).alias("place", "persona"))
    seen = tagged.select("persona", F.explode("domains").alias("d")).distinct().groupBy("persona").agg(F.array_join(F.array_sort(F.collect_set("d")), "|").alias("domains"))
    return every.join(seen, "persona", "left").select("persona", "place", F.coalesce("domains", F.lit("")).alias("domains"))
