"""Validation rules as Catalyst predicates: each is true exactly where a row breaks the rule.

None of them manufactures a value: null stays null (unknown), and a malformed value is reported, never
turned into null silently.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The provenance labels and the schema version of the configuration format.
PROVENANCE = ("observed", "derived", "scenario_based")
SCHEMA_VERSION = "1.0"


def version_broken(col: Column, expected: str = SCHEMA_VERSION) -> Column:
    """Null or any other text than the expected version."""
    return ~col.eqNullSafe(F.lit(expected))


def enum_broken(col: Column, allowed: Sequence[str] = PROVENANCE, required: bool = False) -> Column:
    """Outside the allowed labels (case-sensitive); null breaks the rule only where the field is required."""
    outside = col.isNotNull() & ~F.coalesce(col.isin(*allowed), F.lit(False))
    return (outside | col.isNull()) if required else outside


def cast_broken(raw: Column, type_name: str) -> Column:
    """A raw value is there but does not parse as the type; a null raw value is unknown, not broken."""
    return raw.isNotNull() & raw.try_cast(type_name).isNull()


def violations(df: DataFrame, key: Column, rules: dict[str, tuple[Column, Column, str]]) -> DataFrame:
    """One row (key, rule, found, expected) per broken rule, from a single scan of ``df``.

    ``rules`` maps a rule's name to (broken predicate, found column, text of what was expected).
    """
    found = F.array(
        *[
            F.when(
                broken,
                F.struct(F.lit(name).alias("rule"), value.cast("string").alias("found"), F.lit(expected).alias("expected")),
            )
            for name, (broken, value, expected) in rules.items()
        ]
    )
    return df.select(key.alias("key"), F.explode(F.filter(found, lambda v: v.isNotNull())).alias("v")).select("key", "v.*")
