"""O11 resolve_service_type: free text -> service type, first match in
definition order on a normalised id-or-label key.

The dimension is a fixed handful of rows, so the lookup is a literal map
inside the projection (constant-folded, inside whole-stage codegen) rather
than a join: nothing is shuffled or broadcast, whatever the data size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.service_types import lookup_entries, normalise_key, service_type_struct


def service_ordinal(col: Column, service_types: list[dict] | None = None) -> Column:
    """Definition ordinal of the type whose id or label matches ``col``."""
    entries = lookup_entries(service_types)
    lookup = F.create_map(*[x for key, ordinal in entries for x in (F.lit(key), F.lit(ordinal))])
    return F.try_element_at(lookup, normalise_key(col))


def resolve_service_type_col(col: Column, service_types: list[dict] | None = None) -> Column:
    """``struct(id, label, description)`` or NULL when nothing matches."""
    return service_type_struct(service_ordinal(col, service_types), service_types)


def resolve_service_type(df: DataFrame, col: str, out: str = "service_type",
                         service_types: list[dict] | None = None) -> DataFrame:
    """Add ``out`` = the matched service type (NULL = unmatched)."""
    return df.withColumn(out, resolve_service_type_col(F.col(col), service_types))
