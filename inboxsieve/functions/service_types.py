"""The service-type dimension (5 rows, definition order significant) and the
normalised lookup key used to resolve free text to a service type."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Service types in definition order (id, label, description).
# ---------------------------------------------------------------------------
SERVICE_TYPES = [
    {
        "id": "stumpGrinding",
        "label": "Stump grinding",
        "description": "Grinding an existing stump down below grade while leaving the roots in place.",
    },
    {
        "id": "stumpRemoval",
        "label": "Stump removal",
        "description": "Removing or extracting the stump from the ground, usually including the root ball.",
    },
    {
        "id": "rootRemoval",
        "label": "Root removal",
        "description": "Removing exposed, invasive, or leftover tree roots without necessarily removing a stump.",
    },
    {
        "id": "treePruning",
        "label": "Tree pruning",
        "description": "Trimming, pruning, or cutting limbs/branches on a standing tree.",
    },
    {
        "id": "unknown",
        "label": "Unknown or not listed",
        "description": "Use when the requested service is unclear or does not match any listed service type.",
    },
]
UNKNOWN_ID = "unknown"
# ---------------------------------------------------------------------------

SERVICE_IDS = [t["id"] for t in SERVICE_TYPES]


def service_ids(service_types: list[dict] | None = None) -> list[str]:
    """The ids an answer may name, in definition order."""
    return [t["id"] for t in service_types or SERVICE_TYPES]


def normalise_key_py(value: str) -> str:
    """Driver-side twin of :func:`normalise_key` for building the lookup map."""
    return "".join(ch for ch in value.lower() if ch.isascii() and ch.isalnum())


def normalise_key(col: Column) -> Column:
    """Lower-case, then drop every character outside ``[a-z0-9]``."""
    return F.regexp_replace(F.lower(col), "[^a-z0-9]", "")


def lookup_entries(service_types: list[dict] | None = None) -> list[tuple[str, int]]:
    """(normalised key, definition ordinal) for every id and label; on a
    collision the type defined first wins."""
    types = service_types or SERVICE_TYPES
    seen: dict[str, int] = {}
    for ordinal, t in enumerate(types):
        for raw in (t["id"], t["label"]):
            key = normalise_key_py(raw)
            seen.setdefault(key, ordinal)
    return sorted(seen.items(), key=lambda kv: kv[1])


def service_type_struct(ordinal_col: Column, service_types: list[dict] | None = None) -> Column:
    """``struct(id, label, description)`` for a definition ordinal (NULL stays NULL)."""
    types = service_types or SERVICE_TYPES
    arr = F.array(*[
        F.struct(F.lit(t["id"]).alias("id"), F.lit(t["label"]).alias("label"),
                 F.lit(t["description"]).alias("description"))
        for t in types
    ])
    return F.when(ordinal_col.isNotNull(), F.element_at(arr, ordinal_col + 1))


def prompt_json(service_types: list[dict] | None = None) -> str:
    """The service list as pretty JSON (2-space indent), rendered once on the driver."""
    types = service_types or SERVICE_TYPES
    rows = [{"id": t["id"], "label": t["label"], "description": t["description"]} for t in types]
    return json.dumps(rows, indent=2, ensure_ascii=False)
