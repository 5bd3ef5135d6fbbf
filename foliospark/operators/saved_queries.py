"""Saved queries: a JSON object to a checked set of filter values, and those to a document filter."""
from __future__ import annotations

import json
from collections.abc import Callable
from datetime import date
from decimal import Decimal
from typing import Any
from uuid import UUID

from foliospark.operators.filters import Filters


class BadSavedQuery(ValueError):
    pass


def _string(x: Any) -> str:
    if not isinstance(x, str):
        raise TypeError
    return x.strip()


def _boolean(x: Any) -> bool:
    if not isinstance(x, bool):
        raise TypeError
    return x


def _number(x: Any) -> Decimal:
    if isinstance(x, bool):
        raise TypeError
    return Decimal(str(x))


def _day(x: Any) -> date:
    return date.fromisoformat(_string(x))


#: kind: (parser of one value, whether many are allowed)
KINDS: dict[str, tuple[Callable[[Any], Any], bool]] = {"texts": (_string, True), "uuids": (lambda x: UUID(str(x)), True), "flag": (_boolean, False), "day": (_day, False), "number": (_number, False)}

# The accepted keys of each field, old and new spellings together.
FIELDS = {
    "families": ("texts", "families", "document_family"),
    "folder_ids": ("uuids", "folderIds", "folder_ids"),
    "tags": ("texts", "tags", "tag_names"),
    "review_statuses": ("texts", "reviewStatuses", "review_status"),
    "reviewed_only": ("flag", "reviewedOnly", "reviewed_only"),
    "date_from": ("day", "dateFrom"),
    "date_to": ("day", "dateTo"),
    "amount_min": ("number", "amountMin"),
    "amount_max": ("number", "amountMax"),
    "sensitivity": ("texts", "sensitivity"),
    "relationship_types": ("texts", "relationshipTypes", "relationship_types"),
    "relationship_statuses": ("texts", "relationshipStatuses", "relationship_status"),
    "has_relationships": ("flag", "hasRelationships"),
    "deadline_types": ("texts", "deadlineTypes", "deadline_type"),
    "deadline_statuses": ("texts", "deadlineStatuses", "deadline_status"),
    "has_open_deadlines": ("flag", "hasOpenDeadlines", "open_deadlines"),
    "primary_folder_only": ("flag", "primaryFolderOnly", "primary_folder_only"),
    "open_review_tasks": ("flag", "open_review_tasks"),
}


def parse(text: str | dict | None) -> dict[str, Any]:
    """Field values of a saved query.  Lists keep the first spelling of what is equal in folded case."""
    given = json.loads(text) if isinstance(text, str) else text or {}
    if not isinstance(given, dict):
        raise BadSavedQuery("a saved query is a JSON object")
    owner = {k: f for f, (_, *keys) in FIELDS.items() for k in keys}
    for k in sorted(given.keys() - owner.keys()):
        raise BadSavedQuery(f"no such key: {k}")
    out: dict[str, Any] = {}
    for field, (kind, *keys) in FIELDS.items():
        one, many = KINDS[kind]
        found: dict[Any, Any] = {}
        for k in keys:
            if k not in given or given[k] is None and kind != "flag" or found and not many:
                continue
            values = given[k] if isinstance(given[k], list) and many else [given[k]]
            if many and not isinstance(given[k], list | str):
                raise BadSavedQuery(f"{k} is a string or a list")
            for v in values:
                try:
                    x = one(v)
                except (TypeError, ValueError, ArithmeticError):
                    raise BadSavedQuery(f"{k} holds a wrong value") from None
                if x != "":
                    found.setdefault(x.casefold() if isinstance(x, str) else x, x)
        out[field] = tuple(found.values()) if many else next(iter(found.values()), False if field in ("primary_folder_only", "open_review_tasks") else None)
    if out.pop("open_review_tasks") and "needs_review" not in map(str.casefold, out["review_statuses"]):
        out["review_statuses"] += ("needs_review",)
    return out


def to_filters(values: dict[str, Any]) -> Filters:
    """The filter of a saved query; folders are given by their ids, amounts stay decimals."""
    day = lambda x: str(x) if x else None
    return Filters(
        families=values["families"], folders=tuple(map(str, values["folder_ids"])), sensitivities=values["sensitivity"], review_statuses=values["review_statuses"], reviewed_only=values["reviewed_only"], date_from=day(values["date_from"]), date_to=day(values["date_to"]),
        tags=values["tags"], amount_min=values["amount_min"], amount_max=values["amount_max"], relationship_types=values["relationship_types"], relationship_statuses=values["relationship_statuses"], has_relationships=values["has_relationships"],
        deadline_types=values["deadline_types"], deadline_statuses=values["deadline_statuses"], has_open_deadlines=values["has_open_deadlines"], primary_folder_only=values["primary_folder_only"],
    )


def applied(values: dict[str, Any]) -> int:
    """How many filters a saved query sets."""
    return sum(v not in ((), None, False) for v in values.values())
