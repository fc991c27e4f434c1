"""Predicates over JSON documents: equality, $in, $regex, $or; text search."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featherloom.operators.ordered import q
from featherloom.params import ParameterError


def document_predicate(query: dict, data: str = "data") -> Column:
    """``{"k": v}``, ``{"k": {"$in": [..]}}``, ``{"k": {"$regex": p}}``, ``{"$or": [..]}``; parts are AND-ed.

    A value matches a scalar field with that text or an array field containing it.
    """
    tests = []
    for key, value in query.items():
        if key == "$or":
            parts = [document_predicate(item, data) for item in value]
            if parts:
                tests.append(reduce(lambda a, b: a | b, parts))
            continue
        if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", key):
            raise ParameterError(f"unsafe field name {key!r}")
        text = F.get_json_object(q(data), f"$.{key}")
        items = F.from_json(text, "array<string>")
        if isinstance(value, dict) and "$in" in value:
            wanted = [_as_text(v) for v in value["$in"]]
            test = text.isin(wanted) | F.arrays_overlap(items, F.array(*[F.lit(w) for w in wanted]))
        elif isinstance(value, dict) and "$regex" in value:
            test = text.rlike("(?i)" + value["$regex"])
        elif isinstance(value, dict):
            raise ParameterError(f"unknown operators {sorted(value)}")
        else:
            test = (text == _as_text(value)) | F.array_contains(items, _as_text(value))
        tests.append(F.coalesce(test, F.lit(False)))
    return reduce(lambda a, b: a & b, tests) if tests else F.lit(True)


def _as_text(value) -> str:
    return str(value).lower() if isinstance(value, bool) else str(value)


def find_documents(df: DataFrame, query: dict, data: str = "data") -> DataFrame:
    return df.where(document_predicate(query, data))


def search_documents(df: DataFrame, text: str, title: str = "title", content: str = "content", tags: str = "tags", updated: str = "updated_at", limit: int | None = None) -> DataFrame:
    """Pattern in title or content (any case) or an exact tag; newest first."""
    pattern = "(?i)" + text
    test = q(title).rlike(pattern) | q(content).rlike(pattern) | F.array_contains(q(tags), text)
    found = df.where(F.coalesce(test, F.lit(False))).orderBy(F.desc(updated), q(title))
    return found if limit is None else found.limit(limit)


def documents_with_tag(df: DataFrame, tag: str, tags: str = "tags", updated: str = "updated_at") -> DataFrame:
    return df.where(F.array_contains(q(tags), tag)).orderBy(F.desc(updated))
