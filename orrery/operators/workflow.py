"""Workflows: parameters with placeholders, and webhook payloads as rows of work."""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NAME = re.compile(r"\{([a-zA-Z_][a-zA-Z0-9_.]*)\}")
GONE = object()


def _walk(path: str, context: Any) -> Any:
    """What a dotted path leads to; the empty string for a missing key, GONE where it goes on below something without keys."""
    for key in path.split("."):
        if not isinstance(context, dict):
            return GONE
        context = context.get(key, "")
    return context


def resolve(value: Any, context: dict[str, Any]) -> Any:
    """{a.b} in strings becomes what the context holds there: as it is where it is the whole string, else as text (nothing for
    None). Dictionaries resolve at every depth, lists item by item (strings only); paths that lead below a plain value stay."""
    if isinstance(value, dict):
        return {k: resolve(v, context) for k, v in value.items()}
    if isinstance(value, list):
        return [resolve(v, context) if isinstance(v, str) else v for v in value]
    if not isinstance(value, str):
        return value
    whole = NAME.fullmatch(value)
    if whole:
        found = _walk(whole[1], context)
        return value if found is GONE else found

    def text(m: re.Match) -> str:
        found = _walk(m[1], context)
        return m[0] if found is GONE else "" if found is None else str(found)

    return NAME.sub(text, value)


def webhooks(events: DataFrame, payload: str = "payload") -> DataFrame:
    """Rows with what their payload asks for: action `review` of a merge request that carries a message to look at, `none` of
    one that does not, `reindex` of a push; repo, title, source_branch, target_branch and diff (null where not given)."""
    get = lambda path: F.get_json_object(F.col(payload), path)
    mr, diff = get("$.object_attributes").isNotNull(), get("$.object_attributes.last_commit.message")
    action = F.when(mr & (F.coalesce(diff, F.lit("")) != ""), "review").when(mr, "none").otherwise("reindex")
    return events.select(
        *[c for c in events.columns if c != payload], action.alias("action"), F.coalesce(get("$.project.name"), F.lit("")).alias("repo"),
        get("$.object_attributes.title").alias("title"), get("$.object_attributes.source_branch").alias("source_branch"),
        get("$.object_attributes.target_branch").alias("target_branch"), F.when(mr, diff).alias("diff"),
    )
