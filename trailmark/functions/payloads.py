"""JSON payloads of any shape, in Arrow batches: redaction, stable text, containment, steps."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable
from typing import Any

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Keys whose values are not kept.
SENSITIVE = {"api_key", "apikey", "authorization", "cookie", "password", "secret", "token"}
SENSITIVE_ENDS = ("_token", "_secret", "_password", "_key")
MASK = "[REDACTED]"


def decoded(text: str | None) -> Any:
    """The value of a JSON object or array; any other text stays text."""
    if not isinstance(text, str) or text.lstrip()[:1] not in ("{", "["):
        return text
    if text == "{}":
        return {}
    try:
        return json.loads(text)
    except ValueError:
        return text


def redacted(value: Any) -> Any:
    """The value without what its sensitive keys hold, at any depth."""
    if isinstance(value, dict):
        return {k: MASK if k.lower() in SENSITIVE or k.lower().endswith(SENSITIVE_ENDS) else redacted(v) for k, v in value.items()}
    if isinstance(value, list):
        return [redacted(v) for v in value]
    return value


def contains(actual: Any, wanted: Any) -> bool:
    """Whether a value has every key and value of another, at any depth."""
    if not isinstance(wanted, dict):
        return type(actual) is type(wanted) and actual == wanted or (actual == wanted and not isinstance(actual, bool) and not isinstance(wanted, bool))
    return isinstance(actual, dict) and all(k in actual and contains(actual[k], v) for k, v in wanted.items())


@F.pandas_udf(T.StringType())
def redact_json(payload: pd.Series) -> pd.Series:
    """Redacted payload; text that is no JSON container, or has nothing to redact, is returned as it is."""

    def one(text: str | None) -> str | None:
        value = decoded(text)
        if isinstance(value, str) or value is None:
            return text
        clean = redacted(value)
        return text if clean == value else json.dumps(clean, ensure_ascii=False)

    return payload.map(one, na_action="ignore")


@F.pandas_udf(T.StringType())
def stable_json(payload: pd.Series) -> pd.Series:
    """JSON containers with sorted keys and spaced separators; other text as it is."""

    def one(text: str | None) -> str | None:
        value = decoded(text)
        return text if isinstance(value, str) or value is None else json.dumps(value, ensure_ascii=False, sort_keys=True)

    return payload.map(one, na_action="ignore")


@F.pandas_udf(T.BooleanType())
def json_contains(actual: pd.Series, wanted: pd.Series) -> pd.Series:
    """Whether the first object contains the second; a null or unreadable side counts as an empty object."""

    def obj(text: str | None) -> dict:
        value = decoded(text)
        return value if isinstance(value, dict) else {}

    return pd.Series([contains(obj(a), obj(w)) for a, w in zip(actual, wanted, strict=True)], dtype="boolean")


# ------------------------------------------------------------------- steps

# Where a row may hold its steps, in order of priority.
DIRECT_PATHS = ["reference_steps", "actions"]
NESTED_PATHS = [
    "metadata.reference_steps", "metadata.actions", "rlvr.reference_steps", "rlvr.actions", "ground_truth.reference_steps",
    "ground_truth.actions", "reward_model.ground_truth.reference_steps", "reward_model.ground_truth.actions",
]
TRUTH_KEYS = ["reference_steps", "actions", "steps"]
_BREAK = re.compile(r"[，,；;\n]")


def steps_of(value: Any, plain: bool) -> list[list[str]]:
    """Steps, each a list of candidates, of a text, a list or a JSON text."""
    if isinstance(value, str):
        inner = decoded(value)
        if not isinstance(inner, str):
            return steps_of(inner, plain)
        return [[p.strip()] for p in _BREAK.split(value) if p.strip()] if plain else []
    if not isinstance(value, list):
        return []
    out = []
    for item in value:
        if isinstance(item, dict):
            item = next((item[k] for k in ("action", "actions") if item.get(k) is not None), None)
            if item is None:
                continue
        texts = [str(c).strip() for c in (item if isinstance(item, list) else [item])]
        texts = [t for t in texts if t]
        if texts:
            out.append(texts)
    return out


def resolve_steps(extra: Any, truth: Any, own_paths: Iterable[str] = ()) -> tuple[list[list[str]], str | None]:
    """The steps of a row and the field they come from; plain text as truth is an answer, not steps."""
    extra = decoded(extra) if isinstance(extra, str) else extra
    for path in dict.fromkeys([*DIRECT_PATHS, *own_paths, *NESTED_PATHS]):
        value = extra
        for part in path.split("."):
            value = value.get(part) if isinstance(value, dict) else None
        if value is not None and (found := steps_of(value, True)):
            return found, f"extra_info.{path}"
    truth = decoded(truth) if isinstance(truth, str) else truth
    if isinstance(truth, dict):
        for key in TRUTH_KEYS:
            if found := steps_of(truth.get(key), True):
                return found, f"ground_truth.{key}"
    elif isinstance(truth, list) and (found := steps_of(truth, False)):
        return found, "ground_truth"
    return [], None


_RESOLVED = T.StructType([T.StructField("steps", T.ArrayType(T.ArrayType(T.StringType()))), T.StructField("source", T.StringType())])


def resolver(own_paths: tuple[str, ...] = ()):
    """A column function of (extra_info, ground_truth) to ``steps, source``."""

    @F.pandas_udf(_RESOLVED)
    def resolve(extra: pd.Series, truth: pd.Series) -> pd.DataFrame:
        both = [resolve_steps(e, t, own_paths) for e, t in zip(extra, truth, strict=True)]
        return pd.DataFrame({"steps": [s for s, _ in both], "source": [x for _, x in both]})

    return resolve
