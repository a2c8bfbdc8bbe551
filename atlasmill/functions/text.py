"""Text functions whose exact Unicode or JSON semantics the built-in functions do not have, in Arrow batches."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _normal(text: str) -> str:
    return " ".join(text.split()).casefold()


def _digest(value: object) -> str:
    return hashlib.sha256(json.dumps(value, ensure_ascii=False, sort_keys=True).encode()).hexdigest()


@F.pandas_udf(T.StringType())
def normalized(text: pd.Series) -> pd.Series:
    """White space squeezed and case folded; null stays null."""
    return text.map(_normal, na_action="ignore")


@F.pandas_udf(T.StringType())
def sample_hash(prompt: pd.Series, completion: pd.Series) -> pd.Series:
    """Digest of the normalized prompt and completion; null if either is."""
    return pd.Series([None if p is None or c is None else _digest([_normal(p), _normal(c)]) for p, c in zip(prompt, completion)], dtype=object)


@F.pandas_udf(T.StringType())
def atomic_id(prompt: pd.Series, completion: pd.Series) -> pd.Series:
    """Digest of prompt and completion as they are; null if either is."""
    return pd.Series([None if p is None or c is None else _digest([p, c]) for p, c in zip(prompt, completion)], dtype=object)


def _unique(pairs: list[tuple[str, object]]) -> dict:
    if len({k for k, _ in pairs}) != len(pairs):
        raise KeyError("duplicate")
    return dict(pairs)


def _no_constant(name: str) -> None:
    raise OverflowError(name)


def _strict(text: str) -> str:
    try:
        value = json.loads(text, object_pairs_hook=_unique, parse_constant=_no_constant)
    except KeyError:
        return "duplicate_key"
    except OverflowError:
        return "not_finite"
    except (ValueError, RecursionError):
        return "bad_json"
    return "ok" if isinstance(value, dict) else "not_an_object"


@F.pandas_udf(T.StringType())
def strict_json(text: pd.Series) -> pd.Series:
    """ok, duplicate_key, not_finite, not_an_object or bad_json (text after the object included)."""
    return text.map(_strict, na_action="ignore")


@F.pandas_udf(T.DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratio of matching blocks, from 0 to 1."""
    from difflib import SequenceMatcher

    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype=float)


#: Fixed value: the form of a key.
KEY = r"\bsk-[A-Za-z0-9_-]{12,}\b"
REDACTED = "[REDACTED]"


def redacted(text: Column, secrets: list[str] = ()) -> Column:
    """The configured secrets and anything of the form of a key replaced; null stays null."""
    for secret in secrets:
        if secret:
            text = F.replace(text, F.lit(secret), F.lit(REDACTED))
    return F.regexp_replace(text, KEY, REDACTED)


def redacted_deep(value: Column, kind: T.DataType, secrets: list[str] = ()) -> Column:
    """The same for every string inside structs, arrays and the values of maps."""
    if isinstance(kind, T.StringType):
        return redacted(value, secrets)
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: redacted_deep(x, kind.elementType, secrets))
    if isinstance(kind, T.MapType):
        return F.transform_values(value, lambda _, v: redacted_deep(v, kind.valueType, secrets))
    if isinstance(kind, T.StructType):
        fields = F.struct(*[redacted_deep(value[f.name], f.dataType, secrets).alias(f.name) for f in kind])
        return F.when(value.isNotNull(), fields)
    return value
