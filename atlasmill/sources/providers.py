"""Answers of a chat provider for rows of a DataFrame: each distinct request once, checked, retried, kept.

A provider is made on the executor by a function without arguments and has chat(system, data, max_tokens) -> value.
validate(value, data) gives the normalized value or raises ValueError. Answers are kept in a table by the digest of the
request, so a run that stops early asks only for what is missing. A request that fails is a row with an error.
"""

from __future__ import annotations

import json
import math
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atlasmill.operators.sinks import insert_missing

# States of an HTTP answer that are worth another try.
RETRIED = (408, 409, 429)
LONGEST_WAIT = 8
SCHEMA = "request_hash string, value string, attempts int, error string"


class ProviderError(RuntimeError):
    """A request failed; `again` says whether another try may help. Carries no credentials."""

    def __init__(self, text: str, again: bool = True):
        super().__init__(text)
        self.again = again


class _NoRedirect(urllib.request.HTTPRedirectHandler):
    def redirect_request(self, *_):
        return None


class HttpProvider:
    """A chat completions endpoint. The key never shows in an error; redirects are refused, plain http only if allowed."""

    def __init__(self, base_url: str, api_key: str, model: str, timeout: float = 180, plain_http: bool = False):
        if not all(isinstance(v, str) and v.strip() for v in (base_url, api_key, model)):
            raise ValueError("base_url, api_key and model must not be empty")
        if not base_url.startswith(("https://", "http://") if plain_http else "https://"):
            raise ValueError("the base URL must be https")
        if not math.isfinite(timeout) or timeout <= 0:
            raise ValueError("the timeout must be positive")
        self.base_url, self.api_key, self.model, self.timeout = base_url.rstrip("/"), api_key, model, timeout
        self._open = urllib.request.build_opener(_NoRedirect).open

    def _send(self, route: str, payload: dict | None) -> object:
        body = None if payload is None else json.dumps({"model": self.model, **payload}, ensure_ascii=False).encode()
        request = urllib.request.Request(self.base_url + route, body, {"Authorization": f"Bearer {self.api_key}", "Content-Type": "application/json"})
        try:
            with self._open(request, timeout=self.timeout) as answer:
                return json.load(answer)
        except urllib.error.HTTPError as e:
            e.close()
            raise ProviderError(f"HTTP {e.code}", e.code in RETRIED or e.code >= 500) from None
        except OSError:
            raise ProviderError("connection failed or timed out") from None

    def models(self) -> list[str]:
        return sorted(m["id"] for m in self._send("/models", None)["data"])

    def chat(self, system: str, data: object, max_tokens: int) -> object:
        messages = [{"role": "system", "content": system}, {"role": "user", "content": json.dumps(data, ensure_ascii=False)}]
        body = self._send("/chat/completions", {"messages": messages, "temperature": 0, "max_tokens": max_tokens, "response_format": {"type": "json_object"}})
        return json.loads(body["choices"][0]["message"]["content"])


def _answer(provider, system: str, data: object, max_tokens: int, validate: Callable, retries: int, wait: Callable[[float], None]) -> tuple[str | None, int, str | None]:
    error = "request failed"
    for attempt in range(1, retries + 2):
        try:
            return json.dumps(validate(provider.chat(system, data, max_tokens), data), ensure_ascii=False), attempt, None
        except ProviderError as e:
            error = str(e)
            if not e.again:
                return None, attempt, error
        except (ValueError, KeyError, TypeError, IndexError) as e:
            error = f"answer not valid: {e}"
        if attempt <= retries:
            wait(min(2 ** (attempt - 1), LONGEST_WAIT))
    return None, retries + 1, error


def ask(rows: DataFrame, system: str, data: str, provider: Callable, validate: Callable, cache: str, name: str, max_tokens: int = 8192, max_chars: int | None = None, retries: int = 2, wait: Callable[[float], None] = time.sleep) -> DataFrame:
    """rows with answer (JSON text), attempts and error. data: a column of JSON text; name: model and endpoint.

    A request longer than max_chars is an error and never cut. Requests that failed are asked again next time.
    """
    spark = rows.sparkSession
    key = F.sha2(F.to_json(F.array(F.lit(name), F.lit(str(max_tokens)), F.lit(system), F.col(data))), 256)
    keyed = rows.withColumn("request_hash", key)
    too_long = F.lit(False) if max_chars is None else F.length(data) + len(system) > max_chars
    folder = spark._jvm.org.apache.hadoop.fs.Path(cache)
    there = folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
    held = spark.read.schema(SCHEMA).parquet(cache) if there else spark.createDataFrame([], SCHEMA)
    new = keyed.where(~too_long).select("request_hash", F.col(data).alias("data")).dropDuplicates(["request_hash"]).join(held.select("request_hash"), "request_hash", "left_anti")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = provider()
        for b in batches:
            for k, d in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                value, attempts, error = _answer(model, system, json.loads(d), max_tokens, validate, retries, wait)
                yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([value], pa.string()), pa.array([attempts], pa.int32()), pa.array([error], pa.string())], names=["request_hash", "value", "attempts", "error"])

    from atlasmill.functions.shared import stash

    told = stash(new.mapInArrow(run, SCHEMA), "answers")  # asked once, whatever reads it
    insert_missing(told.where("error is null"), cache, "request_hash")
    every = held.union(told)
    out = keyed.join(every, "request_hash", "left").withColumn("error", F.when(too_long, "input longer than max_chars").otherwise(F.col("error")))
    return out.select(*rows.columns, F.col("value").alias("answer"), "attempts", "error")
