"""Embedding providers: what turns texts into vectors, on executors in Arrow batches.

`hashing` needs no model: words and word parts are hashed into signed counts. It
is deterministic and the same everywhere. `onnx` runs a model file with mean
pooling. `http` asks a service that speaks the common embeddings protocol.
"""

from __future__ import annotations

import json
import os
import re
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F

DIM, BATCH = 768, 200
_PART = re.compile(r"[A-Z]?[^\W\dA-Z_]+|[A-Z]+|\d+")


class Provider(Protocol):
    dim: int

    def encode(self, texts: list[str], code: bool = False) -> np.ndarray:
        """One vector of length 1 a text (0 for an empty one)."""

    def status(self) -> tuple[bool, str]: ...


def normal(m: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return (m / np.where(norm > 0, norm, 1)).astype(np.float32)


def mean_pool(hidden: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Mean over the positions that the mask keeps."""
    m = mask[..., None].astype(np.float32)
    return (hidden * m).sum(1) / np.maximum(m.sum(1), 1e-9)


@dataclass
class Hashing:
    dim: int = DIM

    def encode(self, texts: list[str], code: bool = False) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), np.float32)
        for row, t in zip(out, texts, strict=True):
            parts = [p.lower() for p in _PART.findall(t or "")]
            grams = parts + [f"{a} {b}" for a, b in zip(parts, parts[1:], strict=False)] if code else parts
            for p in grams:
                h = xxhash.xxh3_64_intdigest(p, int(code))
                row[h % self.dim] += 1 if h >> 63 else -1
        return normal(out)

    def status(self) -> tuple[bool, str]:
        return True, "hashing"


@dataclass
class Onnx:
    """A transformer in ONNX form with its tokenizer file; inputs are input_ids and attention_mask."""

    model: str
    tokenizer: str
    dim: int = DIM
    pad: int = 0
    most: int = 512

    def encode(self, texts: list[str], code: bool = False) -> np.ndarray:
        import onnxruntime
        from tokenizers import Tokenizer

        if not hasattr(self, "_run"):
            self._run, self._tok = onnxruntime.InferenceSession(self.model), Tokenizer.from_file(self.tokenizer)
        # a long text goes through the model in windows; the mean is taken over all of its tokens
        windows = [(i, e.ids[at : at + self.most]) for i, e in enumerate(self._tok.encode_batch([t or "" for t in texts])) for at in range(0, max(1, len(e.ids)), self.most)]
        total, count = None, np.zeros(len(texts))
        want = {i.name for i in self._run.get_inputs()}
        for low in range(0, len(windows), BATCH):
            part = windows[low : low + BATCH]
            size = max(1, *(len(w) for _, w in part)) if len(part) > 1 else max(1, len(part[0][1]))
            x, mask = np.full((len(part), size), self.pad, np.int64), np.zeros((len(part), size), np.int64)
            for row, (_, w) in enumerate(part):
                x[row, : len(w)], mask[row, : len(w)] = w, 1
            hidden = self._run.run(None, {k: v for k, v in {"input_ids": x, "attention_mask": mask, "token_type_ids": np.zeros_like(x)}.items() if k in want})[0]
            at, n = np.array([i for i, _ in part]), mask.sum(1)
            total = np.zeros((len(texts), hidden.shape[-1]), np.float32) if total is None else total
            np.add.at(total, at, mean_pool(hidden, mask) * n[:, None])
            np.add.at(count, at, n)
        return normal(total / np.maximum(count, 1)[:, None])

    def status(self) -> tuple[bool, str]:
        return os.path.isfile(self.model), self.model


class ProviderError(RuntimeError):
    def __init__(self, message: str, retry: bool):
        super().__init__(message)
        self.retry = retry


@dataclass
class Http:
    """A service that takes {model, input} and returns {data: [{index, embedding}]}; rows are put in the order of their index. Errors that can pass are tried again, each time after twice as long."""

    url: str
    model: str
    code_model: str | None = None
    code_url: str | None = None
    key: str | None = None
    dim: int = DIM
    tries: int = 3
    wait: float = 0.5
    timeout: float = 30

    def encode(self, texts: list[str], code: bool = False) -> np.ndarray:
        body = json.dumps({"model": (self.code_model if code else None) or self.model, "input": texts}).encode()
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.key}"} if self.key else {})
        for i in range(self.tries):
            try:
                return self._ask(urllib.request.Request((self.code_url if code else None) or self.url, body, headers), len(texts))
            except ProviderError as e:
                if not e.retry or i == self.tries - 1:
                    raise
                time.sleep(self.wait * 2**i)
        raise AssertionError

    def _ask(self, request: urllib.request.Request, n: int) -> np.ndarray:
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as r:
                data = json.load(r)["data"]
        except urllib.error.HTTPError as e:
            raise ProviderError(f"status {e.code}", e.code not in (400, 401, 403, 404)) from e
        except (OSError, ValueError, KeyError) as e:
            raise ProviderError(str(e), True) from e
        if len(data) != n:
            raise ProviderError(f"{len(data)} vectors for {n} texts", False)
        rows = sorted(data, key=lambda d: d.get("index", 0)) if all("index" in d for d in data) else data
        return normal(np.array([d["embedding"] for d in rows], np.float32))

    def status(self) -> tuple[bool, str]:
        try:
            self.encode(["ready"])
        except ProviderError as e:
            return False, str(e)
        return True, self.url


def provider(kind: str = "hashing", **options) -> Provider:
    """By name: hashing, onnx or http. Local ones must have the table's width."""
    kinds: dict[str, Callable[..., Provider]] = {"hashing": Hashing, "onnx": Onnx, "http": Http}
    if kind not in kinds:
        raise ValueError(f"provider {kind!r}")
    return kinds[kind](**options)


def pieces(batches: Iterator[pa.Array], by: Provider, code: bool = False) -> Iterator[pa.Array]:
    """Vectors of texts, a batch at a time as they came: memory does not grow with the rows that Spark sends at once."""
    for texts in batches:
        for low in range(0, len(texts), BATCH):
            part = texts.slice(low, BATCH).to_pylist()
            some, m = [t for t in part if t is not None], np.zeros((0, by.dim), np.float32)
            if some:
                try:
                    m = by.encode(some, code)
                except ProviderError:
                    some = []
            if m.shape[1] != by.dim:
                raise ValueError(f"vectors of {m.shape[1]} instead of {by.dim} numbers")
            has = np.array([bool(some) and t is not None for t in part])
            ends = np.concatenate([[0], np.cumsum(has * by.dim)]).astype(np.int32)
            yield pa.ListArray.from_arrays(pa.array(ends), pa.array(m.astype(np.float32).ravel()), mask=pa.array(~has))


def embed(text: Column, by: Provider, code: bool = False) -> Column:
    """array<float> of each text, a batch a call; null texts have none, nor have those of a batch that the provider gives up on. Vectors of another width are an error."""

    @F.arrow_udf("array<float>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from pieces(batches, by, code)

    return run(text)
