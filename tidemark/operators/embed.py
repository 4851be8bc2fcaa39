"""Vectors of texts: whatever model the settings name, made in each Python worker when the first text comes."""

from __future__ import annotations

import os
import threading
import time
from collections.abc import Callable, Iterator
from pathlib import Path
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.config import Model


class Embedder(Protocol):
    """Whatever turns texts into vectors; one is made in each Python worker."""

    dimensions: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


class HashingEmbedder:
    """Signed counts of hashed words at length 1. Deterministic and offline; knows equal words, not meanings."""

    def __init__(self, dimensions: int = 64):
        self.dimensions = dimensions

    def embed(self, texts: list[str]) -> np.ndarray:
        import re
        import zlib

        slots: dict[str, int] = {}
        words = [re.findall(r"[一-鿿]|[^\W_一-鿿]+", text.lower()) for text in texts]
        flat = [slots.setdefault(w, len(slots)) for row in words for w in row]
        hashes = np.fromiter((zlib.crc32(w.encode()) for w in slots), np.int64, len(slots))[flat] if flat else np.zeros(0, np.int64)
        row = np.repeat(np.arange(len(texts)), [len(x) for x in words])
        sign = np.where(hashes >> 31, 1.0, -1.0)
        out = np.bincount(row * self.dimensions + hashes % self.dimensions, sign, len(texts) * self.dimensions).reshape(len(texts), self.dimensions).astype(np.float32)
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


class OnnxEmbedder:
    """A sentence encoder in a folder: ``model.onnx`` and ``tokenizer.json``; the mean of its last states at length 1."""

    def __init__(self, folder: str):
        try:
            import onnxruntime
            from tokenizers import Tokenizer
        except ImportError as error:
            raise RuntimeError("a model from a folder needs onnxruntime and tokenizers; name it 'hashing' to go without") from error
        files = [Path(folder) / x for x in ("model.onnx", "tokenizer.json")]
        if missing := [str(f) for f in files if not f.exists()]:
            raise FileNotFoundError(f"no model at {folder}: {', '.join(missing)}")
        options = onnxruntime.SessionOptions()
        options.intra_op_num_threads = options.inter_op_num_threads = 1  # a task has one core
        self.session = onnxruntime.InferenceSession(str(files[0]), options, providers=["CPUExecutionProvider"])
        self.tokenizer = Tokenizer.from_file(str(files[1]))
        self.tokenizer.enable_padding()
        self.dimensions = probe(self)

    def embed(self, texts: list[str]) -> np.ndarray:
        found = self.tokenizer.encode_batch(texts)
        mask = np.array([x.attention_mask for x in found], np.int64)
        given = {"input_ids": np.array([x.ids for x in found], np.int64), "attention_mask": mask, "token_type_ids": np.array([x.type_ids for x in found], np.int64)}
        states = self.session.run(None, {x.name: given[x.name] for x in self.session.get_inputs() if x.name in given})[0]
        if states.ndim == 3:
            states = (states * mask[:, :, None]).sum(1) / np.maximum(mask.sum(1, keepdims=True), 1)
        return (states / np.maximum(np.linalg.norm(states, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def probe(embedder: Embedder) -> int:
    """How many numbers a vector of the model has, found by embedding one word."""
    return int(embedder.embed(["probe"]).shape[1])


class Lazy:
    """A model that is made when it is needed, given up when nobody asked for ``idle`` seconds, and made again then."""

    def __init__(self, make: Callable[[], Embedder], idle: float = 300, clock: Callable[[], float] = time.monotonic):
        self.make, self.idle, self.clock = make, idle, clock
        self._lock = threading.Lock()
        self._model: Embedder | None = None
        self._timer: threading.Timer | None = None
        self._used = 0.0

    @property
    def loaded(self) -> bool:
        return self._model is not None

    @property
    def dimensions(self) -> int:
        with self._lock:
            return self._get().dimensions

    def embed(self, texts: list[str]) -> np.ndarray:
        with self._lock:
            return self._get().embed(texts)

    def _get(self) -> Embedder:
        if self._model is None:
            self._model = self.make()
        self._used = self.clock()
        if self._timer is None and self.idle > 0:
            self._wait(self.idle)
        return self._model

    def _wait(self, seconds: float) -> None:
        self._timer = threading.Timer(seconds, self._look)
        self._timer.daemon = True
        self._timer.start()

    def _look(self) -> None:
        with self._lock:
            left = self.idle - (self.clock() - self._used)
            self._timer = None
            if left <= 0:
                self._model = None
            else:
                self._wait(left)

    def unload(self) -> None:
        with self._lock:
            if self._timer:
                self._timer.cancel()
            self._model = self._timer = None


_HELD: dict[Model, Lazy] = {}


def embedder(settings: Model) -> Lazy:
    """The model the settings name, one per process: ``hashing``, or a folder of that name, itself or in the cache folder.

    A model whose vectors have other than the settings' dimensions is an error, as is one that isn't there.
    """

    def make() -> Embedder:
        if settings.name == "hashing":
            return HashingEmbedder(settings.dimensions)
        places = [settings.name, os.path.join(os.path.expanduser(settings.cache_dir), settings.name)]
        model = OnnxEmbedder(next((p for p in places if os.path.isdir(p)), places[-1]))
        if model.dimensions != settings.dimensions:
            raise ValueError(f"model {settings.name} gives {model.dimensions} numbers, the settings say {settings.dimensions}")
        return model

    return _HELD.setdefault(settings, Lazy(make, settings.unload_after_seconds))


def embed_chunks(texts: DataFrame, make: Callable[[], Embedder] = HashingEmbedder, batch_size: int = 64) -> DataFrame:
    """(chunk_id, embedding) of (chunk_id, content): the content alone, in batches; null contents have none.

    A batch that fails ends the job: no vector is ever put to another text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        engine = make()
        for batch in batches:
            for lo in range(0, batch.num_rows, batch_size):
                part = batch.slice(lo, batch_size)
                found = np.ascontiguousarray(engine.embed(part.column("content").to_pylist()), np.float32)
                if len(found) != part.num_rows:
                    raise ValueError(f"{len(found)} vectors of {part.num_rows} texts")
                offsets = pa.array(np.arange(len(found) + 1, dtype=np.int32) * found.shape[1])
                yield pa.RecordBatch.from_arrays([part.column("chunk_id"), pa.ListArray.from_arrays(offsets, pa.array(found.ravel()))], names=["chunk_id", "embedding"])

    return texts.where(F.col("content").isNotNull()).select("chunk_id", "content").mapInArrow(run, "chunk_id long, embedding array<float>")
