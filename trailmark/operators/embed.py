"""Encoders: unit vectors of texts. The choice is always named, never replaced silently."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from typing import Any, Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailmark.plans.shared import write_shared

#: Concepts and the spellings that express them; a text has a concept if it contains a spelling.
CONCEPTS: dict[str, list[str]] = {
    "failure": ["fail", "störung", "panne", "avería", "故障", "error", "fehler"],
    "trace": ["trac", "aufspür", "repérer", "rastrear", "追踪", "grep"],
    "repair": ["patch", "ausbessern", "réparer", "reparar", "修补", "replaced"],
    "check": ["check", "test", "prüf", "contrôle", "control", "检查", "校验"],
    "guard": ["guard", "rückfall", "rechute", "recaída", "防止"],
    "open": ["open", "öffnen", "ouvrir", "abrir", "打开"],
    "search": ["search", "such", "chercher", "buscar", "搜索"],
    "filter": ["filter", "filtr", "筛选"],
    "form": ["form", "ausfüllen", "填写"],
    "source": ["source", "quellen", "fuentes", "资料", "src/"],
    "compare": ["compare", "vergleich", "abgleich", "comparer", "comparar", "比较", "比对"],
    "version": ["version", "build", "版本"],
    "package": ["package", "paket", "paquet", "安装包"],
    "deploy": ["deploy", "ausrollen", "déployer", "desplegar", "部署"],
    "column": ["column", "spalte", "colonne", "columna", "字段"],
    "row": ["row", "zeile", "ligne", "fila", "行"],
}


class Encoder(Protocol):
    """Texts to unit vectors (or zero vectors), one row each."""

    name: str

    def encode(self, texts: list[str]) -> np.ndarray: ...


@dataclass(frozen=True)
class ConceptEncoder:
    """Indicators of concepts, scaled to unit length: also expressible as columns."""

    concepts: dict[str, list[str]] = field(default_factory=lambda: CONCEPTS)
    name: str = "concepts"

    def encode(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), len(self.concepts)), dtype=np.float32)
        for i, t in enumerate(texts):
            low = t.lower()
            for k, spellings in enumerate(self.concepts.values()):
                out[i, k] = any(s in low for s in spellings)
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, norm, out=out, where=norm > 0)

    def mask(self, text: Column) -> Column:
        """The concepts of a text as bits."""
        low = F.lower(text)
        bits = F.lit(0).cast("long")
        for k, spellings in enumerate(self.concepts.values()):
            hit = F.lit(False)
            for s in spellings:
                hit = hit | F.contains(low, F.lit(s))
            bits = bits + F.when(hit, F.lit(1 << k).cast("long")).otherwise(F.lit(0).cast("long"))
        return bits


def mask_cosine(a: Column, b: Column) -> Column:
    """Cosine of two concept sets given as bits; 0 if either is empty."""
    both, size = F.bit_count(a.bitwiseAND(b)), F.bit_count(a) * F.bit_count(b)
    return F.when(size > 0, both / F.sqrt(size.cast("double"))).otherwise(F.lit(0.0))


@dataclass(frozen=True)
class NgramEncoder:
    """Hashed words and character trigrams: deterministic on any text, without a model."""

    dims: int = 256
    name: str = "ngrams"

    def encode(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dims), dtype=np.float32)
        for at in range(0, len(texts), 1024):
            own = texts[at : at + 1024]
            # a NUL stands between texts; it is no part of a word
            said = re.findall(r"\w+|\0", "\0".join(t.replace("\0", " ") for t in own).lower())
            ids = {w: i for i, w in enumerate(dict.fromkeys(["\0", *said]))}
            grams = [_grams(w) for w in list(ids)[1:]]
            if not grams:
                continue
            word = np.fromiter(map(ids.__getitem__, said), dtype=np.int64, count=len(said)) - 1
            text = np.cumsum(word < 0)[word >= 0]
            word = word[word >= 0]
            hashes, size = np.concatenate(grams), np.array([len(g) for g in grams])
            n = size[word]
            each = np.repeat((np.cumsum(size) - size)[word] - np.cumsum(n) + n, n) + np.arange(n.sum())
            slots, signs = hashes % self.dims, np.where(hashes & 0x80000000, 1.0, -1.0)
            sums = np.bincount(np.repeat(text * self.dims, n) + slots[each], weights=signs[each], minlength=len(own) * self.dims)
            out[at : at + 1024] = sums.reshape(len(own), self.dims)
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, norm, out=out, where=norm > 0)


@lru_cache(maxsize=65_536)
def _grams(word: str) -> np.ndarray:
    """Hashes of a word and of its trigrams with marked ends."""
    pad = f"^{word}$"
    return np.array([zlib.crc32(g.encode()) for g in [word, *(pad[k : k + 3] for k in range(len(pad) - 2))]], dtype=np.int64)


class Cached:
    """An encoder that keeps the vectors of up to ``size`` texts by role; least recently used ones go first.

    An encoder with ``instructions`` (by role: query, passage) gets them before
    the texts; for others a text is the same in every role.
    """

    def __init__(self, encoder: Encoder, size: int = 8192) -> None:
        self.encoder, self.size, self.hits, self.misses = encoder, size, 0, 0
        self.instructions: dict[str, str] = getattr(encoder, "instructions", {})
        self.kept: dict[tuple[str, str], np.ndarray] = {}

    def encode(self, texts: list[str], roles: list[str] | None = None) -> np.ndarray:
        said = [self.instructions.get(r, "") for r in roles] if roles and self.instructions else [""] * len(texts)
        keys = list(zip(said, texts, strict=True))
        new = [k for k in dict.fromkeys(keys) if k not in self.kept]
        self.misses += len(new)
        self.hits += len(keys) - len(new)
        fresh = dict(zip(new, self.encoder.encode([a + t for a, t in new]), strict=True)) if new else {}
        rows = []
        for k in keys:
            v = fresh.get(k)
            if v is None:
                v = self.kept.pop(k)
            self.kept[k] = v
            rows.append(v)
        while len(self.kept) > self.size:
            self.kept.pop(next(iter(self.kept)))
        return np.stack(rows) if rows else np.zeros((0, 1), dtype=np.float32)

    def stats(self) -> dict[str, float]:
        """Texts kept, hits, misses and the share of hits."""
        asked = self.hits + self.misses
        return {"size": len(self.kept), "max_size": self.size, "hits": self.hits, "misses": self.misses, "hit_rate": self.hits / asked if asked else 0.0}


# ------------------------------------------------------------------- models

#: How public models pool and what they want before a text, by role.
_E5 = {"pooling": "mean", "query": "query: ", "passage": "passage: "}
PRESETS = {"intfloat/multilingual-e5-small": _E5, "intfloat/multilingual-e5-base": _E5, "intfloat/multilingual-e5-large": _E5}
#: Providers of the runtime in order of preference, and the number format each is used with.
PROVIDERS = [("CUDAExecutionProvider", "float16"), ("CANNExecutionProvider", "float16"), ("CPUExecutionProvider", "float32")]


@dataclass(frozen=True)
class ModelSpec:
    """A model and how it is used; two equal specifications are one model in a process."""

    path: str
    pooling: str = "cls"
    query: str = ""
    passage: str = ""
    revision: str | None = None
    provider: str | None = None
    batch: int = 128
    max_length: int = 128

    @classmethod
    def of(cls, path: str, **own: Any) -> ModelSpec:
        """What the model's preset says, its name being the end of the path; arguments win."""
        last = path.replace("\\", "/").rstrip("/").rpartition("/")[2]
        preset = next((p for name, p in PRESETS.items() if name == path or name.rpartition("/")[2] == last), {})
        return cls(path, **{**preset, **{k: v for k, v in own.items() if v is not None}})


#: Texts to token vectors (texts x tokens x dims) and their mask.
Forward = Callable[[list[str]], tuple[np.ndarray, np.ndarray]]


def onnx_forward(spec: ModelSpec) -> Forward:
    """The model and tokenizer of a folder (``model.onnx``, ``tokenizer.json``); an OSError if they are not there."""
    import os

    files = [os.path.join(spec.path, name) for name in ("model.onnx", "tokenizer.json")]
    for f in files:
        if not os.path.isfile(f):
            raise FileNotFoundError(f)
    import onnxruntime
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(files[1])
    tokenizer.enable_truncation(spec.max_length)
    tokenizer.enable_padding()
    session = onnxruntime.InferenceSession(files[0], providers=[spec.provider or provider(onnxruntime.get_available_providers())[0]])
    inputs = {i.name for i in session.get_inputs()}

    def forward(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        coded = tokenizer.encode_batch(texts)
        ids, mask = (np.array([getattr(c, n) for c in coded], dtype=np.int64) for n in ("ids", "attention_mask"))
        every = {"input_ids": ids, "attention_mask": mask, "token_type_ids": np.zeros_like(ids)}
        return session.run(None, {n: v for n, v in every.items() if n in inputs})[0].astype(np.float32), mask

    return forward


def provider(available: list[str]) -> tuple[str, str]:
    """The preferred provider among those available, and its number format."""
    return next(((p, f) for p, f in PROVIDERS if p in available), PROVIDERS[-1])


class ModelEncoder:
    """A model as an encoder: micro-batches, pooling, unit vectors. Travels to executors as its specification."""

    #: Texts are better given many at a time.
    batched = True

    def __init__(self, spec: ModelSpec, loader: Callable[[ModelSpec], Forward] = onnx_forward) -> None:
        if spec.pooling not in ("mean", "cls") or spec.batch <= 0 or spec.max_length <= 0:
            raise ValueError("pooling must be 'mean' or 'cls', batch and length positive")
        self.spec, self.loader, self.name = spec, loader, spec.path
        self.instructions = {"query": spec.query, "passage": spec.passage}

    def encode(self, texts: list[str]) -> np.ndarray:
        forward = _forward(self.spec, self.loader)
        return np.concatenate([pooled(*forward(texts[i : i + self.spec.batch]), self.spec.pooling) for i in range(0, len(texts), self.spec.batch)]).astype(np.float32)


_models: dict[tuple[ModelSpec, Any], Forward] = {}


def _forward(spec: ModelSpec, loader: Callable[[ModelSpec], Forward]) -> Forward:
    if (spec, loader) not in _models:
        _models[spec, loader] = loader(spec)
    return _models[spec, loader]


def load_encoder(path: str, *, loader: Callable[[ModelSpec], Forward] = onnx_forward, **own: Any) -> ModelEncoder | None:
    """The encoder of a model, loaded once per process; None if it can't be read, so that scoring falls back to words."""
    encoder = ModelEncoder(ModelSpec.of(path, **own), loader)
    try:
        _forward(encoder.spec, loader)
    except OSError:
        return None
    return encoder


def encode_texts(texts: DataFrame, encoder: Encoder, *, role_prefix: dict[str, str] | None = None) -> DataFrame:
    """``role, text, embedding`` of the distinct (role, text): each is encoded once, then joined by its users.

    ``texts`` has ``role, text``; ``role_prefix`` gives the instruction put
    before the texts of a role. Null texts are left out.
    """
    unique = texts.select("role", "text").filter("text is not null").distinct()
    prefix = role_prefix or getattr(encoder, "instructions", {})
    schema = T.StructType([T.StructField("role", T.StringType()), T.StructField("text", T.StringType()), T.StructField("embedding", T.ArrayType(T.FloatType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roles, own = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            vectors = encoder.encode([prefix.get(r, "") + t for r, t in zip(roles, own, strict=True)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(list(vectors), pa.list_(pa.float32()))], names=schema.names)

    return unique.mapInArrow(run, schema)


def looked_up(users: DataFrame, encoded: DataFrame) -> DataFrame:
    """``users`` (with ``role, text``) and the ``embedding`` of their text; null for a null text. ``encoded`` is :func:`encode_texts`.

    Joined on a hash of role and text first, so that long texts are not keys of
    the shuffle; texts that many users share are split by the session's skew join.
    """
    key = F.xxhash64("role", "text")
    e = encoded.select(F.col("role").alias("__r"), F.col("text").alias("__t"), "embedding", key.alias("__h"))
    same = (F.col("__k") == F.col("__h")) & (F.col("role") == F.col("__r")) & (F.col("text") == F.col("__t"))
    return users.withColumn("__k", key).join(e, same, "left").drop("__k", "__h", "__r", "__t")


def cache_stats(texts: DataFrame) -> DataFrame:
    """``role, asked, encoded, hit_rate``: how many texts are asked for, how many have to be encoded, and the share that is there already."""
    per = texts.filter("text is not null").groupBy("role", F.xxhash64("text").alias("h"), "text").agg(F.count(F.lit(1)).alias("n"))
    out = per.groupBy("role").agg(F.sum("n").alias("asked"), F.count(F.lit(1)).alias("encoded"))
    return out.withColumn("hit_rate", 1 - F.col("encoded") / F.col("asked"))


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision: the cosine of unit vectors."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def _packed(vectors: DataFrame, size: int, names: tuple[str, str]) -> DataFrame:
    """Blocks of at most ``size`` vectors: their ids, and their values one after the other."""
    schema = T.StructType([T.StructField(names[0], T.ArrayType(T.LongType())), T.StructField(names[1], T.ArrayType(T.FloatType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                ids, values = batch.column(0).slice(at, size), batch.column(1).slice(at, size).flatten()
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays([0, len(x)], x) for x in (ids, values)], names=schema.names)

    return vectors.mapInArrow(run, schema)


def cosines(queries: DataFrame, rows: DataFrame, *, query_block: int = 200, row_block: int = 500) -> DataFrame:
    """``query_id, vec_id, cosine`` of every query with every row: one matrix product per pair of blocks.

    Both have ``vec_id, embedding`` with unit vectors of one length; a null
    vector has no cosine and gives no row. The blocks of the queries are
    written once, so that a task of the product doesn't read the rows for them.
    """
    ready = [d.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<float>")).filter("embedding is not null") for d in (queries, rows)]
    own = write_shared(_packed(ready[0].repartition("vec_id"), query_block, ("query_ids", "query_values")), "queries")
    pairs = own.crossJoin(_packed(ready[1], row_block, ("ids", "values")))
    schema = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("vec_id", T.LongType()), T.StructField("cosine", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                query_ids, q, ids, v = (batch.column(k).slice(i, 1).flatten() for k in range(4))
                a, b = (x.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(n), -1) for x, n in ((q, query_ids), (v, ids)))
                at = np.arange(len(query_ids) * len(ids))
                yield pa.RecordBatch.from_arrays(
                    [query_ids.take(pa.array(at // len(ids))), ids.take(pa.array(at % len(ids))), pa.array((a @ b.T).ravel())], names=schema.names
                )

    return pairs.mapInArrow(run, schema)


def pooled(vectors: np.ndarray, mask: np.ndarray, how: str = "mean") -> np.ndarray:
    """Token vectors (texts x tokens x dims) to unit text vectors by the first token or the masked mean."""
    if how not in ("mean", "cls"):
        raise ValueError("pooling must be 'mean' or 'cls'")
    out = vectors[:, 0] if how == "cls" else (vectors * mask[..., None]).sum(1) / np.maximum(mask.sum(1, keepdims=True), 1)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm > 0, norm, 1)
