"""A small BERT encoder on arrays: word pieces, transformer, mean pooling.

The weights are a parameter (a safetensors file and a vocabulary); none are shipped.
"""

from __future__ import annotations

import json
import re
import struct
import unicodedata
from collections.abc import Iterable
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# Element types of the tensor file format.
_KINDS = {"F64": "<f8", "F32": "<f4", "F16": "<f2", "BF16": "<u2", "I64": "<i8", "I32": "<i4", "I16": "<i2", "I8": "i1", "U8": "u1", "BOOL": "?"}
_PIECE = re.compile(r"[a-z0-9]+|[^\sa-z0-9]")


def read_safetensors(data: bytes) -> dict[str, np.ndarray]:
    """Tensors by name, without a leading 'bert.'; floating types as float32."""
    (size,) = struct.unpack_from("<Q", data)
    tensors = {}
    for name, entry in json.loads(data[8 : 8 + size]).items():
        if name == "__metadata__":
            continue
        start, end = entry["data_offsets"]
        flat = np.frombuffer(data, np.dtype(_KINDS[entry["dtype"]]), (end - start) // np.dtype(_KINDS[entry["dtype"]]).itemsize, 8 + size + start)
        if entry["dtype"] == "BF16":  # the upper half of a float32
            flat = (flat.astype(np.uint32) << 16).view(np.float32)
        elif flat.dtype.kind == "f":
            flat = flat.astype(np.float32)
        tensors[name.removeprefix("bert.")] = flat.reshape(entry["shape"])
    return tensors


class WordPieces:
    """Greedy longest-match word pieces of lower-cased words without accents."""

    def __init__(self, vocabulary: Iterable[str]):
        self.ids = {w: i for i, w in enumerate(vocabulary)}
        self.special = {n: self.ids[n] for n in ("[PAD]", "[UNK]", "[CLS]", "[SEP]")}

    def words(self, text: str) -> list[str]:
        plain = "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) != "Mn").lower()
        return _PIECE.findall(plain)

    def pieces(self, word: str) -> list[int]:
        """[UNK] for the whole word if any part of it has no piece."""
        out, at = [], 0
        while at < len(word):
            for end in range(len(word), at, -1):
                found = self.ids.get(("##" if at else "") + word[at:end])
                if found is not None:
                    break
            else:
                return [self.special["[UNK]"]]
            out.append(found)
            at = end
        return out

    def encode(self, texts: list[str | None], length: int) -> tuple[np.ndarray, np.ndarray]:
        """Padded ids between [CLS] and [SEP], cut to ``length``, and the mask of real ones."""
        rows = []
        for text in texts:
            own = [p for w in self.words(text or "") for p in self.pieces(w)]
            rows.append([self.special["[CLS]"], *own[: length - 2], self.special["[SEP]"]])
        width = max(map(len, rows), default=2)
        ids = np.full((len(rows), width), self.special["[PAD]"], np.int64)
        mask = np.zeros((len(rows), width), np.float32)
        for i, row in enumerate(rows):
            ids[i, : len(row)], mask[i, : len(row)] = row, 1
        return ids, mask


class Encoder:
    def __init__(self, tensors: dict[str, np.ndarray], pieces: WordPieces, heads: int = 2, length: int = 96, epsilon: float = 1e-12):
        self.t, self.pieces, self.heads, self.epsilon = tensors, pieces, heads, epsilon
        self.length = max(16, min(512, length))
        self.layers = 1 + max((int(k.split(".")[2]) for k in tensors if k.startswith("encoder.layer.")), default=-1)

    def _linear(self, x, name):
        return x @ self.t[f"{name}.weight"].T + self.t[f"{name}.bias"]

    def _normed(self, x, name):
        centred = x - x.mean(-1, keepdims=True)
        scale = np.sqrt((centred**2).mean(-1, keepdims=True) + self.epsilon)
        return centred / scale * self.t[f"{name}.weight"] + self.t[f"{name}.bias"]

    def encode(self, texts: list[str | None]) -> np.ndarray:
        """A vector of length 1 per text: the mean over its real pieces."""
        ids, mask = self.pieces.encode(texts, self.length)
        n, width = ids.shape
        e = "embeddings"
        x = self.t[f"{e}.word_embeddings.weight"][ids] + self.t[f"{e}.position_embeddings.weight"][:width] + self.t[f"{e}.token_type_embeddings.weight"][0]
        x = self._normed(x, f"{e}.LayerNorm")
        hidden = (1 - mask)[:, None, None, :] * -10000.0
        for i in range(self.layers):
            at = f"encoder.layer.{i}"
            q, k, v = (self._linear(x, f"{at}.attention.self.{p}").reshape(n, width, self.heads, -1).swapaxes(1, 2) for p in ("query", "key", "value"))
            score = q @ k.swapaxes(-1, -2) / np.sqrt(q.shape[-1]) + hidden
            score = np.exp(score - score.max(-1, keepdims=True))
            mixed = (score / score.sum(-1, keepdims=True) @ v).swapaxes(1, 2).reshape(n, width, -1)
            x = self._normed(x + self._linear(mixed, f"{at}.attention.output.dense"), f"{at}.attention.output.LayerNorm")
            y = self._linear(x, f"{at}.intermediate.dense")
            y = 0.5 * y * (1 + np.tanh(np.sqrt(2 / np.pi) * (y + 0.044715 * y**3)))
            x = self._normed(x + self._linear(y, f"{at}.output.dense"), f"{at}.output.LayerNorm")
        pooled = (x * mask[..., None]).sum(1) / np.maximum(mask.sum(1, keepdims=True), 1)
        length = np.linalg.norm(pooled, axis=1, keepdims=True)
        return np.divide(pooled, length, out=np.zeros_like(pooled), where=length > 0)


def bert_embed(docs: DataFrame, weights: str, vocabulary: str, heads: int = 2, length: int = 96, batch: int = 64) -> DataFrame:
    """(id, vector) of docs(id bigint, text) with the encoder in ``weights`` and ``vocabulary``.

    Both are paths that every executor can read; each worker loads them once.
    """
    batch = max(1, min(128, batch))

    def embed(batches):
        model = Encoder(read_safetensors(Path(weights).read_bytes()), WordPieces(Path(vocabulary).read_text(encoding="utf-8").splitlines()), heads, length)
        for b in batches:
            texts, out = b.column(1).to_pylist(), []
            for at in range(0, len(texts), batch):
                out += model.encode(texts[at : at + batch]).astype(np.float32).tolist()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.float32()))], names=["id", "vector"])

    return docs.select("id", "text").mapInArrow(embed, "id bigint, vector array<float>")
