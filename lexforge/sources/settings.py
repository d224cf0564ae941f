"""Settings from the environment (SRC-23, D23)."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields

from lexforge.functions import fixed as X

EMBEDDERS = ("torch", "onnx-fp32", "onnx-int8")
RERANKERS = ("kapali", "torch", "onnx-fp32", "onnx-int8")
TRUE = ("1", "true", "evet", "yes", "on")


@dataclass(frozen=True)
class Settings:
    """Field names in capitals are the variables' names; an empty variable counts as unset."""

    korpus_yol: str = "data/kanun/korpus.jsonl"
    aday_k: int = X.CANDIDATES
    w_dense: float = X.WEIGHTS[0]
    w_sparse: float = X.WEIGHTS[1]
    w_bm25: float = X.WEIGHTS[2]
    embed_backend: str = "torch"
    rerank_backend: str = "kapali"
    rerank_aday: int = X.RERANK_HEAD
    rerank_max_len: int = 512
    rerank_max_krk: int = X.RERANK_CHARS
    rerank_varsayilan: bool = False
    model_dir: str = "models/onnx"
    ort_threads: int = 4

    @property
    def weights(self) -> tuple[float, float, float]:
        return self.w_dense, self.w_sparse, self.w_bm25

    @classmethod
    def read(cls, env: Mapping[str, str] = os.environ) -> Settings:
        def typed(f):
            said = env.get(f.name.upper()) or None
            if said is None:
                return f.default
            return said.strip().lower() in TRUE if f.type == "bool" else {"int": int, "float": float}.get(f.type, str)(said)

        s = cls(**{f.name: typed(f) for f in fields(cls)})
        if s.embed_backend not in EMBEDDERS:
            raise ValueError(f"EMBED_BACKEND={s.embed_backend!r}: one of {EMBEDDERS}")
        if s.rerank_backend not in RERANKERS:
            raise ValueError(f"RERANK_BACKEND={s.rerank_backend!r}: one of {RERANKERS}")
        return s
