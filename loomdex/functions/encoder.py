"""A sentence encoder from a local folder: ``tokenizer.json`` and ``model.onnx``; nothing is downloaded.

Texts are cut to ``EMBEDDING_CHARS`` characters and ``EMBEDDING_TOKENS`` tokens, token vectors
averaged over the tokens that aren't padding, and the mean scaled to length one.
"""

from __future__ import annotations

from collections.abc import Sequence
from pathlib import Path
from typing import Any

import numpy as np

from loomdex.functions.text import EMBEDDING_CHARS, EMBEDDING_TOKENS

BATCH = 32


class MissingModel(FileNotFoundError):
    """The folder lacks a file, or a library to read it isn't there: search goes on without the semantic signal."""


class LocalEncoder:
    """Texts to vectors.  It is loaded where it is first used, so that it can be sent to workers by its path."""

    def __init__(self, folder: str, tokenizer: Any = None, session: Any = None) -> None:
        self.folder, self._tokenizer, self._session = folder, tokenizer, session

    def __getstate__(self) -> dict:
        return {"folder": self.folder, "_tokenizer": None, "_session": None}

    def _load(self) -> None:
        if self._session is not None:
            return
        files = [Path(self.folder, n) for n in ("tokenizer.json", "model.onnx")]
        for f in files:
            if not f.is_file():
                raise MissingModel(f"{f} isn't there")
        try:
            import onnxruntime
            from tokenizers import Tokenizer
        except ImportError as e:
            raise MissingModel(str(e)) from e
        self._tokenizer = Tokenizer.from_file(str(files[0]))
        options = onnxruntime.SessionOptions()
        options.intra_op_num_threads = 1  # tasks are the parallelism
        self._session = onnxruntime.InferenceSession(str(files[1]), options, providers=["CPUExecutionProvider"])

    def __call__(self, texts: Sequence[str]) -> list[list[float]]:
        self._load()
        out: list[list[float]] = []
        for i in range(0, len(texts), BATCH):
            out += self._encode([t[:EMBEDDING_CHARS] for t in texts[i : i + BATCH]])
        return out

    def _encode(self, texts: list[str]) -> list[list[float]]:
        ids = [e.ids[:EMBEDDING_TOKENS] for e in self._tokenizer.encode_batch(texts)]
        width = max(1, max(map(len, ids)))
        tokens, mask = np.zeros((len(ids), width), np.int64), np.zeros((len(ids), width), np.int64)
        for row, own in enumerate(ids):
            tokens[row, : len(own)], mask[row, : len(own)] = own, 1
        asked = {x.name for x in self._session.get_inputs()}
        given = {"input_ids": tokens, "attention_mask": mask, "token_type_ids": np.zeros_like(tokens)}
        vectors = np.asarray(self._session.run(None, {k: v for k, v in given.items() if k in asked})[0], np.float32)
        mean = (vectors * mask[:, :, None]).sum(1) / np.maximum(mask.sum(1, keepdims=True), 1)
        size = np.sqrt((mean * mean).sum(1, keepdims=True))
        return (mean / np.where(size > 0, size, 1)).tolist()
