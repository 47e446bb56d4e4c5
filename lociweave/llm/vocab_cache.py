"""Ids of whole texts through a library tokenizer that sees each word once.

BPE works inside pre-tokens only, so a text's ids are those of its pre-tokens
one after the other. A worker keeps the ids of the pieces (a word and what
clings to it) that it has met.
"""

from __future__ import annotations

import json
import os
import sys
from array import array
from functools import lru_cache

from .common import release_memory
from .pretokens import byte_chars, byte_chunks, byte_level, specials_splitter

if array("I").itemsize != 4 or sys.byteorder != "little":
    raise ImportError("ids are written as little-endian 32-bit integers")

_MOST = 500_000  # pieces kept by a worker


class ByteTokenizer:
    """The byte-level vocabulary of a ``tokenizers`` file."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec["pre_tokenizer"]
        if spec["normalizer"] or spec["post_processor"] or pre != {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}:
            raise ValueError(f"{path}: only plain byte-level vocabularies are known here")
        if any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError(f"{path}: only exact added tokens are known here")
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._split = specials_splitter(list(self.added))
        self._library = Tokenizer.from_file(path)
        self._library.no_truncation()
        self._library.no_padding()
        self._chunks: dict[str, bytes] = {}
        self._piece = self._piece_encoder(spec["model"])

    def _piece_encoder(self, model: dict):
        """The same merges in ``tiktoken``, several times faster on single
        pre-tokens; only where ids follow the order of the merges."""
        v = model["vocab"]
        made = [v[a + b] for a, b in model["merges"]]
        if made != sorted(set(made)) or len(v) != len(made) + 256:
            return None
        import tiktoken

        byte = {c: b for b, c in byte_chars().items()}
        ranks = {bytes(map(byte.__getitem__, t)): i for t, i in v.items()}
        core = getattr(tiktoken.Encoding("own", pat_str=".", mergeable_ranks=ranks, special_tokens={}), "_core_bpe", None)
        return getattr(core, "encode_single_piece", None)

    def _chunk(self, chunk: str) -> bytes:
        words = byte_level(chunk)
        if self._piece:
            return b"".join([array("I", self._piece(w.encode())).tobytes() for w in words])
        return array("I", [i for e in self._library.encode_batch(words, add_special_tokens=False) for i in e.ids]).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        out = []
        for text in texts:
            parts = self._split.split(text) if self._split and any(s in text for s in self.added) else (text,)
            got = []
            for k, part in enumerate(parts):
                before = len(got)
                if k % 2:
                    got.append(self.added[part].to_bytes(4, "little"))
                    continue
                if not part:
                    continue
                pieces = byte_chunks(part)
                chunks = self._chunks
                try:
                    got.extend(map(chunks.__getitem__, pieces))
                except KeyError:
                    if len(chunks) > _MOST:
                        chunks.clear()
                    for c in set(pieces).difference(chunks):
                        chunks[c] = self._chunk(c)
                    del got[before:]
                    got.extend(map(chunks.__getitem__, pieces))
            out.append(b"".join(got))
        return out


    def forget(self) -> None:
        """Drops what a task has learnt; its worker may go on to other work."""
        self._chunks.clear()
        release_memory()


@lru_cache(maxsize=2)
def byte_tokenizer(path: str) -> ByteTokenizer:
    return ByteTokenizer(path)
