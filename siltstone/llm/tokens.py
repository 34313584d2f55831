"""Encoding of whole texts with a public tokenizer file, fast enough for a whole corpus.

The ids are always those of the ``tokenizers`` library for the given file:

* ``lead``: a byte-level tokenizer without a normalizer, whose merges are numbered in the order of their ids.  The
  vocabulary of the file is handed to ``tiktoken``, which then does the same merges much faster.
* ``apart``: a tokenizer that drops white space, never merges across it and marks the end of each pre-token.  Each
  distinct word of a batch is encoded once (words told apart by 64-bit hashes, so that a wrong id needs a collision of two
  words in one worker's cache) and the ids are gathered.  Words of Latin letters go through ``tiktoken`` with a byte 0 as
  the end mark, all others through ``tokenizers``.
* ``whole``: any other tokenizer encodes each text as it is.  So does every kind with texts that may hold an added token
  of the file (``<|endoftext|>``), which ``tokenizers`` cuts out before anything else.

On first use the fast ways are compared with ``tokenizers`` on probe texts, and dropped if they ever differ.
"""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from siltstone.llm.shared import joined, word_hashes

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Fixed value: the pre-tokenizer pattern that byte-level tokenizers of this kind build in.
BYTE_LEVEL = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_PROBES = ["It's we'll  I'D a1b22 été\n\n x \t!", " lead trail  ", "<|endoftext|> a  b   c", "日本語 テスト", "x́ Σ ΑΣ", "a\xa0b \x85\x1c c"]


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies: itself if printable Latin-1, else 256, 257, ..."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """``encode(column)`` gives (ids of all texts as uint32, number of ids of each text), without special tokens."""

    def __init__(self, path: str, cache_words: int = 1_000_000):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, norm = spec.get("pre_tokenizer") or {}, json.dumps(spec.get("normalizer"))
        self.kind = "whole"
        if spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space"):
            self.kind = "lead" if self._ranked(spec) else "whole"
        elif '"\\\\s+"' in norm and pre.get("type") == "Sequence" and pre["pretokenizers"][0].get("behavior") == "Removed":
            self.kind = "apart" if self._marked(spec) else "whole"
        added = spec.get("added_tokens") or []
        if spec.get("normalizer") is not None and any(t["normalized"] for t in added):
            self.kind = "whole"  # such a token is looked for in normalized texts, not in these
        self.added = [t["content"] for t in added]
        self.limit = cache_words
        self._clear()
        if self.kind != "whole" and not self._agrees():
            self.kind = "whole"

    def _ranked(self, spec: dict) -> bool:
        """Hand the vocabulary to tiktoken, if its ids follow the order of the merges."""
        import tiktoken

        vocab, letters = spec["model"]["vocab"], byte_alphabet()
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        order = [vocab.get(a + b, -1) for a, b in merges]
        if len(vocab) != 256 + len(merges) or any(x >= y for x, y in zip(order, order[1:], strict=False)) or not order or order[0] != 256:
            return False
        ranks = {bytes(letters[c] for c in token): i for token, i in vocab.items()}
        self.fast = tiktoken.Encoding("own", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={})
        return True

    def _marked(self, spec: dict) -> bool:
        """The same for a vocabulary whose pre-tokens end in a mark: ids 0-255 bytes, 256-511 marked bytes, then the merges."""
        import tiktoken

        model, pattern = spec["model"], spec["pre_tokenizer"]["pretokenizers"][0]["pattern"].get("Regex")
        vocab, letters, mark = model["vocab"], byte_alphabet(), model.get("end_of_word_suffix")
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        if not mark or not pattern or [vocab.get(a + b) for a, b in merges] != list(range(512, 512 + len(merges))) or len(vocab) != 512 + len(merges):
            return False
        ranks = {}
        for token, i in vocab.items():
            ended = token.endswith(mark) and len(token) > len(mark)
            body = bytes(letters[c] for c in (token[: -len(mark)] if ended else token))
            if body != b"\0":  # it stands for the mark; words that hold one go the slow way
                ranks[body + b"\0" * ended] = i
        ranks[b"\0"] = len(vocab)
        self.fast = tiktoken.Encoding("own", pat_str=r"[^\x00]+\x00", mergeable_ranks=ranks, special_tokens={})
        self.pieces = regex.compile(pattern)
        self.ends = np.zeros(len(vocab) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith(mark) and len(t) > len(mark)]] = True
        return True

    def _encode_new(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, number of ids of each)."""
        pieces, counts, slow = [], np.zeros(len(words), np.int64), []
        for i, word in enumerate(words):
            if word.isascii() and word.isalpha():
                pieces.append(word.lower())
                counts[i] = 1
            elif "\0" in word or max(word) > "\u024f" or "\u0130" in word:
                slow.append(i)
            else:
                found = self.pieces.findall(word.lower())
                pieces += found
                counts[i] = len(found)
        flat = np.array(self.fast.encode_ordinary("\0".join(pieces) + "\0") if pieces else [], np.uint32)
        stops = np.concatenate(([0], np.flatnonzero(self.ends[flat]) + 1))[np.concatenate(([0], np.cumsum(counts)))]
        counts = np.diff(stops)
        if slow:
            rows = [flat[a:b] for a, b in zip(stops[:-1], stops[1:], strict=True)]
            for i, e in zip(slow, self.tok.encode_batch_fast([words[i] for i in slow], add_special_tokens=False), strict=True):
                rows[i], counts[i] = np.array(e.ids, np.uint32), len(e.ids)
            flat = np.concatenate(rows)
        return flat, counts

    def _agrees(self) -> bool:
        ids, counts = self.encode(pa.array(_PROBES))
        want = [self.tok.encode(t, add_special_tokens=False).ids for t in _PROBES]
        return ids.tolist() == [x for w in want for x in w] and counts.tolist() == [len(w) for w in want]

    def _clear(self) -> None:
        self.keys = np.empty(0, np.uint64)
        self.place = np.empty(0, np.int64)
        self.flat = np.empty(0, np.uint32)
        self.offset = np.zeros(1, np.int64)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if self.kind == "whole" or not self.added:
            return self._encode_plain(column)
        marked = np.zeros(len(column), bool)
        for content in self.added:
            marked |= pc.fill_null(pc.match_substring(column, content), False).to_numpy(zero_copy_only=False)
        if not marked.any():
            return self._encode_plain(column)
        ids, counts = self._encode_plain(pc.if_else(pa.array(marked), pa.scalar("", column.type), column))
        at = np.flatnonzero(marked)
        rows = np.split(ids, np.cumsum(counts)[:-1])
        for i, e in zip(at.tolist(), self.tok.encode_batch_fast(column.take(pa.array(at)).to_pylist(), add_special_tokens=False), strict=True):
            rows[i], counts[i] = np.array(e.ids, np.uint32), len(e.ids)
        return np.concatenate(rows), counts

    def _encode_plain(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if self.kind == "lead":
            rows = [self.fast.encode_ordinary(t) if t else () for t in column.to_pylist()]
        elif self.kind == "whole":
            rows = [e.ids for e in self.tok.encode_batch_fast([t or "" for t in column.to_pylist()], add_special_tokens=False)]
        else:
            return self._encode_words(column)
        counts = np.fromiter(map(len, rows), np.int64, len(rows))
        return (np.concatenate([np.array(r, np.uint32) for r in rows]) if len(rows) else np.empty(0, np.uint32)), counts

    def _encode_words(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        data, starts = joined(column)
        hashes, first, begin, end = word_hashes(data, starts, spans=True, lower=False)
        keys, one, which = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.keys) > self.limit:
            self._clear()
        at = np.searchsorted(self.keys, keys)
        known = (self.keys[np.minimum(at, len(self.keys) - 1)] == keys) if len(self.keys) else np.zeros(len(keys), bool)
        if not known.all():
            raw = data.tobytes()
            new = np.flatnonzero(~known)
            words = [raw[b:e].decode() for b, e in zip(begin[one[new]].tolist(), end[one[new]].tolist(), strict=True)]
            ids, lens = self._encode_new(words)
            self.keys, self.place = np.insert(self.keys, at[new], keys[new]), np.insert(self.place, at[new], len(self.offset) - 1 + np.arange(len(new)))
            self.offset = np.concatenate((self.offset, self.offset[-1] + np.cumsum(lens)))
            self.flat = np.concatenate((self.flat, ids))
            at = np.searchsorted(self.keys, keys)
        words = self.place[at][which] if len(keys) else np.empty(0, np.int64)
        from_ = self.offset[words]
        lens = self.offset[words + 1] - from_
        ends = np.concatenate(([0], np.cumsum(lens)))
        where = np.arange(int(ends[-1]), dtype=np.int64)
        where += np.repeat(from_ - ends[:-1], lens)
        return self.flat[where], np.diff(ends[first])
