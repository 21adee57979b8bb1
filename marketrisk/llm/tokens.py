"""Token ids of whole texts from a public vocabulary, each distinct piece of a batch encoded once.

Byte-level BPE never merges across a space that follows another character, so a text may be cut there: the ids of
the pieces, joined, are the ids of the text.  Arrow finds the distinct pieces of some megabytes of text, and those
are encoded as one string of which the ids' byte lengths tell the pieces apart.  The ids come from tiktoken over the
ranks of the vocabulary, and equal those of the tokenizers library, special token included, at its defaults.

Defined cases: a null or empty text has no id; the string of a special token gives that token's id, as the library
does by default; a text without spaces is one piece.
"""

from __future__ import annotations

import base64
import json

import numpy as np
import pyarrow as pa

from marketrisk.llm.textbytes import chunks, utf8

#: Vocabulary file of the tokenizers library, and the ranks of the same vocabulary.
VOCABULARY, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"
#: Texts encoded together, in bytes.
TOGETHER = 8 << 20


def library_encoder(vocabulary: str = VOCABULARY):
    """The tokenizer of the library, at its defaults."""
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(vocabulary))


def _ends_in_blank(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Whether the character before each position may be white space (or is none); never no when it is."""
    last = data[np.maximum(ends - 1, 0)]
    two, three = data[np.maximum(ends - 2, 0)], data[np.maximum(ends - 3, 0)]
    plain = (last > 32) & (last < 127)
    wide = (last >= 128) & (two != 0xC2) & ((three < 0xE1) | (three > 0xE3)) & (ends >= 3)
    return ~(plain | wide)


def cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where pieces begin, texts' own starts included, and the end of the last: rising positions in ``data``.

    A piece begins at a space after a character that is certainly no white space.
    """
    first, last = int(offsets[0]), int(offsets[-1])
    spaces = np.flatnonzero(data[first:last] == 32) + first
    spaces = spaces[(spaces > first) & ~_ends_in_blank(data, spaces)]
    edge = np.zeros(last - first + 1, bool)
    edge[spaces - first] = True
    edge[offsets - first] = True
    return np.flatnonzero(edge) + first


class Encoder:
    """Ids of a column of texts."""

    def __init__(self, vocabulary: str = VOCABULARY, ranks: str = RANKS):
        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(ranks), "rb") as lines:
            merges = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        with open(public_tokenizers.path(vocabulary), encoding="utf-8") as file:
            special = {t["content"]: t["id"] for t in json.load(file)["added_tokens"]}
        self._bpe = tiktoken.Encoding(
            ranks, pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens=special
        )
        self._bytes = np.zeros(self._bpe.max_token_value + 1, np.int64)
        for token, rank in merges.items():
            self._bytes[rank] = len(token)
        for token, rank in special.items():
            self._bytes[rank] = len(token.encode())

    def text(self, text: str) -> np.ndarray:
        return self._bpe.encode_to_numpy(text, allowed_special="all")

    def _distinct(self, pieces: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces one after another, number of ids of each)."""
        data, offsets = utf8(pieces)
        begins, ends = offsets[:-1], offsets[1:]
        # One string, unless white space at the end of a piece or a missing one at the start would change the ids.
        apart = (data[np.minimum(begins, max(len(data) - 1, 0))] != 32) | _ends_in_blank(data, ends)
        joined, bounds = utf8(pieces.filter(pa.array(~apart)))
        together = self.text(joined[bounds[0] : bounds[-1]].tobytes().decode())
        upto = np.searchsorted(np.cumsum(self._bytes[together]), bounds[1:] - bounds[0], "right")
        counts = np.zeros(len(pieces), np.int64)
        counts[~apart] = np.diff(upto, prepend=0)
        single = [self.text(p) for p in pieces.filter(pa.array(apart)).to_pylist()]
        counts[apart] = [len(x) for x in single]
        begins = np.cumsum(counts) - counts
        ids = np.empty(int(counts.sum()), np.uint32)
        of_joined = np.repeat(~apart, counts)
        ids[of_joined] = together
        ids[~of_joined] = np.concatenate([np.empty(0, np.uint32), *single])
        return ids, counts

    def _chunk(self, data: np.ndarray, where: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        edges = cuts(data, where)
        if len(edges) < 2:
            return np.empty(0, np.uint32), np.zeros(len(where) - 1, np.int64)
        pieces = pa.LargeStringArray.from_buffers(
            len(edges) - 1, pa.py_buffer(np.ascontiguousarray(edges, np.int64)), pa.py_buffer(data)
        )
        distinct = pieces.dictionary_encode()
        flat, lengths = self._distinct(distinct.dictionary)
        begins = np.cumsum(lengths) - lengths
        which = distinct.indices.to_numpy()
        n = lengths[which]
        ends = np.cumsum(n)
        ids = flat[np.arange(len(n) and ends[-1]) + np.repeat(begins[which] - (ends - n), n)]
        bounds = np.concatenate([[0], ends])[np.searchsorted(edges, where)]
        return ids, np.diff(bounds)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(all ids one after another, number of ids of each text)."""
        data, offsets = utf8(column)
        found = [self._chunk(data, offsets[a : b + 1]) for a, b in chunks(offsets, TOGETHER)]
        if not found:
            return np.empty(0, np.uint32), np.zeros(0, np.int64)
        return np.concatenate([x for x, _ in found]), np.concatenate([n for _, n in found])
