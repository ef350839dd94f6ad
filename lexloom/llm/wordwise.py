"""Token ids of whole texts from the tokenizers library, which sees each word once.

Byte-pair merges stay inside the pieces that a vocabulary's own pattern cuts a text into, so a text may be cut wherever
that pattern never looks across, and the pieces' ids joined. Where white space is dropped and no pattern holds any, that
is at each space and line feed. Vocabularies that are not of this kind (by their file) are handed whole texts.

A batch of texts is cut and its distinct pieces are numbered by Arrow; only these are looked up, one by one. Pieces are
kept until a bound is reached; frequent ones are among the first, so what comes later is looked up for its own batch
alone. Words of Latin letters that are not known are handed to the library many at a time, in one text with spaces
between, and cut apart again by the vocabulary's own mark of where words end.
"""

from __future__ import annotations

import json
import re
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces that a worker keeps (some 100 MB), and the longest that it keeps.
KEPT, LONGEST = 500_000, 64
#: Words in one text for the library.
TOGETHER = 5000
#: Fixed value: the pattern of vocabularies that drop white space.
APART = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?]*)\Z")


def drops_space(config: dict) -> bool:
    """Whether a tokenizer's file says that white space is dropped and parts what stands on its sides."""
    pre, norm, model = config.get("pre_tokenizer") or {}, config.get("normalizer") or {}, config.get("model", {})
    steps = pre.get("pretokenizers", [{}])
    split = steps[0].get("type") == "Split" and steps[0].get("pattern") == {"Regex": APART} and steps[0].get("behavior") == "Removed" and steps[0].get("invert")
    then = [x.get("type") for x in steps[1:]] == ["ByteLevel"] and not steps[1].get("add_prefix_space")
    plain = [x["type"] for x in norm.get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
    return bool(split and then and plain and model.get("type") == "BPE" and not model.get("dropout") and model.get("end_of_word_suffix"))


class Encoder:
    """Ids of texts; no special tokens are added, and strings of special tokens are what the library makes of them."""

    def __init__(self, tokenizer_file: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(tokenizer_file)
        self.library.no_truncation()
        self.library.no_padding()
        config = json.loads(Path(tokenizer_file).read_text(encoding="utf-8"))
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        self.size = max(vocabulary.values()) + 1
        self.apart = drops_space(config)
        #: Little-endian unsigned integers of two bytes, or four if the vocabulary needs them.
        self.dtype = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self.ends_word = np.zeros(self.size, dtype=bool)
        if self.apart:
            for piece, k in vocabulary.items():
                self.ends_word[k] = piece.endswith(config["model"]["end_of_word_suffix"])
        self.known: dict[str, bytes] = {"": b""}

    def direct(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of words of Latin letters."""
        found: list[bytes] = []
        for k in range(0, len(words), TOGETHER):
            some = words[k : k + TOGETHER]
            ids = np.array(self.library.encode(" ".join(some), add_special_tokens=False).ids, self.dtype)
            cuts = np.append(0, np.flatnonzero(self.ends_word[ids]) + 1)
            if len(cuts) != len(some) + 1 or cuts[-1] != len(ids):  # a mark in an unforeseen place
                found += self.direct(some)
                continue
            raw, ends = ids.tobytes(), (cuts * self.dtype.itemsize).tolist()
            found += [raw[a:b] for a, b in zip(ends, ends[1:], strict=False)]
        return found

    def _looked_up(self, missing: list[str]) -> dict[str, bytes]:
        """Ids of pieces that are not known."""
        cut = {p: m for p in missing if len(p) <= LONGEST and (m := PLAIN.match(p))}
        words = {m[1].lower() for m in cut.values()}
        known = {w: self.known[w] for w in words if w in self.known}
        rest = {p for p in missing if p not in cut} | {m[2] for m in cut.values()}
        for some, find in ((list(words - known.keys()), self._words), (list(rest), self.direct)):
            known.update(zip(some, find(some), strict=True))
        return {p: known[m[1].lower()] + known[m[2]] if (m := cut.get(p)) else known[p] for p in missing}

    def pieces(self, pieces: list[str]) -> list[bytes]:
        """Ids of distinct pieces."""
        found = list(map(self.known.get, pieces))
        at = [k for k, x in enumerate(found) if x is None]
        if at:
            new = self._looked_up([pieces[k] for k in at])
            for k in at:
                found[k] = new[pieces[k]]
            if len(self.known) < KEPT:
                self.known.update((p, x) for p, x in new.items() if len(p) <= LONGEST)
        return found

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and where each text's begin (and the last one's end)."""
        texts = texts.cast(pa.large_string())
        if not self.apart:
            found = self.direct(texts.to_pylist())
            return np.frombuffer(b"".join(found), self.dtype), np.append(0, np.cumsum([len(x) // self.dtype.itemsize for x in found], dtype=np.int64))
        cut = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        offsets = cut.offsets.to_numpy()
        numbered = cut.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
        codes = numbered.indices.to_numpy()
        found = self.pieces(numbered.dictionary.to_pylist())
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // self.dtype.itemsize
        return gathered(np.frombuffer(b"".join(found), self.dtype), sizes, codes, offsets - offsets[0])


def gathered(values: np.ndarray, sizes: np.ndarray, codes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of ``values`` (of the given sizes, one after the other), written out in the order of ``codes``, and where what
    stands between two ``offsets`` into the codes begins in the result."""
    own = sizes[codes]
    begun = np.append(0, np.cumsum(own))
    from_ = np.append(0, np.cumsum(sizes))[:-1][codes]
    at = np.repeat(from_ - begun[:-1], own) + np.arange(begun[-1])
    return values[at], begun[offsets]


_ENCODERS: dict[str, Encoder] = {}


def encoder(tokenizer_file: str) -> Encoder:
    """One per worker process, as loading takes a second."""
    if tokenizer_file not in _ENCODERS:
        _ENCODERS[tokenizer_file] = Encoder(tokenizer_file)
    return _ENCODERS[tokenizer_file]
