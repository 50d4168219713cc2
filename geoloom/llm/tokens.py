"""Ids of whole texts by the tokenizers library, which is asked once for each distinct chunk that a worker remembers.

No piece, special token or normalisation reaches across white space in the supported files, so a text's ids are its
chunks' ids one after the other (tests compare with the library's own answer for whole texts). Texts are brought to NFC and
lower case first, as the files' normalisers do, and a run of ASCII punctuation between a letter and white space is parted from its
word, which it never shares a piece with; words then come back whatever their case and punctuation. Texts in which a special
token may stand are cut into chunks as they are. Chunks of small letters are single pieces and go straight to the library's
model, many at a time: each one's last id, and no other, is that of a token with the end-of-word mark.

What is remembered is bounded in bytes; chunks over LONG characters are never remembered.
"""

from __future__ import annotations

import os
import re
import unicodedata
from array import array
from functools import lru_cache

import numpy as np

from geoloom.llm.arrow import claim
from geoloom.llm.bpe import byte_symbols, chunks, read_spec, vocabulary_path

#: Bytes that each of a worker's two generations of remembered chunks takes, about.
REMEMBERED = 96 << 20
LONG = 64
#: What a remembered chunk takes besides its characters and ids.
_ENTRY = 190
_PARTED = re.compile(r"[!-/:-@\[-`{-~](?<=[a-zß-öø-ÿ].)[!-/:-@\[-`{-~]*(?=[ \n])")
#: Words that the model gets as one sequence.
_TOGETHER = 512


class ChunkEncoder:
    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.code = "H" if self.library.get_vocab_size() <= 1 << 16 else "I"
        self.type = np.dtype("<u2" if self.code == "H" else "<u4")
        spec = read_spec(path)  # refuses files whose pieces could be cut otherwise
        self.special = [x["content"] for x in spec["added_tokens"]]
        self.model = Tokenizer.from_file(path)
        self.model.normalizer = self.model.pre_tokenizer = None
        self.symbol = dict(enumerate(byte_symbols()))
        self.last = np.zeros(self.library.get_vocab_size(), bool)
        self.last[[i for x, i in spec["model"]["vocab"].items() if x.endswith(spec["model"]["end_of_word_suffix"])]] = True
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.held = 0

    def chunks(self, text: str) -> list[str]:
        """Chunks that have the text's ids one after the other."""
        low = text.lower() if text.isascii() else self._low(text)
        if "<" in low and any(x in low for x in self.special):
            return chunks(text)
        return chunks(_PARTED.sub(r" \g<0>", low))

    @staticmethod
    def _low(text: str) -> str:
        text = unicodedata.normalize("NFC", text)
        # As a whole, a capital sigma would be lower-cased by its place in the word.
        return "".join([x.lower() for x in text]) if "Σ" in text else text.lower()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        found = [self.chunks(x) for x in texts]
        young, old = self.young, self.old
        new = set().union(*found) if found else set()
        new.difference_update(young)
        ask = []
        for c in new:
            if (ids := old.get(c)) is None:
                ask.append(c)
            else:
                young[c] = ids
        if ask:
            self._learn(ask)
        out = [np.frombuffer(b"".join(map(young.__getitem__, x)), self.type) for x in found]
        long = 0
        for c in new:
            if len(c) > LONG:
                del young[c]
                long += 1
        self.held += (len(new) - long) * _ENTRY
        if self.held > REMEMBERED:
            self.old, self.young, self.held = young, {}, 0
        return out

    def _learn(self, ask: list[str]) -> None:
        young, code = self.young, self.code
        plain = [c for c in ask if c.isalpha() and c.islower()]
        if plain:
            mapped = [x if x.isascii() else x.encode().decode("latin-1").translate(self.symbol) for x in plain]
            runs = [mapped[k : k + _TOGETHER] for k in range(0, len(mapped), _TOGETHER)]
            ids = np.concatenate([np.array(e.ids, self.type) for e in self.model.encode_batch_fast(runs, is_pretokenized=True, add_special_tokens=False)])
            stop = ((np.flatnonzero(self.last[ids]) + 1) * self.type.itemsize).tolist()
            if len(stop) != len(plain):
                raise ValueError("a word's last id has no end-of-word mark")
            raw, at = ids.tobytes(), 0
            for x, to in zip(plain, stop, strict=True):
                young[x] = raw[at:to]
                at = to
        whole = [c for c in ask if c not in young]
        if whole:
            for c, e in zip(whole, self.library.encode_batch_fast(whole, add_special_tokens=False), strict=True):
                young[c] = array(code, e.ids).tobytes()


@lru_cache(maxsize=1)
def _chunk_encoder(path: str) -> ChunkEncoder:
    return ChunkEncoder(path)


def chunk_encoder(path: str) -> ChunkEncoder:
    """One per Python worker, as long as it does nothing else."""
    claim("tokens", _chunk_encoder.cache_clear)
    return _chunk_encoder(path)


__all__ = ["ChunkEncoder", "chunk_encoder", "vocabulary_path"]
