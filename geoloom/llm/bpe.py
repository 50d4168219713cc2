"""Exact byte-pair encoding and decoding by dynamic programming over prefixes.

A text falls into pieces that no merge crosses. For a piece, `PrefixEncoder` keeps for each prefix the one token with
which that prefix's encoding ends. An automaton reads the piece once: its state is the longest suffix read so far that some token
begins with, and it reports all tokens that are suffixes of the prefix, the longest first (the automaton of the vocabulary's
strings, built once, stands for one of each piece's own suffixes, which would be built anew for every piece and matched against the
vocabulary for the same list); the first one that is compatible with the last token of the prefix before it is the
answer for this prefix. Two tokens are compatible if encoding their joined strings gives just these two back, which is
decided by undoing their merges, the later one first, and looking for an earlier merge across the seam. Back-pointers
from the last prefix then give the ids.

Supported tokenizer files: BPE models with an end-of-word suffix, no byte fallback and no continuing prefix, the
normalisers NFC, white-space replacement and lower case, a removing split by regex followed by byte-level mapping,
and special tokens that are taken as they stand. Anything else is refused when the file is read.

Null and empty texts have no ids. Very long texts are handled piece by piece. Ids may be null or repeated: each row
gives one row.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from geoloom.llm import arrow

#: Bytes, about, that each of the two generations of each of a Python worker's memos takes.
REMEMBERED = 64 << 20
#: Chunks and pieces over this many characters aren't remembered.
LONG = 64


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Remembered(dict):
    """A memo bounded in bytes: when the young generation is full it becomes the old one; what is still asked for moves back."""

    def __init__(self, make: Callable, size: Callable, most: int = REMEMBERED) -> None:
        super().__init__()
        self.make, self.size, self.most, self.held, self.old = make, size, most, 0, {}

    def __missing__(self, key):
        got = self.old.get(key)
        if got is None:
            got = self.make(key)
        if len(key) > LONG:
            return got
        if self.held >= self.most:
            self.old, self.held = dict(self), 0
            self.clear()
        self[key] = got
        self.held += self.size(got) + len(key)
        return got


#: str.split() also cuts at these four controls, which are no white space to the tokenizers library.
_CONTROLS = ("\x1c", "\x1d", "\x1e", "\x1f")


def chunks(text: str) -> list[str]:
    """The runs between white space. Neither normalisation, nor special tokens, nor pieces reach across it."""
    for c in _CONTROLS:
        if c in text:
            import regex

            return [x for x in regex.split(r"[\t-\r \x85   -     　]+", text) if x]
    return text.split()


def byte_symbols() -> list[str]:
    """The public byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for code points from 256."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    shifted = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(shifted)) for b in range(256)]


def read_spec(path: str) -> dict:
    """The tokenizer file's content; ValueError for parts that aren't supported here."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, split = spec["model"], spec["pre_tokenizer"]["pretokenizers"][0]
    kinds = [x["type"] for x in spec["normalizer"]["normalizers"]], [x["type"] for x in spec["pre_tokenizer"]["pretokenizers"]]
    if model["type"] != "BPE" or kinds != (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]) or split["behavior"] != "Removed" or not split["invert"] or model.get("continuing_subword_prefix") or model.get("byte_fallback") or model.get("dropout") or not model.get("end_of_word_suffix"):
        raise ValueError("this tokenizer file has parts that aren't supported")
    return spec


class PrefixEncoder:
    def __init__(self, path: str) -> None:
        import ahocorasick
        import regex

        spec = read_spec(path)
        model, split = spec["model"], spec["pre_tokenizer"]["pretokenizers"][0]
        self.ids: dict[str, int] = model["vocab"]
        self.end = model["end_of_word_suffix"]
        self.pattern = regex.compile(split["pattern"]["Regex"])
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.strings = {i: s for s, i in self.ids.items()} | {i: s for s, i in self.special.items()}
        self.symbol = dict(enumerate(byte_symbols()))
        self.parts: dict[int, tuple[int, int, int]] = {}
        self.rank_of_pair: dict[tuple[int, int], int] = {}
        for rank, merge in enumerate(model["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            a, b, both = self.ids[left], self.ids[right], self.ids[left + right]
            self.rank_of_pair.setdefault((a, b), rank)
            self.parts.setdefault(both, (rank, a, b))
        alphabet = {s for s in self.symbol.values()} | {s + self.end for s in self.symbol.values()}
        self.fits: dict[tuple[int, int], bool] = {}
        # The end-of-word mark is one extra character, so that it only matches at a piece's end.
        self.automaton = ahocorasick.Automaton()
        for string, i in self.ids.items():
            if i in self.parts and self._whole(i) or i not in self.parts and string in alphabet:
                at_end = string.endswith(self.end) and string != self.end
                self.automaton.add_word(string[: -len(self.end)] + "\0" if at_end else string, (len(string) - len(self.end) if at_end else len(string), at_end, i))
        self.automaton.make_automaton()
        self.piece = Remembered(self._piece, lambda x: 200 + 8 * len(x))
        self.chunk = Remembered(self._chunk, lambda x: 320 + len(x[0]) + len(x[1]))

    def _whole(self, token: int) -> bool:
        """Whether merging this token's own string gives the token: its two parts must not merge in another way first."""
        rank, a, b = self.parts[token]
        return self.compatible(a, b, rank) and all(x not in self.parts or self._whole_memo(x) for x in (a, b))

    @lru_cache(maxsize=None)  # noqa: B019  lives as long as the encoder
    def _whole_memo(self, token: int) -> bool:
        return self._whole(token)

    def compatible(self, a: int, b: int, before: int = 1 << 60) -> bool:
        """Whether no merge of rank under `before` crosses the seam between a and b at the time it could."""
        parts, ranks, bound = self.parts, self.rank_of_pair, before
        while True:
            rank = ranks.get((a, b))
            if rank is not None and rank < bound:
                return False
            of_a, of_b = parts.get(a), parts.get(b)
            if of_a is None and of_b is None:
                return True
            if of_b is None or of_a is not None and of_a[0] > of_b[0]:
                bound, a = of_a[0], of_a[2]
            else:
                bound, b = of_b[0] + 1, of_b[1]

    def _piece(self, piece: str) -> tuple[int, ...]:
        """Ids of one piece (a string of byte symbols)."""
        n = len(piece)
        ending: list[list[tuple[int, int]]] = [[] for _ in range(n + 1)]
        for _, (size, at_end, token) in self.automaton.iter(piece + "\0"):
            if at_end:
                ending[n].append((size, token))
            elif _ + 1 < n:
                ending[_ + 1].append((size, token))
        last, back, fits, compatible = [-1] * (n + 1), [0] * (n + 1), self.fits, self.compatible
        for i in range(1, n + 1):
            for size, token in ending[i] if len(ending[i]) < 2 or ending[i][0][0] > ending[i][-1][0] else sorted(ending[i], reverse=True):
                j = i - size
                if j:
                    before = last[j]
                    if before < 0:
                        continue
                    ok = fits.get((before, token))
                    if ok is None:
                        if len(fits) > 1_000_000:
                            fits.clear()
                        ok = fits[before, token] = compatible(before, token)
                    if not ok:
                        continue
                last[i], back[i] = token, j
                break
        out, i = [], n
        while i:
            if last[i] < 0:
                raise ValueError("the vocabulary doesn't cover this piece")
            out.append(last[i])
            i = back[i]
        return tuple(out[::-1])

    def pieces(self, chunk: str) -> list[str]:
        """Byte-symbol strings of the pieces of one chunk without special tokens."""
        if chunk.isascii():
            low = chunk.lower()
            return [low] if low.isalpha() else [x.translate(self.symbol) if not x.isprintable() else x for x in self.pattern.findall(low)]
        import unicodedata

        low = "".join(c.lower() for c in unicodedata.normalize("NFC", chunk))
        return [x.encode().decode("latin-1").translate(self.symbol) for x in self.pattern.findall(low)]

    def _chunk(self, chunk: str) -> tuple[str, str]:
        """Ids in decimal and token strings of one chunk, each joined by one space."""
        ids: list[int] = []
        for part in self.special_split.split(chunk) if self.special_split and "<" in chunk else (chunk,):
            if part in self.special:
                ids.append(self.special[part])
            elif part:
                for piece in self.pieces(part):
                    ids += self.piece[piece]
        return " ".join(map(str, ids)), " ".join(self.strings[i] for i in ids)

    def encode(self, text: str | None) -> list[int]:
        return [int(x) for c in chunks(text or "") for x in self.chunk[c][0].split()]

    def decode(self, ids: list[int]) -> str:
        """As the library does where the file names no decoder: token strings joined by one space."""
        return " ".join(self.strings[i] for i in ids if i in self.strings)


@lru_cache(maxsize=1)
def _encoder(path: str) -> PrefixEncoder:
    return PrefixEncoder(path)


def encoder(path: str) -> PrefixEncoder:
    """One per Python worker, as long as it does nothing else."""
    arrow.claim("bpe", _encoder.cache_clear)
    return _encoder(path)


def encode_documents(df: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array of int): the ids themselves."""
    path = path or vocabulary_path()
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches):
        coder = encoder(path)
        for batch in arrow.slices(batches):
            yield arrow.table(schema, doc_id=batch.column(0), ids=[coder.encode(x) for x in arrow.texts(batch)])

    return arrow.documents(df, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(df: DataFrame, path: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, text from arrays of ids; unknown ids are left out, null gives an empty text."""
    path = path or vocabulary_path()
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(batches):
        coder = encoder(path)
        for batch in batches:
            yield arrow.table(schema, doc_id=batch.column(0), text=[coder.decode(x or []) for x in batch.column(1).to_pylist()])

    arrow.prepare(df.sparkSession)
    return df.selectExpr(f"cast(`{id_col}` as long) doc_id", f"cast(`{ids_col}` as array<int>) ids").mapInArrow(run, "doc_id long, text string")


def round_trip_digest(df: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode, then decode, every text: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    path = path or vocabulary_path()
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batches):
        coder = encoder(path)
        memo = coder.chunk
        for batch in arrow.slices(batches):
            count, ids, decoded = [], [], []
            for text in arrow.texts(batch):
                found = [memo[c] for c in chunks(text)]
                line = " ".join([x[0] for x in found if x[0]])
                count.append(line.count(" ") + 1 if line else 0)
                ids.append(hashlib.sha256(line.encode()).hexdigest())
                decoded.append(hashlib.sha256(" ".join([x[1] for x in found if x[0]]).encode()).hexdigest())
            yield arrow.table(schema, doc_id=batch.column(0), n_tokens=count, ids_sha256=ids, decoded_sha256=decoded)

    return arrow.documents(df, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
