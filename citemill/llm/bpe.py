"""Byte-pair encoding by backtracking over token matches, and decoding by an offset table.

A sequence of tokens is what repeated merging gives exactly when each two
neighbours are compatible: merging the two alone, in order of rank, never joins
across their border. An Aho-Corasick automaton lists the tokens that start at
each place of a word. The encoder takes the longest one compatible with its
predecessor and steps back from places where none is; a place left that way is
never tried again, so the work is linear in the word.

The vocabulary file is a parameter. Supported are files whose model is BPE with
a suffix for word ends, whose words are cut by one pattern after
NFC, white space and lower case are settled.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from array import array
from functools import lru_cache

import ahocorasick
import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from citemill.llm.batches import text_column

# White space as Unicode has it; Python's own class also holds U+001C to U+001F.
SPACES = r"\t-\r\x20\x85\xa0  -     　"
CACHED_WORDS, CACHED_PAIRS = 100_000, 150_000


NEWER = regex.compile(r"[\p{L}\p{N}]")


class NewerLetter(Exception):
    """A word holds a letter or number that only the pattern library's Unicode has."""


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable Latin-1 for itself, the others numbered from U+0100."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


class Vocabulary:
    """Tokens, merges and the automaton of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, suffix = spec["model"], spec["model"].get("end_of_word_suffix") or ""
        if model["type"] != "BPE" or not suffix:
            raise ValueError("expected a BPE vocabulary with a suffix for word ends")
        ids: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"] if t["special"]}
        size = max([*ids.values(), *self.special.values()]) + 1
        names = [""] * size
        for token, i in [*ids.items(), *self.special.items()]:
            names[i] = token
        self.offsets = np.zeros(size + 1, dtype=np.int64)
        encoded = [n.encode() for n in names]
        np.cumsum([len(n) for n in encoded], out=self.offsets[1:])
        self.blob = np.frombuffer(b"".join(encoded), dtype=np.uint8)

        # A symbol is one character: the last byte of a word, with the suffix, lies 512 above the byte's letter.
        letters = byte_letters()
        self.inner = str.maketrans({chr(b): c for b, c in enumerate(letters)})
        self.last = {c: chr(ord(c) + 512) for c in letters}
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        for n, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            made = ids[left + right]
            self.rank[ids[left], ids[right]] = (n, made)
            self.parts.setdefault(made, (ids[left], ids[right]))
        self.order = {made: self.rank[pair][0] for made, pair in self.parts.items()}
        self.automaton = ahocorasick.Automaton()
        basic = {t for t in letters} | {t + suffix for t in letters}
        for token, i in ids.items():
            if i in self.parts or token in basic:
                symbols = self.symbols(token.removesuffix(suffix)) if token.endswith(suffix) and token != suffix else token
                self.automaton.add_word(symbols, (i, len(symbols)))
        self.automaton.make_automaton()
        splitter = [
            p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"]
            if p["type"] == "Split" and p["behavior"] == "Removed" and p["invert"]
        ]
        if len(splitter) != 1:
            raise ValueError("expected one pattern for words")
        self.pattern = regex.compile(splitter[0].replace(r"\s", SPACES))
        self.specials = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) or r"(?!)")
        self.fits: dict[tuple[int, int], bool] = {}
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def symbols(self, letters: str) -> str:
        return letters[:-1] + self.last[letters[-1]]

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the two tokens' symbols together leaves the border between them.

        The tokens are taken apart from the border, the later made one first. A merge across the border that
        ranks before what was taken apart would have come first.
        """
        key = (left, right)
        known = self.fits.get(key)
        if known is None:
            known = self._compatible(left, right)
            if len(self.fits) >= CACHED_PAIRS:
                self.fits.clear()
            self.fits[key] = known
        return known

    def _compatible(self, left: int, right: int) -> bool:
        never = len(self.rank)
        # The rank by which a crossing merge must be beaten, and if it must be strictly lower.
        limit, strict = never, True
        while True:
            crossing = self.rank.get((left, right))
            if crossing and (crossing[0] < limit or not strict and crossing[0] == limit):
                return False
            a, b = self.order.get(left, -1), self.order.get(right, -1)
            if a < 0 and b < 0:
                return True
            # Of equal rank, the left one is made first, so the right one is taken apart first.
            if a > b:
                left, limit, strict = self.parts[left][1], a, True
            else:
                right, limit, strict = self.parts[right][0], b, False

    def encode_word(self, word: str) -> list[int]:
        """Ids of one word as the pattern cuts it, lower-cased already."""
        # Printable ASCII stands for itself.
        plain = word.isascii() and word.isprintable()
        text = self.symbols(word if plain else word.encode().decode("latin-1").translate(self.inner))
        n = len(text)
        # At each place the tokens that start there with their lengths, the longest last.
        starting: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for end, token in self.automaton.iter(text):
            starting[end + 1 - token[1]].append(token)
        fits, compatible = self.fits, self.compatible
        dead = bytearray(n + 1)
        path: list[int] = []
        steps: list[tuple[int, list]] = []
        at, previous, open_ = 0, -1, starting[0]
        while at < n:
            while open_:
                token, size = open_.pop()
                if not dead[at + size] and (previous < 0 or fits.get((previous, token)) or compatible(previous, token)):
                    break
            else:
                # Nothing fits here: no encoding of what lies before goes on from this place, and none comes back.
                dead[at] = 1
                size, open_ = steps.pop()
                path.pop()
                at -= size
                previous = path[-1] if path else -1
                continue
            path.append(token)
            steps.append((size, open_))
            previous = token
            at += size
            # A copy, as another path may come to this place again.
            open_ = starting[at][:] if at < n else open_
        return path

    def word_bytes(self, word: str) -> bytes:
        ids = self.known.get(word)
        if ids is None:
            ids = self.older.get(word)
            if ids is not None:
                self.known[word] = ids
        if ids is None:
            if not word.isascii() and NEWER.search(word) and any(unicodedata.category(c) == "Cn" for c in word):
                raise NewerLetter
            if len(self.known) >= CACHED_WORDS:
                # Words that were not seen again since the last time are forgotten.
                self.known, self.older = {}, self.known
            ids = self.known[word] = array("I", self.encode_word(word)).tobytes()
        return ids

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of a text as unsigned 32-bit numbers. Special tokens written in the text are themselves."""
        out: list[bytes] = []
        start = 0
        text = text or ""
        for match in self.specials.finditer(text):
            out += self.piece(text[start : match.start()])
            out.append(array("I", [self.special[match[0]]]).tobytes())
            start = match.end()
        out += self.piece(text[start:] if start else text)
        return np.frombuffer(b"".join(out), dtype=np.uint32).astype("<u4", copy=False)

    def piece(self, text: str) -> list[bytes]:
        # Letter by letter, as a capital sigma at a word's end is an ordinary one to the tokenizer.
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        cut = self.pattern.findall(text)
        try:
            out = list(map(self.known.get, cut))
            if None in out:
                out = [self.word_bytes(w) if x is None else x for w, x in zip(cut, out)]
            return out
        except NewerLetter:
            # The tokenizer's letters are those of an older Unicode: cut the text by those, letting newer ones
            # stand as a sign that is neither letter, number nor white space.
            plain = "".join("\ue000" if unicodedata.category(c) == "Cn" else c for c in text)
            cut = [text[m.start() : m.end()] for m in self.pattern.finditer(plain)]
            return [array("I", self.encode_word(w)).tobytes() for w in cut]

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 of the tokens joined by a space, copied from the table of all tokens by their offsets."""
        if not len(ids):
            return b""
        starts, sizes = self.offsets[ids], self.offsets[1:][ids] - self.offsets[ids]
        ends = np.cumsum(sizes + 1)
        out = np.full(ends[-1], 32, dtype=np.uint8)
        shift = np.repeat(starts - (ends - sizes - 1), sizes)
        places = np.arange(len(shift)) + np.repeat(np.arange(len(ids)), sizes)
        out[places] = self.blob[places + shift]
        return out[:-1].tobytes()


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """One per Python worker."""
    return Vocabulary(path)


def encode_texts(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids, ids_sha256, decoded_sha256) for each row of ``docs`` (doc_id, text; others are not read).

    ``path`` is the vocabulary file, there on every executor. A null text is empty: no ids, and the digests of nothing.
    """
    kind = StructType([
        StructField("n_tokens", LongType()), StructField("ids", ArrayType(IntegerType())),
        StructField("ids_sha256", StringType()), StructField("decoded_sha256", StringType()),
    ])

    def run(texts: list) -> list:
        v, out = vocabulary(path), []
        for text in texts:
            ids = v.encode(text)
            out.append({
                "n_tokens": len(ids), "ids": ids.view(np.int32),
                "ids_sha256": hashlib.sha256(ids).hexdigest(), "decoded_sha256": hashlib.sha256(v.decode(ids)).hexdigest(),
            })
        return out

    return docs.select("doc_id", text_column(run, kind, F.col("text")).alias("coded")).select("doc_id", "coded.*")


def decode_texts(coded: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """``coded`` with the column ``decoded``: the text of the ids in column ``ids``. Null ids give null."""
    import pyarrow as pa

    def run(column: pa.Array) -> pa.Array:
        v = vocabulary(path)
        return pa.array([None if x is None else v.decode(np.array(x, np.int64)).decode() for x in column.to_pylist()], pa.string())

    run.__annotations__ = {"column": pa.Array, "return": pa.Array}
    return coded.withColumn("decoded", F.arrow_udf(run, StringType())(F.col(ids)))
