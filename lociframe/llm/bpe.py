"""BPE encoding and decoding with a segment tree over adjacent pair ranks.

The tree's root holds the lowest rank of all adjacent pairs, the leftmost of equal ones; a merge updates
the pairs on either side, each in logarithmic time, until no pair can be merged. A word of n bytes so
takes O(n log n) whatever its merges, also where a text has no white space at all.

Chunks between white space, and the words in them, are encoded once and remembered by the worker: normalisation and the split
pattern never reach over white space, so a text's tokens are those of its chunks.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from .common import CACHES, column, strings, text_or_empty, tidied

NONE = 1 << 60
#: What one worker remembers: chunks, and words (and as many of the generation before), and code points of one that is remembered.
MOST_CHUNKS, LONGEST_CHUNK = 300_000, 64
#: White space of the tokenizer's patterns; str.split() would also split at the separators 1C to 1F.
SPACE = regex.compile(r"[\t-\r\x20\x85\xa0  -     　]+")
ODD = re.compile("[\x1c-\x1f]")
#: Latin letters and common punctuation, whose classes, lower case and composition are the same in Python's tables and in the
#: tokenizer library's (a test compares them all). Chunks with any others are normalised and split by the library.
COMMON = re.compile("[\0-\u024f\u2010-\u2027\u20ac]*")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else the next from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, more = {}, 0
    for b in range(256):
        if b in shown:
            out[b] = chr(b)
        else:
            out[b] = chr(256 + more)
            more += 1
    return [out[b] for b in range(256)]


class PairTree:
    """Minimum segment tree over the ranks of adjacent pairs; find() goes to the leftmost minimum."""

    def __init__(self, ranks: list[int]):
        self.size = 1 << max(0, (len(ranks) - 1).bit_length())
        self.node = [NONE] * (2 * self.size)
        self.node[self.size : self.size + len(ranks)] = ranks
        for i in range(self.size - 1, 0, -1):
            a, b = self.node[2 * i], self.node[2 * i + 1]
            self.node[i] = a if a <= b else b

    def set(self, i: int, rank: int) -> None:
        node = self.node
        i += self.size
        node[i] = rank
        i >>= 1
        while i:
            a, b = node[2 * i], node[2 * i + 1]
            new = a if a <= b else b
            if node[i] == new:
                return
            node[i] = new
            i >>= 1

    def find(self) -> int:
        """The place of the leftmost lowest rank, -1 if no pair is left."""
        node, i = self.node, 1
        if node[1] >= NONE:
            return -1
        while i < self.size:
            i *= 2
            if node[i] > node[i + 1]:
                i += 1
        return i - self.size


class Bpe:
    """A tokenizer file of the kind: NFC, lower case, white space dropped, split by a pattern, bytes, merges with word ends."""

    _loaded: dict[str, Bpe] = {}

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end: str = model["end_of_word_suffix"] or ""
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.token_of = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.cut = re.compile("|".join(re.escape(x) for x in sorted(self.special, key=len, reverse=True)) or "(?!)")
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = regex.compile(split["pattern"]["Regex"])
        from tokenizers import Tokenizer

        bare = spec | {"model": model | {"vocab": {}, "merges": []}, "added_tokens": [], "pre_tokenizer": split}
        rules = Tokenizer.from_str(json.dumps(bare))
        self.normalised, self.pieces = rules.normalizer.normalize_str, rules.pre_tokenizer.pre_tokenize_str
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        for r, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.rank.setdefault((self.vocab[a], self.vocab[b]), (r, self.vocab[a + b]))
        symbols = byte_symbols()
        self.inner = [self.vocab.get(s) for s in symbols]
        self.last = [self.vocab.get(s + self.end) for s in symbols]
        self.words: dict[str, tuple] = {}
        self.older: dict[str, tuple] = {}
        self.merged: dict[str, list[int]] = {}
        self.merged_before: dict[str, list[int]] = {}

    @classmethod
    def of(cls, path: str) -> Bpe:
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def merge(self, raw: bytes) -> list[int]:
        """The ids of one word's bytes."""
        ids = [self.inner[b] for b in raw[:-1]] + [self.last[b] for b in raw[-1:]]
        ids = [i for i in ids if i is not None]  # without an unknown token, symbols not in the vocabulary vanish
        n = len(ids)
        if n < 2:
            return ids
        rank = self.rank.get
        tree = PairTree([rank(p, (NONE, 0))[0] for p in zip(ids, ids[1:], strict=False)])
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while (i := tree.find()) >= 0:
            j = after[i]
            ids[i] = rank((ids[i], ids[j]))[1]
            k = after[i] = after[j]
            ids[j] = -1
            if j < n - 1:
                tree.set(j, NONE)
            if k < n:
                before[k] = i
                tree.set(i, rank((ids[i], ids[k]), (NONE, 0))[0])
            else:
                tree.set(i, NONE)
            if (h := before[i]) >= 0:
                tree.set(h, rank((ids[h], ids[i]), (NONE, 0))[0])
        return [i for i in ids if i >= 0]

    def chunk(self, chunk: str) -> list[int]:
        """The ids of a stretch of text without white space."""
        out: list[int] = []
        at = 0
        for m in self.cut.finditer(chunk):
            out += self.plain(chunk[at : m.start()]) + [self.special[m[0]]]
            at = m.end()
        return out + self.plain(chunk[at:])

    def plain(self, text: str) -> list[int]:
        if COMMON.fullmatch(text):
            words = self.pattern.findall(unicodedata.normalize("NFC", text).lower())
        else:
            words = [w for w, _ in self.pieces(self.normalised(text))]
        out: list[int] = []
        for word in words:
            ids = self.merged.get(word)
            out += self.word(word) if ids is None else ids
        return out

    def word(self, word: str) -> list[int]:
        """The ids of a word that was not met lately: chunks are many, the words in them are fewer, in whatever case and punctuation."""
        ids = self.merged_before.get(word)
        if ids is None:
            ids = self.merge(word.encode())
        if len(word) <= LONGEST_CHUNK:
            if len(self.merged) >= MOST_CHUNKS:
                self.merged_before, self.merged = self.merged, {}
            self.merged[word] = ids
        return ids

    def entry(self, chunk: str) -> tuple[int, str, str]:
        ids = self.chunk(chunk)
        return len(ids), " ".join(map(str, ids)), " ".join(map(self.token_of.__getitem__, ids))

    def encode(self, text: str) -> list[int]:
        return [i for c in chunks(text) for i in self.chunk(c)]

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by a space, as a tokenizer without a decoder does; unknown ids are left out."""
        return " ".join(self.token_of[i] for i in ids if i in self.token_of)

    def digest(self, text: str) -> tuple[int, str, str]:
        """(number of tokens, the ids joined by spaces, the decoded text), chunk by chunk."""
        known = self.words
        n, ids, decoded = 0, [], []
        for c in chunks(text):
            e = known.get(c)
            if e is None:
                e = self.older.get(c) or self.entry(c)
                if len(c) <= LONGEST_CHUNK:
                    if len(known) >= MOST_CHUNKS:  # what the last generation had stays for another one
                        self.older, self.words = known, (known := {})
                    known[c] = e
            if e[0]:
                n += e[0]
                ids.append(e[1])
                decoded.append(e[2])
        return n, " ".join(ids), " ".join(decoded)


CACHES["bpe"] = Bpe._loaded.clear


def chunks(text: str) -> list[str]:
    return [c for c in SPACE.split(text) if c] if ODD.search(text) else text.split()


ENCODED = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def encoded_digests(docs: DataFrame, tokenizer: str, text: str = "text") -> DataFrame:
    """A row for each row of docs: tokens, and digests of its ids and of what they decode to. A null text is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = Bpe.of(tokenizer)
        for b in batches:
            n, ids, decoded = [], [], []
            for t in strings(b, "t"):
                k, i, d = bpe.digest(t)
                n.append(k)
                ids.append(hashlib.sha256(i.encode()).hexdigest())
                decoded.append(hashlib.sha256(d.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([pa.array(column(b, "doc_id"), pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], names=[x.split()[0] for x in ENCODED.split(", ")])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty(text).alias("t")).mapInArrow(tidied(run, "bpe"), ENCODED)


def encoded(docs: DataFrame, tokenizer: str, text: str = "text", into: str = "ids") -> DataFrame:
    """docs with a column of token ids; what it has by that name already is replaced. A null text is empty, a table without rows gives none.

    Other columns, whatever their names, and equal rows stay as they are; a text that isn't a string is read as one.
    """
    names = [c for c in docs.columns if c != into]
    schema = docs.select(*names).schema.add(into, ArrayType(IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = Bpe.of(tokenizer)
        for b in batches:
            ids = pa.array([bpe.encode("" if t is None else str(t)) for t in column(b, text)], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*b.columns, ids], names=[*b.schema.names, into])

    return docs.select(*names).mapInArrow(tidied(run, "bpe"), schema)


def decoded(docs: DataFrame, tokenizer: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """docs with the text that their token ids decode to; a null list is empty, and ids that the vocabulary lacks are left out.

    What docs has by the new column's name is replaced; its other columns, and equal rows, stay as they are.
    """
    names = [c for c in docs.columns if c != into]
    schema = docs.select(*names).schema.add(into, "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = Bpe.of(tokenizer)
        for b in batches:
            text = pa.array([bpe.decode(x or []) for x in column(b, ids)], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, text], names=[*b.schema.names, into])

    return docs.select(*names).mapInArrow(tidied(run, "bpe"), schema)
