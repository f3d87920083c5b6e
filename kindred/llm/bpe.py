"""BPE encoding and decoding in batched numpy merge rounds.

The words of a batch that are not known yet lie in one flat array of symbols. Each round looks all adjacent pairs up by
binary search over the sorted pair keys, takes the lowest rank of each word, and merges its occurrences from the left.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, Tokenizer, pre_tokenizers

from .common import chunks, strings, widened

NO_RANK = np.iinfo(np.int64).max


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = (b for b in range(256) if b not in set(plain))
    table = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}
    return [table[b] for b in range(256)]


def newer_characters() -> str:
    """Characters that the regex module knows and Python's Unicode tables do not yet, as ranges of a class."""
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    codes = [ord(c) for c in regex.findall(r"\P{Cn}", every) if unicodedata.category(c) == "Cn"]
    starts = [c for c, before in zip(codes, [-2, *codes], strict=False) if c != before + 1]
    ends = [c for c, after in zip(codes, [*codes[1:], -2], strict=True) if after != c + 1]
    return "".join(f"\\U{a:08X}-\\U{b:08X}" for a, b in zip(starts, ends, strict=True))


#: Separators of Python's ``split`` that are no white space in the file's pattern.
CONTROLS = regex.compile("[\x1c-\x1f]")
#: Strings longer than this are not remembered.
LONG = 100


class Memory:
    """What was computed for the strings of late: a young and an old generation of at most ``limit`` strings each."""

    def __init__(self, limit: int):
        self.limit, self.young, self.old = limit, {}, {}

    def of(self, wanted: set[str], make) -> dict[str, bytes]:
        """A table with all of ``wanted``; ``make`` turns a list of strings that are not known into their values."""
        if len(self.young) > self.limit:
            self.young, self.old = {}, self.young
        missing = wanted.difference(self.young)
        again = missing.intersection(self.old)
        self.young.update({x: self.old[x] for x in again})
        fresh = list(missing - again)
        if not fresh:
            return self.young
        made = dict(zip(fresh, make(fresh), strict=True))
        long_ = [x for x in fresh if len(x) > LONG]
        if not long_ and len(self.young) + len(made) <= 2 * self.limit:
            self.young.update(made)
            return self.young
        table = self.young | made
        for x in long_:
            del made[x]
        if len(made) <= self.limit:
            self.young.update(made)
        return table


class WordBpe:
    """A tokenizer file with word ends: its normalizer, its split pattern, its merges and its added tokens.

    No word and no normal form reaches over white space, so the unit that is encoded once and then looked up is a run of
    other characters. ``known`` bounds how many runs and pieces are remembered.
    """

    def __init__(self, path: str, known: int = 300_000):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        vocab = model["vocab"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.tokens = {i: t for t, i in vocab.items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        names = sorted(self.special, key=len, reverse=True)
        self.specials = regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None
        self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.lines = regex.compile(self.pattern.pattern + r"|\n")
        self.newer = regex.compile(f"[{newer_characters() or chr(0xFFFF)}]")
        library = Tokenizer.from_file(path)
        steps = spec["normalizer"] or {"type": "Sequence", "normalizers": []}
        self.steps = [s["type"] for s in steps.get("normalizers", [steps])]
        split = pre_tokenizers.Split(Regex(self.pattern.pattern), "removed", invert=True)
        self.whole = library.normalizer.normalize_str if library.normalizer else str
        self.library = lambda text: [p for p, _ in split.pre_tokenize_str(self.whole(text))]
        symbols = byte_symbols()
        self.inner = np.array([vocab[s] for s in symbols], np.int64)
        self.final = np.array([vocab[s + self.suffix] for s in symbols], np.int64)
        self.base = max(vocab.values()) + 1
        pairs = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in model["merges"]]
        keys = np.array([vocab[a] * self.base + vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made[order]
        self.known, self.runs = Memory(known), Memory(known)

    def normalize(self, text: str) -> str:
        """The file's normal form. Lower case is that of each character by itself (a final sigma is not special)."""
        for step in self.steps:
            if step == "NFC":
                text = text if text.isascii() else unicodedata.normalize("NFC", text)
            elif step == "Lowercase":
                text = (text if text.isascii() else text.replace("Σ", "σ")).lower()
            elif step != "Replace":  # white space only separates
                return self.whole(text)
        return text

    def split(self, text: str) -> list[str]:
        """The words of a text. Unicode versions differ, so texts with recent characters are split by the library's rules."""
        if not text.isascii() and self.newer.search(text):
            return self.library(text)
        return self.pattern.findall(self.normalize(text))

    def pieces(self, text: str) -> list[str]:
        """Words and added tokens in order."""
        parts = self.specials.split(text) if self.specials else [text]
        if len(parts) == 1:
            return self.split(text)
        return [p for part in parts for p in ([part] if part in self.special else self.split(part))]

    def merge(self, words: list[bytes]) -> list[bytes]:
        """Token ids of each word, little-endian, 32 bits."""
        raw = np.frombuffer(b"".join(words), np.uint8)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths)
        symbols = self.inner[raw]
        symbols[ends - 1] = self.final[raw[ends - 1]]
        owner = np.repeat(np.arange(len(words)), lengths)
        done_symbols, done_owner = [], []
        while len(symbols) > 1:
            key = symbols[:-1] * self.base + symbols[1:]
            at = np.searchsorted(self.keys, key)
            at[at == len(self.keys)] = 0
            valid = (self.keys[at] == key) & (owner[:-1] == owner[1:])
            rank = np.where(valid, self.ranks[at], NO_RANK)
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            best = np.minimum.reduceat(np.r_[rank, NO_RANK], starts)
            sizes = np.diff(np.r_[starts, len(symbols)])
            active = np.repeat(best < NO_RANK, sizes)
            hit = np.flatnonzero((rank == np.repeat(best, sizes)[:-1]) & (rank < NO_RANK))
            if not len(hit):
                break
            if len(hit) > 1:  # overlapping occurrences of one pair: every other one of a chain, from the left
                chain = np.r_[True, (np.diff(hit) > 1)]
                place = np.arange(len(hit)) - np.maximum.accumulate(np.where(chain, np.arange(len(hit)), 0))
                hit = hit[place % 2 == 0]
            symbols[hit] = self.made[at[hit]]
            keep = np.ones(len(symbols), bool)
            keep[hit + 1] = False
            idle = ~active
            if idle.any():
                done_symbols.append(symbols[idle])
                done_owner.append(owner[idle])
                keep &= active
            symbols, owner = symbols[keep], owner[keep]
        done_symbols.append(symbols)
        done_owner.append(owner)
        symbols, owner = np.concatenate(done_symbols), np.concatenate(done_owner)
        order = np.argsort(owner, kind="stable")
        flat = symbols[order].astype("<u4").tobytes()
        ends = (np.cumsum(np.bincount(owner, minlength=len(words))) * 4).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def encoded(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, little-endian, 32 bits."""
        split = [[t] if CONTROLS.search(t) else t.split() for t in texts]
        look = self.runs.of(set().union(*split), self._runs)
        return [b"".join(map(look.__getitem__, runs)) for runs in split]

    def _runs(self, fresh: list[str]) -> list[bytes]:
        together = "\n".join(fresh)
        odd = set()
        if self.specials and self.specials.search(together):
            odd = {r for r in fresh if self.specials.search(r)}
        if not together.isascii() and self.newer.search(together):
            odd |= {r for r in fresh if self.newer.search(r)}
        if CONTROLS.search(together):
            odd |= {r for r in fresh if CONTROLS.search(r)}
        if odd:
            plain = [r for r in fresh if r not in odd]
            cut = dict(zip(plain, self._cut("\n".join([*plain, ""])), strict=True))
            found = [self.pieces(r) if r in odd else cut[r] for r in fresh]
        else:
            found = self._cut(together + "\n")
        look = self.known.of({p for pieces in found for p in pieces}, self._pieces)
        return [b"".join([look[p] for p in pieces]) for pieces in found]

    def _cut(self, lines: str) -> list[list[str]]:
        """The words of each line by one pass over all of them."""
        pieces = self.lines.findall(self.normalize(lines))
        ends = [i for i, p in enumerate(pieces) if p == "\n"]
        return [pieces[a:b] for a, b in zip([0, *(i + 1 for i in ends)], ends, strict=False)]

    def _pieces(self, fresh: list[str]) -> list[bytes]:
        special = [p for p in fresh if p in self.special]
        plain = [p for p in fresh if p not in self.special]
        ids = dict(zip(plain, self.merge([p.encode() for p in plain]), strict=True)) if plain else {}
        ids |= {p: self.special[p].to_bytes(4, "little") for p in special}
        return [ids[p] for p in fresh]

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encoded([text])[0], "<u4").tolist()

    def decode(self, ids: list[int]) -> str:
        """The file has no decoder, so tokens are joined by spaces and keep their word ends."""
        return " ".join(map(self.tokens.__getitem__, ids))


@lru_cache(maxsize=2)
def loaded(path: str) -> WordBpe:
    return WordBpe(path)


def encode_digests(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256) of every row; a null or empty text has no tokens.

    ``path`` is the tokenizer file, present on every executor. Repeated keys stay separate rows, other columns are ignored.
    """

    def run(batches):
        bpe = loaded(path)
        for part in chunks(batches, 2 << 20):
            ids = bpe.encoded(strings(part.column(1)))
            plain = [bpe.decode(np.frombuffer(x, "<u4").tolist()) for x in ids]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in ids]),
                    pa.array([hashlib.sha256(x.encode()).hexdigest() for x in plain]),
                ],
                ["key", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    source = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = source.schema["key"].dataType.simpleString()
    return source.mapInArrow(run, f"key {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("key", key)


def encode_ids(df: DataFrame, path: str, text: str = "text", ids: str = "token_ids") -> DataFrame:
    """All columns of ``df`` and the token ids of ``text`` (null and empty: none); a column of that name is replaced."""
    source = df.drop(ids)
    columns = source.columns
    at = columns.index(text)

    def run(batches):
        bpe = loaded(path)
        for part in chunks(batches, 2 << 20):
            found = bpe.encoded(strings(part.column(at)))
            rows = pa.array([np.frombuffer(x, "<i4") for x in found], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*part.columns, rows], [*columns, ids])

    return source.mapInArrow(run, widened(source.schema, f"`{ids}` array<int>"))


def decode_ids(df: DataFrame, path: str, ids: str = "token_ids", text: str = "decoded") -> DataFrame:
    """All columns of ``df`` and the text of ``ids`` (null and empty: empty); a column of that name is replaced."""
    source = df.drop(text)
    columns = source.columns
    at = columns.index(ids)

    def run(batches):
        bpe = loaded(path)
        for part in chunks(batches, 2 << 20):
            rows = pa.array([bpe.decode(x or []) for x in part.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*part.columns, rows], [*columns, text])

    return source.mapInArrow(run, widened(source.schema, f"`{text}` string"))


def bpe_digest(documents: DataFrame, path: str | None = None) -> DataFrame:
    """The registered query, with the public word-end vocabulary unless another file is given."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    return encode_digests(documents, path)
