"""Byte-level BPE: exact linear-time encoding by backtracking, decoding by an offset table.

The merges of a BPE are a set of pairwise facts: a token sequence is the encoding of its
bytes exactly if every two neighbours are *compatible*, that is if encoding their joined
bytes gives the two tokens back.  So the encoder need not replay merges.  An Aho-Corasick
automaton over the vocabulary gives the longest token at every position, the encoder takes
it, checks the pair with the token before it, falls back to the next shorter token where
the pair is not compatible, and steps back where none is left.  A position given up once is
never tried again, so the time is linear in the text.

The pair table is filled as pairs occur (the vocabulary squared would not fit); each entry
is decided once, by the merge rules on the few bytes of the two tokens.

Words repeat, so a worker remembers the encoding of the pieces it has seen, up to
``CACHED_PIECES``; then the memory starts anew.  This bounds the memory, not the result.

Defined cases: a null text is the empty text and has no tokens; texts of any length are
encoded whole; special tokens written in a text become their own id, as the tokenizers
library does by default; repeated rows stay rows and an empty table gives no rows; other columns
pass through unless they have the output's name, in which case they are replaced.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from collections.abc import Iterator, Sequence

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"  # fixed value: the byte-level split rule
CACHED_PIECES = 600_000
CACHED_PAIRS = 1_000_000
LONGEST_CACHED = 64
BATCH_CHARS = 1_000_000


def byte_alphabet() -> dict[str, int]:
    """Printable stand-ins of the 256 bytes in vocabulary files of this kind."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def latin_pieces() -> str:
    """The split rule over the first 256 code points, where Python's own engine can run it."""
    kind = {k: "".join(map(re.escape, (c for c in map(chr, range(256)) if unicodedata.category(c)[0] == k))) for k in "LN"}
    space = "".join(map(re.escape, (c for c in map(chr, range(256)) if regex.match(r"\s", c))))
    letters, digits = kind["L"], kind["N"]
    return rf"'(?:[smtd]|re|ve|ll)| ?[{letters}]+| ?[{digits}]+| ?[^{space}{letters}{digits}]+|[{space}]+(?![^{space}])|[{space}]+"


class Known(dict):
    """Pieces seen so far with their ids as packed int32; a new piece is encoded when it is asked for."""

    def __init__(self, bpe: Bpe):
        super().__init__()
        self.bpe = bpe

    def __missing__(self, piece: str) -> bytes:
        packed = array("i", self.bpe.backtrack(piece.encode().decode("latin-1"))).tobytes()
        if len(piece) <= LONGEST_CACHED:
            if len(self) >= CACHED_PIECES:
                self.clear()
            self[piece] = packed
        return packed


class Bpe:
    """A vocabulary ready to encode and decode; ``source`` is the text of a tokenizers JSON file."""

    def __init__(self, source: str):
        spec = json.loads(source)
        model, back, added, before = spec["model"], byte_alphabet(), spec.get("added_tokens", []), spec["pre_tokenizer"]
        plain = all(not x[k] for x in added for k in ("single_word", "lstrip", "rstrip"))
        if (model["type"] != "BPE" or spec.get("normalizer") or model.get("ignore_merges") or not plain or before["type"] != "ByteLevel"
                or before["add_prefix_space"] or not before.get("use_regex", True)):
            raise ValueError("only plain byte-level BPE files are supported")
        self.source = source
        self.extra = {x["content"]: x["id"] for x in added}
        plain_bytes = lambda word: bytes(back[c] for c in word).decode("latin-1")  # noqa: E731  one character a byte
        ids = {plain_bytes(word): i for word, i in model["vocab"].items() if word not in self.extra}
        self.rule: dict[tuple[int, int], int] = {}  # a mergeable pair and the rank of its rule
        self.halves: dict[int, tuple[int, int, int]] = {}  # a token's two halves and the rank of its rule
        for k, pair in enumerate(model["merges"]):
            left, right = map(plain_bytes, pair.split(" ") if isinstance(pair, str) else pair)
            self.rule[ids[left], ids[right]] = k
            self.halves.setdefault(ids[left + right], (ids[left], ids[right], k))
        self.matcher = ahocorasick.Automaton()
        for word, i in ids.items():
            self.matcher.add_word(word, (len(word) - 1, i))
        self.matcher.make_automaton()
        self.shorter = {}  # the next shorter token that a token begins with
        for word, i in ids.items():
            self.shorter[i] = next(((n - 1, ids[word[:n]]) for n in range(len(word) - 1, 0, -1) if word[:n] in ids), None)
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.extra, key=len, reverse=True))) + ")") if self.extra else None
        self.any_split, self.latin_split = regex.compile(PIECES), re.compile(latin_pieces())
        self.pairs: dict[tuple[int, int], bool] = {}
        self.edges: dict[tuple[int, int], list[tuple[int, int]]] = {}
        self.known = Known(self)
        words = {i: word.encode("latin-1") for word, i in ids.items()} | {i: word.encode() for word, i in self.extra.items()}
        table = [words.get(i, b"") for i in range(max(words) + 1)]
        self.offsets = np.cumsum([0, *map(len, table)])
        self.bytes = np.frombuffer(b"".join(table), np.uint8)

    def __reduce__(self):
        return Bpe, (self.source,)  # a worker builds its tables once, when the broadcast arrives

    def edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """What stands at the left (0) or right (1) end of a token while it is merged, each with the rank of the rule that ends it."""
        found = self.edges.get((token, side))
        if found is None:
            found, end, at = [], 1 << 60, token
            while True:
                found.append((at, end))
                if at not in self.halves:
                    break
                end, at = self.halves[at][2], self.halves[at][side]
            self.edges[token, side] = found
        return found

    def compatible(self, a: int, b: int) -> bool:
        """No rule merges across the border before both sides have grown past it; of equal ranks the left place goes first."""
        good = True
        for x, x_ends in self.edge(a, 1):
            for y, y_ends in self.edge(b, 0):
                rank = self.rule.get((x, y))
                if rank is not None and rank < x_ends and rank <= y_ends:
                    good = False
        if len(self.pairs) >= CACHED_PAIRS:
            self.pairs.clear()
        self.pairs[a, b] = good
        return good

    def backtrack(self, word: str) -> list[int]:
        """Ids of one piece, given as one character a byte."""
        n = len(word)
        longest: list = [None] * n
        for end, hit in self.matcher.iter(word):
            longest[end - hit[0]] = hit  # matches of one start come in the order of their ends
        if longest[0] is not None and longest[0][0] == n - 1:
            return [longest[0][1]]
        dead: set[int] = set()
        out: list[int] = []
        starts: list[int] = []
        at, last, hit = 0, -1, longest[0]
        pairs, shorter, compatible = self.pairs, self.shorter, self.compatible
        while at < n:
            while hit is not None:
                size, token = hit
                if at + size + 1 not in dead:
                    if last < 0:
                        break
                    good = pairs.get((last, token))
                    if good or good is None and compatible(last, token):
                        break
                hit = shorter[token]
            if hit is not None:
                out.append(token)
                starts.append(at)
                last, at = token, at + size + 1
                hit = longest[at] if at < n else None
            elif not out:
                raise ValueError("the vocabulary lacks a byte")
            else:
                dead.add(at)
                hit, at = shorter[out.pop()], starts.pop()
                last = out[-1] if out else -1
        return out

    def encode(self, text: str) -> np.ndarray:
        packed = []
        for k, part in enumerate(self.special.split(text) if self.special else [text]):
            if k % 2:
                packed.append(np.int32(self.extra[part]).tobytes())
            else:
                try:
                    part.encode("latin-1")
                    pieces = self.latin_split.findall(part)
                except UnicodeEncodeError:
                    pieces = self.any_split.findall(part)
                packed += map(self.known.__getitem__, pieces)
        return np.frombuffer(b"".join(packed), np.int32)

    def decode_bytes(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of all tokens, one after the other."""
        starts = self.offsets[ids]
        size = self.offsets[ids + 1] - starts
        ends = np.cumsum(size)
        return self.bytes[np.repeat(starts - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]

    def decode(self, ids) -> str:
        return self.decode_bytes(np.asarray(ids, np.int64)).tobytes().decode("utf-8", "replace")


def read_vocabulary(path: str, max_bytes: int = 64 << 20) -> str:
    """The vocabulary file, small by nature; it goes to the workers as a broadcast."""
    with open(path, encoding="utf-8") as f:
        text = f.read(max_bytes + 1)
    if len(text) > max_bytes:
        raise ValueError(f"{path} is larger than {max_bytes} bytes")
    return text


def _slices(batch: pa.RecordBatch, sizes: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about ``BATCH_CHARS`` units each, a longer row alone."""
    at, ends = 0, np.cumsum(sizes)
    while at < len(sizes):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BATCH_CHARS)))
        yield batch.slice(at, end - at)
        at = end


def _mapped(df: DataFrame, keep: Sequence[str] | None, name: str, kind: T.DataType, make) -> DataFrame:
    """``df``'s columns (or those of ``keep``) and a new one of Arrow values that ``make`` yields for parts of a batch."""
    carried = [f for f in df.schema.fields if f.name != name and (keep is None or f.name in keep)]

    def run(batches):
        for whole in batches:
            for part, column in make(whole):
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in carried), column], [*(f.name for f in carried), name])

    return df.mapInArrow(run, T.StructType([*carried, T.StructField(name, kind)]))


def encode(df: DataFrame, vocabulary: str, text: str = "text", ids: str = "ids", keep: Sequence[str] | None = None) -> DataFrame:
    """``df`` with the token ids of its texts; ``vocabulary`` is the content of the file, ``keep`` the columns to carry (all if not given)."""
    shared = df.sparkSession.sparkContext.broadcast(Bpe(vocabulary))

    def make(whole):
        sizes = np.asarray(pc.utf8_length(whole.column(text)).fill_null(0), np.int64)
        for part in _slices(whole, sizes):
            rows = [shared.value.encode(x or "") for x in part.column(text).to_pylist()]
            ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
            yield part, pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(rows)))

    return _mapped(df, keep, ids, T.ArrayType(T.IntegerType()), make)


def decode(df: DataFrame, vocabulary: str, ids: str = "ids", text: str = "decoded", keep: Sequence[str] | None = None) -> DataFrame:
    """``df`` with the texts of its token ids; null ids give an empty text."""
    shared = df.sparkSession.sparkContext.broadcast(Bpe(vocabulary))

    def make(whole):
        lengths = np.asarray(pc.list_value_length(whole.column(ids)).fill_null(0), np.int64)
        for part in _slices(whole, lengths):
            yield part, decoded(shared.value, part.column(ids))

    return _mapped(df, keep, text, T.StringType(), make)


def decoded(bpe: Bpe, ids: pa.ListArray) -> pa.Array:
    """All lists of a part at once: gather the bytes of every token, cut where a list ends."""
    lengths = np.asarray(pc.list_value_length(ids).fill_null(0), np.int64)
    flat = np.asarray(ids.flatten(), np.int64)
    data = bpe.decode_bytes(flat).tobytes()
    at = np.concatenate([[0], np.cumsum(bpe.offsets[flat + 1] - bpe.offsets[flat])])[np.concatenate([[0], np.cumsum(lengths)])].tolist()
    return pa.array([data[a:b].decode("utf-8", "replace") for a, b in zip(at[:-1], at[1:], strict=True)], pa.string())
