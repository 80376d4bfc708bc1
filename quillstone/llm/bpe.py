"""BPE encoding and decoding by forced-boundary splitting.

Two adjacent symbols that occur inside no token of the vocabulary can never be
merged over, so the place between them is a certain cut: the fragments are encoded
independently and their ids concatenated. Merges run on short fragments only.

The text is prepared as the vocabulary file says: special tokens apart, NFC, runs
of white space as one, lower case by character, pieces by pattern, bytes as
printable characters, the last one of a piece with the end-of-word mark. The file
has no decoder, so decoding joins the tokens by blanks.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import sys
import unicodedata
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import regex

from .common import slices, table, whole

_SPACES = r"\t-\r \x85\xa0  -     　"
_CACHE = 400_000
#: Fragments of more symbols are merged by a heap; longer pieces than this are not remembered.
_LONG, _KEPT = 48, 256


def _byte_chars() -> list[str]:
    """The character of each byte: itself where printable, else the next free one from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, free = [], 256
    for b in range(256):
        out.append(chr(b if b in shown else free))
        free += b not in shown
    return out


@functools.cache
def _undecided() -> np.ndarray:
    """For each code point, whether the ids of a text with it depend on the Unicode that the tokenizers library has: if the interpreter has
    not assigned it, or if it came after Unicode 3.2 and takes part in NFC (has a combining class, or is or is in a composition). How those
    of 3.2 compose is fixed for all versions."""
    old, out = unicodedata.ucd_3_2_0.category, np.zeros(sys.maxunicode + 1, bool)
    for i in range(sys.maxunicode + 1):
        c = chr(i)
        if old(c) != "Cn":
            continue
        if unicodedata.category(c) == "Cn" or unicodedata.combining(c):
            out[i] = True
        elif (parts := unicodedata.normalize("NFD", c)) != c:
            out[[ord(p) for p in c + parts if old(p) == "Cn"]] = True
    return out


@functools.cache
def _odd_points() -> tuple[str, dict[int, str], Callable[[str], str]]:
    """What follows from the versions of Unicode of `regex`, the interpreter and the tokenizers library, as the ids are to be the
    library's: the code points, as a set for a pattern, that `regex` calls letters or numbers and the library doesn't, the lower case of
    those that only the library knows to have one, and the library's NFC. Letters and cases differ only in what the interpreter has not
    assigned, compositions and the order of marks also in what the library's older NFC doesn't know. A missing library is an ImportError:
    nothing else says what it does with such a code point."""
    from tokenizers import Regex, normalizers, pre_tokenizers

    some = regex.compile(r"[\p{L}\p{N}]")
    open_ = [chr(c) for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c)) == "Cn"]
    text = "".join(c for c in open_ if some.match(c))
    known = set()
    for _, (a, b) in pre_tokenizers.Split(Regex(r"[^\p{L}\p{N}]"), "removed").pre_tokenize_str(text):
        known.update(text[a:b])
    capital, lower = regex.compile(r"[\p{Lu}\p{Lt}]"), normalizers.Lowercase().normalize_str
    odd = "".join(map(regex.escape, sorted(set(text) - known)))
    return odd, {ord(c): lower(c) for c in open_ if capital.match(c)}, normalizers.NFC().normalize_str


class Codec:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab, self.end = model["vocab"], model["end_of_word_suffix"]
        pair = lambda m: tuple(m.split(" ")) if isinstance(m, str) else tuple(m)
        self.ranks = {pair(m): i for i, m in enumerate(model["merges"])}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in [*self.vocab.items(), *self.special.items()]}
        self.inside = {p for t in self.vocab for s in [self._symbols(t)] for p in zip(s, s[1:], strict=False)}
        self.pieces = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^" + _SPACES + r"\p{L}\p{N}]+")
        self.undecided = _undecided()
        self.rare = regex.compile(f"[{chr(int(self.undecided.argmax()))}-\U0010ffff]")  # most texts have nothing from there on
        self.apart = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        self.bytes, self.known = _byte_chars(), {}

    def _symbols(self, token: str) -> list[str]:
        body = token[: -len(self.end)] if token.endswith(self.end) else token
        out = list(body)
        if out and len(body) < len(token):
            out[-1] += self.end
        return out

    def fragments(self, symbols: list[str]) -> list[list[str]]:
        out = [symbols[:1]]
        for a, b in zip(symbols, symbols[1:], strict=False):
            if (a, b) in self.inside:
                out[-1].append(b)
            else:
                out.append([b])
        return out

    def merge(self, part: list[str]) -> list[str]:
        """part with its merges done, lowest rank first and leftmost of equals; only the neighbours of a merge are looked up anew."""
        if len(part) > _LONG:
            return self._merge_long(part)
        get, none = self.ranks.get, 1 << 60
        ranks = [get(p, none) for p in zip(part, part[1:], strict=False)]
        while ranks and (low := min(ranks)) < none:
            i = ranks.index(low)
            part[i] += part.pop(i + 1)
            del ranks[i]
            if i:
                ranks[i - 1] = get((part[i - 1], part[i]), none)
            if i < len(ranks):
                ranks[i] = get((part[i], part[i + 1]), none)
        return part

    def _merge_long(self, part: list[str]) -> list[str]:
        """The same by a heap of (rank, place) and linked neighbours: n log n for a fragment of n symbols, such as a run of one letter. An
        entry counts only while the pair at its place has that rank: a merge changes the pairs at its place and at the one before, and
        takes the place after away."""
        get, n = self.ranks.get, len(part)
        after, before, now = list(range(1, n + 1)), list(range(-1, n - 1)), [-1] * n
        heap = []

        def look(i):
            now[i] = -1 if after[i] >= n else get((part[i], part[after[i]]), -1)
            if now[i] >= 0:
                heapq.heappush(heap, (now[i], i))

        for i in range(n):
            look(i)
        while heap:
            rank, i = heapq.heappop(heap)
            if now[i] != rank:
                continue
            j = after[i]
            part[i] += part[j]
            now[j], part[j], after[i] = -1, None, after[j]
            if after[i] < n:
                before[after[i]] = i
            look(i)
            if before[i] >= 0:
                look(before[i])
        return [p for p in part if p is not None]

    def piece(self, text: str) -> bytes:
        symbols = [self.bytes[b] for b in text.encode("utf-8")]
        symbols[-1] += self.end
        tokens = [t for part in self.fragments(symbols) for t in self.merge(part)]
        return b"".join(self.vocab[t].to_bytes(4, "little") for t in tokens)

    @functools.cached_property
    def odd(self) -> tuple:
        """NFC, lower cases and the pattern of pieces for texts with undecided code points, from the library."""
        odd, lower, composed = _odd_points()
        letter, number = (rf"[\p{{{c}}}--[{odd}]]" if odd else rf"\p{{{c}}}" for c in "LN")
        return composed, lower, regex.compile(rf"(?V1)'s|'t|'re|'ve|'m|'ll|'d|{letter}+|{number}|(?:(?!{letter}|{number})[^{_SPACES}])+")

    def prepared(self, part: str) -> tuple[str, regex.Pattern]:
        """part composed and in lower case, and the pattern of its pieces."""
        composed, lower, pieces = functools.partial(unicodedata.normalize, "NFC"), None, self.pieces
        if not part.isascii() and self.rare.search(part):
            found = self.undecided[np.frombuffer(part.encode("utf-32-le"), "<u4")]
            if found.any():
                try:
                    composed, lower, pieces = self.odd
                except ImportError as e:
                    c = ord(part[found.argmax()])
                    raise RuntimeError(f"U+{c:04X} is not in every version of Unicode, and its ids are to be the tokenizers library's, which can't be imported") from e
        part = composed(part).replace("Σ", "σ").lower()
        return part.translate(lower) if lower else part, pieces

    def encode(self, text: str) -> tuple[bytes, str]:
        """The ids as little-endian 32-bit integers, and the text decoded from them. Where the tokenizers library can't be imported, a text
        with an undecided code point is an error, since its ids would be a guess; others don't need the library."""
        ids, known = [], self.known
        for part in self.apart.split(text) if "<|" in text else [text]:
            if part in self.special:
                ids.append(self.special[part].to_bytes(4, "little"))
                continue
            part, pieces = self.prepared(part)
            for word in pieces.findall(part):
                got = known.get(word)
                if got is None:
                    if len(known) >= _CACHE:
                        known.clear()
                    got = self.piece(word)
                    if len(word) <= _KEPT:
                        known[word] = got
                ids.append(got)
        raw = b"".join(ids)
        return raw, self.decode(raw)

    def decode(self, ids: bytes) -> str:
        return " ".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encode_docs(docs, path: str | None = None):
    """doc_id, ids (binary, little-endian unsigned 32-bit) and decoded for each row of docs (doc_id, text).

    Null text is empty and has no ids. Every row is encoded by itself, whole: repeated rows alike, an empty table gives an empty
    result. Other columns of docs are not carried. path is that of the vocabulary on every executor.
    """
    path = path or vocabulary_path()

    def run(batches):
        codec = Codec(path)
        for batch in slices(batches):
            made = [codec.encode(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([m[0] for m in made], pa.binary()), pa.array([m[1] for m in made], pa.string())], ["doc_id", "ids", "decoded"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", whole("text").alias("text")).mapInArrow(run, f"doc_id {kind}, ids binary, decoded string")


def digests(docs, path: str | None = None):
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 for each row of docs, as encode_docs makes them; made in the workers, so ids and
    texts don't travel. Null, empty, repeated and very long texts, extra columns and an empty table: as there."""
    path = path or vocabulary_path()

    def run(batches):
        codec, sha = Codec(path), lambda b: hashlib.sha256(b).hexdigest()
        for batch in slices(batches):
            made = [codec.encode(t) for t in batch.column(1).to_pylist()]
            cols = [[len(m[0]) // 4 for m in made], [sha(m[0]) for m in made], [sha(m[1].encode()) for m in made]]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", whole("text").alias("text")).mapInArrow(run, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def op6_bpe(spark, sf_dir: str):
    return digests(table(spark, sf_dir, "documents"))
