"""BPE encoding and decoding for a public word-level BPE vocabulary (a tokenizers JSON file).

A word's parts live in one contiguous array of boundaries beside an array of the
ranks of adjacent pairs; the minimum rank is found by a scan, its boundary is
deleted and the two neighbouring ranks are refreshed.  Words over LONG bytes keep
the same parts in linked arrays with a heap of ranks, which gives the same merges
without a quadratic scan.

Null texts are empty; special-token strings inside a text become their ids, as the
library does.  Decoding joins the vocabulary's strings by spaces, as the library
does for a file without a decoder.
"""
import hashlib
import heapq
import json

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import column, id_of, keyed, trimmed

LONG = 128
#: characters of a text up to which its words are listed at once
LISTED = 1 << 20
#: distinct words a task remembers before it starts anew
REMEMBERED = 400_000
_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_NONE = 1 << 60


def byte_letters() -> list:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, spare = [""] * 256, 256
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b] = chr(spare)
            spare += 1
    return out


def later_letters() -> tuple:
    """Code points that only newer Unicode versions assign to letters or digits, as ranges of a character class, and lower cases that
    the interpreter lacks.

    The library's own tables decide which: it is asked for the characters that the interpreter's Unicode version lacks.
    """
    import unicodedata

    from tokenizers import Regex, normalizers, pre_tokenizers

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    found = [ord(c) for c in regex.findall(r"[\p{L}\p{N}]", every) if unicodedata.category(c) == "Cn"]
    known = {ord(c) for c, _ in pre_tokenizers.Split(Regex(r"[\p{L}\p{N}]"), "removed", invert=True).pre_tokenize_str(" ".join(map(chr, found)))}
    ranges = []
    for c in (c for c in found if c not in known):
        if ranges and c == ranges[-1][1] + 1:
            ranges[-1][1] = c
        else:
            ranges.append([c, c])
    low = normalizers.Lowercase()
    folds = {c: x for c in found if (x := low.normalize_str(chr(c))) != chr(c)}
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges), folds


class Codec:
    def __init__(self, source: str, later: tuple | None = None):
        spec = json.loads(source)
        model = spec["model"]
        self.vocab = model["vocab"]
        self.end = model.get("end_of_word_suffix") or ""
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.ranks = {(a, b): i for i, (a, b) in enumerate(pairs)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.words = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{_SPACE}\p{{L}}\p{{N}}]+")
        later, self.folds = later_letters() if later is None else later
        self.folding = regex.compile("[" + "".join(map(chr, self.folds)) + "]") if self.folds else None
        self.later = regex.compile(f"[{later}]") if later else None
        if later:
            self.careful = regex.compile(rf"(?V1)'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}--[{later}]]+|[\p{{N}}--[{later}]]|[[^{_SPACE}\p{{L}}\p{{N}}]||[{later}]]+")
        found = sorted(map(regex.escape, self.special), key=len, reverse=True)
        self.specials = regex.compile("(" + "|".join(found) + ")") if found else None
        self.letters = byte_letters()
        self.known = {}

    def parts(self, word: str) -> list:
        """The word's final parts as vocabulary strings."""
        letters = [self.letters[b] for b in word.encode()]
        n = len(letters)
        if n == 1:
            return [letters[0] + self.end]
        if n > LONG:
            letters[-1] += self.end
            return self._long(letters)
        whole, rank = "".join(letters) + self.end, self.ranks.get
        # part i is whole[bounds[i] : bounds[i + 1]]; ranks[i] is that of parts i and i + 1
        bounds = [*range(n), len(whole)]
        ranks = [rank((whole[i : i + 1], whole[i + 1 : bounds[i + 2]]), _NONE) for i in range(n - 1)]
        while ranks:
            least = min(ranks)
            if least == _NONE:
                break
            at = ranks.index(least)
            del bounds[at + 1], ranks[at]
            a, b = bounds[at], bounds[at + 1]
            if at < len(ranks):
                ranks[at] = rank((whole[a:b], whole[b : bounds[at + 2]]), _NONE)
            if at:
                ranks[at - 1] = rank((whole[bounds[at - 1] : a], whole[a:b]), _NONE)
        return [whole[a:b] for a, b in zip(bounds, bounds[1:])]

    def _long(self, letters: list) -> list:
        n, rank = len(letters), self.ranks.get
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(r, i, letters[i], letters[i + 1]) for i in range(n - 1) if (r := rank((letters[i], letters[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if letters[i] != a or j < 0 or letters[j] != b:
                continue
            letters[i], letters[j] = a + b, None
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
                if (r := rank((letters[i], letters[after[i]]))) is not None:
                    heapq.heappush(heap, (r, i, letters[i], letters[after[i]]))
            if before[i] >= 0 and (r := rank((letters[before[i]], letters[i]))) is not None:
                heapq.heappush(heap, (r, before[i], letters[before[i]], letters[i]))
        return [x for x in letters if x is not None]

    def _piece(self, text: str, ids: list, out: list) -> None:
        if not text:
            return
        words, known = self.words, self.known
        if not text.isascii():
            import unicodedata

            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
            if self.folding is not None and self.folding.search(text):
                text = text.translate(self.folds)
            if self.later is not None and self.later.search(text):
                words = self.careful
        text = text.lower()
        for word in words.findall(text) if len(text) <= LISTED else (m.group() for m in words.finditer(text)):
            got = known.get(word)
            if got is None:
                if len(known) >= REMEMBERED:
                    known.clear()
                parts = [x for x in self.parts(word) if x in self.vocab]
                got = known[word] = (np.array([self.vocab[x] for x in parts], "<u4").tobytes(), " ".join(parts))
            if got[0]:
                ids.append(got[0])
                out.append(got[1])

    def encode(self, text) -> tuple:
        """(ids as little-endian unsigned 32-bit integers, the decoded text)."""
        ids, out = [], []
        if not text:
            return b"", ""
        if self.specials is None or "<" not in text:
            self._piece(text, ids, out)
        else:
            for piece in self.specials.split(text):
                if piece in self.special:
                    ids.append(np.uint32(self.special[piece]).astype("<u4").tobytes())
                    out.append(piece)
                else:
                    self._piece(piece, ids, out)
        return b"".join(ids), " ".join(out)


def load(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def _encode(source, digest: bool):
    def run(batches):
        codec = Codec(*source.value)
        for batch in trimmed(batches):
            n, a, b = [], [], []
            for text in column(batch, "text").to_pylist():
                ids, decoded = codec.encode(text)
                n.append(len(ids) >> 2)
                a.append(hashlib.sha256(ids).hexdigest() if digest else np.frombuffer(ids, "<u4").astype(np.int64).tolist())
                b.append(hashlib.sha256(decoded.encode()).hexdigest() if digest else decoded)
            kinds = (pa.string(), pa.string()) if digest else (pa.list_(pa.int64()), pa.string())
            yield pa.RecordBatch.from_arrays([column(batch, "_k"), pa.array(n, pa.int64()), pa.array(a, kinds[0]), pa.array(b, kinds[1])],
                                             ["_k", "n_tokens", "ids", "decoded"])

    return run


def encoded(docs: DataFrame, path: str, digest: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids, decoded of every document row; with digest, SHA-256 instead of the last two."""
    source = docs.sparkSession.sparkContext.broadcast((load(path), later_letters()))  # a fixed public file of under 2 MB
    kinds = "ids string, decoded string" if digest else "ids array<long>, decoded string"
    rows = keyed(docs).select("_k", "text").mapInArrow(_encode(source, digest), f"_k long, n_tokens long, {kinds}")
    return rows.select(id_of().alias("doc_id"), "n_tokens", "ids", "decoded")


def digests(docs: DataFrame, path: str) -> DataFrame:
    return encoded(docs, path, digest=True).withColumnsRenamed({"ids": "ids_sha256", "decoded": "decoded_sha256"})


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    import public_tokenizers

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
