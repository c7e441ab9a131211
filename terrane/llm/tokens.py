"""Token ids and counts of whole texts by public tokenizers.

Counts: a pre-token is encoded by the tokenizers library once and remembered;
merges stay inside pre-tokens, so a text's count is the sum over its pre-tokens.
Ids: byte_bpe_50k.tiktoken holds the vocabulary of byte_bpe_50k.json as ranks,
and tiktoken gives the same ids several times faster; texts with very long
pre-tokens go to the tokenizers library. Tests hold both against the library.
"""

from __future__ import annotations

import base64
import json
import os
import re
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TOKENIZER_DIR, by_value, id_and_text, table

by_value(__name__)

# Pre-token patterns of the two vocabularies (the second over raw text, with either case of the contractions).
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD_PATTERN = r"'[sS]|'[tT]|'[rR][eE]|'[vV][eE]|'[mM]|'[lL][lL]|'[dD]|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"
#: Pre-tokens remembered by a task at most; then the memory starts anew.
REMEMBER = 300_000
#: Characters of a pre-token that is remembered at most.
LONG = 64
#: Characters of a chunk of a huge document, and of the first overlap tried.
CHUNK, OVERLAP = 16_000, 500
#: White space under every definition of it.
BLANKS = " \t\r\n"
#: Characters without (or of) white space from which a text's ids come from the tokenizers library.
LONG_RUN = 2_000


class _Memory(dict):
    """Pre-token to what the library makes of it."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, piece):
        value = self.make(piece)
        if len(piece) <= LONG:
            if len(self) >= REMEMBER:
                self.clear()
            self[piece] = value
        return value


def load(path: str):
    """A tokenizer of the library that does not cut, pad or use threads."""
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def kind_of(path: str) -> str:
    """"byte" or "word", the vocabularies whose pre-tokens and boundaries this module knows; others are an error, not a guess."""
    with open(path, encoding="utf-8") as f:
        made = json.load(f)
    steps = lambda part, inner: [] if part is None else [x["type"] for x in part.get(inner, [part])]
    shape = (steps(made["normalizer"], "normalizers"), steps(made["pre_tokenizer"], "pretokenizers"))
    plain = all(not any(c.isspace() for c in t["content"]) and not t["lstrip"] and not t["rstrip"] and not t["single_word"] for t in made["added_tokens"])
    known = {"byte": ([], ["ByteLevel"]), "word": (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"])}
    for name, of in known.items():
        if shape == of and plain:
            return name
    raise ValueError(f"no proven boundaries are known for the vocabulary {path}: {shape}")


def reader(path: str) -> "TokenReader":
    """The worker's reader of a vocabulary: a Python worker runs many tasks, and what it remembers serves them all."""
    import tokenizers

    kept = vars(tokenizers).setdefault("_readers_of_this_worker", {})
    if path not in kept:
        kept[path] = TokenReader(path)
    return kept[path]


class TokenReader:
    """Ids or counts of whole texts under one vocabulary of the two kinds that this module knows."""

    def __init__(self, path: str):
        self.library = load(path)
        self.lower = kind_of(path) == "word"
        self.pattern = regex.compile(WORD_PATTERN if self.lower else BYTE_PATTERN)
        special = {t.content: i for i, t in self.library.get_added_tokens_decoder().items()}
        self.special = special
        self.cut = regex.compile("(" + "|".join(map(regex.escape, special)) + ")")
        self.ranks, self.long_run = None, re.compile(r"\S{%d}|\s{%d}" % (LONG_RUN, LONG_RUN))
        if os.path.exists(same := path.removesuffix(".json") + ".tiktoken"):
            import tiktoken

            with open(same, "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.ranks = tiktoken.Encoding("ranks", pat_str=BYTE_PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.count_of = _Memory(lambda p: len(self.library.encode(p, add_special_tokens=False).ids))

    def _parts(self, text: str):
        return self.cut.split(text) if any(s in text for s in self.special) else [text]

    def _plain(self, text: str) -> str | None:
        """The text as its pre-tokens can be cut from, or None where only the library can tell.

        The lower-case form of U+0130 has a mark that may join what follows.
        """
        if not self.lower:
            return text
        if "İ" in text:
            return None
        return text if unicodedata.is_normalized("NFC", text) else unicodedata.normalize("NFC", text)

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if self.ranks is None or len(text) > LONG_RUN and self.long_run.search(text):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        return self.ranks.encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False).tobytes()

    def count(self, text: str) -> int:
        n = 0
        for part in self._parts(text):
            if part in self.special:
                n += 1
            elif (plain := self._plain(part)) is None:
                n += len(self.library.encode(part, add_special_tokens=False).ids)
            else:
                n += sum(map(self.count_of.__getitem__, self.pattern.findall(plain)))
        return n

    def spans(self, text: str) -> list[tuple[int, int]]:
        """(start, tokens) of each pre-token or special string of a chunk, by characters of the chunk."""
        found, at = [], 0
        for part in self._parts(text):
            if part in self.special:
                found.append((at, 1))
            elif self.lower and ("İ" in part or not unicodedata.is_normalized("NFC", part)):
                # the library keeps offsets of the raw text through its normalisation
                starts = {}
                for a, _ in self.library.encode(part, add_special_tokens=False).offsets:
                    starts[a] = starts.get(a, 0) + 1
                found += [(at + a, n) for a, n in sorted(starts.items())]
            else:
                found += [(at + m.start(), self.count_of[m.group()]) for m in self.pattern.finditer(part)]
            at += len(part)
        return found

    def count_spliced(self, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
        """Tokens of a huge text from overlapping chunks.

        Each chunk is encoded with offsets. Where two chunks overlap, they are
        spliced at an offset at which both start a token and which is proven to
        be a boundary (see `_splice`), so what stands after it is encoded the same
        from any earlier start. If an overlap has no such offset it is widened; at
        worst it becomes the text.
        """
        total, start, size, lap = 0, 0, chunk, overlap
        while True:
            end = min(len(text), start + size)
            left = [(start + a, n) for a, n in self.spans(text[start:end])]
            if end == len(text):
                return total + sum(n for _, n in left)
            at = None
            while at is None and lap < end - start:
                begin = end - lap
                right = [(begin + a, n) for a, n in self.spans(text[begin : end + lap])]
                at = self._splice(text, left, right, begin)
                lap *= 2
            if at is None:  # not even the whole chunk has a proven boundary
                size *= 2
                lap = overlap
                continue
            total += sum(n for a, n in left if a < at)
            start, size, lap = at, chunk, overlap

    def _splice(self, text: str, left, right, begin: int) -> int | None:
        """The first common start that no pre-token, special string or normalisation crosses, whatever stands around it.

        Word vocabulary: after a blank, for its pre-tokens hold no white space and
        no character composes with a blank. Byte vocabulary: before a blank that
        follows another character, for its pre-tokens may begin with white space
        but never go on with it. Special strings hold none.
        """
        starts = {a for a, _ in left if a > begin}
        for a, _ in right:
            if a > begin and a in starts and (text[a - 1] in BLANKS if self.lower else text[a] in BLANKS and not text[a - 1].isspace()):
                return a
        return None


def token_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "word_bpe_49k.json", limit: int = 2048, tokenizer_dir: str = TOKENIZER_DIR) -> DataFrame:
    """Tokens of every whole text as the vocabulary's library gives them, special strings as its default.

    Texts over CHUNK characters are counted from overlapping chunks spliced at
    proven boundaries, in bounded memory; nothing is cut or skipped.

    Returns doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit): one
    row per input row, repeated rows and null ids included. Null text counts as
    empty (0 tokens). An empty table gives no rows; other columns are ignored.
    """
    path = os.path.join(tokenizer_dir, vocabulary)

    def batches(it):
        of = reader(path)
        for b in it:
            n = [of.count(t) if len(t) <= CHUNK else of.count_spliced(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    docs = id_and_text(df, id_col, text_col).withColumn("n_bytes", F.octet_length("text").cast("long"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    counted = docs.mapInArrow(batches, f"doc_id {kind}, n_bytes bigint, n_tokens bigint")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def op6(spark, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
