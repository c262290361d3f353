"""Byte-level BPE encoding and decoding.

A text is cut into overlapping chunks (one, if it has at most CHUNK characters), which are pre-tokenised in parallel, each
from its own start, and whose pre-tokens are encoded where they are found, each by itself, by the same code for all texts.
Two neighbouring chunks resynchronise at the first boundary that both find in their overlap: matching is memoryless, so
from there on they agree. The stitched boundaries cut the text into the same pre-tokens as one pass over it. Where an
overlap holds no common boundary (one run of letters longer than the overlap), pre-tokenising goes on from the last sure
boundary over as much text as it takes. Decoding concatenates the raw bytes of the tokens.

Patterns: a match may depend on what it matches and on the character after it, as all patterns of public byte-level
vocabularies do; others (lookbehind, longer lookahead, word boundaries, anchors) are rejected with a ValueError.

Scale: texts of one chunk are encoded where they are read; only chunks of longer ones are shuffled, encoded evenly, and
meet by text: a digest of all its tokens needs them in order, so a task holds one text and its tokens. The ranks are read
from a parameter path on each worker, never broadcast.

Edge cases: null and empty texts give no tokens; equal rows (doc_id and text) each give a row, and long ones are encoded
once; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, slices, texts

#: Characters of a chunk, and of the overlap that follows it.
CHUNK, OVERLAP = 32_768, 2_048
#: What a pattern may look at beyond the end of a match: a boundary nearer to the cut than this isn't sure.
AHEAD = 4

_CODERS: dict[tuple[str, str], "Coder"] = {}
#: Pieces whose tokens a worker remembers, twice as many at most.
KNOWN = 60_000
Span = tuple[int, int]


def check_pattern(pattern: str) -> None:
    """ValueError for patterns whose matches do not depend on what they match and the character after it alone."""
    rest = re.sub(r"\(\?[=!](?:\\[A-Za-z](?:\{\^?\w+\})?|\[(?:[^\]\\]|\\.)*\]|[^\\()\[])\)", "", pattern)  # looks one character ahead
    if found := re.search(r"\(\?<?[=!]|\\[bBGKAZz]|(?<![\[\\])[\^$]", rest):
        raise ValueError(f"chunks cannot be stitched by a pattern with {found[0]}")


class Pieces(dict):
    """piece -> tokens. When it is full, those of the last KNOWN pieces that come again are kept."""

    def __init__(self, encode: Callable[[str], list[int]]):
        self.encode, self.old = encode, {}

    def __missing__(self, piece: str) -> list[int]:
        ids = self.old.get(piece)
        if ids is None:
            ids = self.encode(piece)
        if len(piece) <= 32:
            if len(self) >= KNOWN:
                self.old = dict(self)
                self.clear()
            self[piece] = ids
        return ids


class Coder:
    """Ranks and pattern of a byte-level BPE vocabulary."""

    def __init__(self, path: str, pattern: str):
        import regex
        import tiktoken

        check_pattern(pattern)
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.pattern = regex.compile(pattern)
        # merges one piece at a time: its own pattern takes any text whole
        self.merges = tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
        self.bytes = [b""] * (max(ranks.values()) + 1)
        for raw, rank in ranks.items():
            self.bytes[rank] = raw
        self.decimal = [str(i) for i in range(len(self.bytes))]
        self.known = Pieces(self.merges.encode_ordinary)

    @classmethod
    def of(cls, path: str, pattern: str) -> "Coder":
        """Read once per Python worker."""
        if (path, pattern) not in _CODERS:
            _CODERS[path, pattern] = cls(path, pattern)
        return _CODERS[path, pattern]

    def spans(self, text: str) -> list[Span]:
        """The pre-tokens when matching begins at the text's start. What the pattern skips, if anything, belongs to none."""
        return [m.span() for m in self.pattern.finditer(text)]

    def pieces(self, text: str) -> list[str]:
        """The same as strings."""
        return [m[0] for m in self.pattern.finditer(text)] if self.pattern.groups else self.pattern.findall(text)

    def tokens(self, pieces: Iterable[str]) -> list[int]:
        """The tokens of the pre-tokens, each by itself."""
        return list(itertools.chain.from_iterable(map(self.known.__getitem__, pieces)))

    def encode(self, text: str) -> list[int]:
        return self.tokens(self.pieces(text))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


def cut(text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[str]:
    """Chunk k: `chunk` characters from k * chunk on, and `overlap` more."""
    return [text[a : a + chunk + overlap] for a in range(0, max(1, len(text)), chunk)]


def stitch(coder: Coder, text: str, found: list[list[Span]], chunk: int = CHUNK, overlap: int = OVERLAP) -> list[Span]:
    """All pre-tokens of the text from those of its chunks (absolute, each matched from its chunk's start)."""
    out: list[Span] = []
    k, mine = 0, found[0]  # right as long as they end before what the chunk has seen
    while k < len(found) - 1:
        lo, end = (k + 1) * chunk, (k + 1) * chunk + overlap
        sure = mine if end >= len(text) else [p for p in mine if p[0] < end - AHEAD][:-1]
        theirs = {p[0] for p in found[k + 1]}
        j, meet = k + 1, next((p[0] for p in sure if p[0] >= lo and p[0] in theirs), None)
        if meet is None:  # no common boundary in the overlap: go on from the last sure one, over ever more text
            base = sure[-1][0] if sure else mine[0][0] if mine else k * chunk
            sure, reach = [p for p in sure if p[0] < base], end
            while meet is None:
                reach = min(len(text), reach + max(chunk, reach - base))
                fresh = [(base + a, base + b) for a, b in coder.spans(text[base:reach])]
                fresh = fresh if reach == len(text) else [p for p in fresh if p[0] < reach - AHEAD][:-1]
                for j in range(k + 1, len(found)):
                    theirs = {p[0] for p in found[j]}
                    meet = next((p[0] for p in fresh if p[0] >= j * chunk and p[0] in theirs), None)
                    if meet is not None:
                        break
                if meet is None and reach == len(text):
                    return out + sure + fresh
            sure = sure + fresh
        out += [p for p in sure if p[0] < meet]
        k, mine = j, [p for p in found[j] if p[0] >= meet]
    return out + mine


def encode_long(coder: Coder, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[int]:
    """The same on one machine: cut, pre-tokenise each chunk, stitch, encode."""
    parts = cut(text, chunk, overlap)
    found = [[(k * chunk + a, k * chunk + b) for a, b in coder.spans(part)] for k, part in enumerate(parts)]
    return coder.tokens(text[a:b] for a, b in stitch(coder, text, found, chunk, overlap))


SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _digest(coder: Coder, ids: list[int]) -> tuple[int, str, str]:
    return len(ids), hashlib.sha256(" ".join(map(coder.decimal.__getitem__, ids)).encode()).hexdigest(), hashlib.sha256(coder.decode(ids)).hexdigest()


_CHUNKS = "row1 long, row2 long, doc_id long, k int, piece string"
_CODED = _CHUNKS + ", starts array<int>, ends array<int>, counts array<int>, ids array<int>"


def _apply(docs: DataFrame, path: str, pattern: str, schema: str, result: Callable[[Coder, list[int]], tuple]) -> DataFrame:
    """One row a document: doc_id and result(coder, ids)."""
    check_pattern(pattern)
    rows, arrow, coded = texts(docs), arrow_schema(schema), arrow_schema(_CODED)

    def one_chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder.of(path, pattern)
        for batch in batches:
            for part in slices(batch):
                out = [(d, *result(coder, coder.encode(t))) for d, t in zip(part["doc_id"].to_pylist(), part["text"].to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), arrow.types, strict=True)], schema=arrow)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder.of(path, pattern)
        for batch in batches:
            for part in slices(batch):
                made: list[list[list[int]]] = [[], [], [], []]
                for piece in part["piece"].to_pylist():
                    spans = coder.spans(piece)
                    each = [coder.known[piece[a:b]] for a, b in spans]
                    for x, v in zip(made, ([a for a, _ in spans], [b for _, b in spans], [*map(len, each)], [*itertools.chain.from_iterable(each)]), strict=True):
                        x.append(v)
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(x, pa.list_(pa.int32())) for x in made)], schema=coded)

    def stitched(pdf: pd.DataFrame) -> pd.DataFrame:
        coder = Coder.of(path, pattern)
        pdf = pdf.drop_duplicates("k").sort_values("k")
        text = "".join(p[:CHUNK] for p in pdf["piece"])
        found, known = [], {}
        for k, starts, ends, counts, ids in zip(*(pdf[c].tolist() for c in ("k", "starts", "ends", "counts", "ids")), strict=True):
            found.append(list(zip((starts + k * CHUNK).tolist(), (ends + k * CHUNK).tolist(), strict=True)))
            upto = np.cumsum(counts).tolist()
            known |= {p: (ids, b - n, b) for p, n, b in zip(found[-1], counts.tolist(), upto, strict=True)}
        out: list[int] = []
        for p in stitch(coder, text, found):
            own = known.get(p)  # a chunk's pre-token, or one that no chunk has seen whole
            out += own[0][own[1] : own[2]].tolist() if own else coder.known[text[p[0] : p[1]]]
        d = pdf["doc_id"].iloc[0]
        return pd.DataFrame([(None if pd.isna(d) else int(d), *result(coder, out))], columns=arrow.names)

    few = rows.where(F.length("text") <= CHUNK).mapInArrow(one_chunk, schema)
    # equal rows (doc_id and text) have one name and one set of chunks, and get as many rows as they are
    long = rows.where(F.length("text") > CHUNK).select(F.xxhash64("doc_id", "text").alias("row1"), F.xxhash64(F.lit(1), "text", "doc_id").alias("row2"), "doc_id", "text")
    chunks = long.mapInArrow(_chunks, _CHUNKS).repartition("row1", "row2", "k").mapInArrow(encoded, _CODED)
    copies = long.groupBy("row1", "row2").agg(F.count("*").alias("copies"))
    done = chunks.groupBy("row1", "row2").applyInPandas(lambda key, pdf: stitched(pdf).assign(row1=key[0], row2=key[1]), schema + ", row1 long, row2 long")
    many = done.join(copies, ["row1", "row2"]).select(*arrow.names, F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(*arrow.names)
    return few.unionByName(many)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = arrow_schema(_CHUNKS)
    for batch in batches:
        for part in slices(batch):
            out = [(*row, k, piece) for *row, t in zip(*(part[c].to_pylist() for c in ("row1", "row2", "doc_id", "text")), strict=True) for k, piece in enumerate(cut(t))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)


def report(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """The contract's row per document: doc_id, n_tokens, digest of the ids, digest of the decoded bytes."""
    return _apply(docs, path, pattern, SCHEMA, _digest)


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids: the tokens of each text."""
    return _apply(docs, path, pattern, "doc_id long, ids array<int>", lambda coder, ids: (ids,))


def decode(tokens: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, data: the raw bytes of ids (null ids: none)."""
    schema = arrow_schema("doc_id long, data binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder.of(path, pattern)
        for batch in batches:
            for part in slices(batch):
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array([coder.decode(x or []) for x in part["ids"].to_pylist()], pa.binary())], schema=schema)

    return tokens.select("doc_id", "ids").mapInArrow(run, "doc_id long, data binary")
