"""Exact substring dedup by the interval tree of an enhanced, sparse suffix array.

Texts are UTF-8 bytes. Every byte goes that lies in a LENGTH-byte string which also starts earlier: in a smaller
doc_id, or earlier in the same document. Strings are judged on the input.

1. Anchors. A window of LENGTH bytes is represented by the GRAM-byte string in it whose hash is smallest (all of them,
   where several tie). Equal windows have equal anchors at equal places, so a suffix array needs only the suffixes that
   start at anchors, about one in 35, and suffixes that can share a window begin with the same GRAM bytes: they are
   dealt out by that fingerprint, which is the first LENGTH-independent part of the suffix order. An anchor's context
   is what windows around it can hold: LENGTH - GRAM bytes before it and LENGTH from it on.
2. Leaves. Occurrences with one fingerprint and one context are one leaf of the array, known by its earliest
   occurrence; every other occurrence of a leaf repeats it whole. Most leaves are alone and done.
3. Tree. Where a fingerprint has several leaves, their contexts are read in a second scan. The leaves are sorted by
   right context, neighbours' common prefixes give the intervals of the tree by a stack scan, and in each interval the
   leaves are sorted by left context, whose common suffixes give the groups with diverse left extensions: the maximal
   repeats, with all their occurrences. In each group of at least LENGTH bytes all but the earliest lose the repeat.
   A fingerprint with more than LEAVES leaves (a short passage in very many surroundings) is not held by one task: the
   tree's nodes of LENGTH bytes are grouped instead, with the same spans.

Scale: a row of some 30 bytes per anchor is shuffled once; of a leaf's occurrences in about a MB of text only the earliest
goes to its fingerprint's task, the others are repeats already and are dealt out evenly; contexts only for leaves that have others beside them,
picked in the second scan by a Bloom filter (a false positive only ships a context more), or by a join where that would
take more than 32 MB. A document's spans are made one where they touch before they meet its text. Whole copies
of a text are set aside first by digest, so that a text which a third of the rows repeat makes no hot anchors. Leaves
stream from sorted partitions.

Edge cases: null and empty texts have no bytes and stay; texts shorter than LENGTH stay; a null doc_id counts as the
largest; one very long text is held by one task, in pieces of a MB but for the text itself; equal rows (doc_id and text) are one document and get the same result; rows with one doc_id and different
texts are told apart by their checksum, the smaller first at equal starts; other columns are ignored by `report` and
carried by `dedup`, where bytes that no longer form a character are dropped.
"""

from __future__ import annotations

import hashlib
import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MOST_BLOOM, arrow_schema, bloom, bloom_room, in_bloom, slices, stored

LENGTH, GRAM = 100, 32
REACH = LENGTH - GRAM  # bytes before an anchor that a window around it can hold
LAST_ID = (1 << 63) - 1
#: Whole copies up to so many are broadcast by id (8 bytes each).
BROADCAST_IDS = 500_000
#: A task holds a fingerprint's leaves up to so many (some 200 bytes each, and as much again for the tree).
LEAVES = 20_000
_PIECE = 1 << 20
_TABLE = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_STEPS = ((1, 0x9E3779B97F4A7C15), (2, 0xC2B2AE3D27D4EB4F), (4, 0x165667B19E3779F9), (8, 0xD6E8FEB86659FD93), (16, 0xFF51AFD7ED558CCD))


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from each place on."""
    h = _TABLE[data]
    with np.errstate(over="ignore"):
        for step, m in _STEPS:
            h = h[:-step] * np.uint64(m) + h[step:]
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    return h | np.uint64(1)


def _slide(x: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """pick over x[i : i + width] for each i."""
    size = 1
    while size * 2 <= width:
        x = pick(x[:-size], x[size:])
        size *= 2
    return pick(x[: len(x) - (width - size)], x[width - size :]) if width > size else x


def anchors(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the anchors in the texts that data holds one after another (each to its end), and their fingerprints."""
    places, prints = [], []
    for lo in range(0, len(data), _PIECE):  # windows that start in a piece
        part = data[lo : lo + _PIECE + LENGTH - 1]
        if len(part) < LENGTH:
            break
        h = _gram_hashes(part)
        low = _slide(h, REACH + 1, np.minimum)
        start = lo + np.arange(len(low))
        low[start + LENGTH > ends[np.searchsorted(ends, start, side="right")]] = 0  # leads into the next text
        pad = np.zeros(REACH, np.uint64)
        high = _slide(np.concatenate([pad, low, pad]), REACH + 1, np.maximum)
        at = np.flatnonzero(high == h)
        places.append(at + lo)
        prints.append(h[at])
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    all_, first = np.unique(np.concatenate(places), return_index=True)
    return all_, np.concatenate(prints)[first]


def _anchored(part: pa.RecordBatch) -> Iterator[tuple[int, int, bytes, int, np.ndarray, np.ndarray]]:
    """(row, doc, text, checksum, places, fingerprints) of each text with anchors."""
    raws = part["text"].cast(pa.binary()).to_pylist()
    ends = np.cumsum([len(r) for r in raws])
    place, print_ = anchors(np.frombuffer(b"".join(raws), np.uint8), ends)
    cuts = np.searchsorted(place, np.r_[0, ends])
    for k, (doc, raw) in enumerate(zip(part["doc"].to_pylist(), raws, strict=True)):
        a, b = cuts[k], cuts[k + 1]
        if b > a:
            yield k, doc, raw, zlib.crc32(raw), place[a:b] - (ends[k] - len(raw)), print_[a:b]


def _where(place: np.ndarray, checksum: int) -> np.ndarray:
    return (place.astype(np.int64) << 32) | checksum


_ANCHORS = "sure boolean, print long, context long, doc long, place long"


def _not_first(prints: np.ndarray, contexts: np.ndarray, docs: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Whether a leaf's occurrence has an earlier one among these rows: a repeat, whatever the other rows are."""
    order = np.lexsort((places, docs, contexts, prints))
    p, c, d, w = (x[order] for x in (prints, contexts, docs, places))
    first = np.flatnonzero(np.r_[True, (p[1:] != p[:-1]) | (c[1:] != c[:-1])])
    of = np.repeat(first, np.diff(np.r_[first, len(p)]))
    out = np.zeros(len(p), bool)
    out[order] = (d != d[of]) | (w != w[of])
    return out


def anchor_rows(rows: DataFrame) -> DataFrame:
    """(sure, print, context, doc, place): surely a repeat, fingerprint, digest of the context, document, and place << 32 | checksum."""
    schema = arrow_schema(_ANCHORS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, _PIECE):
                prints, contexts, docs, places = [], [], [], []
                for _, doc, raw, checksum, place, print_ in _anchored(part):
                    prints.append(print_.view(np.int64))
                    contexts += [xxhash.xxh3_64_intdigest(raw[max(0, p - REACH) : p + LENGTH], min(p, REACH)) for p in place.tolist()]
                    docs.append(np.full(len(place), doc, np.int64))
                    places.append(_where(place, checksum))
                if prints:
                    found = (np.concatenate(prints), np.array(contexts, np.uint64).view(np.int64), np.concatenate(docs), np.concatenate(places))
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (_not_first(*found), *found)], schema=schema)

    return rows.mapInArrow(run, _ANCHORS)


def leaves(anchored: DataFrame) -> DataFrame:
    """(repeat, print, doc, place): occurrences that are not their leaf's first (repeat), and the first ones of leaves whose fingerprint has others."""
    schema = arrow_schema("repeat boolean, print long, doc long, place long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, open_ = None, None  # the last row's (print, context) and its leaf's first (doc, place); the first leaf of its fingerprint, while it is the only one

        for batch in batches:
            if not batch.num_rows:
                continue
            sure = batch["sure"].to_numpy(zero_copy_only=False)
            if sure.any():  # dealt out evenly, sorted behind the others
                at = np.flatnonzero(sure)
                yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(at), bool)), *(pa.array(batch[x].to_numpy()[at]) for x in ("print", "doc", "place"))], schema=schema)
                if len(at) == len(sure):
                    continue
            p, c, d, w = (batch[x].to_numpy()[~sure] for x in ("print", "context", "doc", "place"))
            same_p = np.r_[last is not None and last[0] == p[0], p[1:] == p[:-1]]
            same_leaf = same_p & np.r_[last is not None and last[1] == c[0], c[1:] == c[:-1]]
            first = np.flatnonzero(~same_leaf)
            more = same_p[first]  # not the first leaf of its fingerprint
            ask = more.copy()
            ask[:-1] |= more[1:]  # the first leaf, as the next one has its fingerprint
            out = []
            if len(first):
                if more[0] and open_ is not None:
                    out.append(open_)
                at = first[-1]
                open_ = None if ask[-1] else (int(p[at]), int(d[at]), int(w[at]))
            of = np.cumsum(~same_leaf)  # 0: the last batch's leaf
            first_d, first_w = (np.r_[x0, x[first]][of] for x0, x in (((last or (0, 0, 0, 0))[2], d), ((last or (0, 0, 0, 0))[3], w)))
            last = (p[-1], c[-1], first_d[-1], first_w[-1])
            again, new = np.flatnonzero((d != first_d) | (w != first_w)), first[ask]  # an equal row twice is no repeat
            rows = [np.r_[np.ones(len(again), bool), np.zeros(len(new), bool)], *(np.r_[x[again], x[new]] for x in (p, d, w))]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in rows], schema=schema)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([False]), *(pa.array([x], pa.int64()) for x in out[0])], schema=schema)

    dealt = anchored.withColumn("to", F.when(F.col("sure"), F.xxhash64("doc", "place")).otherwise(F.col("print"))).repartition("to").drop("to")
    return dealt.sortWithinPartitions("sure", "print", "context", "doc", "place").mapInArrow(run, "repeat boolean, print long, doc long, place long")


def _named(doc: np.ndarray, place: np.ndarray) -> np.ndarray:
    """One number for each (doc, place)."""
    with np.errstate(over="ignore"):
        return (doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (place.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


def asked_for(asked: DataFrame, room: int) -> np.ndarray:
    """The Bloom filter of (doc, place)."""
    return bloom(asked.select("doc", "place"), room, lambda batch: _named(batch["doc"].to_numpy(), batch["place"].to_numpy()))


_CONTEXTS = "print long, doc long, place long, before binary, after binary"


def contexts(rows: DataFrame, asked: DataFrame, n: int) -> DataFrame:
    """(print, doc, place, before, after) of the n anchors asked for, (doc, place), and perhaps a few more; before is reversed.

    As long as a Bloom filter of what is asked for fits MOST_BLOOM the texts are read again and the filter picks the
    anchors; beyond that each document's places are joined to its text."""
    schema = arrow_schema(_CONTEXTS)
    sent = rows.sparkSession.sparkContext.broadcast(asked_for(asked, bloom_room(n))) if 8 * n <= MOST_BLOOM else None
    if sent is None:
        own = asked.groupBy("doc", F.col("place").bitwiseAND(F.lit(0xFFFFFFFF)).alias("checksum")).agg(F.collect_list("place").alias("places"))
        rows = rows.withColumn("checksum", F.crc32("text")).join(own, ["doc", "checksum"]).select("doc", "text", "places")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, _PIECE):
                out: list[list] = [[], [], [], [], []]
                for k, doc, raw, checksum, place, print_ in _anchored(part):
                    where = _where(place, checksum)
                    ok = np.flatnonzero(in_bloom(sent.value, _named(np.full(len(place), doc, np.int64), where)) if sent else np.isin(where, part["places"][k].values.to_numpy()))
                    for p, w, f in zip(place[ok].tolist(), where[ok].tolist(), print_[ok].view(np.int64).tolist(), strict=True):
                        for x, v in zip(out, (f, doc, w, raw[max(0, p - REACH) : p][::-1], raw[p : p + LENGTH]), strict=True):
                            x.append(v)
                if out[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, schema.types, strict=True)], schema=schema)

    return rows.mapInArrow(run, _CONTEXTS)


def common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    x = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (x.bit_length() + 7) // 8


def intervals(lcp: list[int], least: int) -> Iterator[tuple[int, int, int]]:
    """(length, first, end) of the intervals of a sorted array whose neighbours k - 1 and k share lcp[k], by a stack scan:
    maximal ranges of at least two with a common prefix of at least `least`."""
    stack: list[tuple[int, int]] = []
    for k in range(1, len(lcp) + 1):
        now, first = lcp[k] if k < len(lcp) else 0, k - 1
        while stack and stack[-1][0] > now:
            length, first = stack.pop()
            yield length, first, k
        if now >= least and (not stack or stack[-1][0] < now):
            stack.append((now, first))


def maximal_repeats(before: list[bytes], after: list[bytes], least: int = LENGTH) -> Iterator[tuple[int, int, list[int]]]:
    """(left, right, occurrences): the repeats around an anchor, `left` bytes before it (given reversed) and `right` from it on,
    of at least `least` together, that no longer repeat has all occurrences of. A text's end counts as an extension of its own."""
    by = sorted(range(len(after)), key=after.__getitem__)
    lcp = [0, *(common(after[a], after[b]) for a, b in zip(by, by[1:]))]
    most = max(map(len, before))
    for right, a, b in intervals(lcp, max(1, least - most)):
        need = least - right
        members = sorted(by[a:b], key=before.__getitem__)
        lcs = [0, *(common(before[x], before[y]) for x, y in zip(members, members[1:]))]
        if need <= 0:  # may have no left part: the whole interval is a group, by what all share
            least_left = min(lcs[1:])
            if not least_left:
                yield 0, right, members
        for left, i, j in intervals(lcs, max(1, need)):
            yield left, right, members[i:j]


def losses(docs: list[tuple[int, int]], before: list[bytes], after: list[bytes]) -> Iterator[tuple[int, int, int]]:
    """(occurrence, left, right): what each occurrence loses around its anchor. docs: their order."""
    left_of, right_of = [0] * len(docs), [0] * len(docs)
    for left, right, members in maximal_repeats(before, after):
        first = min(members, key=docs.__getitem__)
        for x in members:
            if docs[x] != docs[first]:  # all these spans hold the anchor, so their union is one span
                left_of[x], right_of[x] = max(left_of[x], left), max(right_of[x], right)
    return ((x, left_of[x], right_of[x]) for x in range(len(docs)) if right_of[x])


_SPANS = "doc long, checksum long, start long, end long"


def _spans(doc: list[int], place: list[int], left: list[int], right: list[int]) -> pa.RecordBatch:
    at = np.array(place, np.int64)
    start = at >> 32
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (np.array(doc, np.int64), at & 0xFFFFFFFF, start - np.array(left, np.int64), start + np.array(right, np.int64))], schema=arrow_schema(_SPANS))


def tree_spans(context_rows: DataFrame) -> DataFrame:
    """Spans that the leaves of each fingerprint lose to one another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        print_, held = None, []
        out: list[list[int]] = [[], [], [], []]

        def close() -> None:
            if len(held) > 1:
                order = [(d, w) for d, w, _, _ in held]
                for x, left, right in losses(order, [h[2] for h in held], [h[3] for h in held]):
                    for column, v in zip(out, (*order[x], left, right), strict=True):
                        column.append(v)

        for batch in batches:
            for f, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if f != print_:
                    close()
                    print_, held = f, []
                held.append(row)
            if len(out[0]) > 10_000:
                yield _spans(*out)
                out = [[], [], [], []]
        close()
        yield _spans(*out)

    return context_rows.repartition("print").sortWithinPartitions("print").mapInArrow(run, _SPANS)


def window_spans(context_rows: DataFrame) -> DataFrame:
    """What tree_spans gives, for fingerprints with more leaves than a task should hold.

    Nodes of the tree that are LENGTH bytes long are taken one by one: a leaf has one for each window around its anchor, at
    most REACH + 1. The earliest leaf below a node is a pre-aggregated minimum; the others lose the window. All windows
    hold the anchor, so a leaf's losses are one span."""
    schema = arrow_schema("print long, window long, doc long, place long, left long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, _PIECE >> 2):
                out: list[list[int]] = [[], [], [], [], []]
                for f, doc, place, before, after in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    around, n = before[::-1] + after, len(before)
                    for s in range(min(n, len(around) - LENGTH) + 1):
                        digest = xxhash.xxh3_64_intdigest(around[s : s + LENGTH])
                        for x, v in zip(out, (f, digest - (digest >> 63 << 64), doc, place, n - s), strict=True):
                            x.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], schema=schema)

    nodes = context_rows.select("print", "doc", "place", "before", "after").mapInArrow(run, "print long, window long, doc long, place long, left long")
    nodes = nodes.withColumn("at", F.struct("doc", (F.col("place") - F.shiftleft("left", 32)).alias("start")))
    first = nodes.groupBy("print", "window").agg(F.min("at").alias("first"), F.max("at").alias("last")).where("first < last").select("print", "window", "first")
    lost = nodes.join(first, ["print", "window"]).where("at > first")
    spans_ = lost.groupBy("doc", "place").agg(F.max("left").alias("left"), F.max(LENGTH - F.col("left")).alias("right"))
    place = F.shiftright("place", 32)
    return spans_.select("doc", F.col("place").bitwiseAND(F.lit(0xFFFFFFFF)).alias("checksum"), (place - F.col("left")).alias("start"), (place + F.col("right")).alias("end"))


def copies(docs: DataFrame) -> DataFrame:
    """(doc, checksum): documents that repeat a whole text of at least LENGTH bytes of a smaller doc_id."""
    rows = _rows(docs).where(F.octet_length("text") >= LENGTH).select("doc", F.crc32("text").alias("checksum"), F.unhex(F.sha2("text", 256)).alias("digest"))
    first = rows.groupBy("digest").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last")
    return rows.join(first, "digest").where("first < doc").select("doc", "checksum").distinct()


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("doc"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def spans(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc, checksum, start, end): spans to remove, with overlaps; and (doc, checksum) of whole copies, which go altogether."""
    whole = stored(copies(docs), "copies")
    sent = F.broadcast(whole) if whole.count() <= BROADCAST_IDS else whole
    rows = _rows(docs).where(F.octet_length("text") >= LENGTH).withColumn("checksum", F.crc32("text")).join(sent, ["doc", "checksum"], "left_anti").select("doc", "text")
    found = stored(leaves(anchor_rows(rows)), "leaves")
    asked = found.where("not repeat")
    n_asked = asked.count()
    around = contexts(rows, asked, n_asked)
    many = stored(asked.groupBy("print").agg(F.count("*").alias("n")).where(F.col("n") > LEAVES).select("print"), "many", n_asked // LEAVES + 1)
    if n_many := many.count():
        around = stored(around, "contexts")
        many = F.broadcast(many) if n_many <= BROADCAST_IDS else many
        tree = tree_spans(around.join(many, "print", "left_anti")).unionByName(window_spans(around.join(many, "print", "left_semi")))
    else:
        tree = tree_spans(around)
    place = F.shiftright("place", 32)
    # a repeated leaf's context is within the text, which the span is cut to when it is applied
    again = found.where("repeat").select("doc", F.col("place").bitwiseAND(F.lit(0xFFFFFFFF)).alias("checksum"), F.greatest(place - REACH, F.lit(0).cast("long")).alias("start"), (place + LENGTH).alias("end"))
    return again.unionByName(tree), whole


def merged(spans_: DataFrame) -> DataFrame:
    """(doc, checksum, runs): each document's spans (doc, checksum, start, end) made one where they touch, as [start, end, start, end ...] by start."""
    schema = arrow_schema("doc long, checksum long, runs array<long>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last document and its runs, which may go on

        def rows(docs: list[tuple[int, int]], runs: list[np.ndarray]) -> pa.RecordBatch:
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, runs)]), pa.int32()), pa.array(np.concatenate(runs)))
            return pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in zip(*docs, strict=True)), lists], schema=schema)

        for batch in batches:
            if not batch.num_rows:
                continue
            doc, checksum, start, end = (batch[c].to_numpy() for c in ("doc", "checksum", "start", "end"))
            edges = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (checksum[1:] != checksum[:-1]), True])
            docs, runs = [], []
            for a, b in itertools.pairwise(edges.tolist()):
                who, x, top = (int(doc[a]), int(checksum[a])), start[a:b], np.maximum.accumulate(end[a:b])
                if held and held[0] == who:  # its last run may reach into these
                    x, top = np.r_[held[1][::2], x], np.maximum.accumulate(np.r_[held[1][1::2], end[a:b]])
                elif held:
                    docs.append(held[0])
                    runs.append(held[1])
                new = np.flatnonzero(np.r_[True, x[1:] > top[:-1]])
                held = who, np.stack([x[new], top[np.r_[new[1:] - 1, len(x) - 1]]], 1).ravel()
            if docs:
                yield rows(docs, runs)
        if held:
            yield rows([held[0]], [held[1]])

    return spans_.repartition("doc", "checksum").sortWithinPartitions("doc", "checksum", "start").mapInArrow(run, "doc long, checksum long, runs array<long>")


def _kept(raw: bytes, runs: list[int] | None) -> tuple[bytes, int, int]:
    """What stays, how much goes, and in how many runs."""
    out, last, gone, n = [], 0, 0, len(raw)
    for a, b in zip((runs or ())[::2], (runs or ())[1::2], strict=True):
        out.append(raw[last:a])
        last = min(b, n)
        gone += last - a
    return b"".join([*out, raw[last:]]), gone, len(runs or ()) // 2


def _with_runs(docs: DataFrame, *keep: str) -> DataFrame:
    """docs (what is kept, and text) with runs: [start, end, start, end ...] or null; a whole copy has one run over all."""
    found, whole = spans(docs)
    runs = merged(found.unionByName(whole.select("doc", "checksum", F.lit(0).cast("long").alias("start"), F.lit(1 << 40).alias("end"))))
    rows = docs.select(*keep, F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("doc"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("checksum", F.crc32("text"))
    return rows.join(runs, ["doc", "checksum"], "left").select(*keep, "text", "runs")


def report(docs: DataFrame) -> DataFrame:
    """The contract's row per document."""
    schema = arrow_schema("doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                out = []
                for d, raw, runs in zip(part["doc_id"].to_pylist(), part["text"].cast(pa.binary()).to_pylist(), part["runs"].to_pylist(), strict=True):
                    kept, gone, n = _kept(raw, runs)
                    out.append((d, len(raw), gone, n, hashlib.sha256(kept).hexdigest()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)

    return _with_runs(docs, "doc_id").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "runs").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def dedup(docs: DataFrame) -> DataFrame:
    """docs without the repeated bytes; n_chars (if there) follows the text, the other columns stay."""
    names = docs.columns
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names if c != "text"]).alias("rest"), F.col("doc_id"), F.col("text"))
    rows = _with_runs(packed, "rest").select("rest", "text", "runs")
    out = rows.select("rest", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                text = [_kept(raw, runs)[0].decode(errors="ignore") for raw, runs in zip(part["text"].cast(pa.binary()).to_pylist(), part["runs"].to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part["rest"], pa.array(text, pa.string())], names=["rest", "text"])

    return rows.mapInArrow(run, out.schema).select(*[F.col("text") if c == "text" else F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"rest.`{c}`") for c in names])


ORACLE = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, md5_number(substr(h, 2 * i + 1, 200)) AS s FROM (SELECT doc_id, h, unnest(range(0, greatest(len(h) // 2 - 99, 0))) AS i FROM d)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS k FROM w) WHERE k > 1),
g AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 THEN 0 ELSE 1 END AS new FROM r),
q AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM g),
s AS (SELECT doc_id, run, min(i) AS a, max(i) + 100 AS b FROM q GROUP BY doc_id, run),
t AS (SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS before FROM s),
k AS (SELECT t.doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS head, max(b) AS last FROM t JOIN d USING (doc_id) GROUP BY t.doc_id)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
    sha256(unhex(CASE WHEN last IS NULL THEN h ELSE head || substr(h, 2 * last + 1) END)) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""
