"""Exact n-gram Jaccard join by T-occurrence search (DivideSkip), and the groups that its links make.

A document's set: its distinct shingles of five words, as 64-bit hashes; two documents link at a Jaccard similarity of at
least 0.8, tested in integers. Equal sets are one node, named by their smallest doc_id, whatever the number of copies.

1. Routing. Documents that link share a token of their prefixes, the first |x| - ceil(0.8 |x|) + 1 of a fixed order:
   by hash, but those that a Bloom filter of the frequent tokens holds last. Any order that all share is correct.
   Every token's list of nodes is an inverted list. Short lists (up to SHORT nodes) give weighted pairs, of which those
   stay that share enough prefix tokens to reach the similarity at all. A long list ties its nodes to its smallest one,
   a star, never all pairs. The components of these ties are blocks: no link leaves its block.
2. Search. In a block every node's set meets an inverted index of the block: a query merges its short lists, takes the
   nodes that occur in at least T - L of them, and binary-probes its L long lists for those alone (DivideSkip). After a
   few queries the largest group found is the block's main group; only nodes outside it go on as queries, as links
   inside a group change nothing. Blocks above BLOCK_TOKENS are cut into parts: a hub's search contracts them first, and
   the nodes still outside are the query set that meets every part.
3. Groups. Links, at most a few per query, go through distributed connected components.

Scale: nothing about documents reaches the driver, but counts and the Bloom filter of fixed size. As frequent tokens come
last, a long list holds only documents that are made of frequent tokens by four fifths: large groups of near copies, not
all that share a passage. Sets are shipped only for documents that have a candidate. Lists are streamed from sorted partitions; memory is bounded by SHORT, a part's
tokens, and one text.

Edge cases: null or empty texts and texts without words have an empty set and link with nothing; with fewer than five
words the whole sequence is the one shingle; null doc_ids take part in no link and have a null component; rows with one
doc_id are linked, since a component is named by doc_id; other columns are ignored.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, bloom, bloom_room, components, in_bloom, slices, stored

N = 5
SHORT, BLOCK_TOKENS = 24, 2_500_000
#: Queries that look for a block's main group.
FIRST = 6
#: Ids up to so many are broadcast (8 bytes each) rather than shuffled with the texts.
BROADCAST_IDS = 500_000


def prefix_size(n: int) -> int:
    return n - -(-4 * n // 5) + 1


def needed(a: int, b: int) -> int:
    """The smallest overlap of sets of these sizes with 100 * overlap >= 80 * union."""
    return -(-4 * (a + b) // 9)


_SHIFT, _FINISH = np.uint64(32), np.uint64(0xBF58476D1CE4E5B9)
_FACTOR = 0x9E3779B97F4A7C15
_SPACE = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))
#: A random number for each byte; upper case counts as lower case, white space as nothing.
_BYTE = np.random.default_rng(5).integers(1, 1 << 63, 256, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]
_BYTE[_SPACE] = 0
_PIECE = 1 << 20


class Shingler:
    """Sets of word shingles as sorted unsigned 64-bit hashes. Words are hashed a piece of text at a time, as differences of a running sum."""

    MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)

    def __init__(self) -> None:
        self._reach(1 << 16)

    def _reach(self, n: int) -> None:
        powers = lambda x: np.multiply.accumulate(np.r_[np.uint64(1), np.full(n, x, np.uint64)])
        self.up, self.down = powers(_FACTOR), powers(pow(_FACTOR, -1, 1 << 64))

    def words(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the words, and where they start."""
        hashes, starts, at = [], [], 0
        while at < len(data):
            end = at + _PIECE
            if end < len(data) and (m := _GAP.search(data, end)):
                end = m.start()
            else:
                end = len(data)
            x = np.frombuffer(data, np.uint8, end - at, at)
            if len(x) >= len(self.up):
                self._reach(len(x))
            inside = ~_SPACE[x]
            edge = np.flatnonzero(np.diff(np.r_[False, inside, False].view(np.int8)))
            first, last = edge[::2], edge[1::2]
            total = np.zeros(len(x) + 1, np.uint64)
            np.cumsum(_BYTE[x] * self.up[: len(x)], out=total[1:])
            h = (total[last] - total[first]) * self.down[first]
            h ^= h >> _SHIFT
            h *= _FINISH
            h ^= h >> np.uint64(29)
            hashes.append(h)
            starts.append(first + at)
            at = end
        return (np.concatenate(hashes), np.concatenate(starts)) if hashes else (np.zeros(0, np.uint64), np.zeros(0, np.int64))

    def sets(self, texts: list[bytes]) -> list[np.ndarray]:
        w, at = self.words(b"\n".join(texts))
        cuts = np.searchsorted(at, np.cumsum([0, *(len(t) + 1 for t in texts)])).tolist()
        n = max(0, len(w) - N + 1)
        h = w[:n] * self.MIX[0]
        for k in range(1, N):  # words' hashes are random already: a sum with odd factors keeps their order apart
            h += w[k : n + k] * self.MIX[k]
        h ^= h >> _SHIFT
        h *= _FINISH
        out = []
        for a, b in itertools.pairwise(cuts):
            if b - a < N:
                out.append(np.array([xxhash.xxh3_64_intdigest(w[a:b].tobytes(), seed=b - a)], np.uint64) if b > a else w[:0])
                continue
            x = h[a : b - N + 1]
            x.sort()  # in place: no other text's windows are in it
            new = np.empty(len(x), bool)
            new[0] = True
            np.not_equal(x[1:], x[:-1], out=new[1:])
            out.append(x[new])
        return out

    def set(self, text: bytes) -> np.ndarray:
        return self.sets([text])[0]


_GAP = re.compile(rb"[ \t\n\x0b\x0c\r]")


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def _token_sets(batch: pa.RecordBatch, make: Shingler) -> Iterator[tuple[int | None, np.ndarray]]:
    """(doc_id, set) of each row."""
    for part in slices(batch, _PIECE):
        yield from zip(part["doc_id"].to_pylist(), make.sets(part["text"].cast(pa.binary()).to_pylist()), strict=True)


def frequent(docs: DataFrame) -> np.ndarray:
    """A Bloom filter of the tokens that more than SHORT documents hold, counted over all documents: over the first tokens of
    each set by hash, twice as many as a prefix has, so that prefixes that step over frequent tokens still hold counted ones."""
    schema = arrow_schema("token long, n long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Shingler()
        held, size = [], 0
        for batch in itertools.chain(batches, [None]):
            for _, tokens in _token_sets(batch, make) if batch is not None else ():
                held.append(tokens[: 2 * prefix_size(len(tokens))])
                size += len(held[-1])
                if size > 1_000_000:
                    yield count(held)
                    held, size = [], 0
        if held:
            yield count(held)

    def count(held: list[np.ndarray]) -> pa.RecordBatch:
        tokens, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(tokens.view(np.int64)), pa.array(n, pa.int64())], schema=schema)

    found = stored(_texts(docs).mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") > SHORT).select("token"), "frequent")
    return bloom(found, bloom_room(found.count()))


def prefix(tokens: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """The first tokens of a sorted set in the order: those not in the filter, then those in it."""
    n = prefix_size(len(tokens)) if len(tokens) else 0
    for head in (tokens[: 2 * n], tokens) if n else ():  # mostly the first few suffice
        is_hot = in_bloom(hot, head)
        if len(head) - np.count_nonzero(is_hot) >= n:
            return head[~is_hot][:n]
    return np.concatenate([tokens[~is_hot], tokens[is_hot]])[:n] if n else tokens


def prefixes(docs: DataFrame, hot: np.ndarray) -> DataFrame:
    """(doc_id, n, d1, d2, prefix): set size, digest of the set, and its prefix."""
    schema = arrow_schema("doc_id long, n long, d1 long, d2 long, prefix array<long>")
    sent = docs.sparkSession.sparkContext.broadcast(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, last = Shingler(), sent.value
        for batch in batches:
            ids, sizes, d1, d2, parts = [], [], [], [], []
            for doc, tokens in _token_sets(batch, make):
                raw = xxhash.xxh3_128_intdigest(tokens.tobytes())
                ids.append(doc)
                sizes.append(len(tokens))
                d1.append((raw >> 64) - (1 << 63))
                d2.append((raw & 0xFFFFFFFFFFFFFFFF) - (1 << 63))
                parts.append(prefix(tokens, last))
            flat = pa.array(np.concatenate(parts).view(np.int64)) if parts else pa.array([], pa.int64())
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, parts)]), pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), lists], schema=schema)

    return _texts(docs).mapInArrow(run, "doc_id long, n long, d1 long, d2 long, prefix array<long>")


def inverted_lists(nodes: DataFrame) -> DataFrame:
    """(hub, nodes, weight): the distinct lists of 2 to SHORT nodes with the number of tokens that have them, as [id, size, id, size ...];
    and for each longer list its ties (hub, [node]) with a null weight. nodes: (doc_id, n, prefix)."""
    schema = arrow_schema("hub long, nodes array<long>, weight long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token, held, hub = None, [], None  # the open list; once it is long only its hub is kept
        short: dict[tuple[int, ...], int] = {}

        def close() -> None:
            if hub is None and len(held) > 1:
                key = tuple(x for pair in sorted(held) for x in pair)
                short[key] = short.get(key, 0) + 1

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([k[0] for k in short], pa.int64()), pa.array([list(k) for k in short], pa.list_(pa.int64())), pa.array(list(short.values()), pa.int64())], schema=schema)
            short.clear()
            return out

        for batch in batches:
            t, ids, sizes = (batch[c].to_numpy() for c in ("token", "doc_id", "n"))
            edges = np.flatnonzero(np.r_[True, t[1:] != t[:-1], True]) if len(t) else np.zeros(0, int)
            first, lone = t[edges[:-1]], np.diff(edges) == 1
            lone[[0, -1] if len(lone) else []] = False  # may go on in the next batch, or go on from the last
            ties: list[tuple[int, int]] = []
            for i in np.flatnonzero(~lone):
                a, b = edges[i], edges[i + 1]
                if first[i] != token:
                    close()
                    token, held, hub = first[i], [], None
                if hub is None and len(held) + b - a <= SHORT:
                    held += zip(ids[a:b].tolist(), sizes[a:b].tolist(), strict=True)
                else:
                    if hub is None:
                        hub = min(itertools.chain((x for x, _ in held), ids[a:b].tolist()))
                        ties += [(hub, x) for x, _ in held if x != hub]
                    ties += [(hub, x) for x in ids[a:b].tolist() if x != hub]
                    held = []
            if ties:
                yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in ties], pa.int64()), pa.array([[b] for _, b in ties], pa.list_(pa.int64())), pa.nulls(len(ties), pa.int64())], schema=schema)
            if len(short) > 100_000:
                yield flush()
        close()
        yield flush()

    rows = nodes.select(F.explode("prefix").alias("token"), "doc_id", "n")
    return rows.repartition("token").sortWithinPartitions("token").mapInArrow(run, "hub long, nodes array<long>, weight long")


def candidates(lists: DataFrame) -> DataFrame:
    """(a, b): ties that hold every link within a component. Pairs of short lists need enough shared prefix tokens; stars of long ones stay whole."""
    stars = lists.where("weight is null").select(F.col("hub").alias("a"), F.col("nodes")[0].alias("b")).distinct()
    schema = arrow_schema("a long, b long, na long, nb long, weight long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for nodes, w in zip(batch["nodes"].to_pylist(), batch["weight"].to_pylist(), strict=True):
                pairs = list(zip(nodes[::2], nodes[1::2], strict=True))
                out += [(a, b, na, nb, w) for (a, na), (b, nb) in itertools.combinations(pairs, 2) if 5 * min(na, nb) >= 4 * max(na, nb)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)] if out else [pa.array([], pa.int64())] * 5, schema=schema)

    short = lists.where("weight is not null").groupBy("nodes").agg(F.sum("weight").alias("weight"))
    pairs = short.mapInArrow(run, "a long, b long, na long, nb long, weight long").groupBy("a", "b", "na", "nb").agg(F.sum("weight").alias("weight"))
    # overlap <= shared prefix tokens + what either set has beyond its prefix
    rest = F.greatest(*[F.ceil(F.lit(0.8) * F.col(x)) - 1 for x in ("na", "nb")])
    return pairs.where(F.col("weight") + rest + 1 >= F.ceil((F.col("na") + F.col("nb")) * 4 / F.lit(9.0) - 1e-9)).select("a", "b").unionByName(stars)


class Index:
    """Inverted lists of some nodes' token sets: posting lists of row numbers, each sorted."""

    def __init__(self, sets: list[np.ndarray]):
        self.size = np.array([len(s) for s in sets], np.int64)
        flat = np.concatenate(sets)
        row = np.repeat(np.arange(len(sets), dtype=np.int32), self.size)
        order = np.argsort(flat, kind="stable")
        tokens, self.rows = flat[order], row[order]
        edges = np.flatnonzero(np.r_[True, tokens[1:] != tokens[:-1], True])
        self.tokens, self.edges = tokens[edges[:-1]], edges

    def search(self, query: np.ndarray) -> np.ndarray:
        """Rows with 9 * overlap >= 4 * (their size + the query's)."""
        n = len(query)
        at = np.minimum(np.searchsorted(self.tokens, query), len(self.tokens) - 1)
        at = at[self.tokens[at] == query]
        t = -(-4 * n // 5)  # an overlap that any partner needs
        if len(at) < t:
            return np.zeros(0, np.int64)
        length = self.edges[at + 1] - self.edges[at]
        by = np.argsort(length, kind="stable")
        # the longest lists are left out of the merge; L as DivideSkip sets it, at most t - 1
        long = int(min(t - 1, t / (0.01 * np.log2(max(2, length[by[-1]])) + 1)))
        short, probed = at[by[: len(at) - long]], at[by[len(at) - long :]]
        merged = np.concatenate([self.rows[self.edges[i] : self.edges[i + 1]] for i in short])
        merged.sort()  # the merge of the short lists: equal rows meet
        edges = np.flatnonzero(np.r_[True, merged[1:] != merged[:-1], True])
        found, hits = merged[edges[:-1]], np.diff(edges)
        need = -(-4 * (self.size[found] + n) // 9)
        at = (hits + long >= need) & (5 * self.size[found] >= t * 5 - 4) & (5 * n >= 4 * self.size[found])
        found, hits, need = found[at], hits[at], need[at]
        for k, i in enumerate(probed[::-1]):  # binary probes, the longest list first
            if not len(found):
                break
            posting = self.rows[self.edges[i] : self.edges[i + 1]]
            place = np.minimum(np.searchsorted(posting, found), len(posting) - 1)
            hits += posting[place] == found
            if k % 32 == 31:
                at = hits + (len(probed) - 1 - k) >= need
                found, hits, need = found[at], hits[at], need[at]
        return found[hits >= need]


class Groups:
    """Union-find over row numbers; a group's root is its smallest row."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return int(x)

    def join(self, x: int, others: np.ndarray) -> None:
        for y in others.tolist():
            a, b = self.root(x), self.root(y)
            if a != b:
                self.up[max(a, b)] = min(a, b)


def block_links(ids: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links (id, root id) that make the same groups of a block as all its links do."""
    index, groups = Index(sets), Groups(len(ids))
    asked = np.zeros(len(ids), bool)

    def ask(i: int) -> None:
        asked[i] = True
        groups.join(i, index.search(sets[i]))

    for i in range(min(FIRST, len(ids))):  # the smallest ids, then those the first answers leave out
        left = [k for k in range(len(ids)) if not asked[k] and groups.root(k) == k][:1] if i else [0]
        for k in left:
            ask(k)
    roots = np.array([groups.root(i) for i in range(len(ids))])
    main = int(np.bincount(roots).argmax())
    for i in range(len(ids)):  # every node that ends up outside the main group has been a query
        if not asked[i] and groups.root(i) != groups.root(main):
            ask(i)
    return [(int(ids[i]), int(ids[r])) for i in range(len(ids)) if (r := groups.root(i)) != i]


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(block, doc_id, tokens) of the documents in wanted (block, doc_id)."""
    rows = _texts(docs).join(F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted, "doc_id").select("block", "doc_id", "text")
    schema = arrow_schema("block long, doc_id long, tokens binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Shingler()
        for batch in batches:
            for part in slices(batch, _PIECE):
                tokens = [x.tobytes() for x in make.sets(part["text"].cast(pa.binary()).to_pylist())]
                yield pa.RecordBatch.from_arrays([part["block"], part["doc_id"], pa.array(tokens, pa.binary())], schema=schema)

    return rows.mapInArrow(run, "block long, doc_id long, tokens binary")


def _streamed_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[int], list[np.ndarray]]]:
    """The blocks of a partition sorted by block, doc_id and tokens; equal sets of one doc_id come once."""
    block, ids, sets, last = None, [], [], b""
    for part in (p for batch in batches for p in slices(batch)):
        for b, d, raw in zip(part["block"].to_pylist(), part["doc_id"].to_pylist(), part["tokens"].to_pylist(), strict=True):
            if b != block:
                if ids:
                    yield block, ids, sets
                block, ids, sets = b, [], []
            if not ids or ids[-1] != d or last != raw:
                ids.append(d)
                sets.append(np.frombuffer(raw, np.uint64))
                last = raw
    if ids:
        yield block, ids, sets


_LINKS = "a long, b long"


def _search_blocks(sets: DataFrame) -> DataFrame:
    """Links of blocks that fit into one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, ids, sets in _streamed_blocks(batches):
            if out := block_links(np.array(ids), sets):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], schema=arrow_schema(_LINKS))

    return sets.repartition("block").sortWithinPartitions("block", "doc_id", "tokens").mapInArrow(run, _LINKS)


def _search_parts(parts: DataFrame, queries: DataFrame) -> DataFrame:
    """Links between queries (block, part, doc_id, tokens), each there for every part, and the parts' nodes."""
    both = parts.withColumn("ask", F.lit(0)).unionByName(queries.withColumn("ask", F.lit(1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, sets, index, out = None, [], [], None, []
        for batch in (p for b in batches for p in slices(b)):
            for b, p, d, raw, ask in zip(*(batch[c].to_pylist() for c in ("block", "part", "doc_id", "tokens", "ask")), strict=True):
                if (b, p) != at:
                    at, ids, sets, index = (b, p), [], [], None
                s = np.frombuffer(raw, np.uint64)
                if not ask:
                    ids.append(d)
                    sets.append(s)
                elif sets:
                    index = index or Index(sets)
                    out += [(d, ids[k]) for k in index.search(s).tolist() if ids[k] != d]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], schema=arrow_schema(_LINKS))
                out = []

    return both.repartition("block", "part").sortWithinPartitions("block", "part", "ask", "doc_id").mapInArrow(run, _LINKS)


def _large_blocks(docs: DataFrame, blocks: DataFrame) -> DataFrame:
    """Links of blocks too large for one task: hubs contract them, then the nodes outside the main group query every part. blocks: (block, doc_id, parts)."""
    sets = stored(_sets(docs, blocks.select("block", "doc_id")).join(blocks.select("block", "parts").distinct(), "block").dropDuplicates(["block", "doc_id", "tokens"]).withColumn("part", F.pmod(F.xxhash64("doc_id"), F.col("parts"))), "large-sets")
    parts, links, every = sets.drop("parts"), None, F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part")
    outside = sets.select("block", "doc_id")
    for _ in range(3):  # a hub a block and round: the smallest node that is still outside
        hub = outside.groupBy("block").agg(F.min("doc_id").alias("doc_id"))
        ask = sets.join(hub, ["block", "doc_id"], "left_semi").select("block", "doc_id", "tokens", every)
        found = stored(_search_parts(parts, ask), "hub-links")
        links = found if links is None else stored(links.unionByName(found), "hub-links")
        outside = _outside_main(sets, links)
    ask = sets.join(outside.select("block", "doc_id"), ["block", "doc_id"], "left_semi").select("block", "doc_id", "tokens", every)
    return links.unionByName(_search_parts(parts, ask))


def _outside_main(sets: DataFrame, links: DataFrame) -> DataFrame:
    """(block, doc_id) of the nodes outside the largest group of their block."""
    nodes = sets.select("block", "doc_id").join(components(links.select("a", "b"), "large"), F.col("doc_id") == F.col("node"), "left").select("block", "doc_id", F.coalesce("root", "doc_id").alias("root"))
    size = nodes.groupBy("block", "root").agg(F.count("*").alias("n"))
    main = size.groupBy("block").agg(F.max_by("root", F.struct("n", "root")).alias("main"))
    return stored(nodes.join(main, "block").where("root <> main").select("block", "doc_id"), "outside")


def nodes_and_groups(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n, d1, d2) of all documents, and (node, root) of the nodes with links."""
    all_ = stored(prefixes(docs, frequent(docs)), "prefixes")
    known = all_.where("doc_id is not null and n > 0")
    named = known.groupBy("d1", "d2").agg(F.min("doc_id").alias("node"))
    first = known.join(named, (known.doc_id == named.node) & (known.d1 == named.d1) & (known.d2 == named.d2), "left_semi").dropDuplicates(["doc_id", "d1", "d2"])
    ties = stored(candidates(stored(inverted_lists(first.select("doc_id", "n", "prefix")), "lists")), "ties")
    blocks = stored(components(ties, "blocks").select(F.col("root").alias("block"), F.col("node").alias("doc_id")), "blocks")
    sizes = known.select("doc_id", "n").join(blocks, "doc_id").groupBy("block").agg(F.sum("n").alias("tokens"))
    sized = stored(blocks.join(sizes, "block").withColumn("parts", F.ceil(F.col("tokens") / BLOCK_TOKENS)), "sized")
    links = _search_blocks(_sets(docs, sized.where("parts <= 1").select("block", "doc_id")))
    large = sized.where("parts > 1").select("block", "doc_id", "parts")
    if not large.isEmpty():
        links = links.unionByName(_large_blocks(docs, large))
    # rows with one doc_id and different texts are linked by their name
    several = stored(known.groupBy("doc_id").agg(F.min("d1").alias("low"), F.max("d1").alias("high")).where("low < high").select("doc_id"), "several")
    if not several.isEmpty():
        same = known.join(several, "doc_id", "left_semi").join(named, ["d1", "d2"]).select("doc_id", "node")
        links = links.unionByName(same.groupBy("doc_id").agg(F.min("node").alias("a")).join(same, "doc_id").select("a", F.col("node").alias("b")).where("a <> b"))
    return all_.select("doc_id", "n", "d1", "d2"), components(links, "links")


def groups(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id."""
    all_, roots = nodes_and_groups(docs)
    known = all_.where("doc_id is not null and n > 0")
    named = known.groupBy("d1", "d2").agg(F.min("doc_id").alias("node")).join(roots, "node", "left").select("d1", "d2", F.coalesce("root", "node").alias("root"))
    out = all_.join(named, ["d1", "d2"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.when(F.col("doc_id").isNotNull(), F.col("root"))).otherwise(F.col("doc_id")).alias("component_id"))
    return out


def report(docs: DataFrame) -> DataFrame:
    """The contract's row per document."""
    return groups(docs).select("doc_id", F.col("n_shingles").cast("long").alias("n_shingles"), "component_id")


def first_of_group(docs: DataFrame) -> DataFrame:
    """docs with one document of each group, the smallest doc_id; all columns stay."""
    gone = stored(groups(docs).where("component_id <> doc_id").select("doc_id").distinct(), "gone")
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col("doc_id").cast("long").alias("doc_id"))
    return packed.join(F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone, "doc_id", "left_anti").select(*[F.col(f"doc.`{c}`") for c in docs.columns])


ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM p JOIN n AS nx ON nx.doc_id = x JOIN n AS ny ON ny.doc_id = y WHERE 100 * i >= 80 * (nx.n + ny.n - i)),
r AS (SELECT doc_id, doc_id AS c FROM d UNION SELECT e.x, r.c FROM e JOIN r ON r.doc_id = e.y)
SELECT r.doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(r.c) AS component_id FROM r LEFT JOIN n USING (doc_id) GROUP BY r.doc_id
"""
