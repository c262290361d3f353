"""Benchmark decontamination by a generalised suffix automaton of the benchmark's items.

The automaton's symbols are normalised words. Documents stream through it and carry the length of the longest match
that ends at each word. A word is hit if it lies in an occurrence of a window: `window` consecutive words of an item,
or a whole item of fewer words. So a span is removed that exceeds the length limit (`window` words of an item) or the
coverage limit (all of a shorter item).

Scale: the benchmark is the small side; it is cut by size into shards of at most SHARD_BYTES of text, each of which is
broadcast and becomes one automaton per Python worker. With one shard documents are read once and never shuffled. A
larger benchmark means a pass over the documents for each shard, one after another, not a larger broadcast or worker;
what the passes find, by digests of the text, is written and then joined to the texts.

Edge cases: null or empty texts have no words; items without words are never hit; equal item_ids count once, a null
item_id as the empty string; repeated documents each get their row; an empty benchmark hits nothing; a very long text is
held by one task, one text at a time; columns other than doc_id and text are ignored by `scan` and carried by
`decontaminate`, which keeps null texts null.
"""

from __future__ import annotations

import hashlib
import itertools
import pickle
import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import arrow_schema, slices, stored, texts

#: Words of the text after A-Z are lower-cased, on UTF-8 bytes: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ on characters.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
WINDOW = 10
#: Text of a shard; its automaton takes some 60 times as much in a worker.
SHARD_BYTES = 1 << 20


class Automaton:
    """Generalised suffix automaton over the word sequences of many items."""

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW):
        self.window, self.ids = window, sorted({i for i, _ in items})
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]
        self.vocabulary: dict[bytes, int] = {}
        number = {x: k for k, x in enumerate(self.ids)}
        paths = []
        for name, text in items:
            if words := WORD.findall((text or "").encode().lower()):
                at, path = 0, []
                for w in words:
                    at = self._extend(at, self.vocabulary.setdefault(w, len(self.vocabulary)))
                    path.append(at)
                paths.append((number[name], len(words), path))
        self._mark(paths)

    def _state(self, length: int, link: int, edges: dict[int, int]) -> int:
        self.len.append(length)
        self.link.append(link)
        self.next.append(edges)
        return len(self.len) - 1

    def _split(self, p: int, q: int, c: int) -> int:
        """The state for the strings that lead through p, cut off from q's longer ones."""
        clone = self._state(self.len[p] + 1, self.link[q], dict(self.next[q]))
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def _extend(self, last: int, c: int) -> int:
        q = self.next[last].get(c)
        if q is not None:
            return q if self.len[q] == self.len[last] + 1 else self._split(last, q, c)
        new, p = self._state(self.len[last] + 1, 0, {}), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[new] = q if self.len[q] == self.len[p] + 1 else self._split(p, q, c)
        return new

    def _mark(self, paths: list[tuple[int, int, list[int]]]) -> None:
        """For each state: the items that hold its window, and the short items that end with it."""
        n, w = len(self.len), self.window
        holders: list[set[int]] = [set() for _ in range(n)]
        whole: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for item, size, path in paths:
            if size < w:
                whole[path[-1]].append((size, item))
                continue
            for s in path:
                while s > 0 and self.len[s] >= w and item not in holders[s]:
                    holders[s].add(item)
                    s = self.link[s]
        order = sorted(range(1, n), key=self.len.__getitem__)
        #: the ancestor, or the state itself, among whose strings is the one of `window` words
        self.at_window, self.short = [0] * n, [()] * n
        for s in order:
            up = self.link[s]
            if self.len[s] >= w:
                self.at_window[s] = self.at_window[up] if self.len[up] >= w else s
            self.short[s] = (*whole[s], *self.short[up])
        self.holders = [frozenset(h) for h in holders]
        self.watch = [self.len[s] >= w or bool(self.short[s]) for s in range(n)]

    def scan(self, words: list[bytes]) -> tuple[list[list[int]], set[int]]:
        """Maximal runs [start, end) of hit words, and the numbers of the items with an occurring window."""
        step, link, length, watch, w = self.next, self.link, self.len, self.watch, self.window
        root, s, l, runs, found = step[0], 0, 0, [], set()
        for i, c in enumerate(map(self.vocabulary.get, words)):
            if s:
                t = step[s].get(c)
                while t is None and s:
                    s = link[s]
                    l = length[s]
                    t = step[s].get(c)
            else:
                t = root.get(c)
            if t is None:
                s = l = 0
                continue
            s = t
            l += 1
            if watch[s]:
                start = i + 1
                if l >= w:
                    found |= self.holders[self.at_window[s]]
                    start = i + 1 - w
                for size, item in self.short[s]:
                    if size <= l:
                        found.add(item)
                        start = min(start, i + 1 - size)
                if start <= i:
                    while runs and runs[-1][0] >= start:
                        runs.pop()
                    if runs and runs[-1][1] >= start:
                        runs[-1][1] = i + 1
                    else:
                        runs.append([start, i + 1])
        return runs, found


_BUILT: dict[str, Automaton] = {}


def _automaton(shard: bytes, name: str, window: int) -> Automaton:
    """Built once per Python worker."""
    if name not in _BUILT:
        _BUILT.clear()
        _BUILT[name] = Automaton(pickle.loads(shard), window)
    return _BUILT[name]


def shards(benchmark: DataFrame, most: int | None = None) -> Iterator[list[tuple[str, str]]]:
    """The items in shards of about `most` bytes, one after another; only one is on the driver at a time."""
    most = most or SHARD_BYTES
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    n = max(1, -(-total // most))
    items = stored(items.repartition(n, "item_id", "text"), "benchmark") if n > 1 else items
    for k in range(n):
        yield [tuple(r) for r in (items if n == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)).collect()]


def _merge(runs: Iterable[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


Hits = tuple[list[int], list[str], int]


def _scanner(docs: DataFrame, shard: list[tuple[str, str]], window: int) -> Callable[[str | None], Hits]:
    """For a text: its runs (start, end, start, end ...), the items with occurring windows, and its number of words."""
    packed = pickle.dumps(shard)
    name = hashlib.sha256(packed).hexdigest() + str(window)
    sent = docs.sparkSession.sparkContext.broadcast(packed)

    def scan(text: str | None) -> Hits:
        a, words = _automaton(sent.value, name, window), WORD.findall((text or "").encode().lower())
        runs, items = a.scan(words)
        return [x for r in runs for x in r], sorted(a.ids[k] for k in items), len(words)

    return scan


def _hits(docs: DataFrame, shard: list[tuple[str, str]], window: int) -> DataFrame:
    """(t1, t2, runs, items) of the texts that hold a window of the shard's items."""
    find, schema = _scanner(docs, shard, window), "t1 long, t2 long, runs array<int>, items array<string>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found = [find(t) for t in part["text"].to_pylist()]
                rows = part.append_column("runs", pa.array([x[0] for x in found], pa.list_(pa.int32()))).append_column("items", pa.array([x[1] for x in found], pa.list_(pa.string())))
                yield rows.select(["t1", "t2", "runs", "items"]).filter(pa.array([bool(x[0]) for x in found]))

    return docs.mapInArrow(run, schema)


def _by_shards(docs: DataFrame, parts: Iterable[list[tuple[str, str]]], window: int) -> DataFrame:
    """docs with hits, [(runs, items)] of all shards or null. Each shard has a job of its own, so that a task never holds more
    than one automaton; what it finds, by digests of the text, is written, and meets the texts in one join."""
    docs, hits = docs.withColumns({"t1": F.xxhash64("text"), "t2": F.xxhash64(F.lit(1), "text")}), None
    for shard in parts:
        new = stored(_hits(docs.select("t1", "t2", "text"), shard, window), "hits")
        hits = new if hits is None else hits.unionByName(new)
    # a text that many rows have is found by a shard many times, and always the same
    per = hits.groupBy("t1", "t2").agg(F.collect_set(F.struct("runs", "items")).alias("hits"))
    return docs.join(per, ["t1", "t2"], "left").drop("t1", "t2")


def _together(text: str | None, hits: list[dict] | None) -> Hits:
    runs = _merge([r[i], r[i + 1]] for r in (x["runs"] for x in hits or ()) for i in range(0, len(r), 2))
    return [x for r in runs for x in r], sorted({i for x in hits or () for i in x["items"]}), len(WORD.findall((text or "").encode().lower()))


def _found(docs: DataFrame, benchmark: DataFrame, window: int, made: str, result: Callable[..., tuple]) -> DataFrame:
    """docs without text, with the columns (made: their schema) that result(text, runs, items, n_words) gives."""
    parts, keep = shards(benchmark), [c for c in docs.columns if c != "text"]
    first, second = next(parts), next(parts, None)
    find = _scanner(docs, first, window) if second is None else None
    rows = docs if find else _by_shards(docs, itertools.chain((first, second), parts), window)
    schema, types = StructType([*(docs.schema[c] for c in keep), *StructType.fromDDL(made)]), arrow_schema(made).types

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                texts_ = part["text"].to_pylist()
                hits = map(find, texts_) if find else map(_together, texts_, part["hits"].to_pylist())
                out = [result(t, *h) for t, h in zip(texts_, hits, strict=True)]
                yield pa.RecordBatch.from_arrays([*(part[c] for c in keep), *(pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True))], names=schema.names)

    return rows.mapInArrow(run, schema)


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, runs (hit word runs: start, end, start, end ...), items (ids with occurring windows, sorted as strings)."""
    return _found(texts(docs), benchmark, window, "n_words long, runs array<int>, items array<string>", lambda text, runs, items, n: (n, runs, items))


def removed(text: str, runs: list[int]) -> str:
    """The text without the hit words and what stands between two words of one run."""
    raw = text.encode()
    at = [(m.start(), m.end()) for m in WORD.finditer(raw.lower())]
    out, last = [], 0
    for a, b in zip(runs[::2], runs[1::2], strict=True):
        out.append(raw[last : at[a][0]])
        last = at[b - 1][1]
    return b"".join([*out, raw[last:]]).decode()


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs with the hit spans cut out of text; the other columns stay, n_chars (if there) follows the text."""
    names = docs.columns
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names if c != "text"]).alias("rest"), F.col("text").cast("string").alias("text"))
    clean = _found(packed, benchmark, window, "clean string", lambda text, runs, items, n: (removed(text, runs) if runs else text,))
    return clean.select(*[F.col("clean").alias(c) if c == "text" else F.length("clean").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"rest.`{c}`") for c in names])


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The contract's row per document."""
    hit = F.aggregate(F.sequence(F.lit(0), F.size("runs") - 2, F.lit(2)), F.lit(0).cast("long"), lambda s, i: s + F.get("runs", i + 1) - F.get("runs", i))
    return scan(docs, benchmark).select(
        "doc_id", "n_words", F.when(F.size("runs") == 0, F.lit(0).cast("long")).otherwise(hit).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.size("runs") > 0).alias("contaminated"),
    )


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS s FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d), sizes WHERE i + n - 1 <= len(w)),
h AS (SELECT doc_id, i, dw.n, item FROM dw JOIN bw ON dw.s = bw.s AND dw.n = bw.n),
p AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS q FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN t USING (doc_id)
"""
