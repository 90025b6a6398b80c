"""Benchmark decontamination: texts streamed through a generalised suffix automaton of the items."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from likeness.llm.common import SPACE, small_batches, translation, utf8

#: Word bytes are 0-9, a-z after lowering, and everything beyond ASCII.
LETTERS = translation(lambda c: not (48 <= c <= 57 or 97 <= c <= 122 or c >= 128)).tobytes()
BLOCK_BYTES = 1 << 20       # item text in one automaton; more text makes more automata, passed in turn


def words_of(text: bytes) -> list[bytes]:
    return text.translate(LETTERS).split()


class Automaton:
    """All substrings of the items' word sequences, one state per set of equal end positions."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.ids: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.size = [-1], [0]
        sequences = [(name, [self.ids.setdefault(w, len(self.ids)) for w in words]) for name, words in items if words]
        for _, seq in sequences:
            end = 0
            for token in seq:
                end = self._extend(end, token)
        self._mark(sequences)
        self.least = min([window, *(len(s) for _, s in sequences)])

    def _extend(self, end: int, token: int) -> int:
        """Append ``token`` to the string that ends in state ``end``; returns the new end state."""
        known = self.next[end].get(token)
        if known is not None:
            return known if self.size[known] == self.size[end] + 1 else self._clone(end, token, known)
        new = self._state(self.size[end] + 1, {}, 0)
        at = end
        while at != -1 and token not in self.next[at]:
            self.next[at][token] = new
            at = self.link[at]
        if at != -1:
            below = self.next[at][token]
            self.link[new] = below if self.size[below] == self.size[at] + 1 else self._clone(at, token, below)
        return new

    def _clone(self, at: int, token: int, old: int) -> int:
        copy = self._state(self.size[at] + 1, dict(self.next[old]), self.link[old])
        self.link[old] = copy
        while at != -1 and self.next[at].get(token) == old:
            self.next[at][token] = copy
            at = self.link[at]
        return copy

    def _state(self, size: int, edges: dict[int, int], link: int) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.size.append(size)
        return len(self.size) - 1

    def _walk(self, tokens: list[int]) -> int:
        at = 0
        for t in tokens:
            at = self.next[at][t]
        return at

    def _mark(self, sequences) -> None:
        """Which items each state's window belongs to, and which whole short items end in it."""
        w = self.window
        self.items: dict[int, set[str]] = {}
        whole: dict[int, list[tuple[int, str]]] = {}
        for name, seq in sequences:
            if len(seq) < w:
                whole.setdefault(self._walk(seq), []).append((len(seq), name))
            for i in range(len(seq) - w + 1):
                self.items.setdefault(self._walk(seq[i:i + w]), set()).add(name)
        self.at_window, self.short = [0] * len(self.size), [()] * len(self.size)
        for s in sorted(range(len(self.size)), key=self.size.__getitem__):
            up = self.link[s]
            if up >= 0:
                self.at_window[s] = self.at_window[up] if self.size[up] >= w else s
                self.short[s] = (*self.short[up], *whole.get(s, ()))

    def match(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Spans [first, last) of words inside occurrences of windows, and the items they belong to."""
        if len(words) < self.least or not self.ids:
            return [], set()
        get = self.ids.get
        ids = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        edge = np.flatnonzero(np.diff(np.concatenate([[0], (ids >= 0).view(np.int8), [0]])))
        spans, found = [], set()
        for first, last in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            if last - first >= self.least:
                self._stream(ids[first:last].tolist(), first, spans, found)
        return spans, found

    def _stream(self, ids: list[int], base: int, spans: list, found: set) -> None:
        edges, link, size, w = self.next, self.link, self.size, self.window
        at = longest = 0
        for i, token in enumerate(ids, base + 1):
            while at and token not in edges[at]:
                at = link[at]
                longest = size[at]
            step = edges[at].get(token)
            if step is None:
                continue
            at, longest = step, longest + 1
            if longest >= w:
                spans.append((i - longest, i))
                found |= self.items[self.at_window[at]]
            for length, name in self.short[at]:
                if longest >= length:
                    spans.append((i - length, i))
                    found.add(name)


def _covered(spans: list[tuple[int, int]], n: int) -> np.ndarray:
    change = np.zeros(n + 1, np.int64)
    if spans:
        at = np.array(spans)
        np.add.at(change, at[:, 0], 1)
        np.add.at(change, at[:, 1], -1)
    return np.cumsum(change[:-1]) > 0


def _without(text: bytes, hit: np.ndarray) -> str:
    """The text without its hit words and what stands between neighbouring hit words."""
    letters = np.frombuffer(text.translate(LETTERS), np.uint8) != SPACE
    edge = np.flatnonzero(np.diff(np.concatenate([[0], letters.view(np.int8), [0]])))
    starts, ends = edge[::2], edge[1::2]
    run = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))
    out, done = [], 0
    for first, last in zip(run[::2], run[1::2] - 1, strict=True):
        out.append(text[done:starts[first]])
        done = ends[last]
    return b"".join([*out, text[done:]]).decode()


def item_blocks(items: DataFrame) -> list[list[tuple[str, list[bytes]]]]:
    """The items as word lists, in blocks of about ``BLOCK_BYTES``, dealt by a hash of the id."""
    rows = items.select(F.col("item").cast("string").alias("item"), F.coalesce("text", F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    count = max(1, -(-size // BLOCK_BYTES))
    part = F.pmod(F.xxhash64("item"), F.lit(count))
    return [[(r["item"], words_of(r["text"].encode())) for r in rows.where(part == b).toLocalIterator() if r["item"] is not None]
            for b in range(count)]


def decontaminate(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id",
                  item_text_col: str = "text", window: int = 10, max_coverage: float = 0.5) -> DataFrame:
    """Every row of ``docs`` with what it shares with ``items``, and its text without it.

    Words are runs of digits, letters a-z after lowering and characters beyond ASCII. A window is
    ``window`` consecutive words of an item, or a shorter item as a whole. Added columns: _n_words,
    _n_hit (words inside an occurrence), _items (sorted ids of items that occur), _clean (the text
    without hit spans; null when more than ``max_coverage`` of the words are hit). All columns of
    ``docs`` stay.

    Null texts have no words and a null _clean; empty texts stay empty; items without words or id
    match nothing; equal items are found together. Items are matched in blocks of bounded size,
    one pass over the texts for each, so any number of items fits. Input columns with the names of the
    added ones give way to them.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.drop("_text", "_spans", "_items", "_n_words", "_n_hit", "_clean")
    blocks = item_blocks(items.select(F.col(item_col).alias("item"), F.col(item_text_col).alias("text")))
    names = docs.columns
    rows = docs.select("*", F.col(text_col).cast("string").alias("_text"),
                       F.lit(None).cast("array<struct<a:int,b:int>>").alias("_spans"),
                       F.lit(None).cast("array<string>").alias("_items"))
    for block in blocks:
        rows = _pass(rows, spark.sparkContext.broadcast(block), window)
    return _finish(rows, names, max_coverage)


def _pass(rows: DataFrame, block, window: int) -> DataFrame:
    at, schema = {c: i for i, c in enumerate(rows.columns)}, rows.schema

    def run(batches):
        automaton = Automaton(block.value, window)
        for batch in batches:
            data, offsets = utf8(batch.column(at["_text"]))
            spans, found = batch.column(at["_spans"]).to_pylist(), batch.column(at["_items"]).to_pylist()
            for i in range(batch.num_rows):
                got, names = automaton.match(words_of(data[offsets[i]:offsets[i + 1]].tobytes()))
                if got:
                    spans[i] = [*(spans[i] or []), *({"a": a, "b": b} for a, b in got)]
                    found[i] = [*(found[i] or []), *names]
            columns = list(batch.columns)
            for name, values in (("_spans", spans), ("_items", found)):
                columns[at[name]] = pa.array(values, batch.schema.field(name).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return rows.mapInArrow(run, schema)


def _finish(rows: DataFrame, names: list[str], max_coverage: float) -> DataFrame:
    at = {c: i for i, c in enumerate(rows.columns)}
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in names)

    def run(batches):
        for batch in batches:
            data, offsets = utf8(batch.column(at["_text"]))
            spans, found = batch.column(at["_spans"]).to_pylist(), batch.column(at["_items"]).to_pylist()
            n_words, n_hit, items, clean = [], [], [], []
            texts = batch.column(at["_text"])
            for i in range(batch.num_rows):
                text = data[offsets[i]:offsets[i + 1]].tobytes()
                n = len(words_of(text))
                hit = _covered([(s["a"], s["b"]) for s in spans[i] or []], n)
                n_words.append(n)
                n_hit.append(int(hit.sum()))
                items.append(sorted(set(found[i] or [])))
                if not texts[i].is_valid or n_hit[-1] > max_coverage * n:
                    clean.append(None)
                else:
                    clean.append(_without(text, hit) if n_hit[-1] else text.decode())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(at[c]) for c in names), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()),
                 pa.array(items, pa.list_(pa.string())), pa.array(clean, pa.string())],
                names=[*names, "_n_words", "_n_hit", "_items", "_clean"])

    return rows.mapInArrow(run, f"{kinds}, _n_words long, _n_hit long, _items array<string>, _clean string")


def items_digest(items):
    """Lowercase hex sha256 of the comma-joined ids."""
    return F.sha2(F.array_join(items, ","), 256)
