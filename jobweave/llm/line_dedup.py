"""Line dedup by a log-template tree.

A line's tokens with digits are variable fields. A tree of fixed depth leads by token count and leading tokens to a leaf; in a leaf,
lines that agree in most places share a template, whose differing places become variable too. The lines of a leaf are dealt
over a fixed number of parts, so a crowded leaf has many tasks; the parts' templates then meet in the leaf and merge by
the same rule. A template that several documents hold is recurring: its first line (by doc_id, then place) stays, the
others are dropped.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import islice, pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach_by_key, attach_groups, begin, forget, materialize

ANY = "<*>"
DEPTH = 4  # leading tokens of a leaf
CHUNK = 10_000  # rows that a Python worker gives back at a time
PARTS = 64  # of every leaf, whatever its size: lines are dealt over them by their hash
AGREE = 0.8  # share of places in which a line must agree with a template
MIN_TOKENS = 4  # shorter lines have no template, nor have lines most of whose tokens are variable (rows of numbers)
LAST = (1 << 63) - 1
_digit = re.compile("[0-9]").search
#: Thai, Lao, Tibetan, Burmese, Khmer, Tai, kana, Han: written without spaces between words.
_unspaced = re.compile("[\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u1950-\u19ff\u3005-\u3007\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\ua9e0-\ua9ff\uaa60-\uaa7f\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff]")


def _tokens(line: str) -> list[str]:
    """Tokens by white space, and single characters of scripts without spaces; those with a digit are variable."""
    if not line.isascii() and _unspaced.search(line):
        line = _unspaced.sub(r" \g<0> ", line)
    tokens = line.split()
    return [ANY if _digit(t) else t for t in tokens] if _digit(line) else tokens


def _split(text: str) -> Iterator[str]:
    """Lines of a text of any length, one at a time."""
    at = 0
    while (end := text.find("\n", at)) >= 0:
        yield text[at:end]
        at = end + 1
    yield text[at:]


def _signed(text: str) -> int:
    value = xxhash.xxh3_64_intdigest(text)
    return value - (1 << 64) if value >> 63 else value


def _leaf(tokens: list[str]) -> int:
    """The leaf of a line: a 64-bit hash of its token count and leading tokens."""
    return _signed(" ".join([str(len(tokens)), *tokens[:DEPTH]]))


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("id"), F.xxhash64("text").alias("at"), "text")


def _lines(docs: DataFrame, repeats: bool) -> DataFrame:
    """id, at (which text of that doc_id), no, leaf, h (128-bit hash of the line with its variable fields replaced). repeats: lines
    without a template too, each with a leaf of its own words, none replaced; blank lines never."""

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for id_, at, text in zip(batch.column("id").to_pylist(), batch.column("at").to_pylist(), batch.column("text"), strict=True):
                for no, line in enumerate(_split(text.as_py() or "")):
                    tokens = _tokens(line)
                    if len(tokens) >= max(MIN_TOKENS, 2 * tokens.count(ANY)):
                        leaf, key = _leaf(tokens), " ".join(tokens)
                    elif repeats and tokens:
                        key = " ".join(line.split())
                        leaf = _signed(f"= {key}")
                    else:
                        continue
                    yield id_, at, no, leaf, xxhash.xxh3_128_digest(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("op3")
        rows, kinds = rows_of(batches), [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
        while some := list(islice(rows, CHUNK)):
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*some, strict=True), kinds, strict=True)], names=["id", "at", "no", "leaf", "h"])

    return _keyed(docs).mapInArrow(run, "id long, at long, no int, leaf long, h binary")


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The masked lines of wanted (leaf, h, first: where one stands): leaf, h, masked."""
    places = wanted.groupBy(F.col("first.id").alias("id"), F.col("first.at").alias("at")).agg(F.collect_list(F.struct("first.no", "leaf", "h")).alias("places"))
    places = materialize(places, "places")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("op3")
        for batch in batches:
            out: list[list] = [[], [], []]
            for text, places in zip(batch.column("text"), batch.column("places"), strict=True):
                lines = text.as_py().split("\n")
                for p in places.as_py():
                    for column, value in zip(out, (p["leaf"], p["h"], " ".join(_tokens(lines[p["no"]]))), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, [pa.int64(), pa.binary(), pa.string()], strict=True)], names=["leaf", "h", "masked"])

    # The small side is hashed, so texts are not sorted; adaptive execution splits a text that very many rows repeat.
    found = _keyed(docs).join(places.hint("shuffle_hash"), ["id", "at"]).select("text", "places").mapInArrow(run, "leaf long, h binary, masked string")
    out = materialize(found.dropDuplicates(["h"]), "line-texts")
    forget(places)
    return out


class Templates:
    """The templates of lines of one token count, the first `lead` tokens of which are equal.

    A line joins the template that it agrees with most (ties: the first), if in enough places; places that differ become variable.
    Only those are compared that can agree: a line may differ from a template in `spare` places, so of spare + 1 segments one
    is equal. Holds templates, not lines.
    """

    def __init__(self, n: int, lead: int = 0):
        self.least = math.ceil(AGREE * n)
        parts = n - self.least + 1
        self.cuts = [lead + (n - lead) * i // parts for i in range(parts + 1)]
        self.ids, self.words, self.index, self.n = {ANY: 0}, [ANY], {}, 0
        self.rows = np.zeros((4, n), np.int32)

    def _keys(self, row: np.ndarray) -> list[tuple[int, bytes]]:
        return [(i, row[a:b].tobytes()) for i, (a, b) in enumerate(pairwise(self.cuts))]

    def add(self, tokens: list[str]) -> int:
        """The number of the template that the line joins."""
        row = np.array([self.ids.get(t, -1) for t in tokens], np.int32)
        held = [x for x in map(self.index.get, self._keys(row)) if x]
        if held:
            few = sum(map(len, held)) < self.n
            near = np.array(sorted(set().union(*held))) if few else np.arange(self.n)
            same = ((self.rows[near] if few else self.rows[: self.n]) == row).sum(axis=1)
            best = int(same.argmax())
            if same[best] >= self.least:
                at = int(near[best])
                self._generalise(at, row)
                return at
        if self.n == len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        for t in tokens:
            if t not in self.ids:
                self.ids[t] = len(self.words)
                self.words.append(t)
        self.rows[self.n] = [self.ids[t] for t in tokens]
        for key in self._keys(self.rows[self.n]):
            self.index.setdefault(key, set()).add(self.n)
        self.n += 1
        return self.n - 1

    def text(self, at: int) -> str:
        return " ".join(self.words[i] for i in self.rows[at])

    def _generalise(self, at: int, row: np.ndarray) -> None:
        old = self._keys(self.rows[at])
        self.rows[at][self.rows[at] != row] = 0
        for was, now in zip(old, self._keys(self.rows[at]), strict=True):
            if was != now:
                self.index[was].discard(at)
                if not self.index[was]:
                    del self.index[was]
                self.index.setdefault(now, set()).add(at)


def cluster(rows: list[list[str]]) -> list[int]:
    """For lines of one token count, in order, the number of the template that each joins."""
    templates = Templates(len(rows[0])) if rows else None
    return [templates.add(tokens) for tokens in rows]


def _clustered(lines: DataFrame) -> DataFrame:
    """lines: leaf, sub, h, masked. Gives, for each line, h and template (the h of the first line of the line's template in that
    part of the leaf), and, behind a part's lines, a row for each of its templates: leaf, template and masked (its text), h null."""

    def closing(leaf: int, held: dict) -> Iterator[tuple]:
        for templates, first in held.values():
            for k, h in enumerate(first):
                yield leaf, None, h, templates.text(k)

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        key, held = None, {}
        for batch in batches:
            for leaf, sub, h, masked in zip(*(batch.column(c).to_pylist() for c in ("leaf", "sub", "h", "masked")), strict=True):
                if (leaf, sub) != key:
                    if key:
                        yield from closing(key[0], held)
                    key, held = (leaf, sub), {}
                tokens = masked.split(" ")
                n = len(tokens)  # one a leaf, but for colliding hashes
                if n not in held:
                    held[n] = (Templates(n, DEPTH), [])
                templates, first = held[n]
                k = templates.add(tokens)
                if k == len(first):
                    first.append(h)
                yield leaf, h, first[k], None
        if key:
            yield from closing(key[0], held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("op3")
        rows, kinds = rows_of(batches), [pa.int64(), pa.binary(), pa.binary(), pa.string()]
        while some := list(islice(rows, CHUNK)):
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*some, strict=True), kinds, strict=True)], names=["leaf", "h", "template", "masked"])

    dealt = lines.select("leaf", "sub", "h", "masked").repartition("leaf", "sub").sortWithinPartitions("leaf", "sub", "masked", "h")
    return dealt.mapInArrow(run, "leaf long, h binary, template binary, masked string")


def _templates(lines: DataFrame) -> DataFrame:
    """lines: leaf, h, masked. Gives h and template: an h that names the line's template."""
    parts = materialize(_clustered(lines.withColumn("sub", F.pmod(F.xxhash64("h"), F.lit(PARTS)).cast("int"))), "part-templates")
    merged = _clustered(parts.where("h IS NULL").select("leaf", F.lit(0).alias("sub"), F.col("template").alias("h"), "masked")).where("h IS NOT NULL")
    merged = materialize(merged.select(F.col("h").alias("template"), F.col("template").alias("whole")), "templates")
    return attach_by_key(parts.where("h IS NOT NULL").select("h", "template"), merged, "template", F.col("h")).select("h", F.col("whole").alias("template"))


def recurring_lines(docs: DataFrame, repeats: bool = False) -> DataFrame:
    """Lines to drop: id (doc_id, or the largest long for null), at, no."""
    lines = materialize(_lines(docs, repeats), "lines")
    doc = F.xxhash64("id", "at").alias("doc")
    # Only leaves of several documents can hold a recurring template. Their list is written first, so that the join reads both sides
    # straight from a shuffle, where adaptive execution splits a leaf that holds many lines.
    shared = lines.select("leaf", doc).groupBy("leaf").agg(F.min("doc").alias("x"), F.max("doc").alias("y")).where("x <> y").select("leaf")
    shared = materialize(shared, "shared-leaves")
    held = materialize(lines.join(shared, "leaf", "left_semi"), "shared-lines")
    forget(lines, shared)
    distinct = materialize(held.groupBy("leaf", "h").agg(F.min(F.struct("id", "at", "no")).alias("first"), F.min(doc).alias("x"), F.max(doc).alias("y")), "distinct-lines")
    # Only leaves with several different lines need their texts.
    mixed = attach_groups(distinct.select("leaf", "h", "first"), ["leaf"], [F.count("*").alias("n")], [F.sum("n").alias("n")], salt=F.col("h")).where("n > 1")
    texts = _texts(docs, mixed.select("leaf", "h", "first"))
    named = distinct.join(_templates(texts), "h", "left").withColumn("template", F.coalesce("template", "h"))
    partial = [F.min("first").alias("f"), F.min("x").alias("fx"), F.max("y").alias("fy")]
    named = attach_groups(named, ["template"], partial, [F.min("f").alias("f"), F.min("fx").alias("fx"), F.max("fy").alias("fy")], salt=F.col("h"), having=F.col("fx") != F.col("fy"))
    facts = materialize(named.where("f IS NOT NULL").select("h", "f"), "recurring")
    return attach_by_key(held.select("id", "at", "no", "h"), facts, "h", F.struct("id", "no")).where("f IS NOT NULL AND NOT (id = f.id AND at = f.at AND no = f.no)").select("id", "at", "no")


def drop_recurring_lines(docs: DataFrame, repeats: bool = False) -> DataFrame:
    """The documents' columns with the new text, and n_lines, n_dropped; n_chars, where it is a column, follows the text.

    Lines end at line feeds. Null and empty texts stay as they are (an empty text is one line, which is never dropped). A null
    doc_id comes last. Rows that repeat a doc_id and its text are one document, and lose the same lines. Lines of fewer than four tokens,
    or most of whose tokens hold digits, have no template: without repeats they are never dropped. A document all of whose lines recur elsewhere keeps its row, with an
    empty text. Extra columns are kept; an empty table gives an empty result.

    repeats: lines without a template are dropped too where several documents hold the same words, digits included; blank lines stay.
    """
    drops = recurring_lines(docs, repeats).groupBy("id", "at").agg(F.collect_set("no").alias("__jw_drop")).withColumnsRenamed({"id": "__jw_id", "at": "__jw_at"})
    # Written, and hashed by the join: texts are not sorted, and adaptive execution splits a text that very many rows repeat.
    drops = materialize(drops, "drops").hint("shuffle_hash")
    rows = docs.withColumns({"__jw_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)), "__jw_at": F.xxhash64("text")}).join(drops, ["__jw_id", "__jw_at"], "left")
    # Linear in the lines: the numbers that stay come from a hash set, and the text is split once.
    stay = lambda ls: F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), "__jw_drop")
    kept = F.get(F.transform(F.array(F.split("text", "\n")), lambda ls: F.array_join(F.transform(stay(ls), lambda i: F.get(ls, i)), "\n")), F.lit(0))
    new = {"text": F.when(F.col("__jw_drop").isNull(), F.col("text")).otherwise(kept)}
    counts = {"n_lines": F.size(F.split(F.coalesce("text", F.lit("")), "\n")).cast("long"), "n_dropped": F.coalesce(F.size("__jw_drop"), F.lit(0)).cast("long")}
    out = rows.withColumns(counts).withColumns(new)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__jw_drop").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*[c for c in docs.columns if c not in ("n_lines", "n_dropped")], "n_lines", "n_dropped")
