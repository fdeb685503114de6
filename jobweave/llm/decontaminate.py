"""Benchmark decontamination, in DataFrame operations only: a prefix-filtered set join.

An item is cut into windows of 13 consecutive words (a shorter item is one window). A window occurs in a document only
if all its three-word shingles do, so for exact containment one shingle is prefix enough: the rarest by
document frequency over all documents. Shingles of the benchmark found in a document are kept with their positions;
those in a prefix are joined with the windows, alignments that would start before or end behind the text are left out, and
the words of the others are compared one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, materialize

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW, SHINGLE = 13, 3
#: Up to so many benchmark shingles are looked up inside the scan of the documents (a hash set of some MB in each task); more
#: than that are joined by shuffling.
MAX_INLINE = 50_000


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def _hash(size: int, words: str = "words", at: str = "i") -> str:
    return f"xxhash64({size}, " + ", ".join(f"get({words}, {at} + {j})" for j in range(size)) + ")"


def _starts(size: int, n: str = "n_words") -> str:
    """Start positions of the shingles of so many words."""
    return f"CASE WHEN {n} >= {size} THEN sequence(0, cast({n} AS int) - {size}) ELSE cast(array() AS array<int>) END"


def bench_windows(benchmark: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """Distinct windows: wid, win (words), size, shingle (words a shingle); and the items that hold them: wid, item_id. A window that
    all items share is one row of the first and one row an item of the second."""
    items = benchmark.select(F.col("item_id"), words_of(F.col("text")).alias("words")).where("size(words) > 0")
    cut = items.select("item_id", F.expr(f"explode(transform(sequence(0, greatest(size(words) - {window}, 0)), i -> slice(words, i + 1, {window})))").alias("win"))
    windows = cut.select("win").distinct().select(F.monotonically_increasing_id().alias("wid"), "win", F.size("win").alias("size"), F.least(F.size("win"), F.lit(SHINGLE)).alias("shingle"))
    windows = materialize(windows, "windows")
    return windows, materialize(cut.where("item_id IS NOT NULL").join(windows, "win").select("wid", "item_id").distinct(), "items")


def _shingles(windows: DataFrame, sizes: list[int]) -> DataFrame:
    """Each window with its shingles: h, o (offset in the window)."""
    parts = [f"CASE WHEN shingle = {k} THEN transform({_starts(k, 'size')}, i -> struct(i AS o, {_hash(k, 'win')} AS h)) END" for k in sizes]
    return windows.select("wid", "size", F.expr(f"explode(coalesce({', '.join(parts)}))").alias("s")).select("wid", "size", "s.o", "s.h")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_inline: int = MAX_INLINE) -> DataFrame:
    """One row per input row, with what benchmark windows hit: doc_id, n_words, n_hit, n_items, items_sha256, contaminated,
    items (sorted ids as strings), spans (start and end word of each hit stretch).

    Null or empty texts have no words; an item without words has no window. Repeated documents give repeated rows,
    items of one text all count. Rows with a null item_id hit words but are in no list of items. Extra columns are ignored;
    an empty benchmark hits nothing.
    """
    # Of the documents, only the doc_id goes along: no text is written or moved but the words of those with a benchmark shingle.
    clean, marked, found = _hits(docs, ["doc_id"], benchmark, window, max_inline)
    rows = clean.select("doc", "n_words", *(F.lit(None).cast(found.schema[c].dataType).alias(c) for c in ("n_hit", "items", "spans")))
    rows = rows.unionByName(marked.select("row", "doc", "n_words").join(found, "row", "left").drop("row"))
    rows = rows.select("doc.doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.coalesce("spans", F.array().cast(found.schema["spans"].dataType)).alias("spans"))
    return rows.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), F.expr(CONTAMINATED).alias("contaminated"), "items", "spans")


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents (all their columns) that are not contaminated. Only those with a benchmark shingle are joined with anything."""
    clean, marked, found = _hits(docs, docs.columns, benchmark, WINDOW, MAX_INLINE)
    bad = marked.select("row", "n_words").join(found.select("row", "n_hit"), "row").where(CONTAMINATED).select("row")
    return clean.select("doc.*").unionByName(marked.join(bad, "row", "left_anti").select("doc.*"))


CONTAMINATED = "n_hit > 0 AND 20 * n_hit >= n_words"


def _hits(docs: DataFrame, carried: list[str], benchmark: DataFrame, window: int, max_inline: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents without any benchmark shingle (doc, n_words) and those with one (row, doc, n_words), doc being a struct of the
    carried columns, so that no name clashes; and what hits the latter: row, n_hit, items, spans."""
    doc = F.struct(*(F.col(f"`{c}`") for c in carried)).alias("doc")
    windows, items = bench_windows(benchmark, window)
    sizes = [r[0] for r in windows.select("shingle").distinct().collect()]
    n_words = F.size("words").cast("long").alias("n_words")
    tokens = docs.select(doc, words_of(F.col("text")).alias("words")).select(F.monotonically_increasing_id().alias("row"), "doc", "words", n_words)
    if not sizes:
        none = tokens.select("row", F.lit(0).cast("long").alias("n_hit"), F.array().cast("array<string>").alias("items"), F.array().cast("array<struct<start:int,end:int>>").alias("spans")).where("false")
        return tokens.select("doc", "n_words"), tokens.select("row", "doc", "n_words").where("false"), none
    shingles = materialize(_shingles(windows, sizes), "shingles")
    distinct = materialize(shingles.select("h").distinct(), "distinct-shingles")
    inline = distinct.count() <= max_inline

    if inline:
        listed = ", ".join(str(r[0]) for r in distinct.collect())
        hit = [f"transform(filter({_starts(k)}, i -> {_hash(k)} IN ({listed})), i -> struct(i AS i, {_hash(k)} AS h))" for k in sizes]
        seen = tokens.select("row", "doc", "words", "n_words", F.expr(f"concat({', '.join(hit)})").alias("marks"))
        seen = materialize(seen.select("row", "doc", "n_words", F.when(F.size("marks") > 0, F.col("words")).alias("words"), "marks"), "marked")
        clean, marked = seen.where("size(marks) = 0"), seen.where("size(marks) > 0")
    else:
        base = materialize(tokens, "tokens")
        every = [f"transform({_starts(k)}, i -> struct(i AS i, {_hash(k)} AS h))" for k in sizes]
        # Both sides come straight from a shuffle, so adaptive execution splits a shingle that very many documents hold.
        places = base.select("row", F.expr(f"explode(concat({', '.join(every)}))").alias("m")).select("row", "m.i", "m.h").join(distinct, "h", "left_semi")
        marks = materialize(places.groupBy("row").agg(F.collect_list(F.struct("i", "h")).alias("marks")), "marks")
        clean = base.select("row", "doc", "n_words").join(marks.select("row"), "row", "left_anti")
        marked = materialize(base.join(marks.hint("shuffle_hash"), "row"), "marked")

    # Rarity: in how many documents a shingle is. A window with a shingle that is in none can't occur.
    df = marked.select(F.explode(F.array_distinct(F.transform("marks", lambda m: m["h"]))).alias("h")).groupBy("h").agg(F.count("*").alias("df"))
    rated = shingles.join(df, "h", "left")
    prefix = rated.groupBy("wid", "size").agg(F.min(F.struct("df", "h", "o")).alias("rarest"), F.bool_and(F.col("df").isNotNull()).alias("all_there")).where("all_there")
    prefix = materialize(prefix.select("rarest.h", "rarest.o", "wid", "size").join(windows.select("wid", "win"), "wid"), "prefix")

    around = f"struct(m.i AS i, m.h AS h, greatest(m.i - {window}, 0) AS base, slice(words, greatest(m.i - {window}, 0) + 1, {2 * window}) AS near)"
    chosen = "marks"
    if inline:
        # The benchmark's shingles are bounded here, so its prefix tokens are.
        listed = ", ".join(str(r[0]) for r in prefix.select("h").distinct().collect())
        chosen = f"filter(marks, m -> m.h IN ({listed}))" if listed else "filter(marks, m -> false)"
    candidates = marked.select("row", "n_words", F.expr(f"explode(transform({chosen}, m -> {around}))").alias("c")).select("row", "n_words", "c.*")
    met = candidates.join(F.broadcast(prefix) if prefix.count() <= max_inline else prefix, "h")
    met = met.where("i - o >= 0 AND i - o + size <= n_words AND slice(near, i - o - base + 1, size) = win")
    met = materialize(met.select("row", "wid", (F.col("i") - F.col("o")).alias("start"), (F.col("i") - F.col("o") + F.col("size")).alias("end")), "met")
    joined = "aggregate(array_sort(found), cast(array() AS array<struct<start:int,end:int>>), (a, x) -> CASE WHEN size(a) > 0 AND x.start <= element_at(a, -1).end THEN concat(slice(a, 1, size(a) - 1), array(struct(element_at(a, -1).start AS start, greatest(element_at(a, -1).end, x.end) AS end))) ELSE concat(a, array(x)) END)"
    spans = met.groupBy("row").agg(F.collect_set(F.struct("start", "end")).alias("found")).select("row", F.expr(joined).alias("spans"))
    named = met.select("row", "wid").distinct().join(items, "wid").groupBy("row").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    found = spans.join(named, "row", "left")
    total = F.expr("aggregate(spans, 0L, (a, x) -> a + x.end - x.start)")
    return clean.select("doc", "n_words"), marked.select("row", "doc", "n_words"), found.select("row", total.alias("n_hit"), "items", "spans")


ORACLE = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT item_id, least(len(w), 13) AS n, list_slice(w, i + 1, i + 13) AS s FROM (SELECT item_id, w, unnest(range(0, greatest(len(w) - 13, 0) + 1)) AS i FROM iw WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
dwin AS (SELECT doc_id, n, i, list_slice(w, i + 1, i + n) AS s FROM (SELECT doc_id, w, n, unnest(range(0, len(w) - n + 1)) AS i FROM dw, sizes WHERE len(w) >= n)),
hit AS (SELECT d.doc_id, d.i, d.n, w.item_id FROM dwin d JOIN win w ON d.n = w.n AND d.s = w.s),
cov AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, list_sort(list(DISTINCT cast(item_id AS varchar))) AS ids FROM hit GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(len(ids), 0) AS n_items, sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256,
 coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated FROM dw d LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id)
"""
