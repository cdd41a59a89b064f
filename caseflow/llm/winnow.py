"""Benchmark decontamination by winnowing.

Of every window of ``SPAN`` consecutive words the smallest hash of the ``GRAM``-word
grams in it is selected (the last of equal ones); neighbouring windows mostly select the
same gram, so a text keeps few fingerprints.  A span that two texts share selects the
same gram at the same place of it in both, so it is always found.  Training and
test fingerprints are joined, and every hit is extended word by word to both
sides, as far as a window around the gram can reach: if the equal words, those of
the gram included, are a window or more, all of them are hit.  The words decide;
equal hashes of different words hit nothing.

Fingerprints that a Bloom filter of the benchmark's excludes are dropped in the
scan.  The filter has at most ``bloom.MAX_BITS`` bits whatever the benchmark's size,
and only spares work.  A fingerprint travels with the words around it, and equal
ones with equal words are one row in the join, whatever the number of copies.

An item of fewer than ``SPAN`` words is one window of its own length: for each
such length in the benchmark, every gram of that length is a fingerprint, and
its words are the window.

Defined cases: null and empty texts have no words and are never hit; an empty
benchmark hits nothing; rows are judged one by one (repeated ids give repeated
rows); items with a null id count as hits but are not listed; items that share
an id are one item.  Extra columns are kept in ``row``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseflow.llm import bloom as filters
from caseflow.llm import common as C

SPAN = 10
GRAM = 5
#: Bits of the filter per fingerprint, and bits set for one: about one other gram in 5,000 passes, and brings its words along.
BITS, HASHES = 32, 4


def _gram_at(h: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each position."""
    acc = np.zeros(len(at), np.uint64)
    for j in range(n):
        acc = acc * np.uint64(0x9E3779B97F4A7C15) + h[at + j]
    return C.mix64(acc + np.uint64(n))


def _selected(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the grams that the windows of the texts select."""
    n = len(h) - SPAN + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    grams = _gram_at(h, np.arange(len(h) - GRAM + 1), GRAM)
    least, at = grams[:n].copy(), np.arange(n)
    for j in range(1, SPAN - GRAM + 1):
        take = grams[j:j + n] <= least
        least[take] = grams[j:j + n][take]
        at[take] = np.flatnonzero(take) + j
    at = np.unique(at[doc[:n] == doc[SPAN - 1:]])  # windows that lie in one text
    return at, grams[at]


def _prints(texts: pa.Array, shorts: list[int], bloom: np.ndarray | None, whole_short: bool) -> list[pa.Array]:
    """Per text: word count and its fingerprints that pass the filter, with the words around."""
    buf, offs = C.text_buffer(texts)
    starts, ends, woffs = C.word_spans(buf, offs)
    words = woffs[1:] - woffs[:-1]
    h = C.word_hashes(buf, starts, ends)
    doc = np.repeat(np.arange(len(words)), words)
    parts = [(SPAN, *_selected(h, doc))]
    for n in shorts:
        if len(h) >= n:
            at = np.flatnonzero(doc[: len(h) - n + 1] == doc[n - 1:])
            at = at[words[doc[at]] == n] if whole_short else at
            parts.append((n, at, _gram_at(h, at, n)))
    rows, low = [], None
    for span, at, fp in parts:
        if bloom is not None and len(at):
            ok = filters.probe(bloom, fp, fp, hashes=HASHES)
            at, fp = at[ok], fp[ok]
        low = C.LOWER[buf].tobytes() if low is None and len(at) else low
        reach, core = (SPAN - GRAM, GRAM) if span == SPAN else (0, span)
        for a, f in zip(at.tolist(), fp.view(np.int64).tolist()):
            d = doc[a]
            lo, hi = max(a - reach, int(woffs[d])), min(a + core + reach, int(woffs[d + 1]))
            rows.append((d, f, span, a - int(woffs[d]), a - lo, [low[x:y].decode() for x, y in zip(starts[lo:hi].tolist(), ends[lo:hi].tolist())]))
    rows.sort(key=lambda r: r[0])
    _, fp, span, at, pre, ctx = zip(*rows) if rows else [()] * 6
    flat = pa.StructArray.from_arrays([pa.array(fp, pa.int64()), pa.array(span, pa.int32()), pa.array(at, pa.int64()), pa.array(pre, pa.int32()),
                                       pa.array(ctx, pa.list_(pa.string()))], ["fp", "span", "at", "pre", "ctx"])
    return [pa.array(words.astype(np.int64)), C.lists(flat, np.bincount([r[0] for r in rows], minlength=len(words)))]


def _scan(src: DataFrame, shorts: list[int], bloom: np.ndarray | None, whole_short: bool = False) -> DataFrame:
    """``row``, ``n_words`` and the fingerprints of each text that pass the filter.
    ``whole_short``: a gram of fewer than ``SPAN`` words must be the whole text (the benchmark's side)."""
    bc = src.sparkSession.sparkContext.broadcast(bloom)
    return C.annotate(src, "n_words long, prints array<struct<fp:long,span:int,at:long,pre:int,ctx:array<string>>>",
                      lambda texts: _prints(texts, shorts, bc.value, whole_short))


#: What tells fingerprints apart: hash, window length, words before the gram, and the words.
PRINT = ["fp", "span", "pre", "ctx"]


def benchmark_prints(benchmark: DataFrame, text_col: str = "text", id_col: str = "item_id") -> DataFrame:
    """One row (``PRINT``, item) per distinct fingerprint of each item, as a written table."""
    src = C.packed(benchmark, text_col, [id_col])
    rows = _scan(src, list(range(1, SPAN)), None, whole_short=True)
    p = rows.select(F.col(f"row.`{id_col}`").cast("string").alias("item"), F.explode("prints").alias("p"))
    return C.written(p.select(*[f"p.{c}" for c in PRINT], "item").distinct(), "bench-prints")


def _bloom(prints: DataFrame) -> np.ndarray:
    """Filter over the benchmark's distinct fingerprints: ``BITS`` for each, up to the bound of a filter."""
    hashes = C.written(prints.select("fp").distinct(), "bench-hashes")
    return filters.build(hashes, filters.bits_for(hashes.count(), BITS), hashes=HASHES)


def _equal_run(a: Column, b: Column) -> Column:
    """How many words two lists have in common from their beginnings on."""
    differs = F.array_position(F.zip_with(a, b, lambda x, y: ~x.eqNullSafe(y)), True)  # a longer list differs where the other ends
    return F.when(differs > 0, differs - 1).otherwise(F.size(a)).cast("int")


def extended(prints: DataFrame, bench: DataFrame) -> DataFrame:
    """Joins fingerprints (``PRINT``) with the benchmark's and extends every hit: the former, the
    words ``before`` and ``behind`` the gram that are equal, and the item, where they make a window."""
    core = F.when(F.col("span") == SPAN, F.lit(GRAM)).otherwise(F.col("span"))
    mine, other = F.col("ctx"), F.col("octx")
    pair = prints.join(bench.select("fp", "span", F.col("pre").alias("opre"), F.col("ctx").alias("octx"), "item"), ["fp", "span"])
    pair = pair.where(F.slice(mine, F.col("pre") + 1, core) == F.slice(other, F.col("opre") + 1, core))
    before = _equal_run(F.reverse(F.slice(mine, 1, F.col("pre"))), F.reverse(F.slice(other, 1, F.col("opre"))))
    behind = _equal_run(F.slice(mine, F.col("pre") + core + 1, SPAN), F.slice(other, F.col("opre") + core + 1, SPAN))
    pair = pair.select(*PRINT, before.alias("before"), behind.alias("behind"), "item")
    return pair.where(F.col("before") + core + F.col("behind") >= F.col("span"))


def hits(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", keep: list[str] | None = None,
         item_text_col: str = "text", item_id_col: str = "item_id") -> tuple[DataFrame, DataFrame]:
    """Two written tables: all documents (``rid``, ``row``, ``n_words``), and the hit ones
    (``rid``, ``n_hit``, ``items``: sorted ids as strings)."""
    bench = benchmark_prints(benchmark, item_text_col, item_id_col)
    shorts = sorted(r[0] for r in bench.where(F.col("span") < SPAN).select("span").distinct().collect())  # at most SPAN - 1
    scanned = _scan(C.packed(docs, text_col, keep), shorts, _bloom(bench))
    scanned = C.written(scanned.select(F.monotonically_increasing_id().alias("rid"), "row", "n_words", "prints"), "winnowed")
    cand = scanned.where(F.size("prints") > 0).select("rid", F.explode("prints").alias("p")).select("rid", "p.*")
    found = C.written(extended(C.written(cand.select(*PRINT).distinct(), "print-words"), bench), "print-hits")
    # back to the documents: both sides are read from tables, so a passage in very many documents is split over tasks
    spans = C.written(found.select(*PRINT, "before", "behind").distinct(), "hit-spans")
    core = F.when(F.col("span") == SPAN, F.lit(GRAM)).otherwise(F.col("span"))
    spans = cand.join(C.small(spans, _words_size()), PRINT).select("rid", (F.col("at") - F.col("before")).alias("at"), (F.col("at") + core + F.col("behind")).alias("end"))
    # words covered: what each span adds beyond the end of those before it in its document
    w = Window.partitionBy("rid").orderBy("at", "end").rowsBetween(Window.unboundedPreceding, -1)
    new = spans.distinct().select("rid", "at", "end", F.max("end").over(w).alias("seen"))
    new = new.select("rid", F.greatest(F.lit(0), F.col("end") - F.greatest("at", F.coalesce("seen", "at"))).alias("n"))
    covered = new.groupBy("rid").agg(F.sum("n").alias("n_hit"))
    items = C.written(found.where(F.col("item").isNotNull()).select(*PRINT, "item").distinct(), "hit-items")
    items = cand.join(C.small(items, _words_size() + F.octet_length("item")), PRINT).select("rid", "item").distinct()
    items = items.groupBy("rid").agg(F.array_sort(F.collect_list("item")).alias("items"))
    out = covered.join(items, "rid", "left").select("rid", "n_hit", F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    return scanned.select("rid", "row", "n_words"), C.written(out, "contaminated")


def _words_size() -> Column:
    return F.octet_length(F.array_join("ctx", " ")) + 8 * F.size("ctx")


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Every row of ``docs`` as ``row``, with ``n_words``, ``n_hit``, ``items`` and ``contaminated``."""
    rows, hit = hits(docs, benchmark, **options)
    hit = C.small(hit, F.octet_length(F.array_join("items", ",")) + 8 * F.size("items"))
    out = rows.join(hit, "rid", "left")
    return out.select("row", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
                      F.coalesce("items", F.array().cast("array<string>")).alias("items"),
                      F.col("n_hit").isNotNull().alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without the rows that hold a window of the benchmark."""
    rows, hit = hits(docs, benchmark, **options)
    return rows.join(C.small(hit.select("rid")), "rid", "left_anti").select("row.*")
