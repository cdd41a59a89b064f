"""URL filters by Bloom filter cascades.

A rule (host, path) is the key ``host + path``; the keys of a url are its host
suffixes with as many labels as some rule's host has, each with its path
prefixes as long as some rule's path.  The key universe is the distinct keys of
the whole corpus.  Per verdict a cascade is built: level 1 holds the listed
keys, level 2 the universe's false positives of level 1, level 3 the listed keys
that pass level 2, and so on until no key is left.  The first level that a key
fails tells its membership, exactly for every key of the universe and without a
join.  The longest listed key of a url is its rule; a url without one gets
``default``.

Lists of more than ``MAX_LISTED`` rules are not broadcast: they are joined on the key.

Defined cases: a null url, or one without ``://``, has an empty host and path
and fits only a rule with both empty; of two equally long keys the one with the
longer host wins; a rule listed under two verdicts blocks; rules with a null
part are ignored; without rules every url gets ``default``.  Rows are judged one
by one; extra columns are kept in ``row``.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseflow.llm import bloom
from caseflow.llm import common as C

VERDICTS = ("block", "allow")
MAX_LISTED = 1 << 22
_KEY = "key:string,a:long,b:long"


def parts(url) -> tuple:
    """Host and path of a url column."""
    u = F.coalesce(url.cast("string"), F.lit(""))
    host = F.regexp_extract(u, r"(?s)^.*?://([^/?#]*)", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return lower, F.regexp_extract(u, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _hashed(key):
    return F.struct(key.alias("key"), F.xxhash64(key).alias("a"), F.xxhash64(F.lit("second"), key).alias("b"))


def _url_keys(shapes: list[tuple[int, int]]):
    """Array of a url's keys, longest first (the longer host first among equals)."""
    every = F.from_json(F.lit(json.dumps([{"n": n, "m": m} for n, m in shapes])), "array<struct<n:int,m:int>>")
    labels, length = F.split("host", r"\."), F.length("path")
    fit = F.filter(every, lambda s: (s["n"] <= F.size(labels)) & (s["m"] <= length))

    def key(s):
        suffix = F.array_join(F.slice(labels, -s["n"], s["n"]), ".")
        full = F.concat(suffix, F.col("path").substr(F.lit(1), s["m"]))
        return F.struct((-F.length(full)).alias("o"), (-F.length(suffix)).alias("h"), full.alias("key"))

    return F.transform(F.array_sort(F.transform(fit, key)), lambda x: _hashed(x["key"])).cast(f"array<struct<{_KEY}>>")


def cascade(universe: DataFrame, listed: DataFrame) -> list[np.ndarray]:
    """Levels for the ``listed`` keys (a, b) that tell them from all others of ``universe`` (a, b)."""
    inside = C.written(listed.distinct(), "cascade-in")
    outside = C.written(universe.join(inside, ["a", "b"], "left_anti").distinct(), "cascade-out")
    levels = []
    while (n := inside.count()):
        if len(levels) > 64:
            raise RuntimeError("two keys share both hashes")
        salt = len(levels) + 1
        words = bloom.build(inside, bloom.bits_for(n, 8), salt)
        levels.append(words)
        # what of the other side passes this level is what the next one holds
        inside, outside = C.written(_passing(outside, words, salt), "cascade-level"), inside
    return levels


def _passing(keys: DataFrame, words: np.ndarray, salt: int) -> DataFrame:
    bc = keys.sparkSession.sparkContext.broadcast(words)

    def run(batches):
        for b in batches:
            x, y = (b.column(i).to_numpy().view(np.uint64) for i in (0, 1))
            yield b.filter(pa.array(bloom.probe(bc.value, x, y, salt)))

    return keys.mapInArrow(run, keys.schema)


def member(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether each key is listed."""
    out = np.zeros(len(a), bool)
    left = np.arange(len(a))
    for i, words in enumerate(levels):
        left = left[bloom.probe(words, a[left], b[left], i + 1)]
        out[left] = i % 2 == 0  # passing an odd level: listed unless a later level says otherwise
    return out


def judge(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow",
          keep: list[str] | None = None) -> DataFrame:
    """Every row of ``pages`` as ``row`` with ``host``, ``path``, ``rule`` and ``verdict``.
    ``rules`` has the columns host, path, verdict."""
    host, path = parts(F.col(f"`{url_col}`"))
    cols = [F.col(f"`{c}`") for c in (pages.columns if keep is None else keep)]
    rules = rules.select("host", "path", "verdict").where(F.col("host").isNotNull() & F.col("path").isNotNull() & F.col("verdict").isin(*VERDICTS))
    rules = C.written(rules.groupBy("host", "path").agg(F.max("verdict").alias("verdict")), "url-rules")  # block > allow
    shape = rules.select(F.size(F.split("host", r"\.")).alias("n"), F.length("path").alias("m")).distinct()
    shapes = sorted((r.n, r.m) for r in shape.collect())  # label counts x path lengths: bounded by the rules' form
    src = pages.select(F.struct(*cols).alias("row"), host.alias("host"), path.alias("path")).select(
        "row", "host", "path", _url_keys(shapes).alias("keys"))
    listed = rules.select(_hashed(F.concat("host", "path")).alias("k"), "verdict")
    if rules.count() > MAX_LISTED:
        return _joined(src, listed, default)
    universe = C.written(src.select(F.explode("keys").alias("k")).select("k.a", "k.b").distinct(), "url-keys")
    levels = [cascade(universe, listed.where(F.col("verdict") == v).select("k.a", "k.b")) for v in VERDICTS]
    bc = pages.sparkSession.sparkContext.broadcast(levels)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(3)
            flat = keys.flatten()
            name, a, b = (flat.field(i) for i in range(3))
            a, b = (x.to_numpy().view(np.uint64) for x in (a, b))
            found = [member(x, a, b) for x in bc.value]
            hit = np.flatnonzero(found[0] | found[1])
            offs = keys.offsets.to_numpy()
            row = np.searchsorted(offs, hit + offs[0], "right") - 1
            first = np.unique(row, return_index=True)
            at = np.full(batch.num_rows, -1)
            at[first[0]] = hit[first[1]]
            none = at < 0
            rule = name.take(pa.array(at, mask=none))
            verdict = np.where(none, default, np.where(found[0][np.maximum(at, 0)], *VERDICTS)) if len(a) else np.full(batch.num_rows, default)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], rule, pa.array(verdict.tolist(), pa.string())],
                                             names=["row", "host", "path", "rule", "verdict"])

    schema = src.select("row", "host", "path", F.lit("").alias("rule"), F.lit("").alias("verdict")).schema
    for f in schema.fields[3:]:
        f.nullable = True
    return src.mapInArrow(run, schema)


def _joined(src: DataFrame, listed: DataFrame, default: str) -> DataFrame:
    """The same answer for a list too large to broadcast: an equi-join on the key."""
    src = C.written(src.select(F.monotonically_increasing_id().alias("rid"), "*"), "url-rows")
    key = src.select("rid", F.posexplode("keys").alias("i", "k")).select("rid", "i", "k.key")
    got = key.join(listed.select("k.key", "verdict"), "key").groupBy("rid").agg(F.min(F.struct("i", "key", "verdict")).alias("m"))
    return src.join(got, "rid", "left").select("row", "host", "path", F.col("m.key").alias("rule"),
                                               F.coalesce("m.verdict", F.lit(default)).alias("verdict"))
