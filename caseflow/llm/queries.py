"""One query per operator over its whole table, and DuckDB SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caseflow.llm import common as C
from caseflow.llm import (html_lstm, lang_cnn, merkle_manifest, multi_index, pattern_packing, periodic_runs, quality_gbt, secret_owners,
                          simhash_blocks, toxicity_ftrl, url_cascade, vector_packing, winnow)

QUERIES = {}
ORACLE = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _scored(out: DataFrame, threshold: float) -> DataFrame:
    return out.select("row.doc_id", C.held_out(F.col("row.doc_id")).alias("held_out"), "score",
                      (F.col("score") >= threshold).cast("int").alias("predicted"))


@query
def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    model = quality_gbt.train(docs, C.table(spark, sf_dir, "labels"))
    return _scored(quality_gbt.score(docs, model, keep=["doc_id"]), 0.7)


@query
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    model = toxicity_ftrl.train(docs, C.table(spark, sf_dir, "labels"))
    return _scored(toxicity_ftrl.score(docs, model, keep=["doc_id"]), 0.3)


@query
def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    model = lang_cnn.train(docs.where(~C.held_out(F.col("doc_id"))))
    out = lang_cnn.identify(docs, model, keep=["doc_id"])
    return out.select("row.doc_id", C.held_out(F.col("row.doc_id")).alias("held_out"), "lang_pred", "score")


@query
def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = winnow.decontaminate(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return out.select("row.doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                      F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


_WORDS = """regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"""

ORACLE["op3_decontamination"] = f"""
WITH item AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, len, array_to_string(w[i:i + len - 1], ' ') AS s FROM (
    SELECT item_id, w, least(len(w), 10) AS len, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i
    FROM item WHERE len(w) > 0)),
doc AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
lens AS (SELECT DISTINCT len FROM win),
cand AS (
  SELECT rid, i, len, array_to_string(w[i:i + len - 1], ' ') AS s FROM (
    SELECT rid, w, len, unnest(range(1, len(w) - len + 2)) AS i FROM doc, lens WHERE len(w) >= len)),
hit AS (SELECT c.rid, c.i, c.len, w.item_id FROM cand c JOIN win w ON c.s = w.s AND c.len = w.len),
covered AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + len)) AS p FROM hit) GROUP BY rid),
items AS (SELECT rid, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS ids FROM hit WHERE item_id IS NOT NULL GROUP BY rid)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(c.n, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(len(i.ids), 0) AS BIGINT) AS n_items,
       sha256(coalesce(array_to_string(i.ids, ','), '')) AS items_sha256, c.n IS NOT NULL AS contaminated
FROM doc d LEFT JOIN covered c USING (rid) LEFT JOIN items i USING (rid)
"""


@query
def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash_blocks.near_duplicates(C.table(spark, sf_dir, "documents"), keep=["doc_id"])
    return out.select("row.doc_id", simhash_blocks.hex16("fp").alias("fingerprint"), "component_id")


@query
def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing_rows(C.table(spark, sf_dir, "documents"))


def packing_rows(docs: DataFrame) -> DataFrame:
    out = pattern_packing.pack(docs, keep=["doc_id"])
    return out.select("row.doc_id", F.col("piece").cast("int").alias("piece"), "start", "length",
                      F.col("crc").alias("ids_crc32"), "sequence_id", "offset")


@query
def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secret_owners.scan(C.table(spark, sf_dir, "documents"), keep=["doc_id"])

    def count(i):
        return F.size(F.filter("spans", lambda s: s["kind"] == i)).cast("long")

    def flag(name):
        return F.size(F.filter("spans", lambda s: s[name])).cast("long")

    def most(name):
        return F.coalesce(F.array_max(F.transform("spans", lambda s: s[name])), F.lit(0)).cast("long")

    return out.select("row.doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
                      F.sha2(secret_owners.joined(F.col("spans"), 3), 256).alias("base_sha256"),
                      secret_owners.joined(F.col("spans")).alias("spans"),
                      flag("live").alias("n_live"), flag("example").alias("n_example"),
                      most("repos").alias("max_repos"), most("owners").alias("max_owners"))


_CANDIDATES = ",\n".join(
    f"c{i} AS (SELECT rid, doc_id, source, {i} AS kind, regexp_extract_all(t, '{p}') AS m, string_split_regex(t, '{p}') AS gap FROM doc)"
    for i, p in enumerate([
        r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+""",
        "AKIA[A-Z0-9]+", "[0-9a-f]+", "[A-Za-z0-9+/_-]{20,}"]))

_DISTINCT = "len(list_distinct(string_split({}, '')))"

ORACLE["op1_secret_scans"] = f"""
WITH doc AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents),
{_CANDIDATES},
found AS (
  SELECT rid, doc_id, source, kind, m[i] AS s,
         CAST(list_sum(list_transform(gap[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS a
  FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM
        (SELECT * FROM c0 UNION ALL SELECT * FROM c1 UNION ALL SELECT * FROM c2 UNION ALL SELECT * FROM c3))),
valued AS (
  SELECT *, a + length(s) AS b,
         CASE kind WHEN 0 THEN regexp_extract(s, '[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)$', 1) ELSE s END AS v FROM found),
kept AS (
  SELECT *, regexp_replace(v, '[^A-Za-z0-9]', '', 'g') AS core, regexp_replace(regexp_replace(v, '[0-9]+', '0', 'g'), '[A-Za-z]+', 'a', 'g') AS runs
  FROM valued WHERE (kind = 0 AND length(v) >= {secret_owners.ASSIGN_MIN}) OR (kind = 1 AND length(v) >= {secret_owners.ACCESS_MIN})
         OR (kind = 2 AND length(v) >= {secret_owners.HEX_MIN}) OR kind = 3),
random AS (
  SELECT *, CASE
      WHEN length(v) >= {secret_owners.ACCESS_MIN} AND regexp_full_match(v, 'AKIA[A-Z0-9]+') THEN {_DISTINCT.format("v[5:]")} >= {secret_owners.ACCESS_DISTINCT}
      WHEN {_DISTINCT.format("v")} >= {secret_owners.MIN_DISTINCT} AND regexp_matches(v, '[0-9]')
           AND regexp_matches(v, '[a-z]') AND regexp_matches(v, '[A-Z]') THEN true
      WHEN core <> lower(core) AND core <> upper(core) THEN false
      ELSE {_DISTINCT.format("core")} >= CASE WHEN regexp_full_match(core, '[0-9a-f]+|[0-9A-F]+') THEN {secret_owners.HEX_DISTINCT} ELSE {secret_owners.MIN_DISTINCT} END
           AND (2 * length(runs) - length(replace(runs, 'a0', '')) - length(replace(runs, '0a', ''))) / 2 >= greatest(2, length(core) / {secret_owners.PER_TURN})
    END AS rnd FROM kept),
cand AS (
  SELECT * FROM random r WHERE kind < 3 OR (rnd AND NOT EXISTS (
    SELECT 1 FROM random o WHERE o.rid = r.rid AND o.kind < 3 AND o.a < r.b AND r.a < o.b))),
freq AS (SELECT v, count(DISTINCT doc_id) AS repos, count(DISTINCT source) AS owners FROM cand GROUP BY v),
span AS (
  SELECT c.*, repos, owners, owners = 1 AND (rnd OR kind = 2) AS live, owners >= {secret_owners.EXAMPLE_OWNERS} AS example
  FROM cand c JOIN freq USING (v) WHERE kind < 3 OR (rnd AND owners = 1)),
txt AS (SELECT *, (['assign', 'access', 'hex', 'owned'])[kind + 1] || ':' || a || ':' || b AS x FROM span),
per AS (
  SELECT rid, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
         string_agg(x, ',' ORDER BY a, kind) FILTER (kind < 3) AS base, string_agg(x, ',' ORDER BY a, kind) AS spans,
         count(*) FILTER (live) AS n_live, count(*) FILTER (example) AS n_example,
         max(repos) AS max_repos, max(owners) AS max_owners
  FROM txt GROUP BY rid)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
       coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example,
       coalesce(max_repos, 0) AS max_repos, coalesce(max_owners, 0) AS max_owners
FROM doc d LEFT JOIN per USING (rid)
"""


#: Rules of the query: fixed values.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


@query
def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    out = url_cascade.judge(C.table(spark, sf_dir, "pages"), rules, keep=["page_id"])
    return out.select("row.page_id", "host", "path", "rule", "verdict")


ORACLE["op4_url_filters"] = f"""
WITH rules(h, p, verdict) AS (VALUES {", ".join(str(r) for r in URL_RULES)}),
page AS (
  SELECT row_number() OVER () AS rid, page_id,
         translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
best AS (
  SELECT rid, arg_max(h || p, length(h || p)) AS rule, arg_max(verdict, length(h || p)) AS verdict
  FROM page JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY rid)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM page LEFT JOIN best USING (rid)
"""


@query
def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = C.table(spark, sf_dir, "embeddings")
    return multi_index.nearest(vectors, vectors.where(F.col("vec_id") % 50 == 0))


@query
def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = C.table(spark, sf_dir, "pages")
    out = html_lstm.extract(pages, html_lstm.train(pages), keep=["page_id", "url"])
    return out.select("row.page_id", "row.url", "text", "n_chars")


@query
def op11_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain documents: every id bears loss."""
    out = vector_packing.pack(C.table(spark, sf_dir, "documents"), keep=["doc_id"])
    return out.select("row.doc_id", "start", "length", F.col("crc").alias("ids_crc32"), F.col("tokens").alias("doc_tokens"), "sequence_id", "offset")


def _crc32(doc_id) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary"))


def with_periods(docs: DataFrame) -> DataFrame:
    """The documents of the run query: where the contract plants a period, the words from one on repeat."""
    h, g = F.col("h"), F.floor(F.col("h") / 10)
    words = F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit("([^\\x20\\x09-\\x0D]+)"), F.lit(1)))  # null elsewhere
    out = docs.select("doc_id", "text", _crc32(F.col("doc_id")).alias("h")).withColumn("w", words)
    out = out.select("doc_id", "text", "w", F.size("w").alias("n"), g.alias("g"))
    out = out.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    out = out.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    times = (F.col("n") - F.col("a")) / F.col("p")
    tail = F.flatten(F.array_repeat(F.slice("w", F.col("a") + 1, F.col("p")), F.ceil(times).cast("int")))
    whole = F.slice(F.concat(F.slice("w", 1, F.col("a")), tail), 1, F.col("n"))
    return out.select("doc_id", F.when(F.col("n") > 0, F.array_join(whole, " ")).otherwise(F.col("text")).alias("text"))


@query
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = periodic_runs.scan(with_periods(C.table(spark, sf_dir, "documents")), keep=["doc_id"])
    # longest first, then smallest start and period
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("x"), r["start"].alias("start"), r["period"].alias("period"))))
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    text = F.when(F.size("runs") > 0, F.concat(F.array_join(line, "\n"), F.lit("\n"))).otherwise(F.lit(""))
    out = out.select("row.doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("b"), F.sha2(text, 256).alias("runs_sha256"),
                     F.sha2("collapsed", 256).alias("collapsed_sha256"))
    length = -F.col("b.x")
    return out.select("doc_id", "n_runs", F.col("b.start").alias("start"), length.alias("length"), F.col("b.period").alias("period"),
                      F.floor(1000 * length / F.col("b.period")).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAF = ["doc_id", "source", "lang", "n_chars", "text"]


@query
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = merkle_manifest.manifest(C.table(spark, sf_dir, "documents"), LEAF, tampered={"text": F.translate("text", UPPER, LOWER)},
                                   where=_crc32(F.col("doc_id")) % 5 == 0)
    return out.select("row.doc_id", "leaf", "subroot", "root", F.sha2(merkle_manifest.proof_text(F.col("segments")), 256).alias("proof_sha256"),
                      F.col("folded").alias("folded_root"), "verified")


def _crc32_sql(value: str) -> str:
    """The CRC-32 of a text of ASCII characters: a reduction over its bytes, in it one over the bits of each."""
    byte = f"list_transform(string_split({value}, ''), lambda c: CAST(ord(c) AS BIGINT))"
    bits = "list_reduce(list_prepend(xor(s, b), CAST(range(8) AS BIGINT[])), lambda k, _: xor(k >> 1, CAST(3988292384 AS BIGINT) * (k & 1)))"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {byte}), lambda s, b: {bits}), CAST(4294967295 AS BIGINT))"


def _leaf_sql(text: str) -> str:
    cols = [text if c == "text" else f"CAST({c} AS VARCHAR)" for c in LEAF]
    return "sha256(" + " || ".join(f"coalesce(strlen({c}) || ':' || {c}, '-')" for c in cols) + ")"


def _siblings_sql(nodes: str) -> str:
    run = "OVER (PARTITION BY tree, level, idx // 16 ORDER BY idx ROWS BETWEEN"
    return f"""SELECT tree, level, idx,
    coalesce(string_agg(digest, '') {run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
    coalesce(string_agg(digest, '') {run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM {nodes} WHERE n > 1"""


_UP = "SELECT tree, level + 1, idx // 16, (n + 15) // 16, sha256(string_agg(digest, '' ORDER BY idx))"

ORACLE["op13_merkle_manifest"] = f"""
WITH RECURSIVE doc AS MATERIALIZED (
  SELECT doc_id, source, {_leaf_sql("text")} AS leaf,
         CASE WHEN doc_id IS NOT NULL AND {_crc32_sql("CAST(doc_id AS VARCHAR)")} % 5 = 0 THEN {_leaf_sql(f"translate(text, '{UPPER}', '{LOWER}')")} END AS other
  FROM documents),
ranked AS MATERIALIZED (
  SELECT *, row_number() OVER () AS rid, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree,
         row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM doc),
low(tree, level, idx, n, digest) AS (
  SELECT tree, 0, pos, n, leaf FROM ranked UNION ALL {_UP} FROM low WHERE n > 1 GROUP BY tree, level, idx // 16, n),
top(tree, level, idx, n, digest) AS (
  SELECT -1, 0, tree, count(*) OVER (), digest FROM low WHERE n = 1 UNION ALL {_UP} FROM top WHERE n > 1 GROUP BY tree, level, idx // 16, n),
sib AS ({_siblings_sql("low")}),
topsib AS ({_siblings_sql("top")}),
steps AS (
  SELECT rid, 0 AS part, s.level, l, r FROM ranked d JOIN sib s ON s.tree = d.tree AND s.idx = d.pos >> (4 * s.level)
  UNION ALL SELECT rid, 1, s.level, l, r FROM ranked d JOIN topsib s ON s.idx = d.tree >> (4 * s.level)),
path AS (
  SELECT rid, sha256(string_agg(l || r, '' ORDER BY part, level)) AS proof,
         list({{'l': l, 'r': r, 'h': ''}} ORDER BY part, level) AS steps FROM steps GROUP BY rid),
folded AS (
  SELECT d.*, coalesce(proof, sha256('')) AS proof_sha256,
         list_reduce(list_prepend({{'l': '', 'r': '', 'h': coalesce(other, leaf)}}, coalesce(steps, [])),
                     lambda a, s: {{'l': '', 'r': '', 'h': sha256(s.l || a.h || s.r)}}).h AS folded_root
  FROM ranked d LEFT JOIN path USING (rid))
SELECT doc_id, leaf, s.digest AS subroot, t.digest AS root, proof_sha256, folded_root, folded_root = t.digest AS verified
FROM folded f JOIN low s ON s.tree = f.tree AND s.n = 1 JOIN top t ON t.n = 1
"""
