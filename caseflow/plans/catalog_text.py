"""Registered text-corpus queries (survey §2.12) over the title corpus
(``part.p_name`` in row order of ``p_partkey``), each with an oracle SQL twin
that builds the corpus string directly."""

from __future__ import annotations

from pyspark.sql import functions as F

from caseflow.operators import backoff as B
from caseflow.operators import text as TX
from caseflow.plans.catalog import register
from caseflow.sources.tables import raw_table

SEQ = TX.SEQ_LENGTH
NGRAM = 4          # context length of the next-character model
N_SEEDS, STEPS, SEED = 5, 80, 0


def corpus(spark, d):
    return raw_table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("text"))


def _w(spark, d, seq=SEQ):
    return TX.t_windows(corpus(spark, d), seq=seq)


_C = "c AS (SELECT string_agg(lower(coalesce(p_name, '')) || chr(10), '' ORDER BY p_partkey) AS s FROM part)"


def _win_sql(name: str, seq: int) -> str:
    return (f"{name} AS (SELECT CAST(i AS BIGINT) AS pos, substr(s, CAST(i + 1 AS BIGINT), {seq}) AS \"window\", "
            f"substr(s, CAST(i + {seq + 1} AS BIGINT), 1) AS next_char "
            f"FROM (SELECT unnest(range(0, length(s) - {seq})) AS i, s FROM c) r)")


_VOCAB = ("v AS (SELECT ch, CAST(row_number() OVER (ORDER BY ch) - 1 AS INTEGER) AS idx FROM ("
          "SELECT DISTINCT unnest(string_split(lower(coalesce(p_name, '')) || chr(10), '')) AS ch FROM part) u)")


@register("t_corpus_stats", f"""
WITH {_C}, {_VOCAB}
SELECT CAST(length(s) AS BIGINT) AS n_chars, (SELECT CAST(count(*) AS BIGINT) FROM v) AS n_vocab,
       CAST(length(s) - {SEQ} AS BIGINT) AS n_patterns FROM c
""", ctes=False)
def q_t_corpus_stats(spark, d):
    return TX.t_corpus_stats(corpus(spark, d), seq=SEQ)


@register("t_char_vocab", f"WITH {_VOCAB} SELECT ch, idx FROM v", ctes=False)
def q_t_char_vocab(spark, d):
    return TX.t_char_vocab(corpus(spark, d))


@register("t_windows", f"WITH {_C}, {_win_sql('w', SEQ)} SELECT pos, \"window\", next_char FROM w", ctes=False)
def q_t_windows(spark, d):
    return _w(spark, d)


_ENC = f"""
WITH {_C}, {_win_sql('w', SEQ)}, {_VOCAB}, nv AS (SELECT count(*) AS n FROM v),
chars AS (SELECT pos, generate_subscripts(string_split("window", ''), 1) AS k,
                 unnest(string_split("window", '')) AS ch FROM w),
e AS (SELECT chars.pos, list(CAST(v.idx AS DOUBLE) / (SELECT n FROM nv) ORDER BY chars.k) AS x
      FROM chars JOIN v ON v.ch = chars.ch GROUP BY chars.pos)
"""


@register("t_encode", _ENC + """
SELECT e.pos, e.x, v2.idx AS y FROM e JOIN w ON w.pos = e.pos LEFT JOIN v v2 ON v2.ch = w.next_char
""", ctes=False)
def q_t_encode(spark, d):
    c = corpus(spark, d)
    return TX.t_encode_corpus(c, TX.t_char_vocab(c), seq=SEQ)


@register("t_decode", f"WITH {_C}, {_win_sql('w', SEQ)} SELECT pos, \"window\" FROM w", ctes=False)
def q_t_decode(spark, d):
    c = corpus(spark, d)
    vocab = TX.t_char_vocab(c)
    return TX.t_decode(TX.t_encode(_w(spark, d), vocab), vocab)


_COUNTS = f"""{_win_sql('w4', NGRAM)},
cnts AS (SELECT "window" AS ctx, next_char, count(*) AS cnt FROM w4 GROUP BY "window", next_char),
am AS (SELECT ctx, next_char FROM (SELECT ctx, next_char, row_number() OVER (
         PARTITION BY ctx ORDER BY cnt DESC, next_char) AS rn FROM cnts) t WHERE rn = 1)"""


@register("t_next_char_counts", f"WITH {_C}, {_COUNTS} SELECT ctx, next_char, cnt FROM cnts", ctes=False)
def q_t_next_char_counts(spark, d):
    return TX.t_next_char_counts(corpus(spark, d), NGRAM)


@register("t_argmax", f"WITH {_C}, {_COUNTS} SELECT ctx, next_char FROM am", ctes=False)
def q_t_argmax(spark, d):
    return TX.t_argmax(q_t_next_char_counts(spark, d))


_SEEDS = f"seeds AS (SELECT pos, \"window\" FROM w ORDER BY md5(CAST(pos AS VARCHAR) || '|{SEED}') LIMIT {N_SEEDS})"


@register("t_seed_pick", f"WITH {_C}, {_win_sql('w', SEQ)}, {_SEEDS} SELECT pos, \"window\", "
          "(SELECT next_char FROM w w2 WHERE w2.pos = seeds.pos) AS next_char FROM seeds", ctes=False)
def q_t_seed_pick(spark, d):
    return TX.t_seed_pick(_w(spark, d), N_SEEDS, SEED)


@register("t_generate", f"""
WITH RECURSIVE {_C}, {_win_sql('w', SEQ)}, {_SEEDS}, {_COUNTS},
gen(pos, step, text, generated) AS (
  SELECT pos, 0, "window", '' FROM seeds
  UNION ALL
  SELECT g.pos, g.step + 1, g.text || a.next_char, g.generated || a.next_char
  FROM gen g JOIN am a ON a.ctx = right(g.text, {NGRAM}) WHERE g.step < {STEPS})
SELECT pos, arg_max(generated, step) AS generated FROM gen GROUP BY pos
""", ctes=False)
def q_t_generate(spark, d):
    seeds = q_t_seed_pick(spark, d)
    return TX.t_generate(seeds, q_t_argmax(spark, d), NGRAM, STEPS)


def _held(col: str = "p_partkey") -> str:
    """One line in eight is held out, by a hash of its key."""
    return f"substr(md5(CAST({col} AS VARCHAR) || '|9'), 1, 1) < '2'"


_B_CORPUS = "c AS (SELECT string_agg(lower(coalesce(p_name, '')) || chr(10), '' ORDER BY p_partkey) AS s FROM part {where})"


def _backoff_ctes(least: int) -> str:
    """Counts, totals, discounts and probabilities per context length, from the windows ``w4``."""
    out = [f'r{NGRAM} AS (SELECT "window" AS ctx, next_char AS ch, count(*) AS raw, count(*) AS c FROM w4 GROUP BY ALL)']
    out += [f"r{k} AS (SELECT substr(ctx, 2) AS ctx, ch, sum(raw) AS raw, count(*) AS c FROM r{k + 1} GROUP BY ALL)" for k in range(NGRAM - 1, -1, -1)]
    for k in range(NGRAM + 1):
        out.append(f"""d{k} AS (SELECT greatest({B.LEAST_DISCOUNT}, least({B.MOST_DISCOUNT}, coalesce(count(*) FILTER (c = 1) / nullif(
  CAST(count(*) FILTER (c = 1) + 2 * count(*) FILTER (c = 2) AS DOUBLE), 0), 0))) AS d, count(*) + 1 AS v FROM r{k})""")
        out.append(f"""t{k} AS (SELECT ctx, CAST(sum(c) AS DOUBLE) AS total, d * count(*) / sum(c) AS g FROM r{k}, d{k} GROUP BY ctx, d
  {f"HAVING sum(raw) >= {least}" if k else ""})""")
        lower = f"q.p FROM r{k} r JOIN t{k} t USING (ctx) JOIN p{k - 1} q ON q.ctx = substr(r.ctx, 2) AND q.ch = r.ch, d{k}" if k else f"1.0 / v FROM r{k} r JOIN t{k} t USING (ctx), d{k}"
        out.append(f"p{k} AS (SELECT r.ctx, r.ch, (c - d) / total + g * {lower.replace(' FROM', ' AS p FROM', 1)})")
    return ", ".join(out)


def _train_test(spark, d):
    c = corpus(spark, d)
    held = F.substring(F.md5(F.concat(F.col("id").cast("string"), F.lit("|9"))), 1, 1) < "2"
    return c.where(~held), c.where(held)


@register("t_backoff_probs", f"WITH {_B_CORPUS.format(where='')}, {_win_sql('w4', NGRAM)}, {_backoff_ctes(2)} "
          + " UNION ALL ".join(f"SELECT {k} AS len, ctx, ch AS next_char, round(p, 6) AS p FROM p{k}" for k in range(NGRAM + 1)), ctes=False)
def q_t_backoff_probs(spark, d):
    """Every kept (context, next character) of all lengths with its probability; contexts seen once are pruned."""
    model = B.t_backoff_model(corpus(spark, d), NGRAM, min_count=2)
    out = None
    for k, p in enumerate(model.probs):
        one = p.select(F.lit(k).alias("len"), "ctx", "next_char", F.round("p", 6).alias("p"))
        out = one if out is None else out.unionByName(one)
    return out


def _entropy_ctes() -> str:
    out = [_B_CORPUS.replace("c AS", "ct AS", 1).format(where=f"WHERE {_held()}"),
           _win_sql("wt", NGRAM).replace("FROM c)", "FROM ct)"),
           f'x{NGRAM} AS (SELECT "window" AS ctx, next_char AS ch, count(*) AS cnt, CAST(1 AS DOUBLE) AS w FROM wt GROUP BY ALL)']
    for k in range(NGRAM, -1, -1):
        out.append(f"h{k} AS (SELECT cnt, w * p AS p FROM x{k} x JOIN p{k} p ON p.ctx = x.ctx AND p.ch = x.ch)")
        out.append(f"""x{k - 1 if k else 'u'} AS (SELECT substr(x.ctx, 2) AS ctx, x.ch, cnt, w * coalesce(g, 1) AS w FROM x{k} x LEFT JOIN t{k} t ON t.ctx = x.ctx
  WHERE NOT EXISTS (SELECT 1 FROM p{k} p WHERE p.ctx = x.ctx AND p.ch = x.ch))""")
    return ", ".join(out)


@register("t_backoff_entropy", f"WITH {_B_CORPUS.format(where=f'WHERE NOT ({_held()})')}, {_win_sql('w4', NGRAM)}, {_backoff_ctes(1)}, {_entropy_ctes()} "
          "SELECT CAST(sum(cnt) AS BIGINT) AS n_chars, round(-sum(cnt * ln(p)) / sum(cnt), 6) AS cross_entropy FROM ("
          + " UNION ALL ".join(f"SELECT cnt, p FROM h{k}" for k in range(NGRAM + 1)) + " UNION ALL SELECT cnt, w / v FROM xu, d0) a", ctes=False)
def q_t_backoff_entropy(spark, d):
    """Cross-entropy (nats a character) on the lines held out, of a model of the others."""
    train, test = _train_test(spark, d)
    out = B.t_cross_entropy(test, B.t_backoff_model(train, NGRAM))
    return out.select("n_chars", F.round("cross_entropy", 6).alias("cross_entropy"))


def _argmax_ctes() -> str:
    out = []
    for k in range(NGRAM + 1):
        best = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ctx ORDER BY round(p, 12) DESC, ch) AS pos FROM p{k}) o WHERE pos = 1"
        if k:
            other = "round(t.g * q.p, 12) > round(b.p, 12)"
            best = (f"SELECT b.ctx, CASE WHEN {other} THEN q.ch ELSE b.ch END AS ch, CASE WHEN {other} THEN t.g * q.p ELSE b.p END AS p "
                    f"FROM ({best}) b JOIN t{k} t ON t.ctx = b.ctx JOIN a{k - 1} q ON q.ctx = substr(b.ctx, 2)")
        out.append(f"a{k} AS ({best})")
    return ", ".join(out)


@register("t_backoff_generate", f"""
WITH RECURSIVE {_B_CORPUS.format(where='')}, {_win_sql('w', SEQ)}, {_SEEDS}, {_win_sql('w4', NGRAM)}, {_backoff_ctes(2)}, {_argmax_ctes()},
am AS MATERIALIZED ({" UNION ALL ".join(f"SELECT {k} AS len, ctx, ch FROM a{k}" for k in range(NGRAM + 1))}),
gen(pos, step, text, generated) AS (
  SELECT pos, 0, "window", '' FROM seeds
  UNION ALL
  SELECT pos, step + 1, text || ch, generated || ch FROM (
    SELECT g.pos, g.step, g.text, g.generated, arg_max(a.ch, a.len) AS ch FROM gen g JOIN am a ON a.ctx = right(g.text, a.len) AND length(g.text) >= a.len
    WHERE g.step < {STEPS} GROUP BY g.pos, g.step, g.text, g.generated) n)
SELECT pos, arg_max(generated, step) AS generated FROM gen GROUP BY pos""", ctes=False)
def q_t_backoff_generate(spark, d):
    model = B.t_backoff_model(corpus(spark, d), NGRAM, min_count=2)
    return B.t_backoff_generate(q_t_seed_pick(spark, d), B.t_backoff_argmax(model), NGRAM, STEPS)


def documents(spark, d):
    return raw_table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")


@register("t_next_char_counts_docs", """
WITH ch AS (
  SELECT c, row_number() OVER (ORDER BY doc_id, k) AS pos FROM (
    SELECT doc_id, generate_subscripts(s, 1) AS k, unnest(s) AS c FROM (
      SELECT doc_id, string_split(lower(coalesce(text, '')) || chr(10), '') AS s FROM documents) l) u),
w AS (SELECT c || lead(c) OVER o AS ctx, lead(c, 2) OVER o AS next_char FROM ch WINDOW o AS (ORDER BY pos))
SELECT ctx, next_char, count(*) AS cnt FROM w WHERE next_char IS NOT NULL GROUP BY ALL""", ctes=False)
def q_t_next_char_counts_docs(spark, d):
    """Two-character contexts over the whole texts of ``documents`` (non-ASCII, up to very long lines)."""
    return TX.t_next_char_counts(documents(spark, d), 2)


@register("t_char_codes_docs", """
WITH ch AS (SELECT unnest(string_split(lower(coalesce(text, '')) || chr(10), '')) AS c FROM documents),
v AS (SELECT c, row_number() OVER (ORDER BY c) - 1 AS idx FROM (SELECT DISTINCT c FROM ch) u)
SELECT CAST(idx AS INTEGER) AS y, count(*) - (SELECT count(*) FROM (
         SELECT c FROM (SELECT unnest(string_split(lower(coalesce(text, '')) || chr(10), '')) AS c FROM (
           SELECT text FROM documents ORDER BY doc_id LIMIT 10)) f LIMIT 4) g WHERE g.c = ch.c) AS cnt
FROM ch JOIN v USING (c) GROUP BY idx, ch.c""", ctes=False)
def q_t_char_codes_docs(spark, d):
    """How often each vocabulary index is a target: the encoded corpus of ``documents``, windows of 4."""
    docs = documents(spark, d)
    return TX.t_encode_corpus(docs, TX.t_char_vocab(docs), seq=4).groupBy("y").agg(F.count(F.lit(1)).alias("cnt"))
