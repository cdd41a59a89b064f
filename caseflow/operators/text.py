"""Character-level corpus preparation and a next-character model (survey §2.12).

The corpus is the concatenation, in a given row order, of every text
lower-cased with a newline after it.  Nothing here builds that string in one
place: global character offsets come from a distributed prefix sum, and the
corpus is cut into fixed-size blocks (plus a halo of ``seq`` characters) so
every window of ``seq`` characters and its next character is produced inside
one bounded group, whatever the corpus size.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caseflow.operators.prefix import ROWS_PER_RANGE, running_sums
from caseflow.session import ensure_checkpoint_dir, note_shared, reliable_checkpoint, shared_table

SEQ_LENGTH = 76          # window length of the reference's corpus preparation
# characters per block (plus the halo). Kept small on purpose: substring on a
# UTF-8 string walks from its start, so cutting windows costs O(block) each.
DEFAULT_BLOCK = 1 << 10

#: Characters whose windows one task makes. Blocks are small beside their windows, so
#: a partitioning by bytes would leave them to a few tasks.
CHARS_PER_TASK = 1 << 20


def corpus_lines(df: DataFrame, text_col: str = "text", order_col: str = "id") -> DataFrame:
    """(order, line, len): each text lower-cased with its newline kept; NULL text is an empty line."""
    line = F.concat(F.lower(F.coalesce(F.col(text_col), F.lit(""))), F.lit("\n"))
    return df.select(F.col(order_col).alias("ord"), line.alias("line")).withColumn(
        "len", F.length("line").cast("bigint"))


def corpus_offsets(lines: DataFrame, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Add ``off``: the global character offset of each line in ``ord`` order
    (a distributed running sum of the line lengths; ``ord`` must be unique).

    Only order and length are sorted and summed; the lines take their offsets by a row number."""
    rows = shared_table(lines.withColumn("_row", F.monotonically_increasing_id()), "corpus-lines")
    sums = running_sums(rows.select("_row", "ord", "len"), "ord", ["len"], rows_per_range, suffix="_off", stored=True)
    return rows.join(sums.select("_row", F.col("len_off").cast("bigint").alias("off")), "_row").select("ord", "line", "len", "off")


def corpus_blocks(offsets: DataFrame, seq: int, block: int = DEFAULT_BLOCK, tasks: int = 1) -> DataFrame:
    """(block, text): block b holds corpus characters [b*block, (b+1)*block + seq), seq <= block;
    dealt to ``tasks`` partitions (1: as Spark finds by bytes).

    Each line is cut once, at the block borders (one pass over its characters);
    the first ``seq`` characters of a block go to the block before it as well, so
    a group never holds more than block + seq characters."""
    if seq > block:
        raise ValueError("a block must hold a window")
    b0, head = F.floor(F.col("off") / F.lit(block)).cast("long"), (F.lit(block) - F.col("off") % F.lit(block)).cast("int")
    first = F.substring("line", F.lit(1), head)
    rest = F.regexp_extract_all(F.substring("line", head + 1, F.col("len").cast("int")), F.lit(f"(?s).{{1,{block}}}"), F.lit(0))
    parts = F.concat(F.array(first), F.when(F.col("len") > head, rest).otherwise(F.array().cast("array<string>")))
    cut = offsets.where(F.col("len") > 0).select("off", b0.alias("b0"), F.posexplode(parts).alias("i", "piece"))
    cut = cut.select((F.col("b0") + F.col("i")).alias("block"), "piece",
                     F.when(F.col("i") == 0, F.col("off")).otherwise((F.col("b0") + F.col("i")) * block).alias("s"))
    halo = F.lit(seq) - (F.col("s") - F.col("block") * block)  # characters of the piece that the block before needs
    own = F.struct("block", "s", "piece")
    before = F.when((F.col("block") > 0) & (halo > 0), F.struct(
        (F.col("block") - 1).alias("block"), F.col("s"), F.substring("piece", F.lit(1), halo.cast("int")).alias("piece")))
    pieces = cut.select(F.explode(F.array_compact(F.array(own, before))).alias("x")).select("x.*")
    if tasks > 1:
        pieces = pieces.repartition(tasks, "block")
    return pieces.groupBy("block").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s", "piece"))),
                                 lambda x: x.getField("piece")), "").alias("text"))


def corpus_length(lines: DataFrame) -> DataFrame:
    return lines.agg(F.sum("len").cast("bigint").alias("n_chars"))


def _window_blocks(df: DataFrame, text_col: str, order_col: str, seq: int, block: int, rows_per_range: int) -> tuple:
    """Blocks with ``n_here``, the number of windows that start in each, and the block size used."""
    lines = corpus_lines(df, text_col, order_col)
    block = max(block, seq)
    offsets = corpus_offsets(lines, rows_per_range)
    total = offsets.agg(F.sum("len")).first()[0] or 0
    blocks = corpus_blocks(offsets, seq, block, -(-total // CHARS_PER_TASK))
    n_here = F.least(F.lit(block).cast("bigint"), F.lit(total - seq).cast("bigint") - F.col("block") * block)
    return blocks.withColumn("n_here", n_here).where(F.col("n_here") > 0), block


def t_windows(df: DataFrame, text_col: str = "text", order_col: str = "id", seq: int = SEQ_LENGTH,
              block: int = DEFAULT_BLOCK, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Every window of ``seq`` characters of the corpus and the character after
    it, stride 1, crossing line boundaries: (pos, window, next_char), with
    ``n_chars - seq`` rows.  Lines with a NULL order come last."""
    blocks, block = _window_blocks(df, text_col, order_col, seq, block, rows_per_range)
    starts = blocks.select("block", F.posexplode(_grams(seq)).alias("k", "gram"))
    return starts.select(
        (F.col("block") * block + F.col("k")).cast("bigint").alias("pos"), *_window_and_next(seq))


def _grams(seq: int):
    """Every run of ``seq`` + 1 characters of ``text``, in order, by one walk over it."""
    return F.regexp_extract_all("text", F.lit(f"(?s)(?=(.{{{seq + 1}}}))."), F.lit(1))


def _window_and_next(seq: int) -> list:
    return [F.substring("gram", 1, seq).alias("window"), F.substring("gram", seq + 1, 1).alias("next_char")]


def t_chars(df: DataFrame, text_col: str = "text") -> DataFrame:
    """One row per character of the corpus (newline after each text included)."""
    line = F.concat(F.lower(F.coalesce(F.col(text_col), F.lit(""))), F.lit("\n"))
    return df.select(F.explode(F.split(line, "")).alias("ch")).where(F.length("ch") > 0)


def t_char_vocab(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Sorted distinct characters (code-point order) with a 0-based index.
    Distinct characters are reduced map-side; the index window runs on the
    alphabet only."""
    chars = t_chars(df, text_col).distinct()
    return chars.select("ch", (F.row_number().over(Window.orderBy("ch")) - 1).cast("int").alias("idx"))


def t_corpus_stats(df: DataFrame, text_col: str = "text", seq: int = SEQ_LENGTH) -> DataFrame:
    """Total characters, vocabulary size and number of training patterns (chars - seq)."""
    n_chars = corpus_length(corpus_lines(df, text_col, text_col)).select("n_chars").scalar()
    vocab = t_chars(df, text_col).agg(F.count_distinct("ch").cast("bigint").alias("n_vocab"))
    return vocab.select(n_chars.alias("n_chars"), "n_vocab",
                        (n_chars - F.lit(seq)).cast("bigint").alias("n_patterns"))


def _code_point(ch):
    return F.ascii(F.nullif(ch, F.lit("")))  # of any character, not of ASCII only


def vocab_arrays(vocab: DataFrame) -> tuple:
    """The vocabulary as scalar values: index by code point (NULL where absent), character
    by index, and size.  None of them can exceed the 1,114,112 code points of Unicode."""
    spark = vocab.sparkSession
    coded = vocab.select("ch", "idx", _code_point(F.col("ch")).alias("cp"))
    top = coded.agg(F.max("cp")).first()[0] or 0
    every = spark.range(top + 1).select(F.col("id").cast("int").alias("cp")).join(coded, "cp", "left")

    def in_order(df, key, value):
        pairs = F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), F.col(value).alias("v"))))
        return df.agg(F.transform(pairs, lambda x: x["v"]).alias("a")).scalar()

    return in_order(every, "cp", "idx"), in_order(coded, "idx", "ch"), coded.agg(F.count(F.lit(1))).scalar()


def _indices(chars, lookup):
    """Vocabulary index of each character: one array access per character."""
    return F.transform(chars, lambda c: F.get(lookup, _code_point(c)))


def t_encode(windows: DataFrame, vocab: DataFrame, col: str = "window", normalise: bool = True) -> DataFrame:
    """Characters -> vocabulary indices (NULL if unknown), divided by the vocabulary size when ``normalise``."""
    lookup, _, n = vocab_arrays(vocab)
    w = windows.withColumn("_lookup", lookup).withColumn("_n", n)
    enc = _indices(F.split(F.col(col), ""), F.col("_lookup"))
    if normalise:
        enc = F.transform(enc, lambda i: i.cast("double") / F.col("_n").cast("double"))
    nxt = F.get("_lookup", _code_point(F.col("next_char"))) if "next_char" in windows.columns else F.lit(None)
    return w.select("pos", enc.alias("x"), nxt.cast("int").alias("y"))


def t_encode_corpus(df: DataFrame, vocab: DataFrame, text_col: str = "text", order_col: str = "id", seq: int = SEQ_LENGTH,
                    block: int = DEFAULT_BLOCK, normalise: bool = True, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """``t_encode`` of every corpus window, (pos, x, y): each block's characters are
    encoded once, and a window is a slice of its block's indices."""
    blocks, block = _window_blocks(df, text_col, order_col, seq, block, rows_per_range)
    lookup, _, n = vocab_arrays(vocab)
    codes = blocks.withColumn("_lookup", lookup).select("block", "n_here", _indices(F.split("text", ""), F.col("_lookup")).alias("codes"))
    if normalise:
        codes = codes.withColumn("_n", n).withColumn("values", F.transform("codes", lambda i: i.cast("double") / F.col("_n").cast("double")))
    else:
        codes = codes.withColumn("values", F.col("codes"))
    k = codes.select("block", "codes", "values", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_here") - 1)).alias("k"))
    return k.select((F.col("block") * block + F.col("k")).cast("bigint").alias("pos"),
                    F.slice("values", (F.col("k") + 1).cast("int"), F.lit(seq)).alias("x"),
                    F.get("codes", (F.col("k") + seq).cast("int")).alias("y"))


def t_decode(encoded: DataFrame, vocab: DataFrame, col: str = "x", normalised: bool = True) -> DataFrame:
    """Indices (or index / size) back to text."""
    _, chars, n = vocab_arrays(vocab)
    e = encoded.withColumn("_chars", chars).withColumn("_n", n)
    idx = F.col(col)
    if normalised:
        idx = F.transform(idx, lambda v: F.round(v * F.col("_n").cast("double")).cast("int"))
    return e.select("pos", F.array_join(F.transform(idx, lambda i: F.get(F.col("_chars"), i)), "").alias("window"))


def t_one_hot(encoded: DataFrame, vocab_size: int, col: str = "y") -> DataFrame:
    """One-hot target as a sparse vector (MLlib ``OneHotEncoder``, all categories kept)."""
    from pyspark.ml.feature import OneHotEncoder
    enc = OneHotEncoder(inputCols=[col], outputCols=[f"{col}_onehot"], dropLast=False)
    model = enc.fit(encoded.limit(0).unionByName(
        encoded.sparkSession.range(1).select(F.lit(vocab_size - 1).cast("int").alias(col)),
        allowMissingColumns=True))
    return model.transform(encoded)


def t_next_char_counts(df: DataFrame, n: int, text_col: str = "text", order_col: str = "id",
                       block: int = DEFAULT_BLOCK) -> DataFrame:
    """Counts of (n-character context -> next character) over the corpus."""
    blocks, _ = _window_blocks(df, text_col, order_col, n, block, ROWS_PER_RANGE)
    grams = blocks.select(F.explode(_grams(n)).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("cnt"))
    window, next_char = _window_and_next(n)
    return grams.select(window.alias("ctx"), next_char, "cnt")


def t_argmax(counts: DataFrame) -> DataFrame:
    """Most frequent next character per context (ties: the smallest character)."""
    return counts.groupBy("ctx").agg(
        F.min_by("next_char", F.struct((-F.col("cnt")).alias("c"), F.col("next_char").alias("ch")))
        .alias("next_char"))


def t_seed_pick(windows: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """``n`` pseudo-random windows: ordered by md5(pos|seed) (reproducible, engine independent)."""
    key = F.md5(F.concat(F.col("pos").cast("string"), F.lit(f"|{seed}")))
    return windows.orderBy(key).limit(n)


#: Contexts in one bucket of the written model.
ROWS_PER_BUCKET = 1 << 18


def _model_table(argmax: DataFrame, rows_per_bucket: int) -> tuple[DataFrame, int]:
    """The argmax table written once to the shared checkpoint folder, partitioned by a
    hash bucket of the context (one file per bucket, as many buckets as its counted
    rows ask for), and the number of buckets."""
    whole = shared_table(argmax.select("ctx", "next_char"), "ngram")
    n = max(1, -(-whole.count() // rows_per_bucket))
    path = f"{ensure_checkpoint_dir(whole.sparkSession).rstrip('/')}/ngram-model-{uuid.uuid4().hex}"
    bucketed = whole.select(F.pmod(F.xxhash64("ctx"), F.lit(n)).alias("b"), "ctx", "next_char")
    bucketed.repartition("b").write.partitionBy("b").parquet(path)
    schema = bucketed.select("ctx", "next_char", "b").schema
    note_shared(path)
    return whole.sparkSession.read.schema(schema).parquet(path), n


def t_generate(seeds: DataFrame, argmax: DataFrame, n: int, steps: int,
               checkpoint_every: int = 10, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Greedy generation: repeatedly look up the last ``n`` characters in the
    argmax table and append the predicted character, for every seed at once.

    Seeds are few (a bounded parameter) and the argmax table is only joined,
    never collected.  It is written once, partitioned by a context hash; each
    step gathers the buckets of the current contexts (at most one per seed)
    and reads only those partitions.  A seed whose context has no
    continuation stops.  Each step's small seed table is cached, and the
    lineage is cut every ``checkpoint_every`` steps with a reliable checkpoint
    (``spark.checkpoint.dir``)."""
    table, n_buckets = _model_table(argmax, rows_per_bucket)
    table = table.select("b", "ctx", F.col("next_char").alias("_nx"))
    g = reliable_checkpoint(seeds.select("pos", F.col("window").alias("text"), F.lit("").alias("generated"),
                                         F.lit(False).alias("done")))
    cached = []
    for i in range(steps):
        g = (g.withColumn("ctx", F.expr(f"substring(text, -{n}, {n})"))
             .withColumn("b", F.pmod(F.xxhash64("ctx"), F.lit(n_buckets))))
        part = table
        if n_buckets > 1:
            live = [r[0] for r in g.where(~F.col("done")).select("b").distinct().collect()]  # <= #seeds
            if not live:
                break
            part = table.where(F.col("b").isin(live))
        g = g.join(part, ["b", "ctx"], "left")
        stop = F.col("done") | F.col("_nx").isNull()
        g = g.select("pos",
                     F.when(stop, F.col("text")).otherwise(F.concat("text", "_nx")).alias("text"),
                     F.when(stop, F.col("generated")).otherwise(F.concat("generated", "_nx")).alias("generated"),
                     stop.alias("done"))
        if checkpoint_every and (i + 1) % checkpoint_every == 0 and i + 1 < steps:
            g = reliable_checkpoint(g)
            for c in cached:
                c.unpersist()
            cached = []
        elif n_buckets > 1:  # read twice: by the next step and by its search for buckets
            g = g.cache()
            cached.append(g)
    return g.select("pos", "generated")
