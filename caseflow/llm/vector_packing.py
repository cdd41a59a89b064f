"""Vector bin packing of examples into sequences under several limits at once.

An example is a prompt followed by a response; its vector is (tokens, segments,
loss-bearing tokens), where the response and the end id bear loss.  A sequence
is limited in all three.  It is filled by the dot-product heuristic: among the
examples that still fit whole, the one whose vector has the largest weighted dot
product with the room left goes in (weights: the mean demand of a dimension).
If none fits and cutting is allowed, the example with the best cut piece fills
the room.  A sequence that the limits or the end of the examples leave short is
trimmed to a power of two, a shape that needs no padding; what is trimmed goes
back to the waiting examples.

Each task packs its own rows in blocks of at most ``BLOCK_ROWS`` examples and about
``BLOCK_TOKENS`` ids as it tokenises them: no shuffle, bounded memory, and a lost
task is repeated with the same result, whatever its executor.

Defined cases: a null or empty text has no ids but the end id; an empty table
gives no rows; rows are packed one by one (repeated ids are separate examples).
The kept columns travel in ``row``.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseflow.llm import common as C

SIZE = 4096
SEGMENTS = 128
END_ID = 2
BLOCK_ROWS = 1 << 12
BLOCK_TOKENS = 1 << 21
#: Entries of the tokeniser's memory of odd words, and the longest of them.
MEMO_WORDS, MEMO_CHARS = 1 << 16, 64

_BLANK = re.compile("[\t-\r ]+")
#: Texts of blanks, ASCII and Latin-1 letters; there the tokeniser's rules are these (letter
#: case folded first): contractions, letters, single digits, runs of anything else.
_PLAIN = re.compile("[\t-\r -~À-ÖØ-öø-ÿ]*")
_PARTS = re.compile("'(?:s|t|re|ve|m|ll|d)|[a-zß-öø-ÿ]+|[0-9]|[!-/:-@\\[-`{-~]+")
#: Ends every part in place of the vocabulary's end mark; never inside a plain text.
_END, _SUFFIX = "\0", "</w>"


def _ranks(path: str) -> dict[bytes, int]:
    """The file's vocabulary as bytes.  Its ids are ranks already: bytes, bytes with the
    end mark, then merges in order, so an end mark goes to the byte before it first.
    The file writes a byte that is no visible character as one from 256 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in seen} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in seen)}
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    added = {t["content"] for t in spec["added_tokens"]}
    out = {}
    for token, rank in spec["model"]["vocab"].items():
        if token not in added:
            end = token.endswith(_SUFFIX) and token != _SUFFIX
            out[bytes(byte[c] for c in (token[:-len(_SUFFIX)] if end else token)) + _END.encode() * end] = rank
    return out


class Words:
    """Ids of texts, those that ``tokenizers`` gives for the same file.  Plain texts are
    cut into parts here and merged by ``tiktoken``, at several times the speed; words
    with other characters, and with what may be an added token, go to ``tokenizers``."""

    def __init__(self, path: str | None = None):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer
        path = path or public_tokenizers.path("word_bpe_49k.json")
        self.tokenizer = Tokenizer.from_file(path)
        self.merges = tiktoken.Encoding("words", pat_str=f"[^{_END}]+{_END}", mergeable_ranks=_ranks(path), special_tokens={})
        self.memo = {}

    def _plain(self, text: str) -> list[int]:
        parts = _PARTS.findall(text.lower())
        return self.merges.encode_ordinary(_END.join([*parts, ""]))

    def _odd(self, word: str) -> list[int]:
        ids = self.memo.get(word)
        if ids is None:
            ids = self.tokenizer.encode(word, add_special_tokens=False).ids
            if len(word) <= MEMO_CHARS:
                if len(self.memo) >= MEMO_WORDS:
                    self.memo.clear()
                self.memo[word] = ids
        return ids

    def ids(self, text: str | None) -> list[int]:
        if not text:
            return []
        if "<|" not in text and _PLAIN.fullmatch(text):
            return self._plain(text)
        out, run = [], []
        for w in _BLANK.split(text):  # white space is dropped, so a text's ids are those of its words in a row
            if "<|" not in w and _PLAIN.fullmatch(w):
                run.append(w)
            else:
                out += self._plain(" ".join(run))
                out += self._odd(w)
                run = []
        return out + self._plain(" ".join(run))


_loaded = {}


def words(path: str | None = None) -> Words:
    if path not in _loaded:
        _loaded[path] = Words(path)
    return _loaded[path]


class Pool:
    """Waiting ranges of examples: item, first id, ids, and how many of these precede the loss-bearing ones."""

    def __init__(self, tokens: np.ndarray, loss: np.ndarray):
        n = len(tokens)
        self.item, self.start = np.arange(n), np.zeros(n, np.int64)
        self.size, self.free = tokens.astype(np.int64), (tokens - loss).astype(np.int64)
        self.waiting = int((self.size > 0).sum())

    def take(self, k: int, length: int) -> tuple[int, int, int]:
        """The first ``length`` ids of range k; the rest waits on."""
        piece = (int(self.item[k]), int(self.start[k]), length)
        self.start[k] += length
        self.size[k] -= length
        self.free[k] = max(0, self.free[k] - length)
        self.waiting -= self.size[k] == 0
        return piece

    def give(self, item: int, start: int, length: int, free: int) -> None:
        at = np.flatnonzero(self.size == 0)
        if not len(at):
            at = [len(self.size)]
            self.item, self.start, self.size, self.free = (np.append(x, np.zeros(64, np.int64)) for x in (self.item, self.start, self.size, self.free))
        k = at[0]
        self.item[k], self.start[k], self.size[k], self.free[k] = item, start, length, free
        self.waiting += 1

    def compact(self) -> None:
        if 2 * self.waiting < len(self.size):
            live = self.size > 0
            self.item, self.start, self.size, self.free = (x[live] for x in (self.item, self.start, self.size, self.free))


def place(tokens: np.ndarray, loss: np.ndarray, size: int = SIZE, segments: int = SEGMENTS, max_loss: int | None = None,
          cut: bool = True) -> list[list[tuple[int, int, int]]]:
    """Sequences as lists of pieces (item, first id, length), in the order of their places.

    ``loss``: ids at an item's end that bear loss.  Without ``cut`` an item is cut
    only if it cannot fit an empty sequence, and sequences are not trimmed."""
    cap = np.array([size, segments, size if max_loss is None else max_loss], float)
    if min(cap) < 1:
        raise ValueError("limits must be at least 1")
    pool, out = Pool(tokens, loss), []
    if not pool.waiting:
        return out
    # weight of a dimension: mean demand in shares of its limit, over the square of the limit for the two vectors
    weight = np.array([tokens.mean(), 1.0, loss.mean()]) / cap / cap ** 2
    lead = (tokens - loss).astype(np.int64)
    while pool.waiting:
        pool.compact()
        room, held = cap.astype(np.int64), []
        while pool.waiting and room[0] and room[1]:
            fit = np.minimum(np.minimum(pool.size, room[0]), pool.free + room[2])  # longest first part that the limits allow
            ok = fit > 0
            if held:
                whole = ok & (fit == pool.size)
                if whole.any():
                    ok = whole
                elif not cut:
                    break
            if not ok.any():
                break
            w = weight * room
            score = np.where(ok, w[0] * fit + w[1] + w[2] * np.maximum(0, fit - pool.free), -1.0)
            k = int(np.argmax(score))
            n = int(fit[k])
            room -= [n, 1, max(0, n - int(pool.free[k]))]
            held.append(pool.take(k, n))
        total = size - int(room[0])
        if cut and total < size:
            spare = total - (1 << (total.bit_length() - 1))
            while spare:
                i, a, n = held.pop()
                keep = max(0, n - spare)
                if keep:
                    held.append((i, a, keep))
                spare -= n - keep
                pool.give(i, a + keep, n - keep, max(0, int(lead[i]) - a - keep))
        out.append(held)
    return out


def _blocks(batches: Iterator[pa.RecordBatch], path: str | None, prompts: bool):
    """(rows, ids per row, loss-bearing ids per row) of bounded size; columns: row, text and perhaps prompt."""
    enc = words(path)
    rows, ids, loss, held = [], [], [], 0
    for batch in batches:
        lo, n = 0, batch.num_rows
        for i in range(n):
            answer = [*enc.ids(batch.column(1)[i].as_py()), END_ID]
            ids.append(np.array(enc.ids(batch.column(2)[i].as_py()) + answer if prompts else answer, "<u4"))
            loss.append(len(answer))
            held += len(ids[-1])
            if len(ids) == BLOCK_ROWS or held >= BLOCK_TOKENS or i == n - 1:
                rows.append(batch.column(0).slice(lo, i + 1 - lo))
                lo = i + 1
            if len(ids) == BLOCK_ROWS or held >= BLOCK_TOKENS:
                yield pa.concat_arrays(rows), ids, np.array(loss)
                rows, ids, loss, held = [], [], [], 0
    if ids:
        yield pa.concat_arrays(rows), ids, np.array(loss)


def _source(docs: DataFrame, text_col: str, prompt_col: str | None, keep: list[str] | None) -> DataFrame:
    """``row`` (kept columns; by default all but the texts), ``text`` and perhaps ``prompt``."""
    C.bound_batches(docs.sparkSession)
    texts = [text_col] + ([prompt_col] if prompt_col else [])
    cols = [F.col(f"`{c}`") for c in (keep if keep is not None else [c for c in docs.columns if c not in texts])]
    return docs.select(F.struct(*cols).alias("row"),
                       *[F.col(f"`{c}`").cast("string").alias(n) for c, n in zip(texts, ("text", "prompt"))])


def _numbers(count: int) -> int:
    """First number of a task's next ``count`` sequences: unique over tasks, and the same when a task is repeated."""
    return (TaskContext.get().partitionId() << 36) + count


def pack(docs: DataFrame, text_col: str = "text", prompt_col: str | None = None, keep: list[str] | None = None,
         size: int = SIZE, segments: int = SEGMENTS, max_loss: int | None = None, cut: bool = True,
         path: str | None = None) -> DataFrame:
    """One row per piece: ``row``, ``start``, ``length``, ``crc`` (of its ids), ``tokens`` (of the whole
    example), ``loss`` (loss-bearing ids of the piece), ``sequence_id``, ``offset``."""
    src = _source(docs, text_col, prompt_col, keep)
    names = ["start", "length", "crc", "tokens", "loss", "sequence_id", "offset"]
    schema = T.StructType([src.schema["row"], *[T.StructField(n, T.LongType()) for n in names]])

    def run(batches):
        done = 0
        for rows, ids, loss in _blocks(batches, path, prompt_col is not None):
            tokens = np.array([len(x) for x in ids])
            seqs = place(tokens, loss, size, segments, max_loss, cut)
            out = []
            for s, held in enumerate(seqs, _numbers(done)):
                at = 0
                for i, a, n in held:
                    bearing = a + n - max(a, tokens[i] - loss[i])
                    out.append((i, a, n, zlib.crc32(ids[i][a:a + n].tobytes()), tokens[i], max(0, bearing), s, at))
                    at += n
            done += len(seqs)
            flat = np.array(out, np.int64).T
            yield pa.RecordBatch.from_arrays([rows.take(pa.array(flat[0])), *map(pa.array, flat[1:])], names=["row", *names])

    return src.mapInArrow(run, schema)


def sequences(docs: DataFrame, text_col: str = "text", prompt_col: str | None = None, size: int = SIZE, segments: int = SEGMENTS,
              max_loss: int | None = None, cut: bool = True, path: str | None = None) -> DataFrame:
    """The packed sequences themselves: ``sequence_id``, ``ids``, ``lengths`` (of the segments), ``loss`` (whether each id bears loss)."""
    src = _source(docs, text_col, prompt_col, [])

    def run(batches):
        done = 0
        for _, ids, loss in _blocks(batches, path, prompt_col is not None):
            seqs = place(np.array([len(x) for x in ids]), loss, size, segments, max_loss, cut)
            for lo in range(0, len(seqs), 64):
                part = seqs[lo:lo + 64]
                flat = [np.concatenate([ids[i][a:a + n] for i, a, n in held]).astype(np.int32) for held in part]
                bears = [np.concatenate([np.arange(a, a + n) >= len(ids[i]) - loss[i] for i, a, n in held]) for held in part]
                total = [len(x) for x in flat]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(len(part)) + _numbers(done + lo)), C.lists(pa.array(np.concatenate(flat)), total),
                     C.lists(pa.array([n for held in part for _, _, n in held], pa.int32()), [len(h) for h in part]),
                     C.lists(pa.array(np.concatenate(bears)), total)], names=["sequence_id", "ids", "lengths", "loss"])
            done += len(seqs)

    return src.mapInArrow(run, "sequence_id long, ids array<int>, lengths array<int>, loss array<boolean>")
