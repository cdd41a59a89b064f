"""Secret scan with corpus-wide ownership frequency.

Every whole text is searched for credentials (assignments, access keys, long
hex) and for bare opaque tokens.  Hashes of all candidate values are counted
over distinct repositories and owners: a value that ``EXAMPLE_OWNERS`` or more
owners carry is a widely copied example, one that a single owner carries and
that looks random is a live-looking credential.  The pattern finds are reported
whatever their frequency; a bare token only if it is live-looking and outside
every pattern find.

Defined cases: a null text counts as empty; a null repository or owner is not
counted; a candidate without any owner is neither live nor an example; rows are
judged one by one, so repeated rows repeat their spans; values are compared and
kept as SHA-256 only.  Extra columns are kept in ``row``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseflow.llm import common as C

KINDS = ["assign", "access", "hex", "owned"]
#: Fixed patterns of the contract, and the least length of what they must match.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
ASSIGN_MIN, ACCESS_MIN, HEX_MIN = 8, 16, 32
#: A bare candidate: an unbroken run of this many characters.
OPAQUE = re.compile(r"[A-Za-z0-9+/_-]{20,}")
#: A value looks random if it has digits, both letter cases and so many different characters.
MIN_DISTINCT = 10
#: Different characters of a random value of one case: hexadecimal, and of an access key behind its AKIA.
HEX_DISTINCT, ACCESS_DISTINCT = 8, 8
#: Random characters of one case go from a letter to a digit or back at least once in so many (names and dates do not).
PER_TURN = 8
EXAMPLE_OWNERS = 5
#: Columns of a reported span, and their bytes.
SPAN = ["start", "kind", "end", "live", "example", "repos", "owners"]
SPAN_BYTES = 56

_RUN = np.zeros(256, bool)
_RUN[[ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"]] = True
_WORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")


_ONE_CASE_HEX = re.compile(r"[0-9a-f]+|[0-9A-F]+")
_TURN = re.compile(r"(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])")


def looks_random(value: str) -> bool:
    """Judged by the alphabet of the value: an access key, both cases, hexadecimal or letters of one case with digits."""
    if len(value) >= ACCESS_MIN and ACCESS.fullmatch(value):
        return len(set(value[4:])) >= ACCESS_DISTINCT
    if mixed_case(value):
        return True
    core = "".join(c for c in value if c.isalnum())
    if core != core.lower() and core != core.upper():
        return False
    least = HEX_DISTINCT if _ONE_CASE_HEX.fullmatch(core) else MIN_DISTINCT
    return len(set(core)) >= least and len(_TURN.findall(value)) >= max(2, len(core) / PER_TURN)


def mixed_case(value: str) -> bool:
    return (len(set(value)) >= MIN_DISTINCT and any("0" <= c <= "9" for c in value)
            and any("a" <= c <= "z" for c in value) and any("A" <= c <= "Z" for c in value))


def find(text: str, runs: bool = True) -> list[tuple[int, int, int, str]]:
    """(start, kind, end, value) of all candidates by start, then kind.  ``runs``
    false: the text is known to have no run of ``ACCESS_MIN`` token characters."""
    out = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        out += [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_MIN]
    if runs:
        if "AKIA" in text:
            out += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_MIN]
        opaque = [(m.start(), m.end()) for m in OPAQUE.finditer(text)]
        for a, b in opaque:  # a long hex run lies within one of these
            out += [(a + m.start(), 2, a + m.end(), m[0]) for m in HEX.finditer(text[a:b]) if m.end() - m.start() >= HEX_MIN]
        known = sorted((a, b) for a, _, b, _ in out)
        for a, b in opaque:
            if looks_random(text[a:b]) and not any(s < b and a < e for s, e in known):
                out.append((a, 3, b, text[a:b]))
    out.sort()
    return out


def _scan(texts: pa.Array) -> list:
    buf, offs = C.text_buffer(texts)
    starts, ends, woffs = C.word_spans(buf, offs, _RUN)
    long_run = np.zeros(len(texts), bool)
    doc = np.searchsorted(woffs[1:], np.flatnonzero(ends - starts >= ACCESS_MIN), "right")
    long_run[doc] = True
    count, flat = np.zeros(len(texts), np.int64), []
    for i, t in enumerate(texts.to_pylist()):
        got = find(t, bool(long_run[i])) if t else []
        count[i] = len(got)
        flat += got
    rows = pa.StructArray.from_arrays(
        [pa.array([x[0] for x in flat], pa.int64()), pa.array([x[1] for x in flat], pa.int32()),
         pa.array([x[2] for x in flat], pa.int64()),
         pa.array([hashlib.sha256(x[3].encode()).digest() for x in flat], pa.binary()),
         pa.array([looks_random(x[3]) or x[1] == 2 for x in flat], pa.bool_())],
        ["start", "kind", "end", "hash", "random"])
    return [C.lists(rows, count)]


def candidates(docs: DataFrame, text_col: str, repo_col: str, owner_col: str, keep: list[str] | None) -> DataFrame:
    """Written table of all documents: ``rid``, ``row``, ``repo``, ``owner``, ``found`` (candidate spans with the value's hash)."""
    cols = [F.col(f"`{c}`") for c in (docs.columns if keep is None else keep)]
    src = docs.select(F.struct(F.struct(*cols).alias("row"), F.col(f"`{repo_col}`").cast("string").alias("repo"),
                               F.col(f"`{owner_col}`").cast("string").alias("owner")).alias("row"),
                      F.col(f"`{text_col}`").cast("string").alias("text"))
    rows = C.annotate(src, "found array<struct<start:long,kind:int,end:long,hash:binary,random:boolean>>", _scan)
    return C.written(rows.select(F.monotonically_increasing_id().alias("rid"), "row.*", "found"), "secret-candidates")


def frequencies(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Written table (``hash``, ``repos``, ``owners``) of all candidate values, and the candidates, one a row."""
    cand = rows.where(F.size("found") > 0).select("rid", "repo", "owner", F.explode("found").alias("f")).select("rid", "repo", "owner", "f.*")
    # distinct (value, repository, owner) first: a value copied everywhere is one row per place before it is counted
    places = cand.select("hash", "repo", "owner").distinct()
    freq = places.groupBy("hash").agg(F.countDistinct("repo").alias("repos"), F.countDistinct("owner").alias("owners"))
    # written, so that both sides of a join with it are plain shuffles, and that of a hot value is split
    return C.written(freq, "secret-frequencies"), cand


def secrets(docs: DataFrame, text_col: str = "text", repo_col: str = "doc_id", owner_col: str = "source",
            keep: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Two written tables: all documents (``rid``, ``row``), and those with spans
    (``rid``, ``spans``: array of ``SPAN`` by start, then kind; ``repos`` and ``owners``
    are the numbers of distinct repositories and owners that carry the span's value)."""
    rows = candidates(docs, text_col, repo_col, owner_col, keep)
    freq, cand = frequencies(rows)
    spans = cand.join(freq, "hash").select(
        "rid", "start", "kind", "end", ((F.col("owners") == 1) & F.col("random")).alias("live"),
        (F.col("owners") >= EXAMPLE_OWNERS).alias("example"), "repos", "owners")
    spans = spans.where((F.col("kind") < 3) | F.col("live"))
    per = spans.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct(*SPAN))).alias("spans"))
    return rows.select("rid", "row"), C.written(per, "secret-spans")


def _small(found: DataFrame) -> DataFrame:
    return C.small(found, F.size("spans") * SPAN_BYTES)


def scan(docs: DataFrame, **options) -> DataFrame:
    """Every row of ``docs`` as ``row`` with its ``spans`` (empty if none)."""
    rows, found = secrets(docs, **options)
    none = F.array().cast(found.schema["spans"].dataType)
    return rows.join(_small(found), "rid", "left").select("rid", "row", F.coalesce("spans", none).alias("spans"))


def joined(spans, kinds: int = len(KINDS)):
    """``kind:start:end`` of the spans of the first ``kinds`` kinds, comma-joined."""
    name = F.array(*[F.lit(k) for k in KINDS])
    part = F.transform(F.filter(spans, lambda s: s["kind"] < kinds),
                       lambda s: F.concat_ws(":", F.element_at(name, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(part, ",")


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]", **options) -> DataFrame:
    """``docs`` with every reported span of ``text_col`` replaced by ``mark`` (overlapping spans by one)."""
    rows, found = secrets(docs, text_col=text_col, **options)
    found = _small(found)
    text = F.col(f"row.`{text_col}`").cast("string").alias("text")

    def cut(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for whole, found_in in batches:
            texts = []
            for t, spans in zip(whole.to_pylist(), found_in.to_pylist()):
                parts, at = [], 0
                for s in spans:
                    if s["end"] > at:
                        parts += [t[at:s["start"]], mark] if s["start"] >= at else []
                        at = s["end"]
                texts.append("".join([*parts, t[at:]]) if spans else t)
            yield pa.array(texts, pa.string())

    masked = F.arrow_udf(cut, "string")
    hit = rows.join(found, "rid").select("row", masked(text, "spans").alias("text"))
    done = rows.join(found.select("rid"), "rid", "left_anti").select("row", text)
    done = done.unionByName(hit)
    fields = [F.col(f"row.`{c}`") if c != text_col else F.col("text").alias(text_col) for c in docs.columns]
    return done.select(*fields)
