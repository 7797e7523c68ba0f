"""Secret scanning: fixed patterns, and strings that are novel to a primed compressor in a sensitive context.

A candidate's novelty is its marginal compressed size: zstandard, primed with a dictionary of common identifiers
followed by the text around the candidate (without it), compresses the candidate; the bytes that it takes beyond
an empty input, per byte of the candidate, are high for random keys and low for words, identifiers and repeats.

A context word stands near a candidate, on either side, or the candidate follows one in context (lines of a block).
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "novel")
_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
# runs of 24 characters and more: the same as all runs of which shorter ones are dropped
_HEX = re.compile(r"[0-9a-f]{24,}")
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
_CONTEXT = re.compile(
    r"pass(?:word|wd|phrase)|pwd|secret|token|api_?key|auth|bearer|credential|private|signature|session|access|\bkey\b", re.ASCII | re.IGNORECASE)

# The last line of a block, too short for a candidate.
_LAST_LINE = re.compile(r"(?:\\r)?(?:\\n|\r?\n)[ \t]*([A-Za-z0-9+/=]{1,15})(?=(?:\\r|\\n|\s)*-----END)")

# Identifiers that code and configuration repeat; a parameter of the operator.
IDENTIFIERS = (
    "access_key_id secret_access_key client_secret client_id api_key apikey auth_token access_token refresh_token id_token "
    "authorization: Bearer Basic password passwd username user_name private_key public_key BEGIN END certificate session_id "
    "csrf_token signature sha256 sha512 md5 base64 encoding utf-8 application/json content-type text/plain http:// https:// "
    "localhost 127.0.0.1 example.com config settings environment production development staging database connection string "
    "AbstractFactory Builder Controller Exception Handler Listener Manager Provider Repository Service Serializer "
    "getElementById addEventListener querySelector createElement innerHTML function return const static public private "
    "protected class interface extends implements import export default async await true false null None undefined "
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 0000000000000000 1234567890123456 "
    "xxxxxxxxxxxxxxxx XXXXXXXXXXXXXXXX ---------------- ================ ________________ your_api_key_here changeme placeholder"
)


@dataclass(frozen=True)
class Novelty:
    """``share``: least marginal compressed bytes per byte; ``near``: characters before and behind a candidate that make its context.

    ``apart``: characters that may stand between two parts of one token or block.
    """

    share: float = 0.5
    near: int = 64
    apart: int = 2
    around: int = 1024
    level: int = 3
    identifiers: str = field(default=IDENTIFIERS, repr=False)


def marginal_share(candidate: str, around: str, novelty: Novelty) -> float:
    """Bytes that the primed compressor adds for the candidate, per byte of it."""
    import zstandard

    primer = zstandard.ZstdCompressionDict(
        (novelty.identifiers + "\n" + around).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    zstd = zstandard.ZstdCompressor(level=novelty.level, dict_data=primer, write_checksum=False, write_content_size=False)
    raw = candidate.encode()
    return (len(zstd.compress(raw)) - len(zstd.compress(b""))) / len(raw)


def _judged(s: str) -> bool:
    """Whether the compressed size is to decide: for digits with letters, and for letters whose case changes often.

    Letters of one case and numbers are left out: a rare word is as new to the compressor as a key is.
    """
    if any(c.isdigit() for c in s):
        return any(c.isalpha() for c in s)
    letters = [c.isupper() for c in s if c.isalpha()]
    return 4 * sum(a != b for a, b in zip(letters, letters[1:], strict=False)) >= len(s)


def _in_context(text: str, novelty: Novelty) -> list[tuple[int, int]]:
    """Spans of the candidates that have a context word within ``near`` characters, or belong to one that has.

    Context goes on to the next candidate within ``near`` characters, so it reaches every line of a block, and back to
    one at most ``apart`` characters before, so that a word behind a token of several parts counts for all of them.
    """
    spans = [m.span() for m in _CANDIDATE.finditer(text)]
    if not spans:
        return []
    words = [m.span() for m in _CONTEXT.finditer(text)]
    if not words:
        return []
    near, inside, at = novelty.near, [], 0
    for i, (start, end) in enumerate(spans):
        # a word counts if it lies whole within reach and outside the candidate
        while at < len(words) and words[at][0] < start - near:
            at += 1
        j = at
        while j < len(words) and words[j][1] > start and words[j][0] < end:
            j += 1
        inside.append(j < len(words) and words[j][1] <= end + near or i > 0 and inside[-1] and start - spans[i - 1][1] <= near)
    for i in range(len(spans) - 2, -1, -1):
        inside[i] = inside[i] or inside[i + 1] and spans[i + 1][0] - spans[i][1] <= novelty.apart
    return [span for span, yes in zip(spans, inside, strict=True) if yes]


def find_secrets(text: str | None, novelty: Novelty) -> list[tuple[str, int, int, float | None]]:
    """(kind, start, end, novelty) of each secret, by start and then kind. Offsets are code points, the end is exclusive.

    Base kinds are found leftmost and without overlap, each on its own. Novel spans overlap no base span.
    """
    if not text:
        return []
    found: list[tuple[str, int, int, float | None]] = []
    if "=" in text or ":" in text:
        found += [("assign", *m.span(), None) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    found += [("access", *m.span(), None) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [("hex", *m.span(), None) for m in _HEX.finditer(text)]
    base = sorted((s, e) for _, s, e, _ in found)
    at, covered = 0, -1  # base spans that start before the candidate ends, and how far they reach

    def novel(start: int, end: int) -> float:
        around = text[max(0, start - novelty.around):start] + " " + text[end:end + novelty.around]
        around = around.replace(text[start:end], " ")  # a key that is written twice is novel twice
        return marginal_share(text[start:end], around, novelty)

    for start, end in _in_context(text, novelty):
        while at < len(base) and base[at][0] < end:
            covered = max(covered, base[at][1])
            at += 1
        if covered > start or not _judged(text[start:end]):
            continue
        share = novel(start, end)
        if share >= novelty.share:
            found.append(("novel", start, end, share))
            last = _LAST_LINE.match(text, end)
            if last:
                found.append(("novel", *last.span(1), novel(*last.span(1))))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


SPANS = "array<struct<kind:string,start:int,end:int,novelty:double>>"


def scan_secrets(docs: DataFrame, novelty: Novelty | None = None, carry: Sequence[str] = ("doc_id",), into: str = "secrets") -> DataFrame:
    """The ``carry`` columns of ``docs`` and ``into``: an array of kind, start, end, novelty (null for base kinds).

    Whole texts are scanned; null text has no secrets. One row per input row, repeated or not. The work is linear in
    the text but for one small compression per candidate in a sensitive context. An empty table gives an empty result.
    """
    novelty = novelty or Novelty()
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("novelty", pa.float64())]))
    columns = [c for c in carry if c != into]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [
                [{"kind": k, "start": s, "end": e, "novelty": n} for k, s, e, n in find_secrets(t.as_py(), novelty)]
                for t in batch.column(batch.num_columns - 1)
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(spans, kind)], [*columns, into])

    taken = docs.select(*[F.col(f"`{c}`") for c in columns], F.col("text").alias("_scanned"))
    schema = taken.schema[:-1] if columns else None
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in (schema or []))
    return taken.mapInArrow(scan, f"{ddl}{', ' if ddl else ''}`{into}` {SPANS}")


def spans_text(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def of_kind(spans: Column, *kinds: str) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(*kinds))


def redact(text: str | None, spans: list[tuple[int, int]], mask: str) -> str | None:
    """The text with each covered stretch replaced by ``mask``; overlapping spans make one stretch."""
    if not spans:
        return text
    out, at = [], 0
    for start, end in sorted(spans):
        if start >= at:
            out += [text[at:start], mask]
        at = max(at, end)
    return "".join(out) + text[at:]


def redact_secrets(docs: DataFrame, novelty: Novelty | None = None, mask: str = "<SECRET>") -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by ``mask``; the same columns, rows and null texts."""
    novelty = novelty or Novelty()
    columns = docs.columns
    where = columns.index("text")

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for t in batch.column(where):
                text = t.as_py()
                texts.append(redact(text, [(s, e) for _, s, e, _ in find_secrets(text, novelty)], mask))
            yield batch.set_column(where, batch.schema.field(where), pa.array(texts, batch.schema.field(where).type))

    return docs.mapInArrow(clean, docs.schema)
