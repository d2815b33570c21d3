"""Secret scan: keyword prefilter, anchored expressions, checksum validation.

An Aho-Corasick automaton over the ASCII-lower-cased text finds the places of
all keywords in one pass; a second one, over the text with each byte mapped to
whether it is a hexadecimal digit, finds runs of them.  A kind's expression is
only tried anchored at such a place (or, for runs, around it), in ascending
order and never inside the last match of the kind, which gives the leftmost
non-overlapping matches.  Matches that are too short are then dropped.

Kinds without a checksum (always reported): ``assign`` (a secret's name, a sign
and a value), ``access`` (cloud access key ids) and ``hex``.  Kinds that the
method adds must pass their embedded check: ``github`` and ``npm`` tokens (the
last six characters are the CRC-32 of those before, base 62), ``jwt`` (header
and payload are JSON, the header names an algorithm) and ``pem`` private keys
(the body is Base64 of a DER sequence of the stated length).

Defined results: null and empty texts have no spans; repeated rows and null
ids are scanned like any other; very long texts are scanned whole, in time
proportional to their length; an empty table gives no rows; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_HEX_DIGITS = b"0123456789abcdef"
_HEX_CLASS = bytes(ord("h") if c in _HEX_DIGITS else ord(".") for c in range(256))
_BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
HEX_LEAST = 24


def checksum_base62(body: bytes) -> bytes:
    """CRC-32 in base 62, six characters."""
    n, out = zlib.crc32(body), ""
    for _ in range(6):
        n, digit = divmod(n, 62)
        out = _BASE62[digit] + out
    return out.encode()


def _crc_token(m: re.Match) -> bool:
    return checksum_base62(m[1]) == m[2]


def _json_part(part: bytes) -> object:
    try:
        return json.loads(base64.urlsafe_b64decode(part + b"=" * (-len(part) % 4)))
    except (ValueError, RecursionError):
        return None


def _jwt(m: re.Match) -> bool:
    header = _json_part(m[1])
    return isinstance(header, dict) and "alg" in header and isinstance(_json_part(m[2]), dict)


def _pem(m: re.Match) -> bool:
    try:
        der = base64.b64decode(re.sub(rb"\s", b"", m[1]), validate=True)
    except (ValueError, binascii.Error):
        return False
    if len(der) < 4 or der[0] != 0x30:
        return False
    if der[1] < 0x80:
        return der[1] == len(der) - 2
    n = der[1] & 0x7F
    return 0 < n <= 4 and int.from_bytes(der[2:2 + n], "big") == len(der) - 2 - n


@dataclass(frozen=True)
class Kind:
    """An expression that begins with one of its (lower-case) keywords."""

    name: str
    keywords: tuple[str, ...]
    pattern: re.Pattern
    valid: Callable[[re.Match], bool]


#: Kinds in the order in which spans at one start are listed; ``hex`` stands
#: third, the added kinds after it.
KINDS = (
    Kind("assign", ("password", "passwd", "secret", "token", "apikey", "api_key"),
         re.compile(rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE),
         lambda m: len(m[2]) >= 6),
    Kind("access", ("akia",), re.compile(rb"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    Kind("hex", (), re.compile(rb"[0-9a-f]+"), lambda m: len(m[0]) >= HEX_LEAST),
    Kind("github", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"),
         re.compile(rb"gh[pousr]_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])"), _crc_token),
    Kind("npm", ("npm_",), re.compile(rb"npm_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])"), _crc_token),
    Kind("jwt", ("eyj",), re.compile(rb"(?<![A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+)\.[A-Za-z0-9_-]+"), _jwt),
    Kind("pem", ("-----begin ",),
         re.compile(rb"-----BEGIN (?:[A-Z]+ ){0,3}PRIVATE KEY-----([A-Za-z0-9+/=\s]+)-----END (?:[A-Z]+ ){0,3}PRIVATE KEY-----"), _pem),
)
BASE = ("assign", "access", "hex")
_HEX = BASE.index("hex")
_AUTOMATA: list[ahocorasick.Automaton] = []


def _automata() -> list[ahocorasick.Automaton]:
    """Built once in a Python worker: keywords, and runs of digits."""
    if not _AUTOMATA:
        words = ahocorasick.Automaton()
        for k, kind in enumerate(KINDS):
            for word in kind.keywords:
                words.add_word(word, (k, len(word)))
        runs = ahocorasick.Automaton()
        runs.add_word("h" * HEX_LEAST, HEX_LEAST)
        for a in (words, runs):
            a.make_automaton()
            _AUTOMATA.append(a)
    return _AUTOMATA


def scan(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then kind; in code points."""
    if not text:
        return []
    raw = text.encode()
    words, runs = _automata()
    found: list[tuple[int, int, int]] = []
    reached = [0] * len(KINDS)
    hits = [(end + 1 - size, k) for end, (k, size) in words.iter(raw.translate(_LOWER).decode("latin-1"))]
    for start, k in sorted(hits):
        if start >= reached[k]:
            m = KINDS[k].pattern.match(raw, start)
            if m:
                reached[k] = m.end()
                if KINDS[k].valid(m):
                    found.append((start, k, m.end()))
    for end, size in runs.iter(raw.translate(_HEX_CLASS).decode("latin-1")):
        # The first hit of a run ends its first digits, so it starts the run.
        start = end + 1 - size
        if start >= reached[_HEX]:
            m = KINDS[_HEX].pattern.match(raw, start)
            reached[_HEX] = m.end()
            found.append((start, _HEX, m.end()))
    if not found:
        return []
    if len(raw) != len(text):  # bytes to code points, from one place to the next
        points, at, n = {}, 0, 0
        for place in sorted({p for a, _, b in found for p in (a, b)}):
            n += len(raw[at:place].decode())
            points[place], at = n, place
        found = [(points[a], k, points[b]) for a, k, b in found]
    return [(KINDS[k].name, a, b) for a, k, b in sorted(found)]


def scan_secrets(docs: DataFrame) -> DataFrame:
    """doc_id and spans (kind, start, end; ordered by start, then kind)."""
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in common.text_slices(batch):
                found = [[{"kind": k, "start": a, "end": b} for k, a, b in scan(t)] for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(first, len(texts)), pa.array(found, span)], ["doc_id", "spans"])

    common.ship_package(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).mapInArrow(
        run, "doc_id long, spans array<struct<kind:string,start:long,end:long>>")
