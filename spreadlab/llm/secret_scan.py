"""Secret scan: Aho-Corasick keywords first, anchored expressions only at their hits, then checksums.

One automaton over the text's lower-cased bytes finds where a keyword of any kind starts; the kind's
expression is matched only there.  Long runs of hexadecimal digits have no keyword: every run of
16 shows in each fourth byte of the text as four such digits in a row, and only there a run is
measured.  Kinds of tokens with an embedded CRC-32 are reported only where it holds.

All spans count code points, end exclusive.  Kinds, in the order of equal starts: assign, access, hex
(the base), then github, npm and jwt, which never change the base.

Nulls, ties and odd rows: null counts as empty, and has no spans; spans of different kinds may overlap and all
stay; repeated rows get equal results.  An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import zlib

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spreadlab.llm._session import shipped

# The kinds, their keywords and expressions.
KINDS = ("assign", "access", "hex", "github", "npm", "jwt")
BASE = KINDS[:3]
KEYWORDS = {
    "assign": ("password", "passwd", "secret", "token", "api_key", "apikey"),
    "access": ("akia",),
    "github": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"),
    "npm": ("npm_",),
    "jwt": ("eyj",),
}
EXPRESSIONS = {
    "assign": re.compile(rb"(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE),
    "access": re.compile(rb"AKIA[A-Z0-9]+"),
    "github": re.compile(rb"gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9])"),
    "npm": re.compile(rb"npm_[A-Za-z0-9]{36}(?![A-Za-z0-9])"),
    "jwt": re.compile(rb"eyJ[A-Za-z0-9_-]++\.eyJ[A-Za-z0-9_-]++\.[A-Za-z0-9_-]++"),
}
#: Where an expression fails, it fails at all further hits in the same run of these characters: what follows the run decides.
RUNS = {"jwt": re.compile(rb"[A-Za-z0-9_-]++")}
LEAST_VALUE, LEAST_ACCESS, LEAST_HEX = 12, 18, 16
BASE62 = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_HEX = re.compile(rb"[0-9a-f]+")
_SAMPLED = re.compile(rb"[0-9a-f]{4,}")


def checksum_holds(token: bytes) -> bool:
    """The last six characters are the CRC-32 of the 30 before them, in base 62."""
    value, want = token.partition(b"_")[2], 0
    for c in value[30:]:
        want = want * 62 + BASE62.index(c)
    return zlib.crc32(value[:30]) == want


def header_holds(token: bytes) -> bool:
    """The first part is a JSON object that names an algorithm; what cannot be read, or nests too deep to be, is none."""
    part = token.split(b".")[0]
    try:
        header = json.loads(base64.urlsafe_b64decode(part + b"=" * (-len(part) % 4)))
    except (ValueError, RecursionError):
        return False
    return isinstance(header, dict) and "alg" in header


HOLDS = {
    "assign": lambda m: len(m[1]) >= LEAST_VALUE,
    "access": lambda m: len(m[0]) >= LEAST_ACCESS,
    "github": lambda m: checksum_holds(m[0]),
    "npm": lambda m: checksum_holds(m[0]),
    "jwt": lambda m: header_holds(m[0]),
}


def automaton() -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for kind, words in KEYWORDS.items():
        for w in words:
            out.add_word(w, (kind, len(w) - 1))
    out.make_automaton()
    return out


def spans(text: bytes, keywords: ahocorasick.Automaton) -> list[tuple[int, int, int]]:
    """(start, kind's place in KINDS, end) in bytes, ascending."""
    found, after = [], dict.fromkeys(KINDS, 0)
    hits = sorted((end - back, kind) for end, (kind, back) in keywords.iter(text.lower().decode("latin-1")))
    for at, kind in hits:
        if at < after[kind]:
            continue
        if m := EXPRESSIONS[kind].match(text, at):
            after[kind] = m.end()
            if HOLDS[kind](m):
                found.append((at, KINDS.index(kind), m.end()))
        elif kind in RUNS and text[at : at + 3] == b"eyJ":
            after[kind] = RUNS[kind].match(text, at).end()
    end = 0
    for m in _SAMPLED.finditer(text[3::4]):
        for at in range(4 * m.start() + 3, 4 * m.end(), 4):
            if at < end:
                continue  # in a run that is measured
            while at > end and text[at - 1] in b"0123456789abcdef":
                at -= 1
            end = _HEX.match(text, at).end()
            if end - at >= LEAST_HEX:
                found.append((at, KINDS.index("hex"), end))
    found.sort()
    return found


def in_code_points(text: bytes, found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    if text.isascii() or not found:
        return found
    inner = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) == 0x80)])
    return [(a - int(inner[a]), k, b - int(inner[b])) for a, k, b in found]


def _each(text: pa.Array):
    keywords = automaton()
    for x in text:
        raw = x.as_buffer().to_pybytes() if x.is_valid else b""
        yield raw, spans(raw, keywords)


def report(batches):
    """One row of the scan's report for each row."""
    for batch in batches:
        ids, text = (batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "text"))
        out: list[list] = [[] for _ in range(len(KINDS) + 2)]
        for raw, found in _each(text):
            found = in_code_points(raw, found)
            names = [f"{KINDS[k]}:{a}:{b}" for a, k, b in found]
            for i in range(len(KINDS)):
                out[i].append(sum(k == i for _, k, _ in found))
            out[-2].append(hashlib.sha256(",".join(x for x, (_, k, _) in zip(names, found, strict=True) if k < len(BASE)).encode()).hexdigest())
            out[-1].append(",".join(names))
        yield pa.record_batch({"doc_id": ids} | {f"n_{k}": pa.array(v, pa.int64()) for k, v in zip(KINDS, out, strict=False)} | {"base_sha256": pa.array(out[-2], pa.string()), "spans": pa.array(out[-1], pa.string())})


def mask(batches, field: str, place: str):
    """The rows with each span of their texts replaced; overlapping spans are replaced as one."""
    for batch in batches:
        i = batch.schema.get_field_index(field)
        texts, out = batch.column(i), []
        for x, (raw, found) in zip(texts, _each(texts), strict=True):
            if found:
                parts, end = [], 0
                for a, _, b in found:
                    if a >= end:
                        parts += [raw[end:a], place.encode()]
                    end = max(end, b)
                out.append(b"".join([*parts, raw[end:]]).decode())
            else:
                out.append(x.as_py())
        yield batch.set_column(i, batch.schema.field(i), pa.array(out, texts.type))


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_github, n_npm, n_jwt) of each row."""
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    out = rows.mapInArrow(shipped(report), f"doc_id {kind}, {', '.join(f'n_{k} long' for k in KINDS)}, base_sha256 string, spans string")
    return out.select("doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans", *(f"n_{k}" for k in KINDS[len(BASE) :]))


def mask_secrets(docs: DataFrame, text_col: str = "text", place: str = "[SECRET]") -> DataFrame:
    """All rows and columns of docs; secrets in the text are replaced, and n_chars (if there) counts anew."""
    out = docs.mapInArrow(shipped(mask, field=text_col, place=place), docs.schema)
    return out.withColumn("n_chars", F.length(text_col).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
