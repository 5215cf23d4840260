"""Secret scan: patterns, and encoded candidates that are confirmed by their structure before they are reported.

The base patterns find assignments of passwords and tokens, access keys and long hex strings. On top, runs of base64 or
hex and PEM blocks are decoded, and reported only if what comes out parses to its end: a signed token whose header and
payload are JSON objects and whose header names an algorithm (``jwt``), a private key in a PEM block (``pem``), a
private key in nested DER lengths (``der``: PKCS#1, PKCS#8, SEC1 or an encrypted PKCS#8) or in the length-prefixed
strings of an OpenSSH key file (``ssh``). Public keys, images, checksums and other base64 are left alone.

Keys are also found behind other characters of the alphabet (a path), wrapped over lines of one width without marks around
them, and with line ends written as backslash and n. Where a key may begin inside a run, its own lengths say
where it would end, and only if that is the end of the run is it decoded; the body of a PEM block ends at the next
mark. So the scan is linear in the text, whatever its length. All positions are code points, ends exclusive; an
assignment's span is its whole match. Defined results: null and empty texts have no spans; rows that are repeated get equal
results; a candidate that does not decode or parse is not reported, and other columns are never read.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

BASE = ["assign", "access", "hex"]
KINDS = [*BASE, "jwt", "pem", "der", "ssh"]

_ASSIGN = re.compile(r"""(?ia)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
_LONG_HEX = re.compile(r"[0-9a-f]{24}")
_JWT = re.compile(r"(?<![A-Za-z0-9_-])(e[wy][A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+)\.([A-Za-z0-9_-]*)")
_BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{40,}+(?:(?:\r?\n|\\r\\n|\\n)[A-Za-z0-9+/_-]++)*+={0,2}")
_LINE_END = re.compile(r"\r?\n|\\r\\n|\\n")
#: How a DER sequence begins in base64 (its length follows), and an OpenSSH key file.
_KEY_START = re.compile(r"M[A-I]|b3BlbnNzaC1rZXktdjEA")
_HEX_KEY = re.compile(r"(?<![0-9A-Za-z])30(?:[0-9a-f]{2}){30,}(?![0-9A-Za-z])|(?<![0-9A-Za-z])30(?:[0-9A-F]{2}){30,}(?![0-9A-Za-z])")
_HEX_SSH = re.compile(r"(?i)(?<![0-9a-z])6f70656e7373682d6b65792d763100(?:[0-9a-f]{2})+(?![0-9a-z])")
_PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]{0,40})PRIVATE KEY-----")
_SSH = b"openssh-key-v1\0"
#: DER nests no deeper than this in any key.
DEPTH = 16


def unbase64(text: str) -> bytes | None:
    """Bytes of base64 in either alphabet, with or without padding; None if it is none."""
    text = text.rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der(data: bytes, depth: int = 0) -> list[tuple[int, object]] | None:
    """Tags and contents of DER values that fill ``data`` exactly; constructed ones are lists. None if lengths don't fit."""
    out: list[tuple[int, object]] = []
    at = 0
    while at < len(data):
        if at + 2 > len(data) or depth > DEPTH:
            return None
        tag, size = data[at], data[at + 1]
        at += 2
        if size & 0x80:
            n = size & 0x7F
            if not 1 <= n <= 4 or at + n > len(data):
                return None
            size = int.from_bytes(data[at : at + n], "big")
            at += n
        if at + size > len(data):
            return None
        inner: object = data[at : at + size]
        if tag & 0x20:
            inner = der(inner, depth + 1)
            if inner is None:
                return None
        out.append((tag, inner))
        at += size
    return out


def is_private_der(data: bytes | None) -> bool:
    """Whether bytes are one DER sequence laid out as a private key."""
    if not data or data[0] != 0x30:
        return False
    tree = der(data)
    if tree is None or len(tree) != 1:
        return False
    parts = tree[0][1]
    tags = [t for t, _ in parts]
    if tags[:1] == [0x02] and len(parts) >= 2:
        version = parts[0][1]
        if len(tags) >= 9 and set(tags[:9]) == {0x02} and len(parts[1][1]) >= 32:  # PKCS#1: nine integers
            return True
        if tags[1] == 0x04 and version == b"\1" and len(parts[1][1]) >= 16:  # SEC1: the scalar
            return True
        if len(tags) >= 3 and tags[1] == 0x30 and tags[2] == 0x04:  # PKCS#8: algorithm and key
            return bool(parts[1][1]) and parts[1][1][0][0] == 0x06 and len(parts[2][1]) >= 16
    # encrypted PKCS#8: algorithm with parameters, then the cipher text
    return tags == [0x30, 0x04] and len(parts[0][1]) == 2 and parts[0][1][0][0] == 0x06 and parts[0][1][1][0] == 0x30 and len(parts[1][1]) >= 32


def ssh_key_size(read, size: int) -> int | None:
    """Bytes of an OpenSSH private key: magic, three strings, key count, public key, private part. ``read(at, n)`` gives
    bytes, of which there are ``size``; only the lengths are read. None if there is no such key."""
    if read(0, len(_SSH)) != _SSH:
        return None
    at, n = len(_SSH), 0
    for field in range(6):
        if at + 4 > size:
            return None
        n = int.from_bytes(read(at, 4), "big")
        at += 4
        if field == 3:
            if not 1 <= n <= 16:
                return None
            continue
        if at + n > size:
            return None
        at += n
    return at if n >= 32 else None


def is_ssh_key(data: bytes | None) -> bool:
    """Whether bytes are an OpenSSH private key, to the end."""
    return bool(data) and ssh_key_size(lambda at, n: data[at : at + n], len(data)) == len(data)


def der_size(head: bytes) -> int | None:
    """Bytes of the DER value that begins with ``head``."""
    if len(head) < 6:
        return None
    n = head[1] & 0x7F
    if not head[1] & 0x80:
        return 2 + n
    return 2 + n + int.from_bytes(head[2 : 2 + n], "big") if 1 <= n <= 4 else None


def is_signed_token(header: str, payload: str) -> bool:
    def read(part: str) -> dict | None:
        try:
            value = json.loads((unbase64(part) or b"").decode("utf-8"))
        except (ValueError, RecursionError):
            return None
        return value if isinstance(value, dict) else None

    head = read(header)
    return head is not None and isinstance(head.get("alg"), str) and read(payload) is not None


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Matches of the base patterns: start, end, kind."""
    out = [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if _LONG_HEX.search(text):
        out += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text) if m.end() - m.start() >= 24]
    return out


def _pem_spans(text: str) -> list[tuple[int, int, str]]:
    out = []
    marks = list(_PEM.finditer(text))
    for m, after in zip(marks, [*(x.start() for x in marks[1:]), len(text)], strict=True):
        stop = f"-----END {m[1]}PRIVATE KEY-----"
        end = text.find(stop, m.end(), after)
        if end < 0:
            continue
        lines = _LINE_END.split(text[m.end() : end])
        data = unbase64("".join("".join(x for x in lines if ":" not in x).split()))
        sealed = any(x.startswith("DEK-Info:") for x in lines) and bool(data) and len(data) >= 64 and len(data) % 8 == 0
        if sealed or is_private_der(data) or is_ssh_key(data):
            out.append((m.start(), end + len(stop), "pem"))
    return out


def _lines(run: str, at: int) -> list[tuple[int, str]]:
    """The lines of a run as (place, characters): of one width, but for the last, which may be shorter."""
    out, begin = [], at
    for m in [*_LINE_END.finditer(run), None]:
        end = at + (m.start() if m else len(run))
        line = run[begin - at : end - at]
        if out and (len(out[-1][1]) != len(out[0][1]) or len(line.rstrip("=")) > len(out[0][1])):
            break
        out.append((begin, line))
        begin = at + m.end() if m else end
    return out


def _key_in(text: str, places: list[tuple[int, str]]) -> tuple[int, int, str] | None:
    """The first key that begins in the first line and ends with the last one: start, end, kind."""
    body = text.rstrip("=")
    end = places[-1][0] + len(places[-1][1])
    for m in _KEY_START.finditer(places[0][1]):
        at = m.start()
        left = len(body) - at
        size = left * 3 // 4

        def read(first: int, n: int, at: int = at) -> bytes:
            group = first // 3 * 4
            return (unbase64(body[at + group : at + (first + n + 2) // 3 * 4]) or b"")[first % 3 : first % 3 + n]

        kind = "der" if m[0][0] == "M" else "ssh"
        whole = der_size(read(0, 6)) if kind == "der" else ssh_key_size(read, size)
        if whole != size or -(-whole * 4 // 3) != left:
            continue
        data = unbase64(body[at:])
        if is_private_der(data) if kind == "der" else is_ssh_key(data):
            return places[0][0] + at, end, kind
    return None


def _encoded_spans(text: str) -> list[tuple[int, int, str]]:
    """Keys in runs of base64: over several lines of one width, or in a line of its own."""
    out = []
    for m in _BASE64.finditer(text):
        run, at = m[0], m.start()
        if run[0] in "nr" and text[at - 1 : at] == "\\":  # the end of a line end written out
            run, at = run[1:], at + 1
        places = _lines(run, at)
        found = _key_in("".join(x for _, x in places), places)
        if found is None and len(places) > 1:  # a shorter line may already be something else
            found = _key_in("".join(x for _, x in places[:-1]), places[:-1])
        if found is None:
            found = next((f for p in _all_lines(run, at) if len(p[1]) >= 40 and (f := _key_in(p[1], [p]))), None)
        if found:
            out.append(found)
    return out


def _all_lines(run: str, at: int) -> list[tuple[int, str]]:
    out, begin = [], 0
    for m in [*_LINE_END.finditer(run), None]:
        out.append((at + begin, run[begin : m.start() if m else len(run)]))
        begin = m.end() if m else len(run)
    return out


def confirmed_spans(text: str) -> list[tuple[int, int, str]]:
    """Decoded candidates whose structure holds."""
    out = [(m.start(), m.end(), "jwt") for m in _JWT.finditer(text) if is_signed_token(m[1], m[2])]
    pem = _pem_spans(text) if "PRIVATE KEY-----" in text else []
    inside = iter(sorted(pem))
    now = next(inside, None)
    for span in _encoded_spans(text):  # a key in a PEM block is reported once
        while now is not None and now[1] < span[1]:
            now = next(inside, None)
        if now is None or not now[0] <= span[0]:
            out.append(span)
    out += pem
    out += [(m.start(), m.end(), "der") for m in _HEX_KEY.finditer(text) if is_private_der(bytes.fromhex(m[0]))]
    return out + [(m.start(), m.end(), "ssh") for m in _HEX_SSH.finditer(text) if is_ssh_key(bytes.fromhex(m[0]))]


def written(spans: list[tuple[int, int, str]]) -> str:
    """kind:start:end by start, then kind as listed, then end."""
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1])))


def scan_udf():
    """Arrow UDF: text to counts and digest of the base spans, and all spans."""

    @F.arrow_udf("struct<n_assign: bigint, n_access: bigint, n_hex: bigint, base_sha256: string, spans: string>")
    def scan(texts: pa.Array) -> pa.Array:
        rows = []
        for t in texts:
            text = t.as_py() or ""
            base = base_spans(text)
            kinds = [k for _, _, k in base]
            rows.append([*(kinds.count(k) for k in BASE), hashlib.sha256(written(base).encode()).hexdigest(), written(base + confirmed_spans(text))])
        columns = list(zip(*rows, strict=True)) or [()] * 5
        types = [pa.int64()] * 3 + [pa.string()] * 2
        return pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return scan


def scan_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_assign, n_access, n_hex, base_sha256, spans."""
    made = df.select(F.col(id_col), scan_udf()(F.col(text_col)).alias("s"))
    return made.select(id_col, "s.n_assign", "s.n_access", "s.n_hex", "s.base_sha256", "s.spans")
