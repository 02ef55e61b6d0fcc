"""Secrets in texts: what looks like one, and what proves by its structure to be one.

Three kinds are found by their looks and always reported: ``assign`` (a name such as password, a sign, a value
of 8 characters or more), ``access`` (AKIA and 16 characters or more in all) and ``hex`` (32 digits or more).

Further kinds are reported only when a candidate, a run of base64 or hex or an armoured block, decodes
and its bytes parse from end to end as what they claim to be:

* ``token``: a signed token, whose first part is a JSON object with ``alg`` and whose second part is a
  JSON object, with a signature as long as that algorithm makes it;
* ``key``: a private key in DER (PKCS#1, SEC 1, PKCS#8, encrypted PKCS#8), where every nested length must end
  where its container does;
* ``sshkey``: the ``openssh-key-v1`` container, whose length-prefixed fields must fill it;
* ``nested``: base64 or hex of a text that holds one of these.

A key's own length says where it ends, so bytes behind it in the same run are not part of the span; line breaks
(also spelled ``\\n``) within base64 are. Public keys, certificates and unsigned tokens aren't secrets.

Batches are first sifted with linear-time regular expressions over the whole column; only texts that may
hold something are searched in Python. Work and memory follow the longest text.

Defined results: null and empty texts have no spans; every row keeps its row, repeated or without id.
Positions are code points, ends exclusive. Matches of a kind are leftmost and don't overlap; different kinds may.
Spans are ordered by start, then by kind in the order of ``KINDS``, then by end.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "token", "key", "sshkey", "nested")
SPANS = "array<struct<kind:string,start:long,end:long,detail:string>>"

ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.ASCII | re.IGNORECASE,
)
LEAST_VALUE = 8
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")

#: Fewest characters of an encoded key: the shortest private key has 48 bytes.
LEAST_RUN = 48
_LINE = r"(?:\r?\n|\\r\\n|\\n)"
TOKEN = re.compile(r"(?<![A-Za-z0-9_-])([A-Za-z0-9_-]{10,})\.([A-Za-z0-9_-]{2,})\.([A-Za-z0-9_-]{16,})")
#: One alphabet a run; only the plain one is broken in lines.
RUN = re.compile(
    rf"(?<![A-Za-z0-9+/_-])(?:[A-Za-z0-9+/]{{{LEAST_RUN},}}+(?![_-])(?:{_LINE}[A-Za-z0-9+/]++(?![_-]))*"
    rf"|[A-Za-z0-9_-]{{{LEAST_RUN},}}+(?![+/]))={{0,2}}"
)
_FIRST_LINE = re.compile(r"[A-Za-z0-9+/_-]+={0,2}")
HEX_RUN = re.compile(r"(?<![A-Za-z0-9])(?:[0-9a-f]{64,}+|[0-9A-F]{64,}+)(?![0-9A-Fa-f])")
ARMOUR = re.compile(
    rf"-----BEGIN (?P<label>(?:[A-Z0-9]+ )*PRIVATE KEY)-----{_LINE}?(?P<body>(?:[A-Za-z0-9+/=]|[\r\n\x20]|\\[rn])*)"
    r"-----END (?P=label)-----"
)
#: A text can only hold a span if one of these is found in it; the first three are for the base kinds.
SIFT = (
    r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]",
    "AKIA",
    r"[0-9a-f]{32}",
    rf"[A-Za-z0-9+/_-]{{{LEAST_RUN}}}|[A-Za-z0-9_-]{{10}}\.[A-Za-z0-9_-]{{2,}}\.[A-Za-z0-9_-]{{16}}|[0-9A-F]{{64}}|PRIVATE KEY-----",
)
#: Bytes of a signature for the algorithms that fix it; RSA's follow the key, of 1,024 bits at least.
SIGNATURE = {
    "HS256": 32, "HS384": 48, "HS512": 64,
    "ES256": 64, "ES256K": 64, "ES384": 96, "ES512": 132, "EdDSA": 64,
}
RSA_SIGNED = {"RS256", "RS384", "RS512", "PS256", "PS384", "PS512"}
#: How deep texts within texts are decoded.
DEPTH = 2

SEQUENCE, INTEGER, OCTETS, OBJECT = 0x30, 0x02, 0x04, 0x06


class Malformed(ValueError):
    """Bytes that are not what they claim to be."""


def _element(raw: bytes, at: int, end: int) -> tuple[int, int, int]:
    """Tag, start and end of the content of the DER element at ``at``."""
    if at + 2 > end:
        raise Malformed("cut short")
    tag, size, at = raw[at], raw[at + 1], at + 2
    if size & 0x80:
        width = size & 0x7F
        if not 1 <= width <= 4 or at + width > end:
            raise Malformed("length of a length")
        size = int.from_bytes(raw[at : at + width], "big")
        if size < 0x80 or size >> (8 * (width - 1)) == 0:
            raise Malformed("a length that is longer than needed")
        at += width
    if at + size > end:
        raise Malformed("longer than its container")
    return tag, at, at + size


def _inside(raw: bytes, at: int, end: int) -> list[tuple[int, int, int]]:
    """The elements that fill ``at`` to ``end`` exactly."""
    found = []
    while at < end:
        found.append(_element(raw, at, end))
        at = found[-1][2]
    return found


def _private_key(raw: bytes) -> tuple[str, int]:
    """Which private key ``raw`` begins with, and where it ends."""
    tag, at, end = _element(raw, 0, len(raw))
    if tag != SEQUENCE:
        raise Malformed("no sequence")
    parts = _inside(raw, at, end)
    tags = [t for t, _, _ in parts]
    version = raw[parts[0][1] : parts[0][2]] if parts else b""
    if tags[:9] == [INTEGER] * 9 and version in (b"\0", b"\1"):
        return _rsa(raw, parts), end
    if tags[:2] == [INTEGER, OCTETS] and version == b"\1" and 16 <= parts[1][2] - parts[1][1] <= 72:
        if not all(t in (0xA0, 0xA1) for t in tags[2:]):
            raise Malformed("no such field")
        for _, a, b in parts[2:]:
            _inside(raw, a, b)
        return "ec", end
    if tags[:3] == [INTEGER, SEQUENCE, OCTETS] and version in (b"\0", b"\1"):
        _algorithm(raw, parts[1])
        if not all(t in (0xA0, 0xA1, 0x81) for t in tags[3:]):
            raise Malformed("no such field")
        if parts[2][1] == parts[2][2]:
            raise Malformed("no key in it")
        _inside(raw, parts[2][1], parts[2][2])
        return "pkcs8", end
    if tags == [SEQUENCE, OCTETS] and parts[1][2] - parts[1][1] >= 16:
        inner = _algorithm(raw, parts[0])
        if SEQUENCE not in inner[1:]:
            raise Malformed("a digest, not an encrypted key")
        return "encrypted", end
    raise Malformed("no private key")


def _rsa(raw: bytes, parts: list) -> str:
    modulus = int.from_bytes(raw[parts[1][1] : parts[1][2]], "big")
    p, q = (int.from_bytes(raw[a:b], "big") for _, a, b in parts[4:6])
    if modulus.bit_length() < 512 or (raw[parts[0][1] : parts[0][2]] == b"\0" and p * q != modulus):
        raise Malformed("primes that don't make the modulus")
    return "rsa"


def _algorithm(raw: bytes, part: tuple[int, int, int]) -> list[int]:
    """Tags of an algorithm's fields, the first of which names it."""
    fields = _inside(raw, part[1], part[2])
    if not fields or fields[0][0] != OBJECT or fields[0][1] == fields[0][2] or raw[fields[0][2] - 1] & 0x80:
        raise Malformed("no algorithm")
    for tag, a, b in fields[1:]:
        if tag == SEQUENCE:
            _inside(raw, a, b)
    return [t for t, _, _ in fields]


MAGIC = b"openssh-key-v1\0"


def _ssh_key(raw: bytes) -> tuple[str, int]:
    """The kind of an ``openssh-key-v1`` container and where it ends."""
    if not raw.startswith(MAGIC):
        raise Malformed("another container")
    at = len(MAGIC)

    def field() -> bytes:
        nonlocal at
        size = int.from_bytes(raw[at : at + 4], "big")
        if at + 4 + size > len(raw):
            raise Malformed("longer than its container")
        at += 4 + size
        return raw[at - size : at]

    cipher, kdf, options = field(), field(), field()
    if not cipher or (cipher == b"none") != (kdf == b"none") or (kdf == b"none" and options):
        raise Malformed("cipher and derivation disagree")
    keys = int.from_bytes(raw[at : at + 4], "big")
    at += 4
    if not 1 <= keys <= 16:
        raise Malformed("no keys")
    kind = b""
    for _ in range(keys):
        public = field()
        size = int.from_bytes(public[:4], "big")
        kind = public[4 : 4 + size]
        if not size or 4 + size > len(public):
            raise Malformed("no kind of key")
    private = field()
    if len(private) % 8 or len(private) < 8:
        raise Malformed("private part not in whole blocks")
    if cipher == b"none" and private[:4] != private[4:8]:
        raise Malformed("check numbers differ")
    return kind.decode("ascii", "replace"), at


def _decoded(text: str) -> bytes:
    """Bytes of base64 of either alphabet, as many as whole groups give."""
    plain = text.rstrip("=").replace("-", "+").replace("_", "/")
    if len(plain) % 4 == 1:
        plain = plain[:-1]
    return base64.b64decode(plain + "=" * (-len(plain) % 4))


def _token(match: re.Match) -> str | None:
    """The algorithm of a signed token, or None."""
    head, body, signature = match.groups()
    try:
        header, claims = json.loads(_decoded(head)), json.loads(_decoded(body))
    except (ValueError, RecursionError):
        return None
    if not isinstance(header, dict) or not isinstance(claims, dict):
        return None
    name, size = header.get("alg"), len(signature) * 3 // 4
    if not isinstance(name, str):
        return None
    if name in SIGNATURE:
        return name if size == SIGNATURE[name] else None
    return name if name in RSA_SIGNED and size >= 128 else None


_BREAK = re.compile(r"\\[rn]|[\r\n\x20]+")


def _bare(text: str) -> str:
    """``text`` without line breaks, spelled or not, and blanks."""
    return _BREAK.sub("", text)


def _behind(text: str, count: int) -> int:
    """Where ``count`` characters of ``_bare(text)`` end in ``text``."""
    at = 0
    for m in _BREAK.finditer(text):
        if count <= m.start() - at:
            break
        count -= m.start() - at
        at = m.end()
    return at + count


def _structure(raw: bytes, depth: int) -> tuple[str, str, int] | None:
    """Kind, detail and length in bytes of what ``raw`` begins with."""
    for kind, parse in (("key", _private_key), ("sshkey", _ssh_key)):
        try:
            return kind, *parse(raw)
        except Malformed:
            pass
    if depth:
        try:
            text = raw.decode("utf-8")
        except UnicodeDecodeError:
            return None
        inner = _confirmed(text, depth - 1)
        if inner:
            return "nested", inner[0][0], len(raw)
    return None


def _confirmed(text: str, depth: int) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, detail) of all candidates that prove to be secrets."""
    found = []
    blocks = []  # Armoured blocks are not searched again as runs.
    for m in ARMOUR.finditer(text):
        try:
            proof = _structure(_decoded(_bare(m["body"])), 0)
        except (binascii.Error, ValueError):
            proof = None
        if proof:
            found.append((proof[0], m.start(), m.end(), proof[1]))
            blocks.append(m.span())
    for m in TOKEN.finditer(text):
        name = _token(m)
        if name:
            found.append(("token", m.start(), m.end(), name))
    blocks.append((len(text) + 1, len(text) + 1))
    at = 0
    for m in RUN.finditer(text):
        while blocks[at][1] <= m.start():
            at += 1
        if m.start() >= blocks[at][0]:
            continue
        # The lines behind the first may be its continuation, or just the next words.
        proof = None
        for run in dict.fromkeys((m[0], _FIRST_LINE.match(m[0])[0])):
            bare = _bare(run)
            try:
                proof = _structure(_decoded(bare), depth)
            except (binascii.Error, ValueError):
                pass
            if proof:
                break
        if proof:
            kind, detail, size = proof
            last = min(len(bare), -(-size * 4 // 3))
            # Padding belongs to the span that it completes.
            last += len(bare[last : last + 2]) - len(bare[last : last + 2].lstrip("="))
            found.append((kind, m.start(), m.start() + _behind(run, last), detail))
    for m in HEX_RUN.finditer(text):
        proof = _structure(bytes.fromhex(m[0][: len(m[0]) // 2 * 2]), depth)
        if proof:
            kind, detail, size = proof
            found.append((kind, m.start(), m.start() + 2 * size, detail))
    return found


def find(text: str, kinds: tuple[bool, ...] = (True,) * 4) -> list[tuple[str, int, int, str]]:
    """All spans of a text; ``kinds`` says which of ``SIFT`` were seen in it."""
    found = []
    if kinds[0]:
        found += [("assign", *m.span(), m[1].lower()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
    if kinds[1]:
        found += [("access", *m.span(), "") for m in ACCESS.finditer(text)]
    if kinds[2]:
        found += [("hex", *m.span(), "") for m in HEX.finditer(text)]
    if kinds[2] or kinds[3]:
        found += _confirmed(text, DEPTH)
    order = {kind: n for n, kind in enumerate(KINDS)}
    return sorted(found, key=lambda x: (x[1], order[x[0]], x[2]))


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, spans) for each row of ``docs`` (doc_id, text)."""

    kind = pa.list_(
        pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("detail", pa.string())])
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            seen = [
                pc.fill_null(pc.match_substring_regex(texts, pattern), False).to_numpy(zero_copy_only=False)
                for pattern in SIFT
            ]
            spans: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            for n in (seen[0] | seen[1] | seen[2] | seen[3]).nonzero()[0]:
                hits = find(texts[int(n)].as_py(), tuple(bool(s[n]) for s in seen))
                spans[n] = [dict(zip(("kind", "start", "end", "detail"), hit, strict=True)) for hit in hits]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(spans, kind)], names=["doc_id", "spans"])

    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
    )
    return rows.mapInArrow(run, f"doc_id long, spans {SPANS}")
