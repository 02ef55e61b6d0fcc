import base64
import hashlib
import json
import random
import re

import pytest

from codewarden.llm import secrets
from codewarden.llm.queries import QUERIES

from .helpers import EDGES, docs


def der(tag, content):
    size = len(content)
    if size < 0x80:
        return bytes([tag, size]) + content
    width = (size.bit_length() + 7) // 8
    return bytes([tag, 0x80 | width]) + size.to_bytes(width, "big") + content


def number(n):
    return der(0x02, n.to_bytes(n.bit_length() // 8 + 1, "big"))


def oid(*tail):
    return der(0x06, bytes(tail))


# Not primes: only the structure is looked at.
P, Q = 2**512 + 75, 2**511 + 111
RSA = der(0x30, b"".join(number(x) for x in (0, P * Q, 65537, 2**1000 + 1, P, Q, 2**500, 2**501, 2**502)))
CURVE = oid(0x2A, 0x86, 0x48, 0xCE, 0x3D, 3, 1, 7)
EC = der(0x30, number(1) + der(0x04, bytes(range(100, 132))) + der(0xA0, CURVE) + der(0xA1, der(0x03, b"\0\4" + b"k" * 64)))
PKCS8 = der(0x30, number(0) + der(0x30, oid(0x2B, 0x65, 0x70)) + der(0x04, der(0x04, bytes(range(60, 92)))))
WRAPPED = der(0x30, number(0) + der(0x30, oid(0x2A, 0x86, 0x48, 0xCE, 0x3D, 2, 1) + CURVE) + der(0x04, EC))
ENCRYPTED = der(0x30, der(0x30, oid(0x2A, 0x86, 5, 13) + der(0x30, der(0x30, CURVE) + der(0x30, CURVE))) + der(0x04, b"s" * 64))
PUBLIC = der(0x30, der(0x30, CURVE + CURVE) + der(0x03, b"\0\4" + b"k" * 64))


def field(raw):
    return len(raw).to_bytes(4, "big") + raw


def ssh(check=b"abcdabcd", extra=b""):
    public = field(b"ssh-ed25519") + field(b"p" * 32)
    private = check + public + field(b"q" * 64) + field(b"me")
    private += bytes(range(1, 1 + -len(private) % 8))
    return b"openssh-key-v1\0" + field(b"none") + field(b"none") + field(b"") + (1).to_bytes(4, "big") + field(public) + field(private) + extra


def b64(raw, url=False):
    return (base64.urlsafe_b64encode if url else base64.b64encode)(raw).decode()


def token(alg="HS256", size=32, head=None, body=None):
    parts = [json.dumps(head or {"alg": alg, "typ": "JWT"}).encode(), json.dumps({"sub": "1"} if body is None else body).encode(), bytes(range(size))]
    return ".".join(b64(p, True).rstrip("=") for p in parts)


def armour(raw, label="PRIVATE KEY", line="\n"):
    body = b64(raw)
    return line.join([f"-----BEGIN {label}-----", *[body[i : i + 64] for i in range(0, len(body), 64)], f"-----END {label}-----"])


def proven(text):
    return [(k, text[a:b], d) for k, a, b, d in secrets.find(text) if k not in secrets.BASE_KINDS]


@pytest.mark.parametrize(
    "raw,kind,detail",
    [(RSA, "key", "rsa"), (EC, "key", "ec"), (PKCS8, "key", "pkcs8"), (WRAPPED, "key", "pkcs8"), (ENCRYPTED, "key", "encrypted"), (ssh(), "sshkey", "ssh-ed25519")],
)
def test_keys_in_every_spelling(raw, kind, detail):
    for spelled in (b64(raw), b64(raw, True), raw.hex(), raw.hex().upper()):
        assert proven(f"é the key: {spelled} and more") == [(kind, spelled, detail)]
    lines = b64(raw)
    lines = "\n".join(lines[i : i + 76] for i in range(0, len(lines), 76))
    assert proven(f"see\n{lines}\nHello world") == [(kind, lines, detail)]
    for line in ("\n", "\r\n", "\\n"):
        block = armour(raw, "OPENSSH PRIVATE KEY", line)
        assert proven(f"x {block} y") == [(kind, block, detail)]
    inner = b64(armour(raw).encode())
    assert proven(f"data: {inner}\nnext words") == [("nested", inner, kind)]


def test_a_key_ends_where_its_length_says():
    spelled = b64(PKCS8)
    assert len(PKCS8) == 48
    assert proven(spelled + "AAAA") == [("key", spelled, "pkcs8")]


@pytest.mark.parametrize(
    "raw",
    [
        PUBLIC,
        RSA[:-1],
        RSA[:100] + b"\x7f" + RSA[101:],
        der(0x30, der(0x30, CURVE + der(0x05, b"")) + der(0x04, b"d" * 32)),
        PKCS8.replace(b"\x04\x20", b"\x04\x1f"),
        der(0x30, number(1) + der(0x04, b"x" * 32) + number(5)),
        ssh(b"abcdabce"),
        ssh()[:-3],
        bytes(range(48)),
        b"0" * 64,
    ],
)
def test_what_does_not_parse_to_its_end_is_not_reported(raw):
    for spelled in (b64(raw), raw.hex(), armour(raw)):
        assert proven(f"the key: {spelled} and more") == []


def test_tokens_need_header_claims_and_signature():
    for alg, size in (("HS256", 32), ("ES384", 96), ("RS256", 256), ("EdDSA", 64)):
        assert proven(f"auth {token(alg, size)}, ok") == [("token", token(alg, size), alg)]
    for wrong in (
        token("none", 32), token("HS256", 31), token("RS256", 64), token(head=["alg"]), token(body=[1]), token(head={"typ": "JWT"}),
        "one-long-word.another.and-some-more-words-here", token(head={"alg": 7}), token().replace(".", ",", 1),
    ):
        assert proven(f"auth {wrong}, ok") == []
    inner = b64(f"bearer {token()}".encode())
    assert proven(inner) == [("nested", inner, "token")]


def base(text):
    """The contract's base spans, spelled as it spells them."""
    kinds = [
        ("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 8),
        ("access", "AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 16),
        ("hex", "[0-9a-f]+", lambda m: len(m[0]) >= 32),
    ]
    found = [(m.start(), n, m.end(), k) for n, (k, p, ok) in enumerate(kinds) for m in re.finditer(p, text or "") if ok(m)]
    return [(k, a, b) for a, _, b, k in sorted(found)]


def random_text(r):
    bits = ["password", "Token", "seCret", "api_key", "APIKEY", "paſſword", "toKen", "=", ":", " ", "  ", '"', "'", "AKIA", "AKIAAKIA", "A1B2C3D4E5F6", "0123456789abcdef", "deadbeef" * 4, "abc", "é", "日本", "\n", "token=secret:abcdefghijk", token(), b64(PKCS8), ".", "-"]
    return "".join(r.choice(bits) for _ in range(r.randrange(40)))


def test_base_spans_equal_brute_force(spark):
    r = random.Random(5)
    texts = [(i, random_text(r)) for i in range(400)]
    texts += [(1000, "x" * 300_000 + " token = abcdefgh " + "f" * 200_000), *EDGES]
    found = secrets.scan(docs(spark, texts, extra=True)).collect()
    got = sorted((str(d["doc_id"]), [(s["kind"], s["start"], s["end"]) for s in d["spans"] if s["kind"] in secrets.BASE_KINDS]) for d in found)
    assert got == sorted((str(i), base(t)) for i, t in texts)
    every = {(str(d["doc_id"]), s["kind"], s["start"], s["end"]) for d in found for s in d["spans"]}
    assert every == {(str(i), k, a, b) for i, t in texts for k, a, b, _ in secrets.find(t or "")}
    assert secrets.scan(docs(spark, [])).count() == 0


def test_query_digests(spark, tmp_path):
    texts = [(1, f"token: abcdefgh {token()}"), (2, None), (3, "AKIA" + "Z" * 16), (3, "f" * 32 + f" {b64(PKCS8)}")]
    docs(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    rows = QUERIES["op11_structural"](spark, str(tmp_path)).collect()
    got = sorted((d["doc_id"], d["n_assign"], d["n_access"], d["n_hex"], d["base_sha256"], d["confirmed"]) for d in rows)
    want = []
    for i, t in texts:
        spelled = ",".join(f"{k}:{a}:{b}" for k, a, b in base(t))
        counts = [sum(k == kind for k, _, _ in base(t)) for kind in secrets.BASE_KINDS]
        want.append((i, *counts, hashlib.sha256(spelled.encode()).hexdigest(), i == 1 or "f" * 32 in (t or "")))
    assert got == sorted(want)
    one = next(d["spans"] for d in rows if d["doc_id"] == 1)
    assert one == f"assign:0:15,token:16:{16 + len(token())}"
