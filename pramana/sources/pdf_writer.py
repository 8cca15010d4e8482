"""PDF files made from page texts, for exports and for trying the reader: plain, packed, mapped, nested or protected."""

from __future__ import annotations

import hashlib
import zlib

from .pdf_syntax import PAD, object_key, rc4

#: What a file may have besides plain objects.
PLAIN, PACKED, MAPPED, NESTED, PROTECTED = "plain", "packed", "mapped", "nested", "protected"


def _escaped(text: str) -> bytes:
    return text.encode("cp1252", "replace").replace(b"\\", rb"\\").replace(b"(", rb"\(").replace(b")", rb"\)").replace(b"\r", rb"\r")


def _keys(password: str, file_id: bytes) -> tuple[bytes, bytes, bytes]:
    """(key, O, U) of revision 3 with 128 bits, owner password as the user's."""
    word = (password.encode("latin-1", "replace") + PAD)[:32]
    owner = hashlib.md5(word).digest()
    for _ in range(50):
        owner = hashlib.md5(owner).digest()
    o = word
    for i in range(20):
        o = rc4(bytes(k ^ i for k in owner), o)
    key = hashlib.md5(word + o + b"\xfc\xff\xff\xff" + file_id).digest()
    for _ in range(50):
        key = hashlib.md5(key).digest()
    u = hashlib.md5(PAD + file_id).digest()
    for i in range(20):
        u = rc4(bytes(k ^ i for k in key), u)
    return key, o, u + bytes(16)


def pdf_of(pages: list[str], style: str = PLAIN, password: str = "") -> bytes:
    """A file with a page for each text; characters outside of Windows-1252 need the style MAPPED."""
    bodies: dict[int, bytes] = {}
    streams: dict[int, tuple[bytes, bytes]] = {}
    font, characters, code = 3, 4, {}
    if style == MAPPED:
        for c in sorted({c for p in pages for c in p if c != "\n"}):
            code[c] = len(code) + 1
        pairs = [b"<%04x> <%s>" % (n, c.encode("utf-16-be").hex().encode()) for c, n in code.items()]
        groups = [pairs[i : i + 100] for i in range(0, len(pairs), 100)]
        streams[characters] = (b"", b"begincmap 1 begincodespacerange <0000> <ffff> endcodespacerange\n" + b"\n".join(b"%d beginbfchar\n%s\nendbfchar" % (len(g), b"\n".join(g)) for g in groups) + b"\nendcmap")
        bodies[font] = b"<< /Type /Font /Subtype /Type0 /BaseFont /F /Encoding /Identity-H /ToUnicode %d 0 R >>" % characters
    else:
        bodies[font] = b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>"
    kids, number = [], 10
    for text in pages:
        shown = []
        for line in text.split("\n"):
            shown.append(b"<%s> Tj T*" % b"".join(b"%04x" % code[c] for c in line) if style == MAPPED else b"(%s) Tj T*" % _escaped(line))
        streams[number + 1] = (b"", b"BT /F1 12 Tf 14 TL 50 800 Td\n" + b"\n".join(shown) + b"\nET")
        bodies[number] = b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>" % (number + 1)
        kids.append(number)
        number += 2
    resources = b"/Resources << /Font << /F1 3 0 R >> >>"
    if style == NESTED:  # groups of two pages, and a group that leads back to the root
        inner = []
        for i in range(0, len(kids), 2):
            bodies[number] = b"<< /Type /Pages /Parent 2 0 R /Count 2 /Kids [%s] >>" % b" ".join(b"%d 0 R" % k for k in [*kids[i : i + 2], 2])
            inner.append(number)
            number += 1
        kids = inner
    bodies[1] = b"<< /Type /Catalog /Pages 2 0 R >>"
    bodies[2] = b"<< /Type /Pages /Count %d /Kids [%s] %s >>" % (len(pages), b" ".join(b"%d 0 R" % k for k in kids), resources)
    file_id, key, extra = hashlib.md5("".join(pages).encode("utf-8", "replace")).digest(), None, b""
    if style == PROTECTED:
        key, o, u = _keys(password, file_id)
        bodies[5] = b"<< /Filter /Standard /V 2 /R 3 /Length 128 /P -4 /O <%s> /U <%s> >>" % (o.hex().encode(), u.hex().encode())
        extra = b"/Encrypt 5 0 R "
    if style == PACKED:  # all but streams in one object stream
        inside = sorted(bodies)
        heads, data = [], b""
        for n in inside:
            heads.append(b"%d %d" % (n, len(data)))
            data += bodies[n] + b"\n"
        head = b" ".join(heads) + b"\n"
        streams[number] = (b"/Type /ObjStm /N %d /First %d " % (len(inside), len(head)), head + data)
        bodies = {}
    out = b"%PDF-1.7\n"
    places = {}
    for n in sorted({*bodies, *streams}):
        places[n] = len(out)
        if n in bodies:
            out += b"%d 0 obj\n%s\nendobj\n" % (n, bodies[n])
            continue
        more, data = streams[n]
        if style != PLAIN:
            data, more = zlib.compress(data), more + b"/Filter /FlateDecode "
        if key:
            data = rc4(object_key(key, n, 0), data)
        out += b"%d 0 obj\n<< %s/Length %d >>\nstream\n%s\nendstream\nendobj\n" % (n, more, len(data), data)
    at = len(out)
    table = b"".join(b"%d 1\n%010d 00000 n \n" % (n, p) for n, p in places.items())
    return out + b"xref\n" + table + b"trailer\n<< /Root 1 0 R %s/ID [<%s> <%s>] /Size %d >>\nstartxref\n%d\n%%%%EOF\n" % (extra, file_id.hex().encode(), file_id.hex().encode(), number + 1, at)
