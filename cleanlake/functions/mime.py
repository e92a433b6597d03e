"""Content types by leading bytes, for stored files and for text columns."""

from __future__ import annotations

from collections.abc import Callable
from io import BytesIO

from pyspark.sql import Column
from pyspark.sql import functions as F

# Leading bytes (offset, bytes) and the type they announce.
SIGNATURES: tuple[tuple[int, bytes, str], ...] = (
    (0, b"%PDF-", "application/pdf"),
    (0, b"\x89PNG\r\n\x1a\n", "image/png"),
    (0, b"\xff\xd8\xff", "image/jpeg"),
    (0, b"GIF8", "image/gif"),
    (0, b"\x1f\x8b", "application/gzip"),
    (0, b"7z\xbc\xaf\x27\x1c", "application/x-7z-compressed"),
    (0, b"Rar!\x1a\x07", "application/x-rar"),
    (0, b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1", "application/x-ole-storage"),
    (0, b"ID3", "audio/mpeg"),
    (0, b"OggS", "application/ogg"),
    (4, b"ftyp", "video/mp4"),
    (0, b"II*\x00", "image/tiff"),
    (0, b"MM\x00*", "image/tiff"),
    (0, b"{\\rtf", "text/rtf"),
    (0, b"%!PS", "application/postscript"),
    (257, b"ustar", "application/x-tar"),
)
# What the second mark of a RIFF file, at offset 8, announces.
RIFF = {b"WAVE": "audio/x-wav", b"WEBP": "image/webp", b"AVI ": "video/x-msvideo"}
# Folders of packed office documents and the type that each announces.
_OOXML = "application/vnd.openxmlformats-officedocument."
OFFICE = {
    b"word/": _OOXML + "wordprocessingml.document",
    b"xl/": _OOXML + "spreadsheetml.sheet",
    b"ppt/": _OOXML + "presentationml.presentation",
}
_ENTRY = b"PK\x03\x04"
_TYPE_ENTRY = b"mimetype"

EMPTY = "application/x-empty"
BINARY = "application/octet-stream"
CHUNK = 1 << 20

_HTML = (b"<!doctype html", b"<html", b"<head", b"<title", b"<body")
_TEXT_CONTROLS = {7, 8, 9, 10, 12, 13, 27}
_CONTROLS = bytes(b for b in range(32) if b not in _TEXT_CONTROLS)
_BLANKS = b" \t\n\r\x0b\x0c"
# Enough for all signatures.
_START = 512
# Enough for the longest opening that tells a kind of text.
_OPENING = max(map(len, _HTML))


def _zip_type(head: bytes) -> str:
    """The type of a zip archive. E-books and open documents name theirs in their first entry, which is not
    packed; office documents are told by a folder that one of the first entries lies in."""
    names, at = [], 0
    while head.startswith(_ENTRY, at) and len(head) >= at + 30:
        size, name, extra = (
            int.from_bytes(head[at + a : at + b], "little") for a, b in ((18, 22), (26, 28), (28, 30))
        )
        names.append(head[at + 30 : at + 30 + name])
        begin = at + 30 + name + extra
        if names == [_TYPE_ENTRY] and 0 < size < 100 and len(head) >= begin + size:
            return head[begin : begin + size].decode("ascii", "replace").strip()
        # Where the size comes behind the data the next entry is looked for.
        at = begin + size if size else head.find(_ENTRY, begin)
        if at < 0:
            break
    for entry in names:
        for folder, mime in OFFICE.items():
            if entry.startswith(folder):
                return mime
    return "application/zip"


def sniff_stream(read: Callable[[int], bytes]) -> str:
    """Content type of what ``read(n)`` returns piece by piece, empty at the end.

    Signatures are looked for at the start; a control byte makes it binary wherever it is.
    """
    chunk = read(CHUNK)
    if not chunk:
        return EMPTY
    head = chunk
    while len(head) < _START and (more := read(_START)):
        head += more
    if head.startswith(_ENTRY):
        return _zip_type(head)
    if head.startswith(b"RIFF") and head[8:12] in RIFF:
        return RIFF[head[8:12]]
    for offset, mark, mime in SIGNATURES:
        if head.startswith(mark, offset):
            return mime
    opening, chunk = b"", head
    while chunk:
        if chunk.translate(None, _CONTROLS) != chunk:
            return BINARY
        if len(opening) < _OPENING:
            opening = (opening + chunk[: CHUNK + _OPENING]).lstrip(_BLANKS)[:_OPENING]
        chunk = read(CHUNK)
    opening = opening.lower()
    if opening.startswith(b"<?xml"):
        return "text/xml"
    if any(opening.startswith(tag) for tag in _HTML):
        return "text/html"
    return "text/plain"


def sniff_bytes(content: bytes) -> str:
    return sniff_stream(BytesIO(content).read)


def sniff_text(col: str) -> Column:
    """Content type of a string column, the same as of a file with that content."""
    text = F.col(col)
    data = text.cast("binary")
    lead = F.lower(F.ltrim(F.regexp_replace(text, r"^\s+", "")))
    html = F.lit(False)
    for tag in _HTML:
        html = html | lead.startswith(tag.decode())
    mime = F.when(text.isNull() | (text == ""), EMPTY)
    for offset, mark, kind in SIGNATURES:
        start = F.substring(data, offset + 1, len(mark))
        mime = mime.when(start == F.lit(bytearray(mark)), kind)
    return (
        mime.when(text.rlike(r"[\x00-\x06\x0B\x0E-\x1A\x1C-\x1F]"), BINARY)
        .when(lead.startswith("<?xml"), "text/xml")
        .when(html, "text/html")
        .otherwise("text/plain")
    )
