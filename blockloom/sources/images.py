"""What image files say about themselves: format, size, texts they carry and EXIF, read without an imaging library.

Recognising text needs an external function: see operators.visual.image_blocks.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

#: key, text, where it stands (metadata or exif)
Said = tuple[str, str, str]

# fixed values: EXIF tags that hold texts, the tag of the orientation, and how many tags and sources are shown
EXIF = {0x010E: "ImageDescription", 0x010F: "Make", 0x0110: "Model", 0x0131: "Software", 0x0132: "DateTime", 0x013B: "Artist", 0x8298: "Copyright", 0x9003: "DateTimeOriginal", 0x9C9B: "XPTitle", 0x9C9C: "XPComment"}
ORIENTATION, MOST_TAGS, MOST_SOURCES, PREVIEW = 0x0112, 40, 10, 400


def exif(data: bytes) -> tuple[dict[str, str], int]:
    """Texts of the first directory of a TIFF block by tag name, and the orientation (1: upright)."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8:
        return {}, 1
    at = struct.unpack_from(order + "I", data, 4)[0]
    found, turned = {}, 1
    if at + 2 > len(data):
        return found, turned
    for k in range(min(MOST_TAGS, struct.unpack_from(order + "H", data, at)[0])):
        if at + 14 + 12 * k > len(data):
            break
        tag, kind, n = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
        value = data[at + 10 + 12 * k : at + 14 + 12 * k]
        if tag == ORIENTATION and kind == 3:
            turned = struct.unpack(order + "H", value[:2])[0]
        elif kind in (1, 2, 7):
            raw = value[:n] if n <= 4 else data[(o := struct.unpack(order + "I", value)[0]) : o + n]
            text = raw.decode("utf-16-le" if tag >= 0x9C9B else "utf-8", "ignore").strip("\0 \t\r\n")
            if text:
                found[EXIF.get(tag, str(tag))] = text
    return found, turned


def png_chunks(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    at = 8
    while at + 8 <= len(data):
        n, kind = struct.unpack_from(">I4s", data, at)
        yield kind, data[at + 8 : at + 8 + n]
        at += 12 + n


def _png_text(kind: bytes, body: bytes) -> tuple[str, str] | None:
    key, _, rest = body.partition(b"\0")
    try:
        if kind == b"tEXt":
            return key.decode("latin-1"), rest.decode("latin-1")
        if kind == b"zTXt":
            return key.decode("latin-1"), zlib.decompress(rest[1:]).decode("latin-1")
        if kind == b"iTXt":
            packed, (_, _, text) = rest[:1] == b"\1", rest[2:].split(b"\0", 2) if rest.count(b"\0", 2) >= 2 else (b"", b"", b"")
            return key.decode("latin-1"), (zlib.decompress(text) if packed else text).decode("utf-8", "ignore")
    except (zlib.error, ValueError):
        return None
    return None


def _jpeg(data: bytes) -> Iterator[tuple[int, bytes]]:
    at = 2
    while at + 4 <= len(data) and data[at] == 0xFF:
        mark, n = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
        yield mark, data[at + 4 : at + 2 + n]
        if mark == 0xDA:
            return
        at += 2 + n


def describe(data: bytes) -> tuple[dict[str, str], list[Said]]:
    """(metadata, texts) of an image; metadata is empty where the format is not known."""
    meta: dict[str, str] = {}
    said: list[Said] = []
    tags: dict[str, str] = {}
    turned = 1
    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 33:
        w, h, _, color = struct.unpack_from(">IIBB", data, 16)
        meta = {"image_format": "PNG", "image_mode": {0: "L", 2: "RGB", 3: "P", 4: "LA", 6: "RGBA"}.get(color, "?"), "image_size": f"{w}x{h}"}
        for kind, body in png_chunks(data):
            if (found := _png_text(kind, body)) and found[1].strip():
                said.append((found[0], found[1].strip(), "metadata"))
            elif kind == b"eXIf":
                tags, turned = exif(body)
    elif data[:2] == b"\xff\xd8":
        meta = {"image_format": "JPEG", "image_mode": "RGB"}
        for mark, body in _jpeg(data):
            if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC) and len(body) >= 6:
                h, w, parts = struct.unpack_from(">HHB", body, 1)
                meta |= {"image_size": f"{w}x{h}", "image_mode": {1: "L", 4: "CMYK"}.get(parts, "RGB")}
            elif mark == 0xFE and (text := body.decode("utf-8", "ignore").strip("\0 \t\r\n")):
                said.append(("comment", text, "metadata"))
            elif mark == 0xE1 and body[:6] == b"Exif\0\0":
                tags, turned = exif(body[6:])
    elif data[:6] in (b"GIF87a", b"GIF89a") and len(data) >= 10:
        meta = {"image_format": "GIF", "image_mode": "P", "image_size": "{}x{}".format(*struct.unpack_from("<HH", data, 6))}
    elif data[:2] == b"BM" and len(data) >= 26:
        meta = {"image_format": "BMP", "image_mode": "RGB", "image_size": "{}x{}".format(*struct.unpack_from("<ii", data, 18))}
    if turned not in (0, 1):
        meta["image_orientation_corrected"] = "true"
    if tags:
        meta["image_exif_sample"] = json.dumps(tags, ensure_ascii=False)
        said += [(k, t, "exif") for k, t in tags.items()]
    if meta:
        sources = [{"source": where, "key": key, "length": len(text)} for key, text, where in said[:MOST_SOURCES]]
        text = joined([t for _, t, _ in said])
        if sources:
            meta["image_text_sources"] = json.dumps(sources, ensure_ascii=False)
        meta["image_has_text"] = str(bool(text)).lower()
        if text:
            meta |= {"image_text_characters": str(len(text)), "image_text_preview": text[:PREVIEW]}
    return meta, said


def joined(texts: list[str]) -> str:
    """Texts in order, each once, a line each."""
    return "\n".join(dict.fromkeys(texts)).strip()
