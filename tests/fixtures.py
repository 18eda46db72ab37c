"""Writers of test files: FITS, tile-compressed, XISF and ASDF bytes, made with numpy and the standard library."""

import base64
import struct
import zlib

import numpy as np
import pyarrow as pa

from starframe.sources import fits


def shuffle(data: bytes, size: int) -> bytes:
    n = len(data) // size
    return np.frombuffer(data, np.uint8, n * size).reshape(n, size).T.tobytes() + data[n * size :]


def gzip_tiles(image: np.ndarray, kind: str = "GZIP_1", tile: tuple[int, int] | None = None, more=()) -> bytes:
    """A tile-compressed unit (y, x) after an empty primary one; integers or floats kept as they are."""
    h, w = image.shape
    tw, th = tile or (w, 1)
    heap, rows = b"", []
    for y in range(0, h, th):
        for x in range(0, w, tw):
            raw = image[y : y + th, x : x + tw].astype(image.dtype.newbyteorder(">")).tobytes()
            raw = shuffle(raw, image.dtype.itemsize) if kind == "GZIP_2" else raw
            blob = zlib.compressobj(6, zlib.DEFLATED, 31)
            blob = blob.compress(raw) + blob.flush()
            rows.append((len(blob), len(heap)))
            heap += blob
    bitpix = {"i2": 16, "i4": 32, "f4": -32}[image.dtype.str[1:]]
    keys = [("ZIMAGE", True), ("ZCMPTYPE", kind), ("ZBITPIX", bitpix), ("ZNAXIS", 2), ("ZNAXIS1", w), ("ZNAXIS2", h), ("ZTILE1", tw), ("ZTILE2", th), *more]
    return fits.table_bytes([("COMPRESSED_DATA", "1PB", np.array(rows, np.int32))], [fits.card(k, v) for k, v in keys], "COMPRESSED", heap)


def xisf(images: list[dict]) -> bytes:
    """Images: values (channel, y, x), and optionally codec, shuffled, big, normal, embedded, blocks, more (XML inside)."""
    names = {"u1": "UInt8", "u2": "UInt16", "u4": "UInt32", "u8": "UInt64", "f4": "Float32", "f8": "Float64"}
    places, blobs = [], []
    for i in images:
        v = i["values"]
        kind = v.dtype.newbyteorder(">" if i.get("big") else "<")
        raw = (v.transpose(1, 2, 0) if i.get("normal") else v).astype(kind).tobytes()
        size, attrs = v.dtype.itemsize, ""
        if codec := i.get("codec"):
            data = shuffle(raw, size) if i.get("shuffled") else raw
            n = i.get("blocks", 1)
            parts = [data[k * len(data) // n : (k + 1) * len(data) // n] for k in range(n)]
            packed = [zlib.compress(p) if codec == "zlib" else pa.Codec("zstd" if codec == "zstd" else "lz4_raw").compress(p, asbytes=True) for p in parts]
            attrs = f' compression="{codec}{"+sh" if i.get("shuffled") else ""}:{len(raw)}{f":{size}" if i.get("shuffled") else ""}"'
            if n > 1:
                attrs += ' subblocks="' + ":".join(f"{len(a)},{len(b)}" for a, b in zip(packed, parts, strict=True)) + '"'
            raw = b"".join(packed)
        places.append((i, names[v.dtype.str[1:]], v.shape, attrs, raw))
    at = 4096
    body = ""
    for i, name, (c, h, w), attrs, raw in places:
        inside = i.get("more", "")
        if i.get("embedded"):
            text = raw.hex() if i["embedded"] == "hex" else base64.b64encode(raw).decode()
            inside += f'<Data encoding="{i["embedded"]}">{text}</Data>'
            place = "embedded"
        else:
            place = f"attachment:{at}:{len(raw)}"
            blobs.append(raw)
            at += len(raw)
        body += f'<Image id="{i.get("id", "main")}" geometry="{w}:{h}:{c}" sampleFormat="{name}" colorSpace="{"RGB" if c == 3 else "Gray"}" pixelStorage="{"Normal" if i.get("normal") else "Planar"}" byteOrder="{"big" if i.get("big") else "little"}" location="{place}"{attrs}>{inside}</Image>'
    xml = f'<?xml version="1.0" encoding="UTF-8"?><xisf version="1.0" xmlns="http://www.pixinsight.com/xisf">{body}</xisf>'.encode()
    assert len(xml) + 16 <= 4096 or not blobs
    return b"XISF0100" + struct.pack("<II", len(xml), 0) + xml + (b"\0" * (4096 - 16 - len(xml)) + b"".join(blobs) if blobs else b"")


def asdf(arrays: dict[str, dict], more: str = "") -> bytes:
    """Arrays by name: values, and optionally comp, big, strides, offset, shape, streamed."""
    out = f"#ASDF 1.0.0\n#ASDF_STANDARD 1.5.0\n%YAML 1.1\n%TAG ! tag:stsci.edu:asdf/\n--- !core/asdf-1.1.0\n{more}"
    blocks = b""
    for n, (name, a) in enumerate(arrays.items()):
        v = a["values"]
        kind = {"f": "float", "i": "int", "u": "uint"}[v.dtype.kind] + str(v.dtype.itemsize * 8)
        shape = a.get("shape", list(v.shape))
        out += f"{name}: !core/ndarray-1.0.0\n  source: {n}\n  datatype: {kind}\n  byteorder: {'big' if a.get('big') else 'little'}\n  shape: {'[' + ', '.join(map(str, shape)) + ']'}\n"
        out += (f"  strides: {a['strides']}\n" if "strides" in a else "") + (f"  offset: {a['offset']}\n" if "offset" in a else "")
        raw = v.astype(v.dtype.newbyteorder(">" if a.get("big") else "<")).tobytes()
        comp, data = a.get("comp", ""), raw
        if comp == "zlib":
            data = zlib.compress(raw)
        elif comp == "bzp2":
            import bz2

            data = bz2.compress(raw)
        elif comp == "lz4":
            parts = [raw[k : k + 1000] for k in range(0, len(raw), 1000)]
            packed = [pa.Codec("lz4_raw").compress(p, asbytes=True) for p in parts]
            data = b"".join(struct.pack(">I", len(c) + 4) + struct.pack("<I", len(p)) + c for c, p in zip(packed, parts, strict=True))
        flags = 1 if a.get("streamed") else 0
        sizes = (0, 0, 0) if flags else (len(data), len(data), len(raw))
        blocks += b"\xd3BLK" + struct.pack(">H", 48) + struct.pack(">I", flags) + comp.encode().ljust(4, b"\0") + struct.pack(">QQQ", *sizes) + b"\0" * 16 + data
    return out.encode() + b"...\n" + blocks
