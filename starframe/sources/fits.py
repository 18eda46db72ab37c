"""Reading FITS bytes inside tasks: walking headers, decoding rows of tables and images.  Small helpers; Spark deals the work."""

from __future__ import annotations

import re
import zlib

import numpy as np

BLOCK, CARD = 2880, 80
MOST_HDUS, MOST_HEADER, MOST_GZIP = 100_000, 64 << 20, 1 << 30
#: Axes that the format allows; a length of data beyond any file.
MOST_AXES, MOST_DATA = 999, 1 << 61
#: Elements of one variable-length cell; a longer one is null.
MOST_CELL = 1 << 27
DTYPES = {8: "u1", 16: ">i2", 32: ">i4", 64: ">i8", -32: ">f4", -64: ">f8"}


class Bytes:
    """Ranged reads of a file or of bytes already in memory; gzip members are inflated, up to a limit."""

    def __init__(self, path: str | None = None, content: bytes | None = None):
        self.truncated = False
        if content is None and path is not None:
            self.file = open(path.removeprefix("file:"), "rb")  # noqa: SIM115
            magic = self.file.read(2)
            self.size = self.file.seek(0, 2)
            if magic != b"\x1f\x8b":
                self.content = None
                return
            self.file.seek(0)
            content = self.file.read()
        self.content = content or b""
        if self.content[:2] == b"\x1f\x8b":
            self.content, self.truncated = inflate(self.content)
        self.size = len(self.content)

    def read(self, at: int, n: int) -> bytes:
        if self.content is not None:
            return self.content[at : at + n]
        self.file.seek(at)
        return self.file.read(n)


def head(path: str, n: int) -> tuple[bytes, bool]:
    """The first n bytes of a file, of a gzipped one those of what is in it, and whether it is one; no more than 64 KiB are read."""
    with open(path.removeprefix("file://").removeprefix("file:"), "rb") as f:
        data = f.read(n)
        if data[:2] != b"\x1f\x8b":
            return data, False
        try:
            return zlib.decompressobj(47).decompress(data + f.read(1 << 16), n), True
        except zlib.error:
            return b"", True


def inflate(data: bytes, most: int = MOST_GZIP) -> tuple[bytes, bool]:
    """Concatenated gzip members; what is readable, and whether it was cut short."""
    out, total = [], 0
    while data[:2] == b"\x1f\x8b":
        z = zlib.decompressobj(47)
        try:
            part = z.decompress(data, most - total)
        except zlib.error:
            return b"".join(out), True
        out.append(part)
        total += len(part)
        if not z.eof:
            return b"".join(out), True
        data = z.unused_data
    return b"".join(out), False


def _value(card: str):
    text = card[10:]
    m = re.match(r" *'((?:[^']|'')*)", text)
    return m[1].replace("''", "'").rstrip() if m else text.split("/")[0].strip()


def _int(text, default: int = 0) -> int:
    try:
        return int(text)
    except (TypeError, ValueError):
        try:
            d = float(str(text).replace("D", "E"))
            return int(d) if abs(d) < 9e18 else default
        except ValueError:
            return default


def _float(text, default=None):
    try:
        return float(str(text).upper().replace("D", "E"))
    except ValueError:
        return default


def _wrong(kw: dict) -> str | None:
    """What makes a header useless for finding its data, if anything."""
    axes = _int(kw.get("NAXIS"), -1)
    if not 0 <= axes <= MOST_AXES:
        return f"NAXIS is {kw.get('NAXIS')}, from 0 to {MOST_AXES} are possible"
    if any(not 0 <= _int(kw.get(f"NAXIS{i + 1}"), -1) < 1 << 62 for i in range(axes)):
        return "the length of an axis is missing or negative"
    if _int(kw.get("BITPIX")) not in DTYPES:
        return f"BITPIX is {kw.get('BITPIX')}, which is no type of elements"
    if not (0 <= _int(kw.get("PCOUNT")) < 1 << 62 and 0 <= _int(kw.get("GCOUNT", "1"), -1) < 1 << 31):
        return "PCOUNT or GCOUNT is negative or too large"
    return None


def walk(source: Bytes, most: int = MOST_HDUS):
    """One dict per data unit, from header to header; data units are skipped, not read.  Stops at the first header that is none."""
    at, hdu = 0, 0
    while hdu < most and at < source.size:
        cards, end, pos = [], False, at
        while not end and pos - at < MOST_HEADER:
            block = source.read(pos, BLOCK)
            if len(block) < CARD:
                break
            for k in range(0, len(block) - CARD + 1, CARD):
                cards.append(block[k : k + CARD])
                if cards[-1].rstrip() == b"END":
                    end = True
                    break
            pos += BLOCK
        first = cards[0][:9] if cards else b""
        if not end or (hdu == 0 and not first.startswith(b"SIMPLE  =")) or (hdu and not first.startswith(b"XTENSION=")):
            if hdu == 0:
                yield {"hdu": 0, "error": "not a valid header", "hdr_off": 0, "header": ""}
            return
        kw: dict = {}
        for c in (c.decode("latin-1") for c in cards):
            if c[8:10] == "= ":
                kw.setdefault(c[:8].rstrip(), _value(c))
        wrong = _wrong(kw)
        if wrong:
            yield {"hdu": hdu, "error": wrong, "hdr_off": at, "header": b"".join(cards).decode("latin-1")}
            return
        naxes = [_int(kw.get(f"NAXIS{i + 1}")) for i in range(_int(kw.get("NAXIS")))]
        bitpix, pcount, gcount = _int(kw.get("BITPIX")), _int(kw.get("PCOUNT")), _int(kw.get("GCOUNT"), 1) if "GCOUNT" in kw else 1
        groups = kw.get("GROUPS") == "T" and bool(naxes) and naxes[0] == 0
        n = 1
        for x in naxes[1:] if groups else naxes:
            n *= x
        length = gcount * (pcount + (n if naxes else 0)) * abs(bitpix) // 8 if naxes or pcount else 0
        zimage = kw.get("ZIMAGE") == "T"
        length = min(length, MOST_DATA)
        if zimage:
            naxes_z = [_int(kw.get(f"ZNAXIS{i + 1}")) for i in range(min(_int(kw.get("ZNAXIS")), MOST_AXES))]
        scale = _float(kw.get("BSCALE", "1"), 1.0)
        yield {
            "hdu": hdu, "xtension": kw.get("XTENSION", "") if hdu else "", "extname": kw.get("EXTNAME", ""), "bitpix": _int(kw.get("ZBITPIX")) if zimage else bitpix,
            "naxes": (naxes_z if zimage else naxes)[:9], "rowlen": naxes[0] if naxes else 0, "n_rows": naxes[1] if len(naxes) > 1 else 0, "pcount": pcount, "gcount": gcount, "bscale": scale or 1.0, "bzero": _float(kw.get("BZERO", "0"), 0.0),
            "blank": _int(kw.get("BLANK")) if "BLANK" in kw and bitpix > 0 else None, "groups": groups, "zimage": zimage, "cmptype": kw.get("ZCMPTYPE", "") if zimage else "",
            "supported": not zimage or kw.get("ZCMPTYPE", "") in ("GZIP_1", "GZIP_2", "NOCOMPRESS"), "tfields": _int(kw.get("TFIELDS")), "heap": _int(kw.get("THEAP"), 0) or (naxes[0] * naxes[1] if len(naxes) > 1 else 0),
            "hdr_off": at, "hdr_len": pos - at, "data_off": pos, "data_len": length, "next_off": pos + -(-length // BLOCK) * BLOCK, "header": b"".join(cards).decode("latin-1"), "error": None, "keywords": kw,
        }
        at = pos + -(-length // BLOCK) * BLOCK
        hdu += 1


def columns(kw: dict) -> list[dict]:
    """Columns of a table unit from its keywords: name, unit, form, repeat, type, element, width, byte_offset, scale, zero, null.

    None where a form can't be read, or columns lie outside the row.
    """
    row = _int(kw["NAXIS1"]) if "NAXIS1" in kw else 1 << 62
    out, at = [], 0
    for n in range(1, min(999, _int(kw.get("TFIELDS"))) + 1):
        form = kw.get(f"TFORM{n}", "").strip()
        base = {"n": n, "name": kw.get(f"TTYPE{n}", "").strip() or f"col{n}", "unit": kw.get(f"TUNIT{n}", "").strip(), "form": form, "scale": _float(kw.get(f"TSCAL{n}", "1"), 1.0) or 1.0, "zero": _float(kw.get(f"TZERO{n}", "0"), 0.0), "null": _int(kw[f"TNULL{n}"]) if f"TNULL{n}" in kw else None}
        if f"TBCOL{n}" in kw:
            m = re.match(r"([AIFED])(\d+)", form)
            if not m:
                return []
            first, wide = _int(kw[f"TBCOL{n}"]) - 1, int(m[2])
            if first < 0 or first + wide > row:
                return []
            out.append(base | {"repeat": 1, "type": m[1], "element": "", "width": wide, "byte_offset": first, "ascii": True})
            continue
        m = re.match(r"(\d*)([LXBIJKAEDCMPQ])([LXBIJKAEDCM]?)", form)
        if not m:
            return []
        repeat, code = int(m[1] or 1), m[2]
        size = {"L": 1, "B": 1, "A": 1, "X": 1, "I": 2, "J": 4, "E": 4, "K": 8, "D": 8, "C": 8, "P": 8, "M": 16, "Q": 16}[code]
        width = (repeat + 7) // 8 if code == "X" else (size if repeat else 0) if code in "PQ" else repeat * size
        out.append(base | {"repeat": repeat, "type": code, "element": m[3] if code in "PQ" else "", "width": width, "byte_offset": at, "ascii": False})
        at += width
        if at > row:
            return []
    return out


#: Spark and numpy types by letter.
SPARK = {"L": "boolean", "B": "smallint", "I": "smallint", "J": "int", "K": "bigint", "E": "float", "D": "double", "A": "string", "X": "binary", "C": "struct<re:float,im:float>", "M": "struct<re:double,im:double>"}
NUMPY = {"B": "u1", "I": ">i2", "J": ">i4", "K": ">i8", "E": ">f4", "D": ">f8", "C": ">c8", "M": ">c16"}


def spark_type(c: dict) -> str:
    if c["ascii"] or c["type"] in "AX":
        return "binary" if c["type"] == "X" and not c["ascii"] else "string"
    if c["type"] in "PQ":
        return f"array<{SPARK[c['element'] or 'B']}>" if c["element"] != "A" else "string"
    return SPARK[c["type"]] if c["repeat"] == 1 else f"array<{SPARK[c['type']]}>"


def clean(raw: bytes) -> str:
    return "".join(chr(b) if 32 <= b < 127 else "?" for b in raw.split(b"\0")[0].rstrip())


def cells(raw: np.ndarray, c: dict, heap=None) -> list | np.ndarray:
    """Values of one column of some rows (uint8, rows by row length); ``heap`` reads variable-length arrays."""
    part = raw[:, c["byte_offset"] : c["byte_offset"] + c["width"]]
    if c["ascii"]:
        return [bytes(r).decode("latin-1").strip() for r in part]
    if c["type"] == "A":
        return [clean(bytes(r)) for r in part]
    if c["type"] == "X":
        return [bytes(r) for r in part]
    if c["type"] in "PQ":
        if not c["width"]:
            return [[] for _ in part]
        d = np.ascontiguousarray(part).view(">i4" if c["type"] == "P" else ">i8").reshape(len(part), 2)
        kind = NUMPY.get(c["element"] or "B", "u1")
        size = np.dtype(kind).itemsize

        def some(n: int, at: int) -> list | None:
            """Null for a cell that says it has more elements than can be, or lies nowhere."""
            if not 0 <= n <= MOST_CELL or at < 0:
                return None
            found = heap(at, n * size)
            return np.frombuffer(found[: len(found) // size * size], kind).astype(np.dtype(kind).newbyteorder("=")).tolist()

        return [some(int(n), int(at)) for n, at in d]
    if c["type"] == "L":
        values = [[True if b == 84 else False if b == 70 else None for b in r] for r in part.tolist()]
        return [v[0] if v else None for v in values] if c["repeat"] == 1 else values
    v = np.ascontiguousarray(part).view(NUMPY[c["type"]]).reshape(len(part), c["repeat"])
    v = v.astype(v.dtype.newbyteorder("="))
    if c["type"] == "B":
        v = v.astype(np.int16)
    if c["type"] in "CM":
        rows = [[{"re": float(x.real), "im": float(x.imag)} for x in r] for r in v]
        return [r[0] for r in rows] if c["repeat"] == 1 else rows
    return v[:, 0] if c["repeat"] == 1 else v.tolist()


def card(key: str, value, comment: str = "") -> bytes:
    """An 80-character card."""
    if isinstance(value, bool):
        text = f"{'T' if value else 'F':>20}"
    elif isinstance(value, str):
        text = "'" + value.replace("'", "''").ljust(8) + "'"
    else:
        text = f"{value!r:>20}"
    return (f"{key:<8}= {text}" + (f" / {comment}" if comment else "")).ljust(CARD)[:CARD].encode("latin-1", "replace")


def header(cards: list[bytes]) -> bytes:
    out = b"".join(cards) + b"END".ljust(CARD)
    return out.ljust(-(-len(out) // BLOCK) * BLOCK)


def padded(data: bytes) -> bytes:
    return data.ljust(-(-len(data) // BLOCK) * BLOCK, b"\0")


def image_bytes(pixels_: np.ndarray, primary: bool = True, more: list[bytes] = ()) -> bytes:
    """An image unit (y, x order, last axis fastest) in its own element type."""
    kind = {np.dtype("u1"): 8, np.dtype("i2"): 16, np.dtype("i4"): 32, np.dtype("i8"): 64, np.dtype("f4"): -32, np.dtype("f8"): -64}[pixels_.dtype.newbyteorder("=")]
    axes = [card(f"NAXIS{n + 1}", int(s)) for n, s in enumerate(reversed(pixels_.shape))]
    first = card("SIMPLE", True) if primary else card("XTENSION", "IMAGE")
    return header([first, card("BITPIX", kind), card("NAXIS", pixels_.ndim), *axes, *([] if primary else [card("PCOUNT", 0), card("GCOUNT", 1)]), *more]) + padded(pixels_.astype(pixels_.dtype.newbyteorder(">")).tobytes())


def table_bytes(columns_: list[tuple[str, str, np.ndarray]], more: list[bytes] = (), name: str = "TABLE", heap: bytes = b"") -> bytes:
    """A primary unit without data and a binary table: columns are (name, form, values in rows); strings are fixed-width bytes."""
    parts, forms = [], []
    for n, (title, form, values) in enumerate(columns_, 1):
        v = np.asarray(values)
        v = v.astype(v.dtype.newbyteorder(">")) if v.dtype.kind in "iufc" else v
        parts.append(np.ascontiguousarray(v).view(np.uint8).reshape(len(v), -1))
        forms += [card(f"TTYPE{n}", title), card(f"TFORM{n}", form)]
    raw = np.concatenate(parts, axis=1)
    unit = [card("XTENSION", "BINTABLE"), card("BITPIX", 8), card("NAXIS", 2), card("NAXIS1", raw.shape[1]), card("NAXIS2", raw.shape[0]), card("PCOUNT", len(heap)), card("GCOUNT", 1), card("TFIELDS", len(columns_)), *forms, card("EXTNAME", name), *more]
    return header([card("SIMPLE", True), card("BITPIX", 8), card("NAXIS", 0)]) + header(unit) + padded(raw.tobytes() + heap)
