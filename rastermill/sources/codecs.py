"""Image formats in memory: which one it is, its pixels, and its bytes. Pixels are height x width x (r, g, b, a) bytes.

PNG (all depths, interlaced too), BMP (1 to 32 bits without compression), TGA (mapped, true colour and grey, packed or not), GIF (first frame) and PNM
are read here; JPEG, TIFF, WEBP and LBM are known but have no decoder here (SRC2 says so).
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable

import numpy as np


class Unreadable(ValueError):
    """Content that is no image, a damaged one, or of a kind without a decoder."""


def sniff(content: bytes, name: str = "") -> str:
    """SRC3: the format by its first bytes; TGA, which has none, by its name or by a header that makes sense."""
    for kind, marks in (("png", [b"\x89PNG\r\n\x1a\n"]), ("gif", [b"GIF87a", b"GIF89a"]), ("jpg", [b"\xff\xd8\xff"]), ("tif", [b"II*\0", b"MM\0*"]), ("bmp", [b"BM"])):
        if content.startswith(tuple(marks)):
            return kind
    if content[:4] == b"RIFF" and content[8:12] == b"WEBP":
        return "webp"
    if content[:4] == b"FORM" and content[8:12] in (b"ILBM", b"PBM "):
        return "lbm"
    if content[:1] == b"P" and content[1:2] in (b"1", b"2", b"3", b"4", b"5", b"6") and content[2:3].isspace():
        return "pnm"
    if len(content) >= 18 and (name.lower().endswith(".tga") or content[1] in (0, 1) and content[2] in (1, 2, 3, 9, 10, 11) and content[16] in (8, 15, 16, 24, 32)):
        return "tga"
    raise Unreadable("no known image format")


# --- PNG

_CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
# Start and step of the seven passes of an interlaced PNG, across and down.
PASSES = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))


def unfiltered(raw: np.ndarray, kinds: np.ndarray, unit: int) -> np.ndarray:
    """Rows of bytes without their PNG filters; unit: bytes of a pixel. Rows are resolved together, along diagonals."""
    h, length = raw.shape
    w = length // unit
    if (kinds > 4).any():
        raise Unreadable("unknown filter")
    cells = raw.reshape(h, w, unit).astype(np.int16)
    if not np.isin(kinds, (3, 4)).any():  # left and up are plain sums
        out = np.where((kinds == 1)[:, None, None], np.cumsum(cells, axis=1), cells).astype(np.uint8)
        for y in np.flatnonzero(kinds[1:] == 2) + 1:
            out[y] += out[y - 1]
        return out.reshape(h, length)
    out = np.zeros((h + 1, w + 1, unit), np.int16)  # a row above and a column on the left are zero
    for t in range(w + h - 1):
        y = np.arange(max(0, t - w + 1), min(h - 1, t) + 1)
        x = t - y
        left, up, corner = out[y + 1, x], out[y, x + 1], out[y, x]
        guess = left + up - corner
        a, b, c = abs(guess - left), abs(guess - up), abs(guess - corner)
        paeth = np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))
        kind = kinds[y][:, None]
        out[y + 1, x + 1] = (cells[y, x] + np.select([kind == 1, kind == 2, kind == 3, kind == 4], [left, up, (left + up) >> 1, paeth], 0)) & 255
    return out[1:, 1:].astype(np.uint8).reshape(h, length)


def _samples(rows: np.ndarray, w: int, channels: int, depth: int) -> np.ndarray:
    """height x width x channels numbers of packed rows."""
    if depth == 8:
        return rows.reshape(len(rows), -1, channels)[:, :w]
    if depth == 16:
        return rows.reshape(len(rows), -1, 2)[:, :, 0].reshape(len(rows), -1, channels)[:, :w]  # the high byte
    return packed_numbers(rows, depth)[:, :w, None]


def packed_numbers(rows: np.ndarray, depth: int) -> np.ndarray:
    """Numbers of 1, 2 or 4 bits, the highest first."""
    shifts = np.arange(8 - depth, -1, -depth)
    return (rows[:, :, None] >> shifts & (1 << depth) - 1).reshape(len(rows), -1).astype(np.uint8)


def decode_png(content: bytes) -> np.ndarray:
    at, body, head, palette, clear = 8, [], None, None, None
    while at + 8 <= len(content):
        size, kind = struct.unpack(">I4s", content[at : at + 8])
        data = content[at + 8 : at + 8 + size]
        if len(data) < size:
            raise Unreadable("cut off")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", data)
        elif kind == b"PLTE":
            palette = np.frombuffer(data, np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            clear = data
        elif kind == b"IDAT":
            body.append(data)
        elif kind == b"IEND":
            break
        at += 12 + size
    if head is None or not body:
        raise Unreadable("no image data")
    w, h, depth, colour, _, _, lace = head
    if colour not in _CHANNELS or depth not in (1, 2, 4, 8, 16) or colour == 3 and palette is None or not w or not h:
        raise Unreadable("bad header")
    n, raw = _CHANNELS[colour], np.frombuffer(zlib.decompress(b"".join(body)), np.uint8)
    out = np.zeros((h, w, n), np.uint8)
    at = 0
    for x0, y0, dx, dy in PASSES if lace else ((0, 0, 1, 1),):
        pw, ph = -(-(w - x0) // dx), -(-(h - y0) // dy)
        if pw <= 0 or ph <= 0:
            continue
        length = (pw * n * depth + 7) // 8
        part = raw[at : at + ph * (length + 1)]
        if len(part) < ph * (length + 1):
            raise Unreadable("cut off")
        at += len(part)
        part = part.reshape(ph, length + 1)
        out[y0::dy, x0::dx] = _samples(unfiltered(part[:, 1:], part[:, 0], max(1, n * depth // 8)), pw, n, depth)
    rgba = np.full((h, w, 4), 255, np.uint8)
    if colour == 3:
        alphas = np.full(256, 255, np.uint8)
        alphas[: len(clear or b"")] = np.frombuffer(clear or b"", np.uint8)
        if out.max() >= len(palette):
            raise Unreadable("an index is beyond the palette")
        rgba[:, :, :3], rgba[:, :, 3] = palette[out[:, :, 0]], alphas[out[:, :, 0]]
        return rgba
    if clear is not None and colour in (0, 2):
        key = np.frombuffer(clear, ">u2") >> (8 if depth == 16 else 0)
        rgba[:, :, 3] = np.where((out == key.astype(np.uint8)).all(axis=2), 0, 255)
    if depth < 8:
        out = (out.astype(np.int32) * 255 // ((1 << depth) - 1)).astype(np.uint8)
    rgba[:, :, :3] = out[:, :, :3] if n > 2 else out[:, :, :1]
    if colour in (4, 6):
        rgba[:, :, 3] = out[:, :, -1]
    return rgba


def encode_png(rgba: np.ndarray) -> bytes:
    """SNK2: 8-bit RGBA, rows filtered by what is above them."""
    h, w, _ = rgba.shape
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    rows = rgba.astype(np.uint8).reshape(h, -1)
    filtered = np.concatenate([np.full((h, 1), 2, np.uint8), np.diff(rows, axis=0, prepend=np.zeros((1, rows.shape[1]), np.uint8))], axis=1)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(filtered.tobytes())) + chunk(b"IEND", b"")


# --- BMP


def decode_bmp(content: bytes) -> np.ndarray:
    if len(content) < 54:
        raise Unreadable("cut off")
    start, size, w, h, _, depth, packing = struct.unpack("<IIiiHHI", content[10:34])
    if depth not in (1, 4, 8, 24, 32) or packing not in (0, 3) or w <= 0 or not h:
        raise Unreadable("an unknown kind of BMP")
    stride = (w * depth + 31) // 32 * 4
    rows = np.frombuffer(content[start : start + stride * abs(h)], np.uint8)
    if len(rows) < stride * abs(h):
        raise Unreadable("cut off")
    rows = rows.reshape(abs(h), stride)
    rows = rows if h < 0 else rows[::-1]
    out = np.full((abs(h), w, 4), 255, np.uint8)
    if depth <= 8:
        entries = struct.unpack("<I", content[46:50])[0] or 1 << depth
        table = np.frombuffer(content[14 + size : 14 + size + 4 * entries], np.uint8).reshape(-1, 4)
        numbers = (rows if depth == 8 else packed_numbers(rows, depth))[:, :w]
        if numbers.max() >= len(table):
            raise Unreadable("an index is beyond the palette")
        out[:, :, :3] = table[numbers][:, :, 2::-1]
        return out
    cells = rows[:, : w * depth // 8].reshape(abs(h), w, depth // 8)
    out[:, :, :3] = cells[:, :, 2::-1]
    if packing == 3 and size >= 56:  # masks with one for alpha
        out[:, :, 3] = cells[:, :, 3]
    return out


def encode_bmp(rgba: np.ndarray) -> bytes:
    """32 bits with masks, bottom row first."""
    h, w, _ = rgba.shape
    masks = struct.pack("<IIII", 0xFF0000, 0xFF00, 0xFF, 0xFF000000) + b"BGRs" + bytes(48)  # with masks, colour space and end points
    head = struct.pack("<IiiHHIIiiII", 108, w, h, 1, 32, 3, w * h * 4, 2835, 2835, 0, 0) + masks
    return b"BM" + struct.pack("<IHHI", 14 + len(head) + w * h * 4, 0, 0, 14 + len(head)) + head + rgba[::-1][:, :, [2, 1, 0, 3]].astype(np.uint8).tobytes()


# --- TGA


def decode_tga(content: bytes) -> np.ndarray:
    skip, mapped, kind, first, entries, entry, _, _, w, h, depth, flags = struct.unpack("<BBBHHBHHHHBB", content[:18])
    if kind not in (1, 2, 3, 9, 10, 11) or not w or not h:
        raise Unreadable("an unknown kind of TGA")
    at = 18 + skip
    table = np.frombuffer(content[at : at + entries * entry // 8], np.uint8).reshape(entries, -1) if mapped else None
    at += entries * entry // 8 if mapped else 0
    unit = depth // 8
    if unit not in ((1,) if kind in (1, 3, 9, 11) else (3, 4)):
        raise Unreadable("an unknown depth of TGA")
    need = w * h * unit
    body = content[at : at + need] if kind < 9 else _unpacked(content[at:], unit, need)
    if len(body) < need:
        raise Unreadable("cut off")
    cells = np.frombuffer(body[:need], np.uint8).reshape(h, w, unit)
    cells = cells if flags & 32 else cells[::-1]
    cells = cells[:, ::-1] if flags & 16 else cells
    if kind in (1, 9):
        if table is None or table.shape[1] not in (3, 4) or cells.max() - first >= entries:
            raise Unreadable("a bad colour map")
        cells = table[cells[:, :, 0] - first]
    out = np.full((h, w, 4), 255, np.uint8)
    out[:, :, :3] = cells[:, :, 2::-1] if cells.shape[2] >= 3 else cells
    if cells.shape[2] == 4:
        out[:, :, 3] = cells[:, :, 3]
    return out


def _unpacked(content: bytes, unit: int, need: int) -> bytes:
    """Runs and stretches of pixels."""
    out, at, have = [], 0, 0
    while have < need and at < len(content):
        n = (content[at] & 127) + 1
        piece = content[at + 1 : at + 1 + unit] * n if content[at] & 128 else content[at + 1 : at + 1 + unit * n]
        at += 1 + (unit if content[at] & 128 else unit * n)
        out.append(piece)
        have += len(piece)
    return b"".join(out)


def encode_tga(rgba: np.ndarray) -> bytes:
    """32 bits, top row first, equal rows of pixels packed as runs."""
    h, w, _ = rgba.shape
    cells = rgba[:, :, [2, 1, 0, 3]].astype(np.uint8)
    out = [struct.pack("<BBBHHBHHHHBB", 0, 0, 10, 0, 0, 0, 0, 0, w, h, 32, 40)]
    for row in cells:
        heads = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]).any(axis=1)])
        for a, b in zip(heads.tolist(), [*heads[1:].tolist(), w], strict=True):
            for start in range(a, b, 128):
                out.append(bytes([127 + min(128, b - start)]) + row[a].tobytes())
    return b"".join(out)


# --- GIF


def decode_gif(content: bytes) -> np.ndarray:
    """The first frame on a clear ground."""
    w, h, flags = struct.unpack("<HHB", content[6:11])
    at, table, clear = 13, None, None
    if flags & 128:
        table, at = _gif_table(content, at, flags)
    while at < len(content):
        mark = content[at]
        if mark == 0x21:
            if content[at + 1] == 0xF9 and content[at + 3] & 1:
                clear = content[at + 6]
            at += 2
            while content[at]:
                at += 1 + content[at]
            at += 1
        elif mark == 0x2C:
            x, y, fw, fh, own = struct.unpack("<HHHHB", content[at + 1 : at + 10])
            at += 10
            if own & 128:
                table, at = _gif_table(content, at, own)
            least, at, body = content[at], at + 1, []
            while at < len(content) and content[at]:
                body.append(content[at + 1 : at + 1 + content[at]])
                at += 1 + content[at]
            numbers = np.frombuffer(_lzw_decoded(b"".join(body), least, fw * fh), np.uint8)
            if len(numbers) < fw * fh or table is None or numbers.max(initial=0) >= len(table):
                raise Unreadable("cut off or without colours")
            numbers = numbers.reshape(fh, fw)
            if own & 64:  # rows come in four passes
                order = np.r_[np.arange(0, fh, 8), np.arange(4, fh, 8), np.arange(2, fh, 4), np.arange(1, fh, 2)]
                numbers = numbers[np.argsort(order)]
            out = np.zeros((max(h, y + fh), max(w, x + fw), 4), np.uint8)
            out[y : y + fh, x : x + fw, :3] = table[numbers]
            out[y : y + fh, x : x + fw, 3] = np.where(numbers == clear, 0, 255) if clear is not None else 255
            return out
        else:
            break
    raise Unreadable("no frame")


def _gif_table(content: bytes, at: int, flags: int) -> tuple[np.ndarray, int]:
    n = 3 << (flags & 7) + 1
    return np.frombuffer(content[at : at + n], np.uint8).reshape(-1, 3), at + n


def _lzw_decoded(data: bytes, least: int, need: int) -> bytes:
    restart = 1 << least
    table = [bytes([i]) for i in range(restart)] + [b"", b""]
    out, size, have, held, bits, before = [], least + 1, 0, 0, 0, None
    for byte in data:
        held |= byte << bits
        bits += 8
        while bits >= size:
            code, held, bits = held & (1 << size) - 1, held >> size, bits - size
            if code == restart:
                table, size, before = table[: restart + 2], least + 1, None
                continue
            if code == restart + 1 or have >= need:
                return b"".join(out)
            if before is None:
                piece = table[code] if code < restart else b""
            elif code < len(table):
                piece = table[code]
            elif code == len(table):
                piece = before + before[:1]
            else:
                raise Unreadable("a bad code")
            if not piece:
                raise Unreadable("a bad code")
            if before is not None and len(table) < 4096:
                table.append(before + piece[:1])
                if len(table) == 1 << size and size < 12:
                    size += 1
            out.append(piece)
            have += len(piece)
            before = piece
    return b"".join(out)


def encode_gif(rgba: np.ndarray) -> bytes:
    """At most 256 colours, clear ones as one of them; opaque or clear only."""
    h, w, _ = rgba.shape
    if not np.isin(rgba[:, :, 3], (0, 255)).all():
        raise ValueError("a GIF's pixels are opaque or clear")
    flat = np.where(rgba[:, :, 3:] == 0, 0, rgba).reshape(-1, 4).astype(np.uint8)
    table, numbers = np.unique(flat, axis=0, return_inverse=True)
    if len(table) > 256:
        raise ValueError("a GIF has 256 colours at most")
    depth = max(1, int(len(table) - 1).bit_length())
    colours = np.zeros((1 << depth, 3), np.uint8)
    colours[: len(table)] = table[:, :3]
    clear = np.flatnonzero(table[:, 3] == 0)
    control = b"\x21\xf9\x04" + struct.pack("<BHB", 1 if len(clear) else 0, 0, int(clear[0]) if len(clear) else 0) + b"\0"
    body = _lzw_encoded(numbers.astype(np.uint8).tobytes(), max(2, depth))
    blocks = b"".join(bytes([len(body[i : i + 255])]) + body[i : i + 255] for i in range(0, len(body), 255))
    return b"GIF89a" + struct.pack("<HHBBB", w, h, 0xF0 | depth - 1, 0, 0) + colours.tobytes() + control + b"\x2c" + struct.pack("<HHHHB", 0, 0, w, h, 0) + bytes([max(2, depth)]) + blocks + b"\0;"


def _lzw_encoded(data: bytes, least: int) -> bytes:
    restart, out, held, bits = 1 << least, bytearray(), 0, 0
    table, size, prefix = {bytes([i]): i for i in range(restart)}, least + 1, b""

    def put(code: int) -> None:
        nonlocal held, bits
        held |= code << bits
        bits += size
        while bits >= 8:
            out.append(held & 255)
            held, bits = held >> 8, bits - 8

    put(restart)
    for i in range(len(data)):
        longer = prefix + data[i : i + 1]
        if longer in table:
            prefix = longer
            continue
        put(table[prefix])
        if len(table) + 2 < 4096:
            table[longer] = len(table) + 2
            if len(table) + 1 == 1 << size and size < 12:
                size += 1
        else:
            put(restart)
            table, size = {bytes([k]): k for k in range(restart)}, least + 1
        prefix = data[i : i + 1]
    if prefix:
        put(table[prefix])
        # the code that the reader adds now may be longer
        if len(table) + 2 == 1 << size and size < 12:
            size += 1
    put(restart + 1)
    if bits:
        out.append(held & 255)
    return bytes(out)


# --- PNM


def decode_pnm(content: bytes) -> np.ndarray:
    words, at = [], 2
    while len(words) < (2 if content[1:2] in b"14" else 3):
        while at < len(content) and (content[at : at + 1].isspace() or content[at : at + 1] == b"#"):
            at = content.find(b"\n", at) if content[at : at + 1] == b"#" else at + 1
            if at < 0:
                raise Unreadable("cut off")
        end = at
        while end < len(content) and content[end : end + 1].isdigit():
            end += 1
        if end == at:
            raise Unreadable("bad header")
        words.append(int(content[at:end]))
        at = end
    (w, h), most, kind = words[:2], words[2] if len(words) > 2 else 1, int(content[1:2])
    n = 3 if kind in (3, 6) else 1
    if not w or not h or not 0 < most < 256:
        raise Unreadable("an unknown kind of PNM")
    if kind in (1, 2, 3):
        text = content[at:].decode("ascii", "replace")
        numbers = np.array(list(text.replace(" ", "").replace("\n", "")) if kind == 1 else text.split(), np.int64)
    elif kind == 4:
        rows = np.frombuffer(content[at + 1 : at + 1 + (w + 7) // 8 * h], np.uint8)
        numbers = packed_numbers(rows.reshape(h, -1), 1)[:, :w].ravel() if len(rows) == (w + 7) // 8 * h else rows[:0]
    else:
        numbers = np.frombuffer(content[at + 1 :], np.uint8)
    if len(numbers) < w * h * n:
        raise Unreadable("cut off")
    cells = numbers[: w * h * n].reshape(h, w, n).astype(np.int64)
    cells = 255 * (1 - cells) if kind in (1, 4) else cells * 255 // most
    out = np.full((h, w, 4), 255, np.uint8)
    out[:, :, :3] = cells
    return out


DECODERS: dict[str, Callable[[bytes], np.ndarray]] = {"png": decode_png, "bmp": decode_bmp, "tga": decode_tga, "gif": decode_gif, "pnm": decode_pnm}
ENCODERS: dict[str, Callable[[np.ndarray], bytes]] = {"png": encode_png, "bmp": encode_bmp, "tga": encode_tga, "gif": encode_gif}
#: SRC3: what a dialog of images shows, by extension.
EXTENSIONS = {"png": "png", "tif": "tif", "tga": "tga", "gif": "gif", "jpg": "jpg", "jfif": "jpg", "lbm": "lbm", "bmp": "bmp", "webp": "webp", "ppm": "pnm", "pgm": "pnm", "pbm": "pnm"}


def decode(content: bytes, name: str = "") -> np.ndarray:
    """SRC1: pixels of an image of any format that has a decoder; Unreadable says why there are none."""
    kind = sniff(content, name)
    if kind not in DECODERS:
        raise Unreadable(f"no decoder for {kind}")
    try:
        return DECODERS[kind](content)
    except Unreadable:
        raise
    except (ValueError, IndexError, KeyError, struct.error, zlib.error) as e:
        raise Unreadable(f"damaged {kind}: {e}") from e
