"""Sequential JPEG images as luma: enough of a decoder to compare the images of documents.

Huffman-coded sequential images of 8 bits are read (baseline and extended); progressive,
arithmetic-coded and lossless ones are not, and give None. The entropy code is walked in
Python, as each code begins where the last one ends; everything after it works on whole planes.
"""

from __future__ import annotations

import numpy as np

#: The order in which the coefficients of a block are stored.
_ZIGZAG = np.argsort([(r + c) * 64 + (r if (r + c) % 2 else c) for r in range(8) for c in range(8)], kind="stable")
#: Pixels beyond which an image is not decoded.
MAX_PIXELS = 40_000_000


def _lookup(counts: bytes, symbols: bytes) -> list[tuple[int, int]]:
    """``(length, symbol)`` by the next 16 bits; length 0 where no code fits."""
    table, code, at = [(0, 0)] * 65536, 0, 0
    for length, n in enumerate(counts, 1):
        for symbol in symbols[at : at + n]:
            begin = code << (16 - length)
            table[begin : begin + (1 << (16 - length))] = [(length, symbol)] * (1 << (16 - length))
            code += 1
        at += n
        code <<= 1
    return table[:65536]


class _Bits:
    """Bits of a scan without its stuffed zeros; past the end there are ones."""

    def __init__(self, data: bytes):
        self.data, self.at, self.held, self.n = data, 0, 0, 0

    def fill(self) -> None:
        part = self.data[self.at : self.at + 6]
        self.at += 6
        self.held = (self.held << 48 | int.from_bytes(part + b"\xff" * (6 - len(part)), "big")) & (1 << (self.n + 48)) - 1
        self.n += 48

    def code(self, table: list[tuple[int, int]]) -> int:
        if self.n < 16:
            self.fill()
        length, symbol = table[self.held >> (self.n - 16) & 0xFFFF]
        if not length or self.at > len(self.data) + 12:
            raise ValueError("damaged image data")
        self.n -= length
        return symbol

    def signed(self, size: int) -> int:
        if not size:
            return 0
        if self.n < size:
            self.fill()
        self.n -= size
        value = self.held >> self.n & (1 << size) - 1
        return value if value >> (size - 1) else value - (1 << size) + 1


def _segments(data: bytes):
    """``(marker, body, offset after it)`` up to the first scan."""
    at = 2
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            at += 1
            continue
        marker = data[at + 1]
        if marker in (0x00, 0x01, 0xFF) or 0xD0 <= marker <= 0xD8:
            at += 1 if marker == 0xFF else 2
            continue
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        yield marker, data[at + 4 : at + 2 + size], at + 2 + size
        at += 2 + size


def _idct_matrix() -> np.ndarray:
    k, n = np.arange(8)[:, None], np.arange(8)
    return np.cos((2 * n + 1) * k * np.pi / 16) * np.where(k == 0, np.sqrt(1 / 8), 0.5)


def luma(data: bytes, transform: int | None = None, inverted: bool | None = None) -> np.ndarray | None:
    """The luma of each pixel, 0 to 255, or None if the image isn't one that is read here.

    ``transform`` overrides the colour transform that the image states; ``inverted`` says whether
    four inks are stored inverted, by default if the image was marked by the usual program.
    """
    if data[:2] != b"\xff\xd8":
        return None
    quant, codes, frame, interval, adobe = {}, {}, None, 0, None
    for marker, body, after in _segments(data):
        if marker == 0xDB:
            at = 0
            while at < len(body):
                wide = body[at] >> 4
                size = 128 if wide else 64
                quant[body[at] & 15] = np.frombuffer(body[at + 1 : at + 1 + size], dtype=">u2" if wide else np.uint8).astype(np.float64)
                at += 1 + size
        elif marker == 0xC4:
            at = 0
            while at + 17 <= len(body):
                n = sum(body[at + 1 : at + 17])
                codes[body[at]] = _lookup(body[at + 1 : at + 17], body[at + 17 : at + 17 + n])
                at += 17 + n
        elif marker in (0xC0, 0xC1):
            if body[0] != 8:
                return None
            parts = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(body[5])]
            frame = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big"), parts
        elif 0xC0 < marker <= 0xCF and marker != 0xC8 and marker != 0xCC:
            return None
        elif marker == 0xDD:
            interval = int.from_bytes(body[:2], "big")
        elif marker == 0xEE and body[:5] == b"Adobe":
            adobe = body[11]
        elif marker == 0xDA:
            break
    else:
        return None
    if frame is None or not frame[0] or not frame[1] or frame[0] * frame[1] > MAX_PIXELS or body[0] != len(frame[2]):
        return None
    planes = _scan(data[after:], frame, body, quant, codes, interval)
    return _to_luma(planes, adobe if transform is None else transform, adobe is not None if inverted is None else inverted)


def _scan(data: bytes, frame, head: bytes, quant: dict, codes: dict, interval: int) -> list[np.ndarray]:
    """The planes of all components, each in the size of the image."""
    height, width, parts = frame
    tables = {head[1 + 2 * i]: (codes[head[2 + 2 * i] >> 4], codes[0x10 | head[2 + 2 * i] & 15]) for i in range(head[0])}
    most_h, most_v = max(p[1] for p in parts), max(p[2] for p in parts)
    if len(parts) == 1:
        parts, most_h, most_v = [(parts[0][0], 1, 1, parts[0][3])], 1, 1
    across, down = -(-width // (8 * most_h)), -(-height // (8 * most_v))
    blocks = [np.zeros((down * v * across * h, 64)) for _, h, v, _ in parts]
    # restart markers end a stretch of whole bytes; what follows 0xFF 0x00 is data
    end = next((i for i in range(len(data) - 1) if data[i] == 0xFF and data[i + 1] not in (0, *range(0xD0, 0xD8), 0xFF)), len(data))
    stretches, begin = [], 0
    for i in range(end - 1):
        if data[i] == 0xFF and 0xD0 <= data[i + 1] <= 0xD7:
            stretches.append(data[begin:i])
            begin = i + 2
    stretches = [s.replace(b"\xff\x00", b"\xff") for s in [*stretches, data[begin:end]]]
    bits, last, stretch = _Bits(stretches[0]), [0] * len(parts), 0
    for unit in range(across * down):
        if interval and unit and unit % interval == 0:
            stretch += 1
            if stretch >= len(stretches):
                raise ValueError("image data ends early")
            bits, last = _Bits(stretches[stretch]), [0] * len(parts)
        y, x = divmod(unit, across)
        for i, (name, h, v, _) in enumerate(parts):
            dc, ac = tables[name]
            for row in range(v):
                for column in range(h):
                    block = blocks[i][(y * v + row) * across * h + x * h + column]
                    last[i] += bits.signed(bits.code(dc))
                    block[0] = last[i]
                    k = 1
                    while k < 64:
                        symbol = bits.code(ac)
                        size = symbol & 15
                        if not size:
                            if symbol != 0xF0:
                                break
                            k += 16
                            continue
                        k += symbol >> 4
                        if k > 63:
                            raise ValueError("damaged image data")
                        block[k] = bits.signed(size)
                        k += 1
    basis, planes = _idct_matrix(), []
    for own, (_, h, v, q) in zip(blocks, parts, strict=True):
        natural = np.zeros_like(own)
        natural[:, _ZIGZAG] = own * quant[q]
        pixels = basis.T @ natural.reshape(-1, 8, 8) @ basis + 128
        plane = pixels.reshape(down * v, across * h, 8, 8).swapaxes(1, 2).reshape(down * v * 8, across * h * 8)
        plane = np.repeat(np.repeat(plane, most_v // v, axis=0), most_h // h, axis=1)
        planes.append(np.clip(np.round(plane[:height, :width]), 0, 255))
    return planes


def _to_luma(planes: list[np.ndarray], transform: int | None, inverted: bool) -> np.ndarray:
    if len(planes) == 1:
        return planes[0].astype(np.int64)
    colours = planes
    if transform != 0 and (len(planes) == 3 or transform == 2):
        y, b, r = planes[0], planes[1] - 128, planes[2] - 128
        colours = [y + 1.402 * r, y - 0.344136 * b - 0.714136 * r, y + 1.772 * b, *planes[3:]]
        colours = [np.clip(np.round(c), 0, 255) for c in colours]
    if len(colours) == 4:
        # paper minus ink; inverted inks are the paper that is left
        colours = [np.clip(c + colours[3] - 255, 0, 255) if inverted else np.clip(255 - c - colours[3], 0, 255) for c in colours[:3]]
    red, green, blue = (c.astype(np.int64) for c in colours[:3])
    return (299 * red + 587 * green + 114 * blue) // 1000
