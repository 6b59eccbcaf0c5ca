"""SQLite databases in write-ahead-log mode, read from their bytes: committed frames of the log are laid over the pages."""

from __future__ import annotations

import struct

# fixed values of the file format: first bytes of a log (words of the checksum in little or big byte order)
_MAGIC = {0x377F0682: "<", 0x377F0683: ">"}
_HEAD, _FRAME = 32, 24
_WORD = 0xFFFFFFFF


def _checksum(data: bytes, order: str, a: int, b: int) -> tuple[int, int]:
    for x, y in struct.iter_unpack(order + "II", data):
        a = (a + x + b) & _WORD
        b = (b + y + a) & _WORD
    return a, b


def committed_pages(log: bytes) -> tuple[int, int, dict[int, bytes]]:
    """(page size, pages of the database, newest committed content per page number) of a log; (0, 0, {}) if nothing is committed.

    Frames count up to the last commit of the current run of the log: the first one whose salt or checksum does not fit
    was left by an earlier run or is still being written.
    """
    if len(log) < _HEAD:
        return 0, 0, {}
    magic, _, size, _, *salt, a, b = struct.unpack(">8I", log[:_HEAD])
    order = _MAGIC.get(magic)
    if order is None or not 512 <= size <= 65536 or size & (size - 1) or _checksum(log[:24], order, 0, 0) != (a, b):
        return 0, 0, {}
    pages: dict[int, bytes] = {}
    open_: dict[int, bytes] = {}
    count = 0
    for at in range(_HEAD, len(log) - _FRAME - size + 1, _FRAME + size):
        number, total, *mine, c, d = struct.unpack(">6I", log[at:at + _FRAME])
        page = log[at + _FRAME:at + _FRAME + size]
        a, b = _checksum(log[at:at + 8], order, a, b)
        a, b = _checksum(page, order, a, b)
        if mine != salt or (a, b) != (c, d) or not number:
            break
        open_[number] = page
        if total:  # the commit mark
            pages |= open_
            count, open_ = total, {}
    return size, count, pages


def with_log(data: bytes, log: bytes | None) -> bytes:
    """Content of a database as a reader sees it now, with its log merged in and the mark of its mode set to the plain one."""
    size, count, pages = committed_pages(log or b"")
    if not pages and data[18:20] != b"\x02\x02":
        return data
    out = bytearray(data)
    if pages:
        out = out[: size * count].ljust(size * count, b"\0")
        for number, page in pages.items():
            if number <= count:
                out[(number - 1) * size:number * size] = page
    out[18:20] = b"\x01\x01"
    return bytes(out)
