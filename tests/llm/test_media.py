"""Containers against a reader of their own, and damaged ones."""

from __future__ import annotations

import struct

import numpy as np
import pytest

from deskflow.llm import media


def child(data, *path):
    """The content of the first box along a path, by plain loops."""
    for name in path:
        at = 0
        while True:
            size = int.from_bytes(data[at : at + 4], "big")
            if data[at + 4 : at + 8] == name:
                data = data[at + 8 : at + size]
                break
            at += size
    return data


def numbers(data):
    return list(struct.unpack(f">{len(data) // 4}I", data[: len(data) // 4 * 4]))


@pytest.mark.parametrize("n", [1, 15, 16, 17, 40, 333])
def test_tables_by_another_reader(n):
    data = np.random.default_rng(n).bytes(64 * n)
    stored = media.mux(data)
    table = child(stored, b"moov", b"trak", b"mdia", b"minf", b"stbl")
    sizes, count = numbers(child(table, b"stsz"))[1:3]
    chunks = numbers(child(table, b"stco"))[2:]
    runs = numbers(child(table, b"stsc"))[2:]
    keys = numbers(child(table, b"stss"))[2:]
    held, starts = [], []
    for c, begin in enumerate(chunks):
        m = [runs[i + 1] for i in range(0, len(runs), 3) if runs[i] <= c + 1][-1]
        held += [stored[begin + i * sizes : begin + (i + 1) * sizes] for i in range(m)]
        starts += [begin + i * sizes for i in range(m)]
    assert count == n == len(held) and b"".join(held) == data == media.payload(stored)
    bounds = [starts[k - 1] for k in keys] + [starts[-1] + sizes]
    header = child(stored, b"moov", b"trak", b"mdia", b"mdhd")
    scale, duration = struct.unpack_from(">IQ", header, 20)
    codec = child(table, b"stsd")[12:16].decode()
    assert media.describe(stored) == (codec, duration / scale, list(zip(bounds[:-1], bounds[1:], strict=True)))


def test_damage_has_a_result():
    stored = media.mux(bytes(range(256)) * 8)
    whole = media.describe(stored)
    for cut in range(0, len(stored), 3):
        codec, seconds, ranges = media.describe(stored[:cut])
        assert all(0 <= a <= b <= cut for a, b in ranges) and len(media.payload(stored[:cut])) <= cut
    rng = np.random.default_rng(0)
    for _ in range(400):
        broken = bytearray(stored)
        for at in rng.integers(0, len(stored), 6):
            broken[at] = rng.integers(0, 256)
        codec, seconds, ranges = media.describe(bytes(broken))
        assert isinstance(codec, str) and all(0 <= a <= len(broken) and 0 <= b <= len(broken) for a, b in ranges)
    nested = b""
    for _ in range(2000):
        nested = media.box(b"moov", nested)
    assert media.describe(nested) == ("none", 0.0, []) and media.describe(stored) == whole
    assert media.describe(media.box(b"moov", media.box(b"trak", media.box(b"mdia", media.full(b"mdhd"))))) == ("none", 0.0, [])


def test_compact_sizes_edits_and_fragments():
    data = bytes(range(60))
    for bits, packed in ((4, bytes([0x5A, 0xF0])), (8, bytes([5, 10, 15])), (16, struct.pack(">3H", 5, 10, 15))):
        head = media.box(b"ftyp", b"isom")
        stbl = media.box(
            b"stbl",
            media.full(b"stsd", struct.pack(">I", 1), media.box(b"avc1")),
            media.full(b"stz2", bytes([0, 0, 0, bits]), struct.pack(">I", 3), packed),
            media.full(b"stsc", struct.pack(">I3I", 1, 1, 3, 1)),
            media.full(b"stco", struct.pack(">II", 1, len(head) + 8)),
            media.full(b"stss", struct.pack(">III", 2, 1, 3)),
        )
        mdhd = media.full(b"mdhd", struct.pack(">4I", 0, 0, 10, 30))
        edits = media.box(b"edts", media.full(b"elst", struct.pack(">I", 1), struct.pack(">Iihh", 250, 0, 1, 0)))
        movie = media.box(b"moov", media.full(b"mvhd", struct.pack(">4I", 0, 0, 100, 0)), media.box(b"trak", edits, media.box(b"mdia", mdhd, media.box(b"minf", stbl))))
        stored = head + media.box(b"mdat", data) + movie
        at = len(head) + 8
        assert media.payload(stored) == data[:30] and media.describe(stored) == ("avc1", 2.5, [(at, at + 15), (at + 15, at + 30)])
    trak = media.box(b"trak", media.full(b"tkhd", struct.pack(">3I", 0, 0, 7)), media.box(b"mdia", media.full(b"mdhd", struct.pack(">4I", 0, 0, 10, 0))))
    movie = media.box(b"moov", trak, media.box(b"mvex", media.full(b"trex", struct.pack(">5I", 7, 1, 5, 20, 0x10000))))
    run = struct.pack(">IiI", 3, 0, 0)  # three samples, the first a keyframe
    moof = lambda shift: media.box(b"moof", media.box(b"traf", media.full(b"tfhd", struct.pack(">I", 7)), media.full(b"trun", run[:4], struct.pack(">i", shift), run[8:], flags=5)))
    size = len(moof(0))
    stored = movie + moof(size + 8) + media.box(b"mdat", data) + moof(size + 8) + media.box(b"mdat", data[::-1])
    first = len(movie) + size + 8
    assert media.payload(stored) == data + data[::-1]
    assert media.describe(stored) == ("none", 3.0, [(first, first + 60), (first + 60 + size + 8, first + 120 + size + 8)])
