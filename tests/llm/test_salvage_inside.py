"""Salvage inside gzip members of many records."""

from __future__ import annotations

import random
import zlib

import pytest

from panelkit.llm import warc


def plain(n=8, size=3000):
    rnd = random.Random(0)
    return [zlib.decompress(warc.member(i, f"http://x/{i}", rnd.randbytes(size).hex().encode(), None, False), 31) for i in range(n)]


def packed(data):
    packer = zlib.compressobj(3, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def ids(events):
    return [int(e[3]["warc-record-id"].rstrip(">").rsplit(":", 1)[1]) for e in events if e[0] == "record"]


def test_bad_record_in_a_sound_member():
    r = plain()
    r[3] = r[3][:-100] + b"#" + r[3][-99:]
    got = list(warc.salvage(packed(b"".join(r)) + packed(plain(9)[8])))
    assert ids(got) == [0, 1, 2, 4, 5, 6, 7, 8]
    assert [e[3] for e in got if e[0] == "gap"] == ["record: block digest"]


@pytest.mark.parametrize("damage", ["cut", "flip", "checksum"])
def test_member_that_fails_keeps_its_sound_records(damage):
    whole, after = packed(b"".join(plain())), packed(plain(9)[8])
    half = len(whole) // 2
    data = {
        "cut": whole[:half],
        "flip": whole[:half] + bytes([whole[half] ^ 0x5A]) + whole[half + 1:] + after,
        "checksum": whole[:-8] + bytes([whole[-8] ^ 1]) + whole[-7:] + after,
    }[damage]
    got = list(warc.salvage(data))
    kept = ids(got)
    assert kept[:3] == [0, 1, 2] and (damage == "cut" or kept[-1] == 8)
    assert damage != "checksum" or kept == list(range(9))
    assert [e[0] for e in got].count("gap") == 1


def test_older_versions_after_damage():
    r = [x.replace(b"WARC/1.1", v, 1) for x, v in zip(plain(3), (b"WARC/1.0", b"WARC/0.17", b"WARC/0.18"))]
    assert ids(warc.salvage(b"junk" + r[0] + b"junk\n" + r[1] + b"junk" + r[2])) == [0, 1, 2]
