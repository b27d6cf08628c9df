"""WARC writing and salvage, secret ledger."""

from __future__ import annotations

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from panelkit.llm import secrets, warc
from panelkit.session import work_path

PAGES = "page_id long, url string, html string"


def payloads(events):
    return [(e[3]["warc-record-id"], e[4]) for e in events if e[0] == "record"]


def members(n=6, size=3000):
    rnd = random.Random(0)
    return [warc.member(i, f"http://x/{i}", rnd.randbytes(size).hex().encode(), None, False) for i in range(n)]


def test_undamaged_file():
    m = members()
    got = list(warc.salvage(warc.EMPTY_MEMBER.encode("latin-1").join(m)))
    assert [e[0] for e in got] == ["record"] * 6 and got[0][1] == 0


@pytest.mark.parametrize("damage", ["flip", "cut_inside", "junk_between", "cut_end", "zeros"])
def test_salvage_of_members(damage):
    m = members()
    whole = b"".join(m)
    starts = [sum(map(len, m[:i])) for i in range(7)]
    at = starts[2] + 700
    data, lost, gap = {
        "flip": (whole[:at] + bytes([whole[at] ^ 0x5A]) + whole[at + 1:], {2}, (starts[2], starts[3])),
        "cut_inside": (whole[:at] + whole[at + 100:], {2}, (starts[2], starts[3] - 100)),
        "junk_between": (whole[:starts[2]] + warc.MAGIC + b"junk" * 9 + whole[starts[2]:], set(), (starts[2], starts[2] + 39)),
        "cut_end": (whole[:starts[5] + 50], {5}, (starts[5], starts[5] + 50)),
        "zeros": (b"\0" * 200 + whole, set(), (0, 200)),
    }[damage]
    got = list(warc.salvage(data))
    assert [e[:3] for e in got if e[0] == "gap"] == [("gap", *gap)]
    assert [p[0] for p in payloads(got)] == [f"<{warc.RECORD}{i}>" for i in range(6) if i not in lost]


def test_salvage_of_plain_records():
    import zlib

    plain = [zlib.decompress(m, 31) for m in members(4)]
    data = plain[0] + plain[1][:500] + b"WARC/1.1 not at a line start" + plain[1][500:] + plain[2] + b"tail" + plain[3]
    got = list(warc.salvage(data))
    assert [p[0][-2] for p in payloads(got)] == ["0", "2", "3"]
    assert [e[0] for e in got] == ["record", "gap", "record", "gap", "record"]
    assert sum(e[2] - e[1] for e in got) == len(data)


def test_write_and_read(spark):
    big, other = "é" * 700, "z" * 1000
    rows = [(1, "http://a/ü\r\nX: y", big), (5, None, big), (9, "u", big), (2, "u", other), (3, "u", "small"), (4, "u", "small"), (6, "u", None),
            (None, "u", other), (7, "u", "WARC/1.1\r\n\r\n" * 200), (8, "u", "x" * 400_000), (2, "u", other)]
    df = spark.createDataFrame(rows, PAGES).withColumns({"payload": F.lit(0), "same": F.lit(1)})
    path = work_path(spark, "t-warc")
    warc.write_archives(df, path, archive_bytes=100_000)
    got = warc.read_archives(spark, path, payloads=True).collect()
    assert all(r.kind == "record" for r in got) and len(got) == len(rows)
    want = []
    for i, _, html in rows:
        body = (html or "").encode()
        keep = max(j for j, _, h in rows if j is not None and (h or "").encode() == body)
        again = len(body) >= 1000 and i != keep
        want.append((i, len(body), hashlib.sha1(body).hexdigest(), "revisit" if again else "response", keep if again else None))
    key = lambda r: (r[0] is not None, r[0] or 0, r[2])
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=key) == sorted(want, key=key)
    assert {r.page_id: r.target_uri for r in got}[1] == "http://a/%C3%BC%0D%0AX:%20y"
    empty = work_path(spark, "t-warc")
    warc.write_archives(df.limit(0), empty)
    assert warc.read_archives(spark, empty).count() == 0


# ---- secrets ---------------------------------------------------------------------------------


def base(text):
    """The contract's base findings, by its patterns."""
    out = []
    assign = re.compile(r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    out += [("assign", *m.span()) for m in assign.finditer(text) if len(m[1]) >= 6]
    out += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    order = ("assign", "access", "hex")
    return sorted(out, key=lambda x: (x[1], order.index(x[0])))


def texts():
    rnd = random.Random(2)
    bits = ["password", "PassWd", "secret=", "token", "api_key", "APIKEY", ": ", "=", "\"", "'", " ", "abc", "AKIA", "0123456789abcdef" * 2, "ABCDEFGHIJKLMNOP",
            "é", "🙂", "ſecret=longvalue", "toKen=abcdefg", "token=token: abcdefgh", "f" * 23, "g", "\n", "eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0In0.abcdefghij"]
    return ["".join(rnd.choice(bits) for _ in range(rnd.randrange(1, 40))) for _ in range(1500)]


def test_base_findings_by_definition():
    for t in texts():
        assert [f for f in secrets.find(t) if f[0] in secrets.BASE] == base(t)


def test_ledger_scans_only_the_unseen(spark):
    path = work_path(spark, "t-ledger")
    rows = [(i, t) for i, t in enumerate(texts()[:60])] + [(100, None), (101, ""), (None, "token=abcdefgh"), (3, "token=abcdefgh")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"blob": F.lit(0), "findings": F.lit(1)})
    first = secrets.scan_versions(df.limit(40), path)
    first.count()
    n = spark.read.parquet(path).count()
    assert n == df.limit(40).select(F.coalesce("text", F.lit(""))).distinct().count()
    got = secrets.scan_versions(df, path).collect()
    assert len(got) == len(rows)
    ledger = spark.read.parquet(path)
    assert ledger.count() == ledger.select("blob").distinct().count() == df.select(F.coalesce("text", F.lit(""))).distinct().count()
    found = {(r.doc_id, bytes(r.blob)): [(f.kind, f.start, f.end) for f in r.findings] for r in got}
    for i, t in rows:
        assert found[i, hashlib.sha256((t or "").encode()).digest()] == secrets.find(t or "")
    # another rule version scans everything again
    secrets.scan_versions(df, path, rules="next").count()
    assert spark.read.parquet(path).count() == 2 * ledger.select("blob").distinct().count()
    assert secrets.scan_versions(df.limit(0), work_path(spark, "t-ledger")).count() == 0


def test_added_kinds_keep_base_ones():
    t = "-----BEGIN RSA PRIVATE KEY----- password: hunter22 ghp_" + "a" * 36 + " https://u:p@h/"
    kinds = [f[0] for f in secrets.find(t)]
    assert kinds == ["private_key", "assign", "forge_token", "hex", "url_password"] or set(kinds) >= {"private_key", "assign", "forge_token", "url_password"}
