import hashlib
import random
from pathlib import Path

import pytest

from marlstone.llm import warc

FAKE = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:999>\r\nContent-Type: text/html\r\nContent-Length: 5\r\n\r\nhello"
KIND = "page_id long, url string, html string"


def chain(data: bytes):
    """The records of an archive, from the first byte on: (headers, block)."""
    at, out = 0, []
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        head = dict(x.split(": ", 1) for x in data[at:end].decode().split("\r\n")[1:])
        size = int(head["Content-Length"])
        out.append((head, data[end + 4 : end + 4 + size]))
        at = end + 4 + size + 4
    return out


def by_hand(rows):
    first = {}
    for i, _, html in rows:
        if len((html or "").encode()) >= 100 and i is not None:
            first[html] = min(i, first.get(html, i))
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        again = len(data) >= 100 and first.get(html) != i
        out.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first.get(html) if again else None))
    return sorted(out, key=str)


def check(spark, rows, split=None):
    names = "spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"
    before = [spark.conf.get(n) for n in names]
    try:
        if split:
            for n in names:
                spark.conf.set(n, str(split))
        got = warc.archived_pages(spark.createDataFrame(rows, KIND).repartition(2)).collect()
    finally:
        for n, v in zip(names, before):
            spark.conf.set(n, v)
    assert all(r.intact for r in got)
    assert sorted((tuple(r[:5]) for r in got), key=str) == by_hand(rows)
    return got


ODD = [
    (1, "http://a.example/x", "short"),
    (2, None, None),
    (3, "", ""),
    (None, "http://b.example/ \r\nWARC-Type: x", "null id " * 20),
    (4, "http://c.example", "x" * 99),
    (5, "http://c.example", "x" * 99),
    (9, "u", "y" * 100),
    (6, "u", "y" * 100),
    (8, "u", "y" * 100),
    (10, "u", "é" * 50),
    (11, "u", "é" * 50),
    (12, "u", "\r\n\r\n" + FAKE + "\r\n\r\n" + FAKE),
    (13, "u", "\r\n\r\n".join([FAKE] * 40)),
    (14, "u", "WARC/1.1\r\nContent-Length: 0"),
    (15, "u", "\r\n\r\nWARC/1."),
    (16, "u", "\r\n\r\n\r\n\r\n"),
    (17, "u", "end\r\n\r\n"),
    (18, "u", "\r\r\n\r\n\r\nWARC/1.WARC/1.0\r\n\r\nWARC/1.0"),
    (19, "u", "long " * 2_000),
    (20, "u", "\x00\x01 binary-like ﻿   \U0001f600" * 10),
    (21, "u", "\r\n\r\nWARC/1.1\r\nContent-Length: 99999999\r\n\r\n"),
]


@pytest.mark.parametrize("split", [None, 150, 4096])
def test_pages_survive_the_archive(spark, split):
    check(spark, ODD + [(22, "u", "\r\n\r\nWARC/1.1\r\n" * 30)], split)


def test_random_payloads_of_boundary_parts(spark):
    rng = random.Random(5)
    parts = ["\r\n", "\r", "\n", "\r\n\r\n", "WARC/1.", "WARC/1.0\r\n", "Content-Length: 3\r\n", "abc", FAKE, "\r\n\r\n" + FAKE]
    rows = [(i, "u", "".join(rng.choice(parts) for _ in range(rng.randrange(30)))) for i in range(150)]
    check(spark, rows + rows[:20], 1499)


def test_copies_are_written_once(spark, tmp_path):
    page = "copied " * 30
    rows = [(i, "u", page) for i in range(200, 0, -1)] + [(500, "u", "other " * 30)] + [(1, "u", page)]
    got = check(spark, rows)
    assert sum(r.record_type == "response" for r in got) == 3
    warc.write_archives(spark.createDataFrame(rows, KIND), str(tmp_path / "a"))
    records = [x for p in Path(tmp_path / "a").glob("part-*") for x in chain(p.read_bytes())]
    assert len(records) == len(rows) and sum(page.encode() in block for _, block in records) == 2
    assert {h["WARC-Refers-To"] for h, _ in records if h["WARC-Type"] == "revisit"} == {"<urn:page:1>"}


def test_many_copied_payloads_are_joined(spark, monkeypatch):
    monkeypatch.setattr(warc, "FEW", 0)
    check(spark, ODD, 2000)


def test_no_pages_and_the_table(spark):
    check(spark, [])
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    check(spark, [tuple(r) for r in pages.select("page_id", "url", "html").collect()], 100_000)


def record(kind, block, **more):
    head = {"WARC-Type": kind, **{k.replace("_", "-"): v for k, v in more.items()}, "Content-Length": str(len(block))}
    return b"WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block


def test_archives_of_others(spark, tmp_path):
    """Other kinds of records, a block that begins with the magic, bytes that are no text, a record that is cut short and a file that is no archive."""
    good = [record("warcinfo", b"software: x\r\n"), record("resource", b"WARC/1.0\r\nContent-Length: 1\r\n\r\nx"), record("resource", bytes(range(256)) * 3, content_type="image/png")]
    (tmp_path / "a.warc").write_bytes(b"".join(r + b"\r\n\r\n" for r in good))
    (tmp_path / "b.warc").write_bytes(good[2] + b"\r\n\r\n" + record("resource", b"z" * 500)[:-100])
    (tmp_path / "c.warc").write_bytes(b"no archive\r\n\r\n" + good[0] + b"\r\n\r\n")
    got = {(r.file.rsplit("/", 1)[1], r.offset): (r.type, r.payload_bytes, r.payload_sha256, r.intact) for r in warc.read_archives(spark, str(tmp_path)).collect()}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    image = ("resource", 768, sha(bytes(range(256)) * 3), True)
    at = [0, len(good[0]) + 4, len(good[0]) + len(good[1]) + 8]
    inner = b"WARC/1.0\r\nContent-Length: 1\r\n\r\nx"
    assert got == {
        ("a.warc", at[0]): ("warcinfo", 13, sha(b"software: x\r\n"), True),
        ("a.warc", at[1]): ("resource", len(inner), sha(inner), True),
        ("a.warc", at[2]): image,
        ("b.warc", 0): image,
        ("b.warc", len(good[2]) + 4): ("resource", 400, sha(b"z" * 400), False),
    }
