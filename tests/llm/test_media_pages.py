import hashlib
import html
import re
import struct
import zlib

import pyarrow as pa
from pyspark.sql import functions as F

from phaseloom.llm import media, queries


def words_of(markup):
    """Words of a piece of a page, by patterns alone."""
    inline = re.sub(r"</?(?:b|i|a|em|span)(?:\s[^>]*)?>", "", markup)
    return html.unescape(re.sub(r"<[^>]*>", " ", inline)).split()


def stored(piece):
    """payload, and the PNG that a plain encoder makes of it."""
    raw = piece.encode()
    payload = raw + b"\xff" * ((-len(raw)) % 576 or (0 if raw else 576))
    lines = b"".join(b"\0" + payload[k : k + 576] for k in range(0, len(payload), 576))
    part = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    return payload, b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", 576, len(payload) // 576, 8, 0, 0, 0, 0)) + part(b"IDAT", zlib.compress(lines, 3)) + part(b"IEND", b"")


def pieces_of(page):
    bare = re.sub(r"(?s)<script.*?</script>", lambda m: "\0" * len(m[0]), page)  # what a script writes is no paragraph
    cuts = [m.span() for m in re.finditer(r"</p>", bare)]
    return [page[a:b] for a, b in zip([0] + [e for _, e in cuts], [s for s, _ in cuts] + [len(page)])]


def check(page, items):
    """Each paragraph's words, then its medium, in order; the rest of the page last."""
    items = sorted(items, key=lambda r: r.position)
    assert [r.position for r in items] == list(range(len(items)))
    pieces, at = pieces_of(page), 0
    for n, piece in enumerate(pieces):
        said = []
        while at < len(items) and items[at].kind == "text":
            said += items[at].text.split()
            at += 1
        assert said == words_of(re.sub(r"(?s)<(script|style)[^>]*>.*?</\1>|<!--.*?-->", " ", piece))
        if n < len(pieces) - 1:
            payload, png = stored(piece)
            r, at = items[at], at + 1
            assert r.kind == "media" and r.caption == f"paragraph {n}, {len(piece.encode())} bytes"
            assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
            assert (r.media_bytes, r.media_sha256) == (len(png), hashlib.sha256(png).hexdigest()) and r.feature.startswith(f"gray8 576x{len(payload) // 576} ")
    assert at == len(items)


def test_all_pages_equal_a_plain_reading(spark, small):
    pages = spark.read.parquet(f"{small}/pages.parquet")
    rows = media.page_media(pages).collect()
    by = {}
    for r in rows:
        by.setdefault(r.id, []).append(r)
    known = {r.page_id: r.html for r in pages.collect()}
    assert len({r.payload_sha256 for r in rows if r.kind == "media"}) > len(known)  # several a page
    for page_id, page in known.items():
        check(page, by.get(page_id, []))
    got = queries.media_pages(spark, small)
    assert got.count() == len(rows) and got.filter("page_id is null").count() == 0


def test_odd_pages(spark):
    long = "<p>" + "wort " * 300_000 + "</p>tail"
    rows = [(1, "<p>a</p><p>a</p>x</P >y", 7), (2, None, 7), (3, "", 7), (4, '<script>var t="</p>";</script><p>b</p>', 7), (5, long, 7), (None, "<p>a</p>", 7), (6, "<p>a</p>", 7), (6, "<p>a</p>", 7), (7, "</p></p>", 7)]
    pages = spark.createDataFrame(rows, "page_id long, html string, text int")
    by = {}
    for r in media.page_media(pages).collect():
        by.setdefault(r.id, []).append(r)
    assert 2 not in by and 3 not in by and len(by[None]) == 2 and sorted(r.position for r in by[6]) == [0, 0, 1, 1]
    for k in (4, 5, 7):
        check(dict((r[0], r[1]) for r in rows)[k], by[k])
    assert [(r.kind, r.text) for r in sorted(by[1], key=lambda r: r.position)] == [("text", "a"), ("media", None)] * 2 + [("text", "x"), ("media", None), ("text", "y")]
    assert len({r.payload_sha256 for k in (1, 6) for r in by[k] if r.kind == "media" and "8 bytes" not in r.caption}) <= 2
    assert media.page_media(pages.limit(0)).count() == 0


def test_parts_bound_what_a_task_holds():
    batch = pa.record_batch([pa.array(range(4002)), pa.array(["x" * 1000] * 4000 + [None, "y" * 3_000_000])], names=["id", "h"])
    got = list(media.parts(iter([batch, batch.slice(0, 0)]), 1))
    assert pa.Table.from_batches(got).equals(pa.Table.from_batches([batch]))
    assert len(got) >= 4 and all(sum(len(x.as_py() or "") for x in g.column(1)) <= media.CHUNK + 1000 for g in got if g.num_rows > 1)


def test_facts_are_one_row_for_a_digest_stored_again_and_again(spark, monkeypatch):
    monkeypatch.setattr(media, "DIGESTS", 2)
    payloads = spark.range(600, numPartitions=3).select(media.padded((F.col("id") % 7).cast("string")).alias("payload"))
    assert media.facts(media.store(payloads)).count() == 7
