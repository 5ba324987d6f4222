"""Media columns: HTML as ordered text and media references, payloads stored losslessly and joined by digest."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phaseloom.llm.common import partitions
from phaseloom.llm.textscan import CHUNK, as_bytes, give_back

#: Bytes of a row of samples; payloads are padded to whole rows.
WIDTH = 576
_HEAD = b"\x89PNG\r\n\x1a\n"  # fixed value of the PNG format
_SILENT = {"script", "style", "noscript", "template"}
_BREAKS = {"p", "div", "br", "li", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "table", "tr", "td", "article", "section", "figure", "figcaption", "blockquote", "pre", "nav", "title"}
_MEDIA = {"img", "video", "audio", "source", "embed"}
#: So many digests at most are held by a task that stores media.
DIGESTS = 1 << 16
ITEM = "position:int,kind:string,text:string,ref:string,caption:string"


class _Sequence(HTMLParser):
    """Collects text blocks and media references in the order in which they stand."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.words: list[str] = []
        self.silent = 0
        self.figure: list[int] | None = None  # places of the media in the open figure
        self.caption: list[str] | None = None

    def flush(self) -> None:
        text = " ".join("".join(self.words).split())
        self.words.clear()
        if text:
            self.items.append({"kind": "text", "text": text, "ref": None, "caption": None})

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in _SILENT:
            self.silent += 1
        if tag in _BREAKS or tag in _MEDIA:
            if self.caption is None:
                self.flush()
        if tag == "figure":
            self.figure = []
        elif tag == "figcaption":
            self.caption = []
        elif tag in _MEDIA:
            found = dict(attrs)
            if found.get("src"):
                if self.figure is not None:
                    self.figure.append(len(self.items))
                self.items.append({"kind": "media", "text": None, "ref": found["src"], "caption": found.get("alt") or None})

    def handle_endtag(self, tag: str) -> None:
        if tag in _SILENT and self.silent:
            self.silent -= 1
        if tag == "figcaption" and self.caption is not None:
            text = " ".join("".join(self.caption).split())
            for at in self.figure or []:
                self.items[at]["caption"] = text or self.items[at]["caption"]
            self.caption = None
        elif tag == "figure":
            self.figure = None
        if tag in _BREAKS and self.caption is None:
            self.flush()

    def handle_data(self, data: str) -> None:
        if not self.silent:
            (self.words if self.caption is None else self.caption).append(data)


def parse_sequence(html: str) -> list[dict]:
    """The items of a page; positions count from 0. Broken markup is read as far as it makes sense, never refused."""
    parser = _Sequence()
    parser.feed(html)
    parser.close()
    parser.flush()
    return [{"position": i, **x} for i, x in enumerate(parser.items)]


def parts(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """Rows of the batches, about `CHUNK` bytes of a column at a time, so that what is made of them does not grow with a batch; a longer row begins a part of its own."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(np.diff(np.cumsum(size, dtype=np.int64) // CHUNK)) + 1).tolist(), batch.num_rows]
        for low, high in zip(cuts[:-1], cuts[1:], strict=True):
            yield batch.slice(low, high - low)
        give_back()


def sequences(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """id and items of every row: items are structs (position, kind, text, ref, caption), kind `text` or `media`, in page order.

    A caption is the figure's, or else the medium's alternative text. Scripts and styles are no text. A null or empty page has no
    items; repeated rows stay; an empty table gives no rows; other columns are ignored.
    """
    item = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("ref", pa.string()), ("caption", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, 1):
            items = [parse_sequence(x or "") for x in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(items, item)], names=["id", "items"])

    kind = dict(pages.dtypes)[id_col]
    return pages.select(F.col(id_col).alias("id"), F.col(html_col).cast("string").alias("h")).mapInArrow(run, f"id {kind}, items array<struct<{ITEM}>>")


def to_png(payload: bytes, level: int = 3) -> bytes:
    """An 8-bit grey PNG of `WIDTH` columns whose samples are the payload; its length must be a positive multiple of `WIDTH`."""
    height = len(payload) // WIDTH
    rows = np.zeros((height, WIDTH + 1), np.uint8)
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(height, WIDTH)

    def part(name: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))

    head = struct.pack(">IIBBBBB", WIDTH, height, 8, 0, 0, 0, 0)
    return _HEAD + part(b"IHDR", head) + part(b"IDAT", zlib.compress(rows.tobytes(), level)) + part(b"IEND", b"")


def from_png(data: bytes) -> np.ndarray:
    """The samples of such a PNG as (rows, columns); a damaged part is an error."""
    if data[:8] != _HEAD:
        raise ValueError("not a PNG")
    at, width, height, packed = 8, 0, 0, []
    while at < len(data):
        (size,), name = struct.unpack(">I", data[at : at + 4]), data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + size]
        if zlib.crc32(name + body) != struct.unpack(">I", data[at + 8 + size : at + 12 + size])[0]:
            raise ValueError("damaged part")
        if name == b"IHDR":
            width, height = struct.unpack(">II", body[:8])
        elif name == b"IDAT":
            packed.append(body)
        at += 12 + size
    rows = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, width + 1)
    if rows[:, 0].any():
        raise ValueError("filtered rows are not written here")
    return rows[:, 1:]


def padded(text: Column) -> Column:
    """UTF-8 of a text (null: empty) and bytes 255 up to a positive multiple of `WIDTH`."""
    raw = F.coalesce(text.cast("string"), F.lit("")).cast("binary")
    rows = F.greatest(F.ceil(F.octet_length(raw) / WIDTH), F.lit(1))
    return F.concat(raw, F.substring(F.unhex(F.lit("ff" * WIDTH)), F.lit(1), (rows * WIDTH - F.octet_length(raw)).cast("int")))


def feature(samples: np.ndarray) -> str:
    """Size, mean, deviation and a hash of which parts of the picture are lighter than it is on average."""
    flat = samples.reshape(-1)
    cells = np.add.reduceat(flat.astype(np.float64), np.arange(64) * len(flat) // 64)
    sizes = np.diff(np.append(np.arange(64) * len(flat) // 64, len(flat)))
    light = np.packbits(cells / sizes > flat.mean()).tobytes().hex()
    return f"gray8 {samples.shape[1]}x{samples.shape[0]} mean={flat.mean():.4f} std={flat.std():.4f} light={light}"


MEDIA = "digest binary, media binary"
FACTS = "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def store(payloads: DataFrame, payload_col: str = "payload") -> DataFrame:
    """digest (SHA-256) and media (PNG) of payloads; equal payloads of one task are stored once, unless `DIGESTS` others lie between. Lengths must be positive multiples of `WIDTH`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in parts(batches, 0):
            rows = []
            for payload in as_bytes(batch.column(0)):
                digest = hashlib.sha256(payload).digest()
                if digest not in seen:
                    if len(seen) >= DIGESTS:
                        seen.clear()
                    seen.add(digest)
                    rows.append((digest, to_png(payload)))
            yield pa.record_batch([pa.array([r[i] for r in rows], pa.binary()) for i in (0, 1)], names=["digest", "media"])

    return payloads.select(payload_col).mapInArrow(run, MEDIA)


def facts(media: DataFrame) -> DataFrame:
    """What is read back from stored media, one row for each digest (in hex): sizes, hashes of payload and file, tail CRC and feature.

    Equal digests lie side by side, so a task remembers one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in parts(batches, 1):
            rows = []
            for digest, data in zip(as_bytes(batch.column(0)), as_bytes(batch.column(1)), strict=True):
                if digest == last:
                    continue
                last = digest
                samples = from_png(data)
                payload = samples.tobytes()
                rows.append((digest.hex(), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data), hashlib.sha256(data).hexdigest(), feature(samples)))
            types = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            names = ["digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            yield pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)

    spread = media.repartition(partitions(media.sparkSession), "digest").sortWithinPartitions("digest")
    return spread.mapInArrow(run, FACTS)


def resolved(items: DataFrame, known: DataFrame) -> DataFrame:
    """The items of `sequences`, one row each, with what is known of their media: id, position, kind, text, ref, caption and facts.

    A reference is `media:` and a digest in hex. Text and references that are not stored stay, with null facts, so positions
    and captions keep their places.
    """
    each = items.select("id", F.explode("items").alias("item")).select("id", "item.*")
    digest = F.when(F.col("ref").startswith("media:"), F.substr("ref", F.lit(7)))
    return each.withColumn("digest", digest).join(known, "digest", "left").drop("digest")


def document_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document as a page that shows its own text as a medium: id, n_bytes and the facts of the stored medium.

    The text's payload is stored by digest, the page refers to it by digest and carries n_bytes as caption; parsing the page and
    resolving its reference brings both together. Null texts count as empty; rows that share an id give one row each; an empty
    table gives no rows; other columns are ignored.
    """
    base = docs.select(F.col(id_col).cast("long").alias("id"), padded(F.col(text_col)).alias("payload"), F.coalesce(F.octet_length(F.col(text_col).cast("string")), F.lit(0)).alias("n"))
    html = F.concat(F.lit('<article><p>document</p><figure><img src="media:'), F.sha2("payload", 256), F.lit('"><figcaption>'), F.col("n").cast("string"), F.lit(" bytes</figcaption></figure></article>"))
    items = sequences(base.select("id", html.alias("html")), "id", "html")
    found = resolved(items, facts(store(base))).filter("kind = 'media'")
    n_bytes = F.split_part("caption", F.lit(" "), F.lit(1)).cast("long")
    return found.select(F.col("id").alias("doc_id"), n_bytes.alias("n_bytes"), "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


#: The end of a paragraph, but not one that a script writes.
PARAGRAPH_END = r"(?i)</p\s*>(?![^<]*</script)"


def page_media(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Real pages with a medium after each paragraph: id, position, kind, text, caption and the facts of stored media, one row for each item of a page.

    A paragraph's medium is the payload of its own markup, stored by digest; the page gets a figure that refers to it, with the paragraph's number and bytes as caption. Pages are then
    parsed as they come, texts and figures in their order, and all references are resolved in one digest join, so equal paragraphs of any pages share one medium. What stands after the
    last paragraph has no medium. A null or empty page has no items; rows that share an id give their items each; other columns are ignored; an empty table gives no rows.
    """
    pieces = F.split(F.coalesce(F.col(html_col).cast("string"), F.lit("")), PARAGRAPH_END)
    base = pages.select(F.col(id_col).alias("id"), pieces.alias("pieces"))

    def figure(piece: Column, n: Column) -> Column:
        caption = F.concat(F.lit("paragraph "), n.cast("string"), F.lit(", "), F.octet_length(piece).cast("string"), F.lit(" bytes"))
        shown = F.concat(F.lit('</p><figure><img alt="" src="media:'), F.sha2(padded(piece), 256), F.lit('"><figcaption>'), caption, F.lit("</figcaption></figure>"))
        return F.concat(piece, F.when(n < F.size("pieces") - 1, shown).otherwise(""))

    html = F.array_join(F.transform("pieces", figure), "")
    payloads = base.select(F.explode(F.slice("pieces", F.lit(1), F.size("pieces") - 1)).alias("piece")).select(padded(F.col("piece")).alias("payload"))
    found = resolved(sequences(base.select("id", html.alias("html")), "id", "html"), facts(store(payloads)))
    return found.select("id", "position", "kind", "text", "caption", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
