"""Interleaved document sequences with media columns.

A page is parsed into an ordered sequence of text and media-reference structs;
references carry a digest and a caption. Payloads live apart, one row per
digest, as lossless 8-bit images; a join on the digest resolves references, so
that positions and captions stay with them and equal media are stored and
measured once.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import table, text_or_empty

WIDTH = 192
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
ITEM = "position int, kind string, text string, digest string, caption string"


def padded(raw: bytes, unit: int = WIDTH) -> bytes:
    """``raw`` and bytes 32 up to a positive multiple of ``unit``."""
    return raw + b" " * (-len(raw) % unit if raw else unit)


def store(payload: bytes) -> bytes:
    """A grey 8-bit PNG of ``WIDTH`` columns whose samples are the payload's bytes."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)
    lines[:, 1:] = rows
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return _SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 4)) + chunk(b"IEND", b"")


def load(media: bytes) -> np.ndarray:
    """The samples of what ``store`` made, rows by columns; every chunk's checksum is verified."""
    if media[:8] != _SIGNATURE:
        raise ValueError("not a PNG")
    at, data, width, height = 8, [], 0, 0
    while at < len(media):
        n = struct.unpack(">I", media[at : at + 4])[0]
        kind, body = media[at + 4 : at + 8], media[at + 8 : at + 8 + n]
        if struct.unpack(">I", media[at + 8 + n : at + 12 + n])[0] != zlib.crc32(kind + body):
            raise ValueError("a damaged chunk")
        if kind == b"IHDR":
            width, height = struct.unpack(">II", body[:8])
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, width + 1)
    if lines[:, 0].any():
        raise ValueError("a row filter that store() does not write")
    return lines[:, 1:]


def feature(samples: np.ndarray) -> str:
    """64 bits, in hex: over an 8 by 9 grid of means, whether each cell is brighter than its right neighbour."""
    h = len(samples)
    cols = np.add.reduceat(samples.astype(np.float64), np.arange(9) * WIDTH // 9, axis=1)
    edges = np.arange(8) * h // 8
    sums = np.vstack([np.zeros(9), np.cumsum(cols, axis=0)])
    ends = np.maximum(edges + 1, np.r_[edges[1:], h])
    grid = (sums[ends] - sums[edges]) / (ends - edges)[:, None]
    return np.packbits(grid[:, :-1] > grid[:, 1:]).tobytes().hex()


# ---------------------------------------------------------------- sequences


#: Elements that end a run of text.
BLOCKS = frozenset(
    "address article aside blockquote body dd details dialog div dl dt fieldset footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section summary table td th tr ul".split()
)


class _Sequence(HTMLParser):
    """Ordered items of a page; a figure's caption goes to all media in it, before or after it, an image without one keeps its alt text."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.words: list[str] = []
        self.figures: list[tuple[list[dict], list[str]]] = []  # media and captions of the figures that are open
        self.caption: list[str] | None = None
        self.mute = 0

    def _flush(self):
        text = " ".join("".join(self.words).split())
        self.words = []
        if text:
            self.items.append({"kind": "text", "text": text, "digest": None, "caption": None})

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag in ("script", "style"):
            self.mute += 1
        elif tag == "figure":
            self._flush()
            self.figures.append(([], []))
        elif tag == "figcaption" and self.figures:
            self._flush()
            self.caption = []
        elif tag in ("img", "video", "audio", "source", "embed") and a.get("src"):
            if self.caption is None:
                self._flush()
            src = a["src"]
            item = {"kind": "media", "text": None, "digest": src[7:] if src.startswith("sha256:") else hashlib.sha256(src.encode("utf-8", "replace")).hexdigest(), "caption": a.get("alt") or None}
            self.items.append(item)
            if self.figures:
                self.figures[-1][0].append(item)
        elif tag == "br":
            self.handle_data(" ")
        elif tag in BLOCKS and self.caption is None:
            self._flush()

    def _end_caption(self):
        if self.caption is not None:
            self.figures[-1][1].append(" ".join("".join(self.caption).split()))
            self.caption = None

    def end_figure(self):
        self._end_caption()
        self._flush()
        media, captions = self.figures.pop()
        said = " ".join(filter(None, captions))
        if said and not media:
            self.items.append({"kind": "text", "text": said, "digest": None, "caption": None})
        for item in media:
            item["caption"] = said or item["caption"]

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.mute = max(0, self.mute - 1)
        elif tag == "figcaption":
            self._end_caption()
        elif tag == "figure" and self.figures:
            self.end_figure()
        elif tag in BLOCKS and self.caption is None:
            self._flush()

    def handle_data(self, data):
        if not self.mute:
            (self.words if self.caption is None else self.caption).append(data)


def sequence_of(html: str | None) -> list[dict]:
    p = _Sequence()
    p.feed(html or "")
    p.close()
    while p.figures:
        p.end_figure()
    p._flush()
    return [{"position": k, **item} for k, item in enumerate(p.items)]


def sequences(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """(``key``, position, kind, text, digest, caption): the items of every page in order. A null or empty page has none."""
    kind = pages.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, *item.values()) for k, h in zip(pdf[key], pdf[html]) for item in sequence_of(h)]
            out = pd.DataFrame(rows, columns=[key, "position", "kind", "text", "digest", "caption"])
            yield out.astype({key: "Int64"}) if kind in ("bigint", "int") else out

    return pages.select(key, html).mapInPandas(run, f"`{key}` {kind}, {ITEM}")


def resolve(items: DataFrame, media: DataFrame) -> DataFrame:
    """Media items joined with their payloads' columns by digest; text items and unknown digests keep nulls there.

    Of rows of ``media`` that share a digest one is taken, so that no item is
    repeated. Items without a digest, which texts are, stay where they are and
    meet nothing; the references of a digest that many rows share are narrow,
    and the join is one that adaptive execution splits.
    """
    there = F.col("digest").isNotNull()
    own = [F.lit(None).cast(f.dataType).alias(f.name) for f in media.schema.fields if f.name != "digest"]
    found = items.where(there).join(media.dropDuplicates(["digest"]), "digest", "left")
    return found.unionByName(items.where(~there).select("*", *own))


# ---------------------------------------------------------------- whole documents as media


def _store(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for text in pdf["text"]:
            payload = padded((text or "").encode("utf-8", "surrogatepass"))
            out.append((hashlib.sha256(payload).hexdigest(), store(payload)))
        yield pd.DataFrame(out, columns=["digest", "media"])


def _measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for digest, media in zip(pdf["digest"], pdf["media"]):
            media = bytes(media)
            samples = load(media)
            read = samples.tobytes()
            out.append((digest, len(read), hashlib.sha256(read).hexdigest(), zlib.crc32(read[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature(samples)))
        yield pd.DataFrame(out, columns=["digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])


def media_table(docs: DataFrame) -> DataFrame:
    """(digest, media): the stored form of every distinct padded text, once."""
    stored = docs.select(text_or_empty().alias("text")).mapInPandas(_store, "digest string, media binary")
    return stored.groupBy("digest").agg(F.first("media").alias("media"))


def measured(media: DataFrame) -> DataFrame:
    """What is computed from the stored bytes, read back."""
    return media.mapInPandas(_measure, "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def document_media(docs: DataFrame) -> DataFrame:
    """Every text of ``docs`` stored as an image, referenced from a page of its own, resolved and measured.

    Null texts are empty; repeated ids and texts each keep their row.
    """
    raw = F.encode(text_or_empty(), "UTF-8")
    n = F.octet_length(text_or_empty())
    gap = F.when(n == 0, WIDTH).otherwise(F.pmod(-n, F.lit(WIDTH))).cast("int")
    digest = F.sha2(F.concat(raw, F.encode(F.repeat(F.lit(" "), gap), "UTF-8")), 256)
    refs = docs.select(F.col("doc_id").cast("long"), n.cast("long").alias("n_bytes"), digest.alias("digest"))
    page = F.concat(F.lit('<figure><img src="sha256:'), "digest", F.lit('"><figcaption>'), F.col("n_bytes").cast("string"), F.lit("</figcaption></figure>"))
    items = sequences(refs.select("doc_id", page.alias("html")), "doc_id").where("kind = 'media'")
    out = items.join(measured(media_table(docs)), "digest", "left")  # one row a digest already
    return out.select("doc_id", F.col("caption").cast("long").alias("n_bytes"), "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position")


def page_media(pages: DataFrame, media: DataFrame) -> DataFrame:
    """(page_id, position, kind, text, digest, caption, payload_bytes, media_sha256): the sequences of pages, their media resolved in a table (digest, media)."""
    return resolve(sequences(pages, "page_id"), measured(media).select("digest", "payload_bytes", "media_sha256")).select(
        "page_id", "position", "kind", "text", "digest", "caption", "payload_bytes", "media_sha256"
    )


def interleaved(docs: DataFrame, every: int = 3, lost: int = 10) -> tuple[DataFrame, DataFrame]:
    """Pages (doc_id, html) and media (digest, media) of documents cut by their own lines.

    Every third line is a figure that refers to the line's stored form, with
    the line's number as caption; blank lines are none. Of the lines, one in
    ``lost`` by its hash has no stored form, so that its references stay open;
    equal lines are one payload with many references.
    """
    lines = F.transform(F.split(text_or_empty(), "\n"), lambda x, i: F.struct(x.alias("line"), i.alias("i")))
    rows = docs.select(F.col("doc_id").cast("long"), F.filter(lines, lambda x: F.trim(x["line"]) != "").alias("lines"))
    gap = lambda x: F.pmod(-F.octet_length(x), F.lit(WIDTH)).cast("int")
    digest = lambda x: F.sha2(F.concat(x, F.repeat(F.lit(" "), gap(x))), 256)
    plain = lambda x: F.replace(F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    figure = lambda x: F.concat(F.lit('<figure><img src="sha256:'), digest(x["line"]), F.lit('"><figcaption>line '), x["i"].cast("string"), F.lit("</figcaption></figure>"))
    part = lambda x: F.when(x["i"] % every == every - 1, figure(x)).otherwise(F.concat(F.lit("<p>"), plain(x["line"]), F.lit("</p>")))
    pages = rows.select("doc_id", F.array_join(F.transform("lines", part), "").alias("html"))
    told = rows.select(F.inline("lines")).where(F.col("i") % every == every - 1).select(F.col("line").alias("text"))
    return pages, media_table(told.where(F.crc32("text") % lost != 0).distinct())


def op6_interleaved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` as pages of text and figures, parsed into sequences whose media are resolved; see ``interleaved``."""
    pages, media = interleaved(table(spark, sf_dir, "documents"))
    items = resolve(sequences(pages, "doc_id"), measured(media).select("digest", "payload_bytes", "payload_sha256"))
    return items.select("doc_id", "position", "kind", "text", "digest", "caption", "payload_bytes", "payload_sha256")


def op6_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``pages`` as sequences of text and media; media are looked up among the stored ``documents``, unknown ones keep nulls."""
    return page_media(table(spark, sf_dir, "pages"), media_table(table(spark, sf_dir, "documents")))


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of ``documents`` stored and read back; see ``document_media``. An empty table gives no rows."""
    return document_media(table(spark, sf_dir, "documents"))
