"""Operator 9: WARC archives as seekable Zstandard bundles.

Records are grouped into independent Zstandard frames; a bundle is a file of frames with a seek table (the public seekable
format: a skippable frame with the frames' compressed and plain sizes) as its footer. A manifest maps each record to bundle,
frame and offset within the frame, so one record is read by one small range read.

Of records with equal payloads of at least `min_payload` bytes, the one with the largest id is the response, all others
revisit it. Bundles go to the shared folder under names that no other attempt uses; only bundles in the
manifest count, so lost or repeated tasks do no harm.

Empty cases: null html is an empty payload, a null url an empty target. Rows with the same id are archived each; those
that equal the kept one in id and payload are responses too. A null id is archived under none, and nothing refers to it. Payloads of any
length are one record in a frame of its own. An empty table makes no bundle. Other columns never meet the operator's names, since it takes only
page_id, url and html.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

FRAME_BYTES = 256 * 1024
BUNDLE_BYTES = 64 * 1024 * 1024
#: Fixed values of the seekable Zstandard format.
SKIPPABLE_MAGIC, SEEKABLE_MAGIC = 0x184D2A5E, 0x8F92EAB1


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """frames: (compressed, plain) sizes."""
    entries = b"".join(struct.pack("<II", c, d) for c, d in frames)
    footer = struct.pack("<IBI", len(frames), 0, SEEKABLE_MAGIC)
    return struct.pack("<II", SKIPPABLE_MAGIC, len(entries) + len(footer)) + entries + footer


def read_seek_table(tail: bytes) -> list[tuple[int, int]]:
    """From the last bytes of a bundle (all of its footer)."""
    count, _, magic = struct.unpack("<IBI", tail[-9:])
    if magic != SEEKABLE_MAGIC:
        raise ValueError("no seek table")
    entries = tail[-9 - 8 * count : -9]
    return [struct.unpack_from("<II", entries, 8 * k) for k in range(count)]


def record(page_id, url: str, payload: bytes, refers_to, refers_url: str) -> bytes:
    """One WARC/1.1 record. The fields that depend on the run (dates, random ids) are derived from the input instead."""
    kind = "response" if refers_to is None else "revisit"
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{page_id}>",
        f"WARC-Target-URI: {url}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest32(payload)}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if refers_to is not None:
        lines += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: <urn:page:{refers_to}>",
        ]
    body = b"" if refers_to is not None else payload
    lines += ["Content-Type: text/html", f"Content-Length: {len(body)}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode("utf-8", "surrogatepass") + body + b"\r\n\r\n"


def parse(buffer: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """Header fields, body, and where the next record begins."""
    end = buffer.index(b"\r\n\r\n", at)
    first, *lines = buffer[at:end].decode("utf-8", "surrogatepass").split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines)
    start = end + 4
    stop = start + int(fields["Content-Length"])
    return fields, buffer[start:stop], stop + 4


@dataclass
class Bundle:
    """Frames as they fill, and where each record lies."""

    level: int = 6
    plain: bytearray = field(default_factory=bytearray)
    data: bytearray = field(default_factory=bytearray)
    frames: list[tuple[int, int]] = field(default_factory=list)
    records: list[tuple] = field(default_factory=list)

    def add(self, key, blob: bytes) -> None:
        if self.plain and len(self.plain) + len(blob) > FRAME_BYTES:
            self.close_frame()
        self.records.append((key, len(self.frames), len(self.data), len(self.plain), len(blob)))
        self.plain += blob

    def close_frame(self) -> None:
        import zstandard

        if self.plain:
            packed = zstandard.ZstdCompressor(level=self.level).compress(bytes(self.plain))
            self.frames.append((len(packed), len(self.plain)))
            self.data += packed
            self.plain.clear()

    def done(self) -> bytes:
        self.close_frame()
        return bytes(self.data) + seek_table(self.frames)


def _store(folder: str):
    """File system and path of a folder, as the workers see them."""
    from pyarrow import fs

    found, path = fs.FileSystem.from_uri(folder if "://" in folder else folder.replace("file:", "file://", 1))
    found.create_dir(path, recursive=True)
    return found, path


MANIFEST = "page_id long, bundle string, frame int, frame_at long, frame_bytes long, offset long, length long"


def decided(pages: DataFrame, min_payload: int = 0) -> DataFrame:
    """page_id, url, html (never null), refers_to. Who revisits whom is decided on ids and digests alone; pages are then joined by (id, digest) to
    the revisits, so that copies of one payload do not meet in one task."""
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    own = own.withColumns({"sha": F.unhex(F.sha1(F.col("html").cast("binary"))), "size": F.octet_length("html")})
    ids = common.materialize(own.where(F.col("size") >= min_payload).select("page_id", "sha"))
    shared = ids.groupBy("sha").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n")).where("n > 1").select("sha", "keeper")
    revisits = ids.join(shared, "sha").where("NOT page_id <=> keeper").distinct().select("page_id", "sha", F.col("keeper").alias("refers_to"))
    same = F.col("o.page_id").eqNullSafe(F.col("r.page_id")) & (F.col("o.sha") == F.col("r.sha"))
    return own.alias("o").join(revisits.alias("r"), same, "left").select("o.page_id", "url", "html", "refers_to")


def write(rows: DataFrame, folder: str) -> DataFrame:
    """rows: page_id, url, html, refers_to. Writes bundles below folder and returns their manifest, which is itself
    written once: bundles of attempts that did not make it into the manifest are never read."""

    def run(batches):
        import uuid

        import pandas as pd

        store, path = _store(folder)

        def put(b):
            name = f"{uuid.uuid4().hex}.warc.zst"
            data = b.done()
            with store.open_output_stream(f"{path}/{name}", compression=None) as out:
                out.write(data)
            rows = [(key, name, frame, at, b.frames[frame][0], offset, length) for key, frame, at, offset, length in b.records]
            return pd.DataFrame(rows, columns=[x.split()[0] for x in MANIFEST.split(", ")])

        bundle = Bundle()
        for pdf in batches:
            for page_id, url, html, refers_to in zip(pdf["page_id"].array, pdf["url"], pdf["html"], pdf["refers_to"], strict=True):
                to = None if pd.isna(refers_to) else int(refers_to)
                bundle.add(page_id, record("" if pd.isna(page_id) else page_id, url.replace("\r", "%0D").replace("\n", "%0A"), html.encode("utf-8", "surrogatepass"), to, ""))
                if len(bundle.data) >= BUNDLE_BYTES:
                    yield put(bundle)
                    bundle = Bundle()
        if bundle.records:
            yield put(bundle)

    text = rows.select("page_id", "url", "html", F.col("refers_to").cast("string").alias("refers_to"))
    return common.materialize(text.mapInPandas(run, MANIFEST))


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, body: read from the bundles, frame by frame.
    A frame is the unit of work, so bundles spread over tasks."""
    frames = manifest.groupBy("bundle", "frame").agg(
        F.first("frame_at").alias("frame_at"), F.first("frame_bytes").alias("frame_bytes"), F.sort_array(F.collect_list(F.struct("offset", "page_id"))).alias("records")
    )  # a frame holds FRAME_BYTES of records or one longer record

    def run(batches):
        import pandas as pd
        import zstandard

        store, path = _store(folder)
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                with store.open_input_file(f"{path}/{r.bundle}") as f:
                    f.seek(int(r.frame_at))
                    plain = zstandard.ZstdDecompressor().decompress(f.read(int(r.frame_bytes)))
                for x in r.records:
                    fields, body, _ = parse(plain, x["offset"])
                    own, to = fields["WARC-Record-ID"][10:-1], fields.get("WARC-Refers-To")
                    payload, size = fields["WARC-Payload-Digest"][5:], int(fields["X-Payload-Length"])
                    if fields["WARC-Type"] == "response" and (digest32(body), len(body)) != (payload, size):
                        raise ValueError(f"record {own} is damaged")
                    out.append((int(own) if own else None, size, payload, fields["WARC-Type"], int(to[10:-1]) if to else None, body))
            if not out:
                continue
            yield pd.DataFrame({k: pd.array(v, dtype="Int64") if k in ("page_id", "refers_to") else list(v) for k, v in zip(("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "body"), zip(*out, strict=True), strict=True)})

    return frames.mapInPandas(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, body binary")


def op9_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bundles go with the application; `write` into a folder of one's own keeps them."""
    folder = common.shared_dir(spark)
    manifest = write(decided(common.table(spark, sf_dir, "pages")), folder)
    return read(manifest, folder).drop("body")


#: DuckDB has no base32; five bits of the hexadecimal digest's number at a time are looked up.
_DIGIT = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (('0x' || substr(h, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4)))::INTEGER % 32, 1)"
SQL = f"""
WITH own AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
judged AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, h, max(page_id) OVER (PARTITION BY h) AS keeper FROM own)
SELECT page_id, payload_bytes, list_aggregate(list_transform(range(32), lambda i: {_DIGIT}), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type, nullif(keeper, page_id) AS refers_to
FROM judged
"""
