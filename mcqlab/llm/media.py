"""Media columns: texts as progressive JPEGs, and features of JPEGs.

Defined results: a null text counts as empty; an empty text is 192 spaces; equal
texts have equal values; very long texts are one picture each; other columns are
left out unless named in ``keep``.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from mcqlab.llm import jpeg
from mcqlab.llm.common import without

FIELDS = (
    ("n_bytes", "long", pa.int64()), ("payload_bytes", "long", pa.int64()), ("payload_sha256", "string", pa.string()), ("tail_crc32", "long", pa.int64()),
    ("media_bytes", "long", pa.int64()), ("media_sha256", "string", pa.string()), ("feature", "string", pa.string()),
)
MEDIA = (("media", "binary", pa.binary()), ("height", "int", pa.int32()), ("width", "int", pa.int32()), ("rgb", "binary", pa.binary()))


def feature_of(pixels: np.ndarray) -> str:
    """Height, width, and the mean and standard deviation of each colour."""
    flat = pixels.reshape(-1, 3)
    means = flat.sum(0, dtype=np.int64) / len(flat)
    spread = np.sqrt(np.maximum((flat.astype(np.uint32) ** 2).sum(0, dtype=np.int64) / len(flat) - means**2, 0))
    return f"{pixels.shape[0]}x{pixels.shape[1]}:" + ",".join(f"{m:.2f}" for m in (*means, *spread))


def media_of(text: str | None) -> tuple:
    """The values of FIELDS and MEDIA."""
    raw = (text or "").encode()
    padded = raw + b" " * ((-len(raw)) % jpeg.UNIT if raw else jpeg.UNIT)
    media = jpeg.store(np.frombuffer(padded, np.uint8))
    picture = jpeg.decode(media)
    payload = jpeg.payload_of(picture).tobytes()
    pixels = jpeg.rgb(picture)
    digests = len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature_of(pixels)
    return *digests, media, pixels.shape[0], pixels.shape[1], pixels


def media_columns(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), with_media: bool = False) -> DataFrame:
    """docs -> the kept columns, digests and features; with_media: the JPEG and its full-resolution RGB tensor too.

    A kept column gives way to a result of its name.
    """
    fields = FIELDS + (MEDIA if with_media else ())
    kept = docs.select(*without(keep, [n for n, _, _ in fields]), docs[text].alias("_text"))
    schema = ", ".join([f"`{c}` {kind}" for c, kind in kept.dtypes[:-1]] + [f"{n} {kind}" for n, kind, _ in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = 16 if with_media else 1024
        seen: dict[str, tuple] = {}  # short-lived: copies often stand near each other
        held = 0  # characters of the texts in it
        for whole in batches:
            for k in range(0, whole.num_rows, step):
                b, out = whole.slice(k, step), []
                for text in b.column(b.num_columns - 1).to_pylist():
                    if with_media:
                        *head, pixels = media_of(text)
                        out.append((*head, pixels.tobytes()))
                        continue
                    if text not in seen:
                        held += len(text or "")
                        if held > 8_000_000:
                            seen.clear()
                            held = len(text or "")
                        seen[text] = media_of(text)[: len(FIELDS)]
                    out.append(seen[text])
                made = [pa.array(v, kind) for v, (_, _, kind) in zip(zip(*out), fields, strict=True)]
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], *made], [*b.schema.names[:-1], *(n for n, _, _ in fields)])

    return kept.mapInArrow(run, schema)
