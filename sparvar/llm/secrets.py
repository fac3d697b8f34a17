"""Secret scan with multipart credential linking.

Base secrets are found by pattern alone and always reported.  Weak parts (account names,
opaque keys, endpoints) say nothing alone: an interval join of all parts of a document
reports a weak part only where a complementary part stands within ``SCOPE`` code points,
an identifier by a secret, a secret by an identifier or endpoint, an endpoint by both.
Parts are joined on (document, cell of ``SCOPE`` code points) and each part is put into
the cells next to its own, so no pair of far parts is made and a cell's parts are
bounded by its length.

Offsets are code points, ends exclusive.  Defined results: null is the empty text; rows
sharing an id are told apart by the checksum of their text, and repeated rows each get
the same row; a row without id is scanned and linked like any other.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCOPE = 200
#: In order of report; the first three are base kinds.
KINDS = ["assign", "access", "hex", "account", "opaque", "endpoint"]
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
#: A run that fails its length leaves no later match within it, so the length may stand in the pattern.
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
ACCOUNT = re.compile(r"""\b(?:user(?:name)?|login|account|client_id|access_key_id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{3,}""", re.ASCII | re.IGNORECASE)
#: Twenty or more characters with a digit, a small and a capital letter among them.
OPAQUE = re.compile(r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])(?=[0-9A-Z+/_=-]*[a-z])(?=[0-9a-z+/_=-]*[A-Z])[A-Za-z0-9+/_=-]{20,}")
ENDPOINT = re.compile(r"""(?:https?|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp|s3)://[^\x00-\x20"'<>\x7F]+""")

_CALLS = re.compile(r"pass|secret|token|api", re.ASCII | re.IGNORECASE)
_SPAN = T.StructType([T.StructField("s", T.IntegerType()), T.StructField("k", T.IntegerType()), T.StructField("e", T.IntegerType())])


def scan_text(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans and weak parts of one text as (start, kind, end)."""
    base = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6] if _CALLS.search(text) else []
    if "AKIA" in text:
        base += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    base += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    weak = []
    if ":" in text or "=" in text:
        weak += [(m.start(), 3, m.end()) for m in ACCOUNT.finditer(text)]
    if "://" in text:
        weak += [(m.start(), 5, m.end()) for m in ENDPOINT.finditer(text)]
    if weak or base:  # an opaque key alone is never reported
        weak += [(m.start(), 4, m.end()) for m in OPAQUE.finditer(text)]
    inside = lambda x: any(b[0] <= x[0] and x[2] <= b[2] for b in base)
    return sorted(base), sorted(x for x in weak if not inside(x))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("s", pa.int32()), ("k", pa.int32()), ("e", pa.int32())]))
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            found = [scan_text(t) for t in part.column("text").to_pylist()]
            columns = [pa.array([[dict(zip("ske", x, strict=True)) for x in f[i]] for f in found], kind) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([part.column("row"), part.column("crc"), *columns], names=["row", "crc", "base", "weak"])


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """``docs`` without its text, with ``base`` and ``spans``: arrays of (s start, k kind number, e end)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keep = [c for c in docs.columns if c not in (text_col, "base", "spans")]
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.crc32(text).alias("crc"), text.alias("text"))
    spans = T.ArrayType(_SPAN)
    scanned = packed.mapInArrow(_scan, T.StructType([packed.schema["row"], T.StructField("crc", T.LongType()), T.StructField("base", spans), T.StructField("weak", spans)]))
    scanned = scanned.withColumn("id", F.coalesce(F.col(f"row.`{id_col}`").cast("string"), F.lit("")))
    linked = link_parts(scanned.where("size(weak) > 0"), scope)
    own = (F.col("id") == F.col("l_id")) & (F.col("crc") == F.col("l_crc"))
    out = scanned.join(linked, own, "left").withColumn("spans", F.array_sort(F.array_union("base", F.coalesce("linked", F.array().cast(spans)))))
    return out.select("row.*", "base", "spans")


def link_parts(scanned: DataFrame, scope: int) -> DataFrame:
    """``(l_id, l_crc, linked)``: weak parts with the complementary parts they need in reach."""
    weak = scanned.select("id", "crc", F.explode("weak").alias("p")).select("id", "crc", "p.*").distinct()
    role = F.when(F.col("k").isin(1, 3), "identifier").when(F.col("k") == 5, "endpoint").otherwise("secret")
    parts = scanned.select("id", "crc", F.explode(F.concat("base", "weak")).alias("p")).select("id", "crc", "p.*").distinct().withColumn("role", role)
    first, last = F.floor(F.col("s") / scope), F.floor((F.col("e") - 1) / scope)
    spread = parts.select("id", "crc", F.col("s").alias("ps"), F.col("e").alias("pe"), "role", F.explode(F.sequence(first - 1, last + 1)).alias("cell"))
    near = (F.col("s") - F.col("pe") <= scope) & (F.col("ps") - F.col("e") <= scope) & ((F.col("s") != F.col("ps")) | (F.col("e") != F.col("pe")))
    pairs = weak.withColumn("cell", F.explode(F.sequence(first, last))).join(spread, ["id", "crc", "cell"]).where(near)
    met = pairs.groupBy("id", "crc", "s", "k", "e").agg(*[F.max(F.col("role") == r).alias(r) for r in ("identifier", "secret", "endpoint")])
    needs = F.when(F.col("k") == 3, F.col("secret")).when(F.col("k") == 4, F.col("identifier") | F.col("endpoint")).otherwise(F.col("identifier") & F.col("secret"))
    return met.where(needs).groupBy(F.col("id").alias("l_id"), F.col("crc").alias("l_crc")).agg(F.collect_list(F.struct("s", "k", "e")).alias("linked"))


def spans_text(column: str):
    """``kind:start:end`` joined by commas, in order of start and kind."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(F.array_sort(column), lambda x: F.concat_ws(":", names[x["k"]], x["s"].cast("string"), x["e"].cast("string"))))


def _redact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            texts = []
            for text, spans in zip(part.column("text").to_pylist(), part.column("spans").to_pylist(), strict=True):
                out, last = [], 0
                for s in spans or []:
                    if s["s"] >= last:
                        out += [text[last : s["s"]], f"[{KINDS[s['k']].upper()}]"]
                    last = max(last, s["e"])
                texts.append("".join([*out, text[last:]]) if out else text)
            yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(texts, pa.string())], names=["row", "text"])


def redact(found: DataFrame, text_col: str = "text") -> DataFrame:
    """Replace the ``spans`` of each text by the name of their kind and drop the span columns."""
    keep = [c for c in found.columns if c not in (text_col, "base", "spans")]
    packed = found.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col(text_col).alias("text"), "spans")
    out = packed.mapInArrow(_redact, T.StructType([packed.schema["row"], T.StructField("text", T.StringType())]))
    return out.select("row.*", F.col("text").alias(text_col))
