"""Personal data: base patterns, and spans that a character-level BiLSTM-CRF adds.

Every character of every text is read by the network, in overlapping windows, and one decoding of the whole text gives its
spans. Base spans all stay; a span of the model that touches none of them is added as it is, without the blanks and stops at its
end. No pattern judges it. Besides the four kinds of base spans the model finds secrets (values of tokens, keys and passwords).

Defined cases: a null text is empty; very long texts are read whole, a part at a time; rows are independent, so repeated rows
agree; an empty table gives an empty result; other columns stay, those named like new ones are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import pii_model
from ._shared import bounded_batches, foreign_kept, released
from .pii_model import KINDS, luhn

#: The base patterns. The starts they are tried at are those where a match can begin, so long runs take linear time.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def _only_digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """By kind, then start."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append(("email", start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    if any(c in text for c in "0123456789"):
        out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split("."))]
        out += [("card", m.start(), m.end()) for m in _CARD.finditer(text) if 13 <= len(d := _only_digits(m.group())) <= 19 and luhn(d)]
        out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_only_digits(m.group())) <= 15]
    return out


_LONG, _SPLIT = re.compile(r"[0-9A-Za-z_-]{16,}"), re.compile(r"[0-9(][0-9().\x20-]{7,}[0-9]")


def doubtful(text: str) -> bool:
    """Whether a background text may hold personal data, so that it is no example of text without: a base span, an @, a long string of letters and digits, or digits in groups."""
    mixed = any(any(c.isdigit() for c in m.group()) and any(c.isalpha() for c in m.group()) for m in _LONG.finditer(text))
    split = any(not m.group().isdigit() and len(_only_digits(m.group())) >= 9 for m in _SPLIT.finditer(text))
    return "@" in text or mixed or split or bool(base_spans(text))


def all_spans(model, texts: list[str | None]) -> list[list[tuple[str, int, int, bool]]]:
    """For each text (kind, start, end, base) by kind as in KINDS, then start."""
    texts = [t or "" for t in texts]
    out = []
    for text, spans in zip(texts, pii_model.find(model, texts), strict=True):
        base = base_spans(text)
        added = []
        for kind, s, e in spans:
            while e > s and text[e - 1] in " .,\n":
                e -= 1
            if s < e and not any(s < y and x < e for _, x, y in base):
                added.append((kind, s, e, False))
        out.append(sorted([*((*x, True) for x in base), *added], key=lambda x: (KINDS.index(x[0]), x[1])))
    return out


def redacted(text: str | None, spans: list[tuple[str, int, int, bool]]) -> str | None:
    """The text with each stretch of touching spans replaced by its first kind in angle brackets."""
    if not spans or text is None:
        return text
    out, at, end = [], 0, -1
    for kind, a, b, _ in sorted(spans, key=lambda x: (x[1], -x[2])):
        if a >= end:
            out += [text[at:a], f"<{kind.upper()}>"]
        end = max(end, b)
        at = end
    return "".join(out) + text[at:]


SPANS = "array<struct<kind:string,start:int,end:int,base:boolean>>"


def _detect(model, redacts: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))
        for b in batches:
            texts = b.column("__text").to_pylist()
            spans = all_spans(model, texts)
            names = [c for c in b.schema.names if c != "__text"]
            out = [b.column(c) for c in names]
            out.append(pa.array([[dict(zip(("kind", "start", "end", "base"), x, strict=True)) for x in s] for s in spans], kind))
            if redacts:
                out.append(pa.array([redacted(t, s) for t, s in zip(texts, spans, strict=True)], pa.string()))
            yield pa.RecordBatch.from_arrays(out, names=[*names, "spans", *["redacted"] * redacts])

    return run


@foreign_kept
def detect(docs: DataFrame, keep: list[str] | None = None, text_col: str = "text", model=None, redacts: bool = True) -> DataFrame:
    """The columns `keep` of docs (None: all), with spans and, where wanted, the redacted text."""
    bounded_batches(docs.sparkSession)
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("spans", "redacted")]
    rows = docs.select(*keep, F.col(text_col).alias("__text"))
    schema = T.StructType([f for f in rows.schema if f.name != "__text"] + [T.StructField("spans", T.DataType.fromDDL(SPANS)), *[T.StructField("redacted", T.StringType())] * redacts])
    return rows.mapInArrow(released(_detect(model or pii_model.default_model(), redacts)), schema)


def span_digests(found: DataFrame) -> DataFrame:
    """Counts of base spans by kind, the digest of their list, the list of all spans, and how many the model added."""
    base = F.filter("spans", lambda s: s["base"])
    line = lambda xs: F.array_join(F.transform(xs, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in KINDS if k != "secret"], F.sha2(line(base), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"), (F.size("spans") - F.size(base)).cast("long").alias("n_added"))


@foreign_kept
def redact(docs: DataFrame) -> DataFrame:
    """docs with all spans replaced in text, and n_chars, where there is one, of the new text; same columns."""
    clash = [c for c in docs.columns if c in ("spans", "redacted")]
    found = detect(docs.withColumnsRenamed({c: f"__own_{c}" for c in clash}))
    new = {"text": F.col("redacted"), "n_chars": F.when(F.col("redacted").isNotNull(), F.length("redacted"))} if "n_chars" in docs.columns else {"text": F.col("redacted")}
    back = {f"__own_{c}" if c in clash else c: c for c in docs.columns}
    return found.select(*[new[c].cast(docs.schema[c].dataType).alias(c) if c in new else F.col(own).alias(c) for own, c in back.items()])
