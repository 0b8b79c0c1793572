"""TEI XML corpora: scan (one record per ``<TEI>``), parse, and export.

Scan: ``spark.read.text(path, lineSep="</TEI>")`` (or ``</prefix:TEI>``: the first
document tag tells) splits files into one record per document on any split boundary, so a
multi-GB corpus file is read by many tasks in parallel; the prolog / corpus wrapper before
the first ``<TEI`` of a record is cut off, and prefixes that the wrapper declared are declared again. Parse: each record is parsed
once with the standard-library XML parser (namespace-agnostic), some MB of an Arrow batch at a time;
a malformed document sets ``_corrupt`` instead of failing the job.
Spark's own ``xml`` source infers a schema and loses mixed-content order,
and ``xpath`` re-parses per call and throws on malformed input, hence the function.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import (ArrayType, BooleanType, IntegerType, MapType, StringType,
                               StructField, StructType)

from tessel.session import materialize

XML_ID = "{http://www.w3.org/XML/1998/namespace}id"
PARSED = StructType([
    StructField("id", StringType()), StructField("terms", MapType(StringType(), ArrayType(StringType()))),
    StructField("text", StringType()), StructField("url", StringType()), StructField("md5_text", StringType()),
    StructField("chars", IntegerType()), StructField("langs", ArrayType(StringType())),
    StructField("head_p_len", IntegerType()), StructField("_corrupt", BooleanType()),
])
ARROW_KINDS = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string()),
               "map<string,array<string>>": pa.map_(pa.string(), pa.list_(pa.string()))}
#: Bounds of the records that a task parses at a time.
SLICE_BYTES, SLICE_ROWS = 2 << 20, 512
_MD5_RE = re.compile(r"md5_text=([0-9a-fA-F]{32})")
_CHARS_RE = re.compile(r"chars=(\d+)")
_START_RE = re.compile(r"<(?:[A-Za-z_][\w.-]*:)?TEI[\s>]")
_PREFIX_RE = re.compile(r"[<\s/]([A-Za-z_][\w.-]*):[A-Za-z_]")


def _local(tag) -> str:
    return tag.rsplit("}", 1)[-1] if isinstance(tag, str) else ""


def _parse_one(rec: str | None):
    if rec is None:
        return None
    m = _START_RE.search(rec)
    if not m:
        return None  # trailing wrapper or empty split: no document here
    body = rec[m.start():]
    close = "</" + body[1:body.index("TEI") + 3] + ">"
    # prefixes declared outside the record: their names do not matter, only local names are read
    free = sorted({p for p in _PREFIX_RE.findall(body) if p not in ("xml", "xmlns") and f"xmlns:{p}=" not in body})
    declared = "".join(f' xmlns:{p}="urn:prefix:{p}"' for p in free)
    try:
        root = ET.fromstring(f"<w{declared}>{body}{close}</w>")[0]
    except ET.ParseError:
        return {"id": None, "terms": None, "text": None, "url": None, "md5_text": None,
                "chars": None, "langs": None, "head_p_len": None, "_corrupt": True}
    doc_id = (root.get(XML_ID) or "").strip() or (root.get("n") or "").strip() or None
    terms: dict[str, list[str]] = {}
    url = None
    langs = []
    md5_text = chars = None
    text_el = None
    for el in root.iter():
        name = _local(el.tag)
        if name == "term":
            t = (el.get("type") or "").strip()
            v = (el.text or "").strip()
            if t and v:
                terms.setdefault(t, []).append(v)
        elif name == "idno" and (el.get("type") or "") == "url" and url is None:
            url = (el.text or "").strip() or None
        elif name == "language" and el.get("ident"):
            langs.append(el.get("ident"))
        elif name == "change":
            s = "".join(el.itertext())
            mm, mc = _MD5_RE.search(s), _CHARS_RE.search(s)
            md5_text = md5_text or (mm.group(1) if mm else None)
            chars = chars if chars is not None else (int(mc.group(1)) if mc else None)
        elif name == "text" and text_el is None:
            text_el = el
    src = text_el if text_el is not None else root
    text = " ".join(p for p in (s.strip() for s in src.itertext()) if p)
    # header-text length: first <head> of text/body/div plus direct text of every <p> under text/body
    head_p = 0
    if text_el is not None:
        body = next((e for e in text_el if _local(e.tag) == "body"), None)
        if body is not None:
            div = next((e for e in body if _local(e.tag) == "div"), None)
            head = next((e for e in div if _local(e.tag) == "head"), None) if div is not None else None
            head_p += len(head.text or "") if head is not None else 0
            head_p += sum(len(e.text or "") for e in body.iter() if _local(e.tag) == "p")
    return {"id": doc_id, "terms": terms, "text": text, "url": url, "md5_text": md5_text,
            "chars": chars, "langs": langs, "head_p_len": head_p, "_corrupt": False}


def _slices(batches):
    """Batches cut so that a slice has some MB of records (or one longer record): a task holds no more parsed documents than that."""
    for batch in batches:
        ends, at = np.cumsum(pc.fill_null(pc.binary_length(batch.column(0)), 0).to_numpy(zero_copy_only=False).astype(np.int64)), 0
        while at < batch.num_rows:
            stop = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE_BYTES, side="right"))
            stop = max(at + 1, min(stop, at + SLICE_ROWS))
            yield batch.slice(at, stop - at)
            at = stop


def parsed(records: DataFrame, with_record: bool = False) -> DataFrame:
    """The columns of ``records`` (the first one, the record itself, only if it is asked for) and the fields of ``PARSED``, of those that hold a document."""
    skip = 0 if with_record else 1
    names = [*records.columns[skip:], *PARSED.names]
    kinds = [ARROW_KINDS[f.dataType.simpleString()] for f in PARSED.fields]

    def run(batches):
        for b in _slices(batches):
            rows = [_parse_one(r) for r in b.column(0).to_pylist()]
            found = pa.array([i for i, r in enumerate(rows) if r is not None], pa.int64())
            rows = [r for r in rows if r is not None]
            cols = [pa.array([list(r[n].items()) if isinstance(r[n], dict) else r[n] for r in rows], kind) for n, kind in zip(PARSED.names, kinds)]
            if rows:
                yield pa.RecordBatch.from_arrays([*(c.take(found) for c in b.columns[skip:]), *cols], names=names)
        pa.default_memory_pool().release_unused()  # a worker process lives on after its task

    return records.mapInArrow(run, StructType([*records.schema.fields[skip:], *PARSED.fields]))


def close_tag(spark: SparkSession, path: str) -> str:
    """The documents' end tag, from the first document tag found (one prefix per corpus)."""
    tags = spark.read.text(path, lineSep=">").where(F.col("value").rlike(r"<([A-Za-z_][\w.-]*:)?TEI(\s|$)"))
    first = tags.select(F.regexp_extract("value", r"<([A-Za-z_][\w.-]*:)?TEI(\s|$)", 1).alias("p")).first()
    return f"</{first['p'] if first else ''}TEI>"


def _records(spark: SparkSession, path: str, end: str) -> DataFrame:
    """``value`` (all up to an end tag), the split it was read in (``file, start``) and its place in the scan (``at``)."""
    return spark.read.text(path, lineSep=end).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"))


def scan_tei(spark: SparkSession, path: str, corpus_id: str | None = None,
             default_modality: str | None = None, with_record: bool = False, ordinals: DataFrame | None = None) -> DataFrame:
    """One row per ``<TEI>`` document: ``id, text, modality, url, md5_text,
    chars, langs, terms, corpus_id, _corrupt`` (and the document's own XML as ``record``).
    Modality = ``modality`` term, else the corpus default, else ``unknown``. A document without an id
    is named by its file and place in the scan, so equal ones stay apart; given ``ordinals`` (of ``scan_in_order``), by its number, which becomes a column too."""
    end = close_tag(spark, path)
    raw = _records(spark, path, end)
    if ordinals is None:
        place = F.concat(F.lit("doc_"), F.substring(F.md5("file"), 1, 8), F.lit("_"), F.col("at").cast("string"))
        raw = raw.select("value", place.alias("place"), F.lit(None).cast("bigint").alias("ordinal"))
    else:  # one row per split
        raw = raw.join(F.broadcast(ordinals), ["file", "start"]).withColumn("ordinal", F.col("before") + F.col("at") - F.col("first") + 1)
        raw = raw.select("value", F.concat(F.lit("doc_"), F.col("ordinal").cast("string")).alias("place"), "ordinal")
    p = parsed(raw.select("value", "place", "ordinal"), with_record)  # records without a <TEI> start (wrapper tail) hold no document
    first_term = lambda t: F.element_at(F.filter(F.col("terms")[t], lambda x: x != ""), 1)
    record = F.concat(F.regexp_extract("value", r"(?s)(<(?:[A-Za-z_][\w.-]*:)?TEI[\s>].*)", 1), F.lit(end))
    return p.select(
        F.when(~F.col("_corrupt"), F.coalesce("id", "place")).alias("id"), "text",
        F.coalesce(first_term("modality"), F.lit(default_modality).cast("string"), F.lit("unknown")).alias("modality"),
        "url", "md5_text", "chars", "langs", "terms", "head_p_len",
        F.lit(corpus_id).cast("string").alias("corpus_id"), "_corrupt", *([record.alias("record")] if with_record else []),
        *(["ordinal"] if ordinals is not None else []))


def scan_in_order(spark: SparkSession, corpora: list[tuple[str, str, str | None]]) -> DataFrame:
    """Documents of several corpora (path, corpus id, default modality) with ``ordinal``: 1, 2, ... through all of them, corpora as
    listed, files by path, documents as they stand. A document without an id is called ``doc_<ordinal>``.

    A first pass counts the documents of each split without parsing them; the sums of the splits before give each split
    its first number, whatever the splits' size. (A record is numbered by its place in its split: only what
    follows a file's last document may be none.)"""
    counts = None
    for no, (path, _, _) in enumerate(corpora):
        raw = _records(spark, path, close_tag(spark, path)).where(F.col("value").rlike(_START_RE.pattern))
        c = raw.groupBy("file", "start").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n")).withColumn("corpus", F.lit(no))
        counts = c if counts is None else counts.unionByName(c)
    # one row per split
    earlier = Window.orderBy("corpus", "file", "start").rowsBetween(Window.unboundedPreceding, -1)
    splits = materialize(counts.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))))
    out = None
    for no, (path, corpus_id, default) in enumerate(corpora):
        mine = splits.where(F.col("corpus") == no).select("file", "start", "first", "before")
        d = scan_tei(spark, path, corpus_id, default, ordinals=mine)
        out = d if out is None else out.unionByName(d)
    return out


def export_kept(spark: SparkSession, path: str, keep_ids: DataFrame, out: str) -> str:
    """Copy the documents of a corpus whose id is in ``keep_ids`` (one column), byte for byte."""
    ids = keep_ids.select(F.col(keep_ids.columns[0]).cast("string").alias("id")).distinct()
    kept = scan_tei(spark, path, with_record=True).join(ids, "id", "left_semi")
    return write_tei(kept.select(F.col("record").alias("value")), out)


def term(col_terms: str, term_type: str):
    """First non-blank ``<term type=...>`` value (the parser already strips)."""
    return F.element_at(F.filter(F.col(col_terms)[term_type], lambda x: x != ""), 1)


def _esc(c):
    c = F.regexp_replace(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "&", "&amp;"), "<", "&lt;"), ">", "&gt;")


def tei_records(df: DataFrame, id_col: str, text_col: str, lang_col: str, source_col: str,
                modality_col: str | None = None, n_chars_col: str | None = None) -> DataFrame:
    """One ``<TEI>`` element string per row (JVM-side string building): header
    with url, language, domain/crawl/modality terms and an md5/chars change
    note; body with one ``<p>`` per text line."""
    lines = F.transform(F.split(_esc(F.col(text_col)), "\n"), lambda l: F.concat(F.lit("<p>"), l, F.lit("</p>")))
    mod = (F.when(F.col(modality_col).isNotNull(), F.concat(F.lit('<term type="modality">'), _esc(F.col(modality_col)), F.lit("</term>")))
           .otherwise(F.lit("")) if modality_col else F.lit(""))
    chars = F.col(n_chars_col).cast("string") if n_chars_col else F.length(text_col).cast("string")
    return df.select(F.concat(
        F.lit('<TEI xml:id="d'), F.col(id_col).cast("string"), F.lit('"><teiHeader><fileDesc><sourceDesc><biblStruct><idno type="url">http://'),
        _esc(F.col(source_col)), F.lit(".example.org/"), F.col(id_col).cast("string"),
        F.lit('</idno></biblStruct></sourceDesc></fileDesc><profileDesc><langUsage><language ident="'), _esc(F.col(lang_col)),
        F.lit('"/></langUsage><textClass><keywords><term type="domain">'), _esc(F.col(source_col)), F.lit(".example.org</term>"),
        F.lit('<term type="crawl">'), _esc(F.col(source_col)), F.lit("-"), _esc(F.col(lang_col)), F.lit("</term>"), mod,
        F.lit('<term type="blank"> </term></keywords></textClass></profileDesc><revisionDesc><change>md5_text='),
        F.md5(F.col(text_col)), F.lit(" chars="), chars,
        F.lit("</change></revisionDesc></teiHeader><text><body><div>"), F.array_join(lines, ""),
        F.lit("</div></body></text></TEI>")).alias("value"))


def write_tei(records: DataFrame, path: str) -> str:
    """Write TEI element strings as corpus files, each one a ``teiCorpus`` of its own."""
    def wrap(batches):
        yield pa.RecordBatch.from_arrays([pa.array(["<?xml version='1.0' encoding='utf-8'?>", '<teiCorpus xmlns="http://www.tei-c.org/ns/1.0">'])], names=["value"])
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0)], names=["value"])
        yield pa.RecordBatch.from_arrays([pa.array(["</teiCorpus>"])], names=["value"])

    records.select("value").mapInArrow(wrap, "value string").write.mode("overwrite").text(path)
    return path
