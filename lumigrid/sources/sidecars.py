"""Sidecar documents: edit histories in JSON and XMP, styles, GPS tracks."""

from __future__ import annotations

import base64
import binascii
import zlib
from xml.etree import ElementTree
from xml.sax.saxutils import quoteattr

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HISTORY_SCHEMA = "version string, generator string, source struct<filename:string,hash:string,camera:string>, settings struct<iop_order:string,color_workflow:string>, modules map<string,struct<enabled:boolean,version:int,params:map<string,double>>>, custom_order array<string>"
MOST_BYTES = 65_536


def parse_history(document: Column) -> Column:
    """A history document as a struct; null if it is malformed, has no version, or a later major one."""
    doc = F.from_json(document, HISTORY_SCHEMA)
    major = F.split(doc["version"], r"\.")[0].try_cast("int")
    return F.when(major.isNotNull() & (major <= 1), doc)


def write_history(modules: Column, order: str = "v5.0 RAW", filename: Column | None = None) -> Column:
    """A history document from a map of modules."""
    return F.to_json(F.struct(F.lit("1.0").alias("version"), F.lit("lumigrid").alias("generator"), F.struct((filename if filename is not None else F.lit(None).cast("string")).alias("filename")).alias("source"), F.struct(F.lit(order).alias("iop_order")).alias("settings"), modules.alias("modules")))


def history_entries(documents: DataFrame, id_col: str, column: str) -> DataFrame:
    """(id, operation, enabled, version, params) of every readable document."""
    rows = documents.select(F.col(id_col), parse_history(F.col(column)).alias("d")).where("d is not null")
    return rows.select(id_col, F.explode("d.modules").alias("operation", "m")).select(id_col, "operation", "m.enabled", "m.version", "m.params")


def decode_params(text: str) -> bytes:
    """Plain hexadecimal, or "gz", two characters and a zlib stream in base64. Raises ValueError, also for more than MOST_BYTES."""
    if not text:
        return b""
    try:
        if text.startswith("gz"):
            data = zlib.decompressobj().decompress(base64.b64decode(text[4:], validate=False), MOST_BYTES + 1)
        else:
            data = bytes.fromhex(text)
        if len(data) > MOST_BYTES:
            raise ValueError(f"more than {MOST_BYTES} bytes")
        return data
    except (ValueError, binascii.Error, zlib.error) as e:
        raise ValueError(f"damaged parameters: {e}") from e


def encode_params(data: bytes, compress: bool = False) -> str:
    return f"gz{min(99, len(data) // max(1, len(zlib.compress(data)))):02d}" + base64.b64encode(zlib.compress(data)).decode() if compress else data.hex()


def _local(name: str) -> str:
    return name.rsplit("}", 1)[-1]


def read_xmp(text: str) -> list[dict]:
    """History entries in order, whatever the namespace: num, operation, enabled, modversion, multi_priority, params."""
    try:
        root = ElementTree.fromstring(text)
    except ElementTree.ParseError as e:
        raise ValueError(f"not XML: {e}") from e
    out = []
    for node in root.iter():
        if _local(node.tag) != "history":
            continue
        for item in node.iter():
            a = {_local(k): v for k, v in item.attrib.items()}
            if "operation" in a:
                out.append({"num": int(a.get("num", len(out))), "operation": a["operation"], "enabled": a.get("enabled", "1") not in ("0", "false"), "modversion": int(a.get("modversion", 0)), "multi_priority": int(a.get("multi_priority", 0)), "params": decode_params(a.get("params", ""))})
    return out


_NS = "http://lumigrid.invalid/ns/"


def write_xmp(entries: list[dict]) -> str:
    rows = "".join(f"<rdf:li lg:num={quoteattr(str(i))} lg:operation={quoteattr(e['operation'])} lg:enabled={quoteattr(str(int(e.get('enabled', True))))} lg:modversion={quoteattr(str(e.get('modversion', 1)))} lg:multi_priority={quoteattr(str(e.get('multi_priority', 0)))} lg:params={quoteattr(encode_params(e.get('params', b'')))}/>" for i, e in enumerate(entries))
    return f'<x:xmpmeta xmlns:x="adobe:ns:meta/"><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#"><rdf:Description xmlns:lg="{_NS}"><lg:history><rdf:Seq>{rows}</rdf:Seq></lg:history></rdf:Description></rdf:RDF></x:xmpmeta>'


def xmp_entries(files: DataFrame) -> DataFrame:
    """(path, num, operation, enabled, modversion, multi_priority, params, error) from rows (path, content)."""

    def run(frames):
        for f in frames:
            out = []
            for path, data in zip(f.path, f.content):
                try:
                    out += [(path, e["num"], e["operation"], e["enabled"], e["modversion"], e["multi_priority"], e["params"], None) for e in read_xmp(bytes(data).decode("utf-8", "replace"))]
                except ValueError as e:
                    out.append((path, -1, None, False, 0, 0, b"", str(e)))
            yield pd.DataFrame(out, columns=["path", "num", "operation", "enabled", "modversion", "multi_priority", "params", "error"])

    return files.select("path", "content").mapInPandas(run, "path string, num int, operation string, enabled boolean, modversion int, multi_priority int, params binary, error string")


def gpx_points(files: DataFrame) -> DataFrame:
    """Track points (path, t in microseconds since 1970, lat, lon, ele) from rows (path, content)."""
    content = F.decode("content", "UTF-8")
    points = F.regexp_extract_all(content, F.lit(r"(?s)(<trkpt\b.*?</trkpt>)"), F.lit(1))
    p = F.col("p")
    rows = files.select("path", F.explode(points).alias("p"))
    take = lambda pattern: F.nullif(F.regexp_extract(p, pattern, 1), F.lit(""))
    t = F.unix_micros(take(r"<time>\s*([^<]*?)\s*</time>").try_cast("timestamp"))
    return rows.select("path", t.alias("t"), take(r'\blat\s*=\s*["\']([^"\']*)').cast("double").alias("lat"), take(r'\blon\s*=\s*["\']([^"\']*)').cast("double").alias("lon"), take(r"<ele>\s*([^<]*?)\s*</ele>").cast("double").alias("ele")).where("t is not null and lat is not null and lon is not null")


def crawl(files: DataFrame, images: DataFrame) -> DataFrame:
    """Images whose sidecar is newer than what was written last: (id, path, modified). files: (path, modified); images: (id, path, write_timestamp)."""
    side = files.select(F.regexp_replace("path", r"\.xmp$", "").alias("_image"), "path", "modified")
    return images.join(side, images.path == side["_image"]).where(side.modified > images.write_timestamp).select(images.id, side.path, side.modified)
