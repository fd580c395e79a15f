"""Styles and presets as XML documents: what they hold is a list of operators with parameters.

A document is ``<root><info><name/><description/><iop_list/></info><style><plugin>…</plugin>…</style></root>``,
a plugin's fields being child elements; the root's name is the writer's. Files are read in parallel, and a
damaged one becomes a row with its error.
"""

from __future__ import annotations

from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame

from .sidecars import decode_params, encode_params

# The fields of a plugin and their names in items.
FIELDS = {"num": "num", "module": "modversion", "operation": "operation", "op_params": "params", "enabled": "enabled", "blendop_params": "blend_params", "blendop_version": "blend_version", "multi_priority": "multi_priority", "multi_name": "multi_name"}
_NUMBERS = ("num", "modversion", "blend_version", "multi_priority")


def read_style(text: str) -> dict:
    """name, description, order and items of a style. Raises ValueError."""
    try:
        root = ElementTree.fromstring(text)
    except ElementTree.ParseError as e:
        raise ValueError(f"not XML: {e}") from e
    info, body = root.find("info"), root.find("style")
    if info is None or body is None or not (info.findtext("name") or "").strip():
        raise ValueError("not a style")
    items = []
    for plugin in body.findall("plugin"):
        item = {to: (plugin.findtext(field) or "").strip() for field, to in FIELDS.items()}
        if not item["operation"]:
            raise ValueError("a plugin without an operation")
        for k in _NUMBERS:
            item[k] = int(item[k] or 0)
        item["enabled"] = item["enabled"] not in ("", "0")
        item["params"], item["blend_params"] = decode_params(item["params"]), decode_params(item["blend_params"])
        items.append(item)
    return {"name": info.findtext("name").strip(), "description": (info.findtext("description") or "").strip(), "order": (info.findtext("iop_list") or "").strip(), "items": sorted(items, key=lambda i: i["num"])}


def write_style(name: str, items: list[dict], description: str = "", order: str = "", root: str = "style_document") -> str:
    top = ElementTree.Element(root, version="1.0")
    info, body = ElementTree.SubElement(top, "info"), ElementTree.SubElement(top, "style")
    for tag, text in (("name", name), ("description", description), ("iop_list", order)):
        ElementTree.SubElement(info, tag).text = text
    for i, item in enumerate(items):
        plugin = ElementTree.SubElement(body, "plugin")
        for field, key in FIELDS.items():
            value = item.get(key, i if key == "num" else b"" if key.endswith("params") else 0 if key in _NUMBERS else "")
            if key == "enabled":
                value = int(item.get("enabled", True))
            ElementTree.SubElement(plugin, field).text = encode_params(value) if isinstance(value, bytes | bytearray) else str(value)
    return '<?xml version="1.0" encoding="UTF-8"?>\n' + ElementTree.tostring(top, encoding="unicode")


def style_items(files: DataFrame) -> DataFrame:
    """(path, name, description, num, operation, enabled, modversion, multi_priority, multi_name, params, error) from rows (path, content)."""
    columns = ["path", "name", "description", "num", "operation", "enabled", "modversion", "multi_priority", "multi_name", "params", "error"]

    def run(frames):
        for f in frames:
            out = []
            for path, data in zip(f.path, f.content, strict=True):
                try:
                    s = read_style(bytes(data).decode("utf-8", "replace"))
                    out += [(path, s["name"], s["description"], i["num"], i["operation"], i["enabled"], i["modversion"], i["multi_priority"], i["multi_name"], i["params"], None) for i in s["items"]]
                except ValueError as e:
                    out.append((path, None, None, -1, None, False, 0, 0, None, b"", str(e)))
            yield pd.DataFrame(out, columns=columns)

    return files.select("path", "content").mapInPandas(run, "path string, name string, description string, num int, operation string, enabled boolean, modversion int, multi_priority int, multi_name string, params binary, error string")
