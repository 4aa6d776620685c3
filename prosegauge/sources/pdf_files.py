"""One PDF file to rows; imported only where ``pdfplumber`` and ``pypdf`` are."""

from __future__ import annotations

import io
import json

import pdfplumber
import pypdf
from pypdf.generic import ArrayObject, DictionaryObject, IndirectObject

from prosegauge.sources.pdf import observed_metadata

TOLERANCES = {"x_tolerance": 2, "y_tolerance": 3}


def _tree(reader: pypdf.PdfReader) -> str | None:
    """The structure tree as JSON: tags, page numbers, content ids and children."""
    root = reader.trailer["/Root"].get("/StructTreeRoot")
    if root is None:
        return None
    numbers = {(p.indirect_reference.idnum, p.indirect_reference.generation): k for k, p in enumerate(reader.pages, 1)}

    def number(page) -> int | None:
        ref = page if isinstance(page, IndirectObject) else getattr(page, "indirect_reference", None)
        return numbers.get((ref.idnum, ref.generation)) if ref is not None else None

    def plain(node):
        node = node.get_object() if isinstance(node, IndirectObject) else node
        if isinstance(node, ArrayObject):
            return [plain(child) for child in node]
        if isinstance(node, DictionaryObject):
            out = {"S": str(node["/S"])} if "/S" in node else {}
            if "/Pg" in node:
                out["Pg"] = number(node.raw_get("/Pg"))
            if "/MCID" in node:
                out["MCID"] = int(node["/MCID"])
            if "/K" in node:
                out["K"] = plain(node.raw_get("/K"))
            return out
        return int(node) if isinstance(node, int) else None

    top = root.get_object()
    return json.dumps(plain(top.raw_get("/K")) if "/K" in top else [])


def _box(item: dict) -> dict[str, float]:
    return {"left": float(item["x0"]), "top": float(item["top"]), "right": float(item["x1"]), "bottom": float(item["bottom"])}


def read_file(content: bytes) -> dict:
    out: dict = {n: [] for n in ("lines", "geometry", "words", "shapes", "annots", "pages")}
    reader = pypdf.PdfReader(io.BytesIO(content))
    out |= {"tree": _tree(reader), "metadata": list(observed_metadata(reader.metadata).items())}
    with pdfplumber.open(io.BytesIO(content)) as pdf:
        for page in pdf.pages:
            at = {"page": int(page.page_number)}
            try:
                text, failed = page.extract_text(**TOLERANCES) or "", False
            except Exception:  # whatever the parser meets on one page must not end the file
                text, failed = "", True
            out["pages"].append(at | {"width": float(page.width), "height": float(page.height), "extraction_failed": failed})
            lines = [" ".join(x.split()) for x in text.splitlines()]
            out["lines"] += [at | {"line_index": k, "text": x} for k, x in enumerate(x for x in lines if x)]
            observed = page.extract_text_lines(strip=True, return_chars=False, **TOLERANCES) if not failed else []
            out["geometry"] += [at | {"k": k, "text": " ".join(x["text"].split()), "bbox": _box(x)} for k, x in enumerate(observed)]
            words = page.extract_words(keep_blank_chars=False, use_text_flow=False, extra_attrs=["fontname", "size", "mcid", "tag"], **TOLERANCES)
            out["words"] += [
                at | _box(w) | {"native_index": k, "text": w["text"], "font_name": w.get("fontname"), "font_size": w.get("size")}
                | {"mcid": w.get("mcid"), "leaf_tag": w.get("tag")}
                for k, w in enumerate(x for x in words if str(x.get("text") or "").strip())
            ]
            for shape in (*page.rects, *page.curves):
                filled = bool(shape.get("fill")) and shape.get("non_stroking_color") is not None
                out["shapes"].append(at | _box(shape) | {"filled": filled})
            for note in page.annots:
                data = note.get("data") or {}
                text = data.get("Contents")
                text = text.decode("utf-8", "replace") if isinstance(text, bytes) else text
                out["annots"].append(at | _box(note) | {"subtype": str(data.get("Subtype") or ""), "contents": text})
    return out
