"""Blocks of span manifests: an extractor outside names the byte ranges of prose, and this checks them."""

from __future__ import annotations

import json

from weftline.parsers.base import Block

KINDS = {"para": "paragraph", "header": "heading", "list": "list_item", "quote": "block_quote", "table": "table", "footnote": "paragraph", "term": "list_item"}


class ManifestError(ValueError):
    """A manifest or a span in it that does not hold; nothing falls back."""


def fnv1a64(raw: bytes) -> int:
    h = 0xCBF29CE484222325
    for b in raw:
        h = ((h ^ b) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
    return h


def read_manifest(text: str, revision: str | None = None, generator: str | None = None) -> dict[str, dict]:
    """Documents by path. schema must be 1; generator and revision must be those asked for; unknown fields are rejected."""
    raw = json.loads(text)
    if set(raw) - {"schema", "generator", "versoRevision", "documents"}:
        raise ManifestError("unknown fields in the manifest")
    if raw.get("schema") != 1:
        raise ManifestError(f"manifest schema {raw.get('schema')} is not 1")
    for key, want in (("versoRevision", revision), ("generator", generator)):
        if want is not None and raw.get(key) != want:
            raise ManifestError(f"{key} is {raw.get(key)}, not {want}")
    out = {}
    for doc in raw["documents"]:
        if set(doc) - {"path", "sourceHash", "spans"} or any(set(s) - {"start", "stop", "kind", "level"} for s in doc["spans"]):
            raise ManifestError("unknown fields in a document")
        out[doc["path"].removeprefix("./")] = doc
    return out


def parse_verso(text: str, document: dict) -> list[Block]:
    """Blocks of a document's spans, which must be of this source, in order, apart, not empty, on character boundaries, with a level for headings alone."""
    raw = text.encode()
    if str(fnv1a64(raw)) != document["sourceHash"]:
        raise ManifestError("the source is not the one the manifest was made from")
    out, at = [], 0
    for s in document["spans"]:
        start, stop, kind, level = s["start"], s["stop"], s["kind"], s.get("level")
        if not at <= start < stop <= len(raw):
            raise ManifestError(f"span {start}-{stop} is empty, out of order or out of the source")
        if kind not in KINDS or (kind == "header") != (level is not None):
            raise ManifestError(f"span {start}-{stop} has a wrong kind or level")
        for edge in (start, stop):
            if edge < len(raw) and raw[edge] & 0xC0 == 0x80:
                raise ManifestError(f"offset {edge} lies within a character")
        first = len(raw[:start].decode())
        out.append(Block(KINDS[kind], first, first + len(raw[start:stop].decode()), level))
        at = stop
    return out
