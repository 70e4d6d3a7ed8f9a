"""Markdown notes about batches and published versions; counts in, text out."""

from __future__ import annotations

from collections.abc import Iterable
from typing import Any


def cell(value: Any) -> str:
    """One table cell: no line breaks, no bars that would end it."""
    return " ".join(str("" if value is None else value).split()).replace("|", "\\|")


def table(head: Iterable[str], rows: Iterable[Iterable[Any]]) -> list[str]:
    head = list(head)
    lines = ["| " + " | ".join(map(cell, head)) + " |", "|" + "---|" * len(head)]
    return lines + ["| " + " | ".join(map(cell, r)) + " |" for r in rows]


def section(title: str, lines: list[str]) -> list[str]:
    return ["", f"## {title}", "", *(lines or ["(none)"])]


def note_lines(note: str) -> list[str]:
    """Free text as a quotation, line by line."""
    return [f"> {line}" if line.strip() else ">" for line in note.strip().splitlines()]


def images_note(batch: str, stats: dict[str, Any], suffixes: list, sizes: list, note: str = "") -> str:
    lines = [f"# Image batch {cell(batch)}", *([""] + note_lines(note) if note.strip() else [])]
    lines += section("Counts", table(("what", "n"), stats.items()))
    lines += section("File types", table(("suffix", "images"), suffixes))
    lines += section("Sizes", table(("width", "height", "images"), sizes))
    return "\n".join(lines) + "\n"


def annotations_note(batch: str, stats: dict[str, Any], distribution: list, note: str = "") -> str:
    lines = [f"# Annotation batch {cell(batch)}", *([""] + note_lines(note) if note.strip() else [])]
    lines += section("Counts", table(("what", "n"), stats.items()))
    lines += section("Categories", table(("category", "positive", "negative", "unknown"), distribution))
    return "\n".join(lines) + "\n"


def version_note(manifest: dict[str, Any], sources: list, mappings: list, distribution: list, note: str = "") -> str:
    lines = [f"# {cell(manifest['name'])} {cell(manifest['version'])}", "", f"Built by {cell(manifest['created_by'])} at {cell(manifest['created_at'])}.", *([""] + note_lines(note) if note.strip() else [])]
    lines += section("Counts", table(("what", "n"), manifest["counts"].items()))
    lines += section("Sources", table(("set", "version", "images"), sources))
    lines += section("Targets", table(("target", "categories"), mappings))
    lines += section("Distribution", table(("target", "positive", "negative", "unknown", "boxes"), distribution))
    return "\n".join(lines) + "\n"


def bit_depth(head: bytes) -> str:
    """Data type of an image from its first 25 bytes: PNG depth, else unknown."""
    if len(head) >= 25 and head[:8] == b"\x89PNG\r\n\x1a\n" and head[12:16] == b"IHDR":
        return {1: "bool", 2: "uint2", 4: "uint4", 8: "uint8", 16: "uint16"}.get(head[24], "unknown")
    return "unknown"
