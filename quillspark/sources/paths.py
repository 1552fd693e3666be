"""Where logs, stores and histories are: environment, configuration, defaults, in that order."""

from __future__ import annotations

import posixpath
from collections.abc import Mapping
from typing import Any

#: The default folder, and below the names of environment variables, keys and files.
DEFAULT_FEEDBACK_DIR = "data/_feedback"


def _block(tree: Mapping[str, Any], name: str) -> Mapping[str, Any]:
    """A block of the configuration; one that is there but empty reads as null and counts as empty."""
    return tree.get(name) or {}


def feedback_log(tree: Mapping[str, Any], env: Mapping[str, str]) -> str:
    found = env.get("OCR_FEEDBACK_LOG") or _block(tree, "feedback").get("path")
    return found or posixpath.join(env.get("OCR_FEEDBACK_DIR") or DEFAULT_FEEDBACK_DIR, "corrections.jsonl")


def examples_store(tree: Mapping[str, Any], env: Mapping[str, str]) -> str:
    found = env.get("OCR_EMBEDDINGS_DB") or _block(tree, "feedback").get("embeddings_db")
    return found or posixpath.join(posixpath.dirname(feedback_log(tree, env)), "examples.sqlite")


def history_file(tree: Mapping[str, Any], output_dir: str, month: str) -> str:
    """A fixed path, else a monthly file, else one file; ``month`` is YYYY.MM."""
    block = _block(tree, "history")
    if block.get("path"):
        return block["path"]
    if block.get("monthly"):
        return posixpath.join(block.get("dir") or output_dir, f"{month} - PROCESSED_PDFS.md")
    return posixpath.join(output_dir, "PROCESSED_PDFS.md")
