"""Checks of folders and options before a run."""

from __future__ import annotations

from pathlib import Path

#: Stable codes of what can be wrong with a run's folders (fixed values).
CODES = ("source_missing", "source_not_folder", "output_not_folder", "same_folder", "output_empty", "source_empty", "source_in_output")


def path_issues(source: str, output: str, clear_output: bool = False) -> list[str]:
    """Codes of all issues, none if the run can start."""
    issues = []
    if not source.strip():
        issues.append("source_empty")
    if not output.strip():
        issues.append("output_empty")
    if issues:
        return issues
    a, b = Path(source).expanduser().resolve(), Path(output).expanduser().resolve()
    if not a.exists():
        issues.append("source_missing")
    elif not a.is_dir():
        issues.append("source_not_folder")
    if b.exists() and not b.is_dir():
        issues.append("output_not_folder")
    if a == b:
        issues.append("same_folder")
    elif clear_output and a.is_relative_to(b):
        issues.append("source_in_output")
    return issues


def target_folder(output: str, name: str | None, always: bool) -> str:
    """The folder of a run: nested by name where the workflow asks for it."""
    clean = (name or "").strip("/\\")
    if clean in {".", ".."} or "/" in clean or "\\" in clean:
        raise ValueError("the target must be one path component")
    if always and not clean:
        raise ValueError("a target name is needed")
    return f"{output.rstrip('/')}/{clean}" if clean else output.rstrip("/")


def check_options(output_type: str, layout: str | None, dual: bool, suffix: str | None = None) -> None:
    """Layouts and dual outputs go with DOCX; workbooks don't become documents."""
    if output_type not in {"same", "docx"}:
        raise ValueError("the output is 'same' or 'docx'")
    if (layout is not None or dual) and output_type != "docx":
        raise ValueError("a layout or a second output needs docx")
    if layout not in {None, "plain", "preserve"}:
        raise ValueError("the layout is 'plain' or 'preserve'")
    if suffix == ".xlsx" and output_type == "docx":
        raise ValueError("a workbook can't become a document")
