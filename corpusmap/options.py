"""Options of a scan, with their defaults."""

from __future__ import annotations

from dataclasses import dataclass

# Default ignore patterns.
DEFAULT_IGNORE = (
    "node_modules", ".git", "dist", "build", "coverage", ".venv", "__pycache__",
    ".next", ".cache", ".turbo", ".idea", ".vscode", "target", "out", "*.log",
)


@dataclass(frozen=True)
class ScanOptions:
    """How files are chosen and analysed; one instance serves every repository of a job.

    Nothing is cut unless a limit is given: all files, whole texts, all symbols.
    """

    max_files: int | None = None
    max_file_bytes: int | None = None
    ignore: tuple[str, ...] = DEFAULT_IGNORE
    hidden: bool = False
    symbols: bool = True
    symbol_backend: str = "auto"  # 'auto' | 'regex' | 'spans'
    max_symbols: int | None = None
    summary_chars: int = 140
    sort_by: str = "path"  # 'path' | 'size'
