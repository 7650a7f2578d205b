"""Checks of what callers give, before any job starts; each raises ValueError with a sentence for the user."""

from __future__ import annotations

import warnings
from pathlib import Path

DEFAULT_CHUNK, LEAST_CHUNK, MOST_CHUNK = 800, 200, 2000


def is_int(value: object) -> bool:
    return isinstance(value, int) and not isinstance(value, bool)


def chunk_size(value: object) -> int:
    """The size to use: out of 200..2000 the default, with a warning, and never over the default."""
    if not is_int(value):
        raise ValueError("max_chunk_size must be an integer")
    if not LEAST_CHUNK <= value <= MOST_CHUNK:
        warnings.warn(f"max_chunk_size {value} is not in {LEAST_CHUNK}..{MOST_CHUNK}; {DEFAULT_CHUNK} is used", stacklevel=2)
        return DEFAULT_CHUNK
    return min(value, DEFAULT_CHUNK)


def count(value: object, most: int | None = None) -> int:
    if not is_int(value) or value < 1 or most is not None and value > most:
        raise ValueError("k must be a positive integer" + (f" of at most {most}" if most else ""))
    return value


def query(value: object) -> str:
    """The query without white space around it."""
    if not isinstance(value, str) or not value.strip():
        raise ValueError("the query must be text that is not blank")
    return value.strip()


def flag(value: object) -> bool:
    if not isinstance(value, str) or value.lower() not in ("y", "n"):
        raise ValueError("bonus must be y or n")
    return value.lower() == "y"


def port(value: object) -> int:
    if not is_int(value) or not 1 <= value <= 65535:
        raise ValueError("the port must be an integer in 1..65535")
    return value


def file(value: object, what: str) -> Path:
    if not isinstance(value, str) or not value.strip() or not Path(value).is_file():
        raise ValueError(f"the {what} must be the path of a file that exists")
    return Path(value)


def other_files(a: object, b: object) -> tuple[Path, Path]:
    results, dataset = file(a, "results file"), file(b, "dataset")
    if results.resolve() == dataset.resolve():
        raise ValueError("the results file and the dataset must be different files")
    return results, dataset


def save_folder(value: object) -> str:
    if not isinstance(value, str) or not value.strip():
        raise ValueError("the save directory must be a path")
    return value


def output(source: object, folder: object, what: str = "dataset") -> Path:
    """Where results for a file go: under its name in folder, which is made if need be and cannot be the file's own."""
    path = file(source, what)
    save_folder(folder)
    if path.resolve().parent == Path(folder).resolve():
        raise ValueError(f"the save directory cannot be that of the {what}, which would be overwritten")
    Path(folder).mkdir(parents=True, exist_ok=True)
    return Path(folder) / path.name
