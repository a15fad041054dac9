"""Unpacking corpora that are on local disk already; a driver-side utility outside Spark."""

from __future__ import annotations

import gzip
import shutil
import tarfile
import zipfile
from collections.abc import Callable
from pathlib import Path

SENTINEL = ".acquired"


def kind_of(path: Path, told: str = "auto") -> str:
    """zip, tar, gz or none, by name unless told."""
    if told != "auto":
        return {"tar.gz": "tar", "tgz": "tar"}.get(told, told)
    name = path.name.lower()
    if name.endswith(".zip"):
        return "zip"
    if name.endswith((".tar", ".tar.gz", ".tgz")):
        return "tar"
    return "gz" if name.endswith(".gz") else "none"


def _inside(target: Path, name: str) -> Path:
    place = (target / name).resolve()
    if not place.is_relative_to(target.resolve()):
        raise ValueError(f"archive member {name!r} leaves the target folder")
    return place


def unpack(archive: str, target: str, told: str = "auto") -> None:
    """Extract an archive into a folder.  Members that would land outside it are an error, before any is
    written."""
    source, into = Path(archive), Path(target)
    into.mkdir(parents=True, exist_ok=True)
    kind = kind_of(source, told)
    if kind == "zip":
        with zipfile.ZipFile(source) as z:
            for name in z.namelist():
                _inside(into, name)
            z.extractall(into)
    elif kind == "tar":
        with tarfile.open(source) as t:
            for member in t.getmembers():
                _inside(into, member.name)
            t.extractall(into, filter="data")
    elif kind == "gz":
        with gzip.open(source, "rb") as f, open(into / source.name.removesuffix(".gz"), "wb") as g:
            shutil.copyfileobj(f, g)
    elif kind == "none":
        shutil.copy(source, into / source.name)
    else:
        raise ValueError(f"unknown archive kind {kind}")


def ensure_ready(target: str, archives: list[str], expected: list[str], convert: Callable[[Path], None] | None = None) -> bool:
    """Make sure that the expected files are there: unpack, convert, check, and leave a mark.  Returns whether
    anything had to be done."""
    into = Path(target)
    there = lambda: all((into / p).exists() for p in expected)
    if (into / SENTINEL).exists() and there():
        return False
    for archive in archives:
        unpack(archive, target)
    if convert:
        convert(into)
    if not there():
        raise FileNotFoundError(f"missing after unpacking: {[p for p in expected if not (into / p).exists()]}")
    (into / SENTINEL).touch()
    return True
