"""A store of finished archives: admitted by their layout, named by their data, the newest kept."""

from __future__ import annotations

import re
from typing import NamedTuple

import pyarrow.fs as fs

from tilewright.sources import files
from tilewright.sources.pmtiles import Archive

KEEP = 5
NAME = re.compile(r"(.+)--(.+)--([^-]+)\.pmtiles")
PART = re.compile(r"[A-Za-z0-9_.]+")


class Stored(NamedTuple):
    stamp: str
    path: str


def listed(root: str, dataset: str, variant: str) -> list[Stored]:
    """The archives of a data set and variant, the newest first."""
    system, folder = files.located(root)
    found = system.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    told = [(m[3], f"{root}/{x.base_name}") for x in found if (m := NAME.fullmatch(x.base_name)) and m.group(1, 2) == (dataset, variant)]
    return [Stored(*x) for x in sorted(told, reverse=True)]


def admit(root: str, path: str, dataset: str, variant: str, stamp: str, keep: int = KEEP) -> str:
    """Takes an archive into the store and removes all but the ``keep`` newest of its data set and variant; its new path.

    An archive whose header, layout or directory is broken is refused.
    """
    if not all(PART.fullmatch(x) for x in (dataset, variant, stamp)):
        raise ValueError("names have letters, digits, points and underscores")
    Archive(path).entries()
    target = f"{root}/{dataset}--{variant}--{stamp}.pmtiles"
    with files.reader(path) as source, files.writer(f"{target}.part") as out:
        while chunk := source.read(8 << 20):
            out.write(chunk)
    files.move(f"{target}.part", target)
    for old in listed(root, dataset, variant)[keep:]:
        files.delete(old.path)
    return target
