"""A run's structure and its second index's orientation, from its XML files; read on the driver."""

from __future__ import annotations

import os
import xml.etree.ElementTree as ET
from dataclasses import dataclass, field

# Instruments that read the second index from the other strand.
FLIPPED_INSTRUMENTS = ("nextseq", "miniseq", "novaseq")
R1, I1, I2, R2 = range(4)


@dataclass
class RunStructure:
    """Cycles of each segment, and the segment of each cycle in the order of the run."""

    lengths: list[int] = field(default_factory=lambda: [0, 0, 0, 0])
    segments: list[int] = field(default_factory=list)

    @property
    def cycles(self) -> int:
        return len(self.segments)

    @property
    def paired(self) -> bool:
        return self.lengths[R2] > 0

    def order(self) -> list[int]:
        """Cycles (from 1) in the canonical order R1, I1, I2, R2."""
        return [c + 1 for s in range(4) for c, own in enumerate(self.segments) if own == s]


def read_structure(text: str) -> RunStructure:
    root = ET.fromstring(text)
    if root.tag != "RunInfo":
        raise ValueError("no RunInfo element")
    reads = root.findall("./Run/Reads/Read")
    if not reads:
        raise ValueError("no Run/Reads/Read element")
    out, seen = RunStructure(), {True: 0, False: 0}
    for read in reads:
        if "NumCycles" not in read.attrib or "IsIndexedRead" not in read.attrib:
            raise ValueError("a Read lacks NumCycles or IsIndexedRead")
        n, indexed = int(read.attrib["NumCycles"]), read.attrib["IsIndexedRead"] == "Y"
        segment = (I1, I2)[min(seen[True], 1)] if indexed else (R1, R2)[min(seen[False], 1)]
        seen[indexed] += 1
        out.lengths[segment] += n
        out.segments += [segment] * n
    return out


def load_structure(folder: str) -> RunStructure:
    path = os.path.join(folder, "RunInfo.xml")
    if not os.path.exists(path):
        raise FileNotFoundError(f"{path}: a run needs its RunInfo.xml")
    with open(path, encoding="utf-8-sig") as f:
        return read_structure(f.read())


def flipped_index2(folder: str, forced: str = "auto") -> bool:
    """Whether the second index is read reverse-complemented: forced "true" or "false", else by the instrument's name."""
    if forced in ("true", "false"):
        return forced == "true"
    if forced != "auto":
        raise ValueError("i5_rc is 'auto', 'true' or 'false'")
    for name in ("RunParameters.xml", "runParameters.xml"):
        path = os.path.join(folder, name)
        if os.path.exists(path):
            with open(path, encoding="utf-8-sig", errors="replace") as f:
                text = f.read()
            try:
                ET.fromstring(text)
            except ET.ParseError:
                return False
            return any(x in text.lower() for x in FLIPPED_INSTRUMENTS)
    return False
