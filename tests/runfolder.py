"""Makes small run folders and decodes them by plain Python, base by base."""

import gzip
import os
import struct

import numpy as np

REVERSE = str.maketrans("ACGT", "TGCA")


def run_info(path, reads):
    os.makedirs(path, exist_ok=True)
    rows = "".join(f'<Read Number="{i}" NumCycles="{n}" IsIndexedRead="{"Y" if y else "N"}"/>' for i, (n, y) in enumerate(reads, 1))
    with open(os.path.join(path, "RunInfo.xml"), "w") as f:
        f.write(f'<?xml version="1.0"?><RunInfo><Run><Reads>{rows}</Reads></Run></RunInfo>')


def write_cbcl(path, tiles, calls, bins=((0, 0), (1, 12), (2, 24), (3, 40))):
    """tiles: (tile, clusters); calls: by tile, nibbles of each cluster."""
    blocks = []
    for tile, n in tiles:
        nib = np.zeros(n + n % 2, np.uint8)
        nib[:n] = calls[tile]
        blocks.append(gzip.compress((nib[0::2] | nib[1::2] << 4).tobytes()))
    size = 12 + 8 * len(bins) + 4 + 16 * len(tiles)
    head = struct.pack("<HIBBI", 1, size, 2, 2, len(bins)) + b"".join(struct.pack("<II", *b) for b in bins) + struct.pack("<I", len(tiles))
    head += b"".join(struct.pack("<4I", t, n, (n + 1) // 2, len(b)) for (t, n), b in zip(tiles, blocks))
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(head + b"".join(blocks))


def write_filter(path, passing, version=3):
    with open(path, "wb") as f:
        f.write(struct.pack("<I", version) + (struct.pack("<I", 3) if version == 0 else b"") + struct.pack("<I", len(passing)) + bytes(passing))


def cbcl_run(path, reads, lanes, rng, skip_cycle=None):
    """lanes: {lane: [(tile, clusters)]}. Returns {(lane, tile): (nibbles by cycle, passing)}."""
    run_info(path, reads)
    cycles, out = sum(n for n, _ in reads), {}
    for lane, tiles in lanes.items():
        folder = os.path.join(path, "Data", "Intensities", "BaseCalls", f"L{lane:03d}")
        os.makedirs(folder, exist_ok=True)
        for tile, n in tiles:
            passing = rng.integers(0, 3, n).tolist()
            write_filter(os.path.join(folder, f"s_{lane}_{tile}.filter"), passing, int(rng.choice([0, 3])))
            out[lane, tile] = (rng.integers(0, 16, (cycles, n)).astype(np.uint8), passing)
        for c in range(cycles):
            if c + 1 != skip_cycle:
                write_cbcl(os.path.join(folder, f"C{c + 1}.1", f"L{lane:03d}_1.cbcl"), tiles, {t: out[lane, t][0][c] for t, _ in tiles})
    return out


def decode(reads, data, skip_cycle=None):
    """(lane, tile, cluster) -> the strings of a read, one base at a time."""
    segments, seen = [], {True: 0, False: 0}
    for n, y in reads:
        name = ("index1", "index2")[min(seen[y], 1)] if y else ("sequence", "read2_sequence")[min(seen[y], 1)]
        seen[y] += 1
        segments += [name] * n
    out = {}
    for (lane, tile), (nibbles, passing) in data.items():
        for cluster, p in enumerate(passing):
            if p != 1:
                continue
            row = {k: "" for k in ("sequence", "quality", "index1", "index2", "read2_sequence", "read2_quality")}
            for c, name in enumerate(segments):
                nib = int(nibbles[c][cluster])
                base, quality = ("N", "!") if c + 1 == skip_cycle else ("ACGT"[nib & 3], chr((nib >> 2) * 10 + 2 + 33))
                row[name] += base
                if name == "sequence":
                    row["quality"] += quality
                elif name == "read2_sequence":
                    row["read2_quality"] += quality
            out[lane, tile, cluster] = row
    return out


def match(key, barcodes, most=1):
    """(order, distance) of the nearest barcode, the first of equal ones; None beyond `most`."""
    best = None
    for i, b in enumerate(barcodes):
        d = sum(x != y for x, y in zip(key, b))
        if best is None or d < best[1]:
            best = (i, d)
    return best if best and best[1] <= most else None
