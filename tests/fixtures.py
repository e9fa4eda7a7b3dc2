"""A small source tree about weather stations, and scans of it, shared by several test modules."""

import json

STATIONS = '''"""Weather stations and what they read.

def quoted(): a heading inside a text
"""

from .units import (
    celsius,
    half_steps as to_half,
)
import subprocess
from collections import deque
import numfmt as nf
from limits import in_range, widest  # bounds per sensor

WINDOW = 24


def newest(readings):
    return readings[-1]


class Station:
    kind = "tower"

    def history(self, hours):
        kept = deque(maxlen=hours)
        for value in self.feed.poll(hours):
            if in_range(value):
                kept.push(celsius(value))
        return kept

    @property
    def summary(self):
        return nf.pad(newest(self.history(WINDOW)))


def publish(stations, board):
    def line_for(station):
        return celsius(station.level)

    # announce(board) happens elsewhere
    banner = "broadcast(all)"
    return board.show([line_for(s) for s in stations], banner)


def half_way(low, high):
    return to_half(low + high)


def maintenance(command):
    subprocess.run(command, shell=True)  # flagged
'''

LIMITS = '''"""Bounds."""

widest = (-90, 60)


def in_range(value):
    """Whether a sensor can have read this."""
    low, high = widest
    return low < value < high
'''

UNITS = '''def celsius(kelvin):
    return kelvin - 273.15


def half_steps(value):
    return value * 2 // 1 / 2
'''

TREE = {"stations.py": STATIONS, "limits.py": LIMITS, "units.py": UNITS, "chart.html": "<p>\n<i>\n"}


def line_of(text, needle):
    return next(i for i, line in enumerate(text.splitlines(), 1) if needle in line)


def source_files(spark, tree=None, repo_id="met"):
    rows = [(repo_id, path, len(text.encode()), text) for path, text in (tree or TREE).items()]
    return spark.createDataFrame(rows, "repo_id string, path string, length long, text string")


def result(path, start, end=None, rule="rule.a", lines="requires login", **extra):
    meta = extra.pop("metadata", {"cwe": ["CWE-95: Eval"], "confidence": "LOW"})
    return {
        "check_id": rule,
        "path": path,
        "start": {"line": start, "col": 1, "offset": 0},
        "end": {"line": end or start, "col": 9, "offset": 8},
        "extra": {"message": "bad call", "severity": "WARNING", "lines": lines, "metadata": meta, **extra},
    }


def scan_docs(spark, *docs):
    rows = [(f"scan{i}", "met", doc if isinstance(doc, str) else json.dumps(doc)) for i, doc in enumerate(docs)]
    return spark.createDataFrame(rows, "scan_id string, repo_id string, text string")
