"""Files that streams come from: where they are, how to get them, how to split them."""

from __future__ import annotations

import os
import shutil
import time
import urllib.error
import urllib.request
from pathlib import Path

from pyspark.sql import SparkSession

from tallyweave.sources.synthetic import EXPONENTS, tag

#: Environment variable that names the folder of inputs and results.
ROOT = "TALLYWEAVE_ROOT"
#: Bytes of a split and of opening a file, for scans of small files.
SPLIT_BYTES, OPEN_BYTES = 16 << 20, 4 << 20


def resolve(name: str, root: str | None = None) -> str:
    """A path under ``root``, else under the folder in ``TALLYWEAVE_ROOT``, else under the
    current one. Absolute paths and URLs stay as they are."""
    if "://" in name or os.path.isabs(name):
        return name
    return str(Path(root or os.environ.get(ROOT) or Path.cwd()) / name)


def fetch(url: str, path: str, tries: int = 5, wait: float = 10.0) -> str:
    """Downloads a file; after a failure the part that came is removed and, ``wait`` seconds
    later, the download starts again. A file that is there already is kept."""
    if os.path.exists(path):
        return path
    for left in range(tries - 1, -1, -1):
        try:
            with urllib.request.urlopen(url) as source, open(f"{path}.part", "wb") as target:
                shutil.copyfileobj(source, target)
            os.replace(f"{path}.part", path)
            return path
        except (urllib.error.URLError, OSError):
            Path(f"{path}.part").unlink(missing_ok=True)
            if not left:
                raise
            time.sleep(wait)
    raise ValueError("tries must be positive")


def peek(spark: SparkSession, path: str, lines: int = 10) -> list[str]:
    """The first lines of a text file, compressed or not."""
    return [r["value"] for r in spark.read.text(path).limit(lines).collect()]


def size_scans(spark: SparkSession, split_bytes: int = SPLIT_BYTES, open_bytes: int = OPEN_BYTES) -> None:
    """Splits of the session's scans: smaller ones for more tasks, larger ones for fewer."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split_bytes))
    spark.conf.set("spark.sql.files.openCostInBytes", str(open_bytes))


def variants(folder: str, exponents: tuple[float, ...] = EXPONENTS, real: str = "pageviews") -> dict[str, tuple[float | None, str]]:
    """Streams of a local folder: name, then exponent (None: the real one) and path, of the
    generated ones (``zipf_<tag>``) and the real one that are there."""
    named = {f"zipf_{tag(s)}": (s, f"{folder}/zipf_{tag(s)}") for s in exponents} | {real: (None, f"{folder}/{real}")}
    return {name: found for name, found in named.items() if os.path.isdir(found[1])}
