"""Files of a folder as rows: paths, texts and hashes, with ignore patterns; the source of an index run."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ignore_pattern(line: str) -> tuple[bool, str] | None:
    """One line of an ignore file as (keeps, regular expression over relative paths); None for blanks and comments."""
    line = line.strip()
    if not line or line.startswith("#"):
        return None
    keeps, line = line.startswith("!"), line.lstrip("!")
    anchored, folder = "/" in line.rstrip("/"), line.endswith("/")
    parts = []
    for piece in re.split(r"(\*\*/|\*\*|\*|\?)", line.strip("/")):
        parts.append({"**/": "(?:[^/]+/)*", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(piece, re.escape(piece)))
    return keeps, ("^" if anchored else "(^|/)") + "".join(parts) + ("/" if folder else "(/|$)")


def read_files(spark: SparkSession, folder: str, endings: list[str], ignore: list[str] = (), most_bytes: int = 1 << 20) -> DataFrame:
    """path (below folder), content, hash, bytes of files with these endings; later ignore lines overrule earlier ones. Larger files are left out before they are read."""
    glob = "*{" + ",".join(endings) + "}"
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(folder)
    root = re.sub(r"^[a-z]+:/*", "/", folder.rstrip("/"))
    raw = raw.withColumn("path", F.regexp_replace("path", "^[a-z]+:/*" + re.escape(root.lstrip("/")) + "/", ""))
    gone = F.lit(False)
    for rule in filter(None, map(ignore_pattern, ignore)):
        gone = F.when(F.col("path").rlike(rule[1]), F.lit(not rule[0])).otherwise(gone)
    kept = raw.where((F.col("length") <= most_bytes) & ~gone)
    return kept.select("path", F.decode("content", "UTF-8").alias("content"), F.sha2("content", 256).alias("hash"), F.col("length").alias("bytes"))
