"""What approves a source: where and when it was acquired, for exactly its bytes."""

from __future__ import annotations

import datetime
import json
import re
from urllib.parse import urlsplit

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

#: Fields of an approval; fixed values of the contract.
FIELDS = ("source_sha256", "acquisition_url", "acquisition_date", "edition", "language")


def source_digest(spark: SparkSession, source: str) -> str:
    """SHA-256 of a source's bytes, hashed where they are read; a source is one file."""
    found = [r.d for r in spark.read.format("binaryFile").load(source).select(F.sha2("content", 256).alias("d")).limit(2).collect()]
    if len(found) != 1:
        raise ValueError("a source is one file")
    return found[0]


def checked(approval: dict) -> dict:
    """An approval whose fields are all there and well formed."""
    if set(approval) - set(FIELDS) or any(not isinstance(approval.get(f), str) for f in FIELDS):
        raise ValueError(f"an approval has exactly the fields {', '.join(FIELDS)}")
    url = urlsplit(approval["acquisition_url"])
    rules = {
        "source_sha256": re.fullmatch("[0-9a-f]{64}", approval["source_sha256"]), "acquisition_url": url.scheme in ("http", "https") and url.netloc,
        "edition": 1 <= len(approval["edition"]) <= 200, "language": re.fullmatch("[a-z]{3}", approval["language"]),
    }
    wrong = [name for name, good in rules.items() if not good]
    try:
        datetime.date.fromisoformat(approval["acquisition_date"])
    except ValueError:
        wrong.append("acquisition_date")
    if wrong:
        raise ValueError(f"an approval's {' and '.join(wrong)} are not valid")
    return approval


def approved(spark: SparkSession, source: str, edition: str, language: str, url: str | None = None, date: str | None = None) -> dict:
    """The approval of a source, made of a URL and a date or read from the file beside it, which must be of these bytes, edition and language."""
    if (url is None) != (date is None):
        raise ValueError("acquisition URL and date go together")
    digest = source_digest(spark, source)
    if url is not None:
        return checked({"source_sha256": digest, "acquisition_url": url, "acquisition_date": date, "edition": edition, "language": language})
    beside = f"{source}.approval.json"
    at = spark._jvm.org.apache.hadoop.fs.Path(beside)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        raise ValueError(f"a source needs an approval: a URL and a date, or {beside.rpartition('/')[2]}")
    found = checked(json.loads(spark.read.text(beside, wholetext=True).first().value))
    for field, value in (("source_sha256", digest), ("edition", edition), ("language", language)):
        if found[field] != value:
            raise ValueError(f"the approval's {field} is not that of the source")
    return found
