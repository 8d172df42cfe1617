"""Answers that cost money, kept by key in a shared folder.

One small file holds each answer; it is written whole or not at all, so the workers of any task can use it. An answer
that came but was not written when its executor was lost is asked for again: at most one for each lost worker.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

from citemill.schemas import GENERATION

# An empty answer has been paid for; other errors are worth another try.
_KEPT_ERRORS = (None, "empty_response")


class Ledger:
    """Results by key below ``path``: a folder or a URI that every executor reaches."""

    def __init__(self, path: str):
        self.files, self.path = fs.FileSystem.from_uri(path)

    def _place(self, key: str) -> str:
        return f"{self.path}/{key[:2]}/{key}.json"

    def get(self, key: str) -> dict | None:
        place = self._place(key)
        if self.files.get_file_info(place).type == fs.FileType.NotFound:
            return None
        with self.files.open_input_stream(place) as kept:
            return json.loads(kept.read())

    def put(self, key: str, result: dict) -> None:
        place = self._place(key)
        draft = f"{self.path}/{key[:2]}/_{key}-{uuid.uuid4().hex}"
        self.files.create_dir(f"{self.path}/{key[:2]}", recursive=True)
        with self.files.open_output_stream(draft) as out:
            out.write(json.dumps(result).encode())
        self.files.move(draft, place)

    def once(self, key: str, ask: Callable[[], dict]) -> dict:
        """The kept result of a key, or that of ``ask``, which is then kept."""
        found = self.get(key)
        if found is None:
            found = ask()
            if found.get("error") in _KEPT_ERRORS:
                self.put(key, found)
        return found


def kept_answers(spark: SparkSession, path: str) -> DataFrame:
    """All kept results, for a look at what was spent."""
    return spark.read.schema(GENERATION).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(path)
