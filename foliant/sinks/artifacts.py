"""Results of documents as files: ``<root>/<folder>/<stem>.<suffix>``, overwritten in place.

Folder and stem come from the document's name, see ``functions.text``; two names that need the same change get folders of
their own. A file appears whole or not at all, so that a task that runs twice does no harm. ``root`` is a path that all
executors share.

Defined results: a null name and a null or empty text write nothing.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from pathlib import Path
from uuid import uuid4

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from foliant.functions.text import artifact_folder, artifact_stem


def _save(files: DataFrame, root: str) -> None:
    def write(rows: Iterator[Row]) -> None:
        for row in rows:
            folder = Path(root) / row.folder
            folder.mkdir(parents=True, exist_ok=True)
            made = folder / f".{uuid4().hex}"
            made.write_text(row.body, encoding="utf-8", errors="surrogatepass")
            os.replace(made, folder / row.file)

    files.foreachPartition(write)


def _named(name: Column, suffix: str, body: Column) -> list[Column]:
    return [artifact_folder(name).alias("folder"), F.concat(artifact_stem(name), F.lit(suffix)).alias("file"), body.alias("body")]


def save_markdown(documents: DataFrame, name: str, markdown: str, root: str) -> None:
    """The Markdown of each document; nothing where there is none."""
    _save(documents.where((F.length(markdown) > 0) & F.col(name).isNotNull()).select(*_named(F.col(name), ".md", F.col(markdown))), root)


def save_json(records: DataFrame, name: str, record: str, root: str) -> None:
    """The JSON of each record with an indent of two and characters beyond ASCII as they are; a text that is no JSON is
    written as a JSON string."""

    @F.pandas_udf("string")
    def laid_out(texts):  # noqa: ANN001, ANN202
        def one(text: str) -> str:
            try:
                value = json.loads(text)
            except ValueError:
                value = text
            return json.dumps(value, indent=2, ensure_ascii=False)

        return texts.map(one)

    known = records.where(F.col(record).isNotNull() & F.col(name).isNotNull())
    _save(known.select(*_named(F.col(name), ".json", laid_out(F.col(record)))), root)
