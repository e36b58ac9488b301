"""Writing notes and tables. Writes are idempotent: a repeated task writes the same bytes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame


def write_notes(notes: DataFrame, root: str) -> DataFrame:
    """Write ``(path, note)`` below a folder all executors share; returns ``(path, status)`` once run."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os

        for pdf in batches:
            status = []
            for path, note in zip(pdf["path"], pdf["note"]):
                target = os.path.join(root, path)
                try:
                    os.makedirs(os.path.dirname(target), exist_ok=True)
                    part = f"{target}.{os.getpid()}.part"
                    with open(part, "w", encoding="utf-8") as file:
                        file.write(note)
                    os.replace(part, target)
                    status.append("written")
                except OSError as e:
                    status.append(f"failed: {e.strerror}")
            yield pd.DataFrame({"path": pdf["path"], "status": status})

    return notes.select("path", "note").mapInPandas(run, "path string, status string")


def save_table(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """A table as parquet, in folders by the columns given."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def save_texts(df: DataFrame, path: str) -> None:
    """One line of JSON per document, in as many files as partitions."""
    df.write.mode("overwrite").json(path)
