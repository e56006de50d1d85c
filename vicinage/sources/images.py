"""Images as pixel arrays. Decoding needs an image library; where there is none, callers give pixel arrays."""

from __future__ import annotations

import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession


def image_files(spark: SparkSession, folder: str, pattern: str = "*.{jpg,png}") -> DataFrame:
    """``path, content`` of the files of a folder."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", "content")


def grey_pixels(files: DataFrame, size: int = 32) -> DataFrame:
    """``path, pixels`` (size by size). Portable grey maps are always read; other formats where Pillow can be imported."""

    def decode(content: bytes) -> list[list[float]]:
        if content[:2] == b"P5":
            head = content.split(maxsplit=4)
            width, height = int(head[1]), int(head[2])
            body = content[len(content) - width * height :]
            return [[float(x) for x in body[r * width : (r + 1) * width]] for r in range(height)]
        from PIL import Image

        image = Image.open(io.BytesIO(content)).convert("L").resize((size, size))
        flat = list(image.getdata())
        return [[float(x) for x in flat[r * size : (r + 1) * size]] for r in range(size)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"path": batch.path, "pixels": [decode(bytes(c)) for c in batch.content]})

    return files.mapInPandas(run, "path string, pixels array<array<double>>")
