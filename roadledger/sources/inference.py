"""Models as an interface: any detector and any plate reader, loaded once in a Python worker."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_loaded: dict[str, object] = {}

FOUND = "path string, det_id bigint, label string, conf double, x1 bigint, y1 bigint, x2 bigint, y2 bigint"


def once(name: str, load: Callable[[], object]) -> object:
    """The model of this name, loaded at its first use in the process."""
    if name not in _loaded:
        _loaded[name] = load()
    return _loaded[name]


def detect(images: DataFrame, name: str, load: Callable[[], Callable]) -> DataFrame:
    """Detections of images (path, content). load() gives a model: bytes to (label, conf, box) in order.

    Images that the model gives nothing for have no rows; coordinates are cut toward zero.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = once(name, load)
        for part in parts:
            rows = [(path, k, label, float(conf), *(int(side) for side in box)) for path, content in zip(part["path"], part["content"]) for k, (label, conf, box) in enumerate(model(content), 1)]
            yield pd.DataFrame(rows, columns=["path", "det_id", "label", "conf", "x1", "y1", "x2", "y2"])

    return images.select("path", "content").mapInPandas(run, FOUND)


def read_plates(crops: DataFrame, name: str, load: Callable[[], Callable], crop: str = "crop") -> DataFrame:
    """crops with ocr_texts. load() gives a reader: bytes to a list of text fragments; a null crop has none."""

    @F.pandas_udf("array<string>")
    def texts(column: pd.Series) -> pd.Series:
        reader = once(name, load)
        return column.map(lambda c: [] if c is None else list(reader(c)))

    return crops.withColumn("ocr_texts", texts(crop))
