"""Unicode normalisation, by Arrow over whole batches."""

from __future__ import annotations

import pyarrow.compute as pc
from pyspark.sql import DataFrame


def normalized(df: DataFrame, col: str, form: str = "NFC") -> DataFrame:
    """With a text column in a normal form."""

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index(col)
            yield batch.set_column(at, col, pc.utf8_normalize(batch.column(at), form=form))

    return df.mapInArrow(run, df.schema)
