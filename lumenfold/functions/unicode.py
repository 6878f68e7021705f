"""Unicode NFC, which Spark lacks."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


@F.pandas_udf(StringType())
def _nfc(names: pd.Series) -> pd.Series:
    return names.map(lambda s: s if s is None else unicodedata.normalize("NFC", s))


def nfc(name: Column) -> Column:
    """NFC of a name. ASCII names, which are their own NFC, cross to Python as nulls only."""
    return F.coalesce(_nfc(F.when(~name.rlike(r"^[\x00-\x7F]*\z"), name)), name)
