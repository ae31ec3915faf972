"""What no built-in expression says: Unicode normalisation and sequence comparison, as Arrow-batched UDFs."""

from __future__ import annotations

import difflib
import re
import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType


@F.pandas_udf(StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    """Compatibility forms of letters folded."""
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


@F.pandas_udf(StringType())
def casefolded(texts: pd.Series) -> pd.Series:
    """Full case folding, the German sharp s included."""
    return texts.map(lambda t: None if t is None else t.casefold())


DIFF = StructType([StructField("ratio", DoubleType()), StructField("changed", LongType())])


def _compared(a: str, b: str) -> tuple[float, int]:
    if a == b:
        return 1.0, 0
    if not a or not b:
        return 0.0, max(len(a), len(b))
    matcher = difflib.SequenceMatcher(None, a, b, autojunk=False)
    changed = sum(max(i2 - i1, j2 - j1) for tag, i1, i2, j1, j2 in matcher.get_opcodes() if tag != "equal")
    return matcher.ratio(), changed


@F.pandas_udf(DIFF)
def compared(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """(ratio of matching characters, characters that changed) of two texts."""
    rows = [_compared(x or "", y or "") for x, y in zip(a, b, strict=True)]
    return pd.DataFrame(rows, columns=["ratio", "changed"])


TOKEN = re.compile(r"\w+|[^\w\s]")


@F.pandas_udf(LongType())
def tokens_lost(source: pd.Series, target: pd.Series) -> pd.Series:
    """Tokens of the source that an alignment with the target deletes or replaces."""
    out = []
    for x, y in zip(source, target, strict=True):
        a, b = TOKEN.findall(x or ""), TOKEN.findall(y or "")
        matcher = difflib.SequenceMatcher(None, a, b, autojunk=False)
        out.append(0 if a == b else sum(i2 - i1 for tag, i1, i2, _, _ in matcher.get_opcodes() if tag in ("delete", "replace")))
    return pd.Series(out, dtype="int64")
