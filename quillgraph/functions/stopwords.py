"""Stop word lists by language, read from the installed Spark distribution."""

from __future__ import annotations

import zipfile
from functools import cache
from pathlib import Path

import pyspark
from pyspark.sql import DataFrame, SparkSession

Lists = dict[str, tuple[str, ...]]
_FOLDER = "org/apache/spark/ml/feature/stopwords/"


@cache
def default_lists() -> Lists:
    """The lists that Spark ships; any other mapping of language to words may be used in their place."""
    for jar in sorted((Path(pyspark.__file__).parent / "jars").glob("spark-mllib_*.jar")):
        with zipfile.ZipFile(jar) as z:
            found = {n[len(_FOLDER) : -4]: z.read(n).decode() for n in z.namelist() if n.startswith(_FOLDER) and n.endswith(".txt")}
        if found:
            return {lang: tuple(sorted({w.strip() for w in text.split("\n")} - {""})) for lang, text in sorted(found.items())}
    from pyspark.ml.feature import StopWordsRemover

    names = "danish dutch english finnish french german hungarian italian norwegian portuguese russian spanish swedish turkish".split()
    return {lang: tuple(sorted({*StopWordsRemover.loadDefaultStopWords(lang)} - {""})) for lang in names}


def table(spark: SparkSession, lists: Lists | None = None) -> DataFrame:
    """(lang, term); its size is that of the lists, whatever the corpus holds."""
    rows = [(lang, w) for lang, words in (default_lists() if lists is None else lists).items() for w in sorted(set(words))]
    return spark.createDataFrame(rows, "lang string, term string").coalesce(1)
