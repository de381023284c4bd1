import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """documents(rows): a table from (doc_id, text, lang, source) with the driver's schema and a clashing extra column."""

    def build(rows, extra=True):
        df = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], SCHEMA)
        if extra:
            from pyspark.sql import functions as F

            df = df.withColumns({"size": F.lit("clash"), "n": F.lit(-1), "shard": F.lit("x"), "cls": F.lit(None).cast("long"), "copies": F.lit(9)})
        return df.repartition(3) if rows else df

    return build


PROSE = {
    "en": "the house and the river were quiet when the children came back from the field with the old dog",
    "de": "das haus und der fluss waren still als die kinder mit dem alten hund vom feld zurück kamen",
}


@pytest.fixture
def odd_rows():
    """Nulls in every column, empty and white texts, repeated rows, a very long text."""
    return [
        (1, PROSE["en"], "en", "a"),
        (2, PROSE["de"], "de", "b"),
        (2, PROSE["de"], "de", "b"),
        (3, None, "en", "a"),
        (4, "", "en", None),
        (5, " \n\t ", None, "b"),
        (None, "null identifier here", "en", "a"),
        (6, "12345 !!", None, None),
        (7, (PROSE["en"] + "\n") * 3000, "en", "a"),
        (8, PROSE["en"], None, "c"),
        (9, "日本語 のテキスト ½ ² <|endoftext|>", "en", "c"),
    ]
