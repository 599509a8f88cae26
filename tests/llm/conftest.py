import duckdb
import pandas as pd
import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names the operators use inside.
CLASHES = "size long, target double, key string, line long, host string, fp long, node long, component long, label string, pos int, taken boolean"


@pytest.fixture
def documents(spark):
    """A frame of documents from (doc_id, text, lang, source), with a number of rows of further, clashing columns if asked for."""

    def make(rows, clashes=False):
        told = [(i, t, lang, source, None if t is None else len(t)) for i, t, lang, source in rows]
        if not clashes:
            return spark.createDataFrame(told, DOCUMENTS)
        more = (7, 1.0, "k", 3, "h", 5, 6, 8, "l", 9, True)
        return spark.createDataFrame([r + more for r in told], f"{DOCUMENTS}, {CLASHES}")

    return make


def same_rows(found, wanted: pd.DataFrame) -> None:
    """Equal columns and rows, in any order, nulls included."""
    a = found.toPandas()
    assert sorted(a.columns) == sorted(wanted.columns)
    columns = sorted(a.columns)
    text = lambda df: sorted("|".join("null" if pd.isna(x) else repr(round(x, 9)) if isinstance(x, float) else str(x) for x in r) for r in df[columns].astype(object).itertuples(index=False))
    assert text(a) == text(wanted)


def by_sql(sql: str, **tables: pd.DataFrame) -> pd.DataFrame:
    with duckdb.connect() as con:
        for name, df in tables.items():
            con.register(name, df)
        return con.sql(sql).df()


MESSY = [
    (1, "Alpha beta gamma.\nShared line of all sites here\nbeta", "en", "a"),
    (2, "Shared line of all sites here\nother words\n\nend", "en", "b"),
    (3, "  shared LINE of all  sites here \nthird text", "de", "c"),
    (4, "Shared line of all sites here", "de", "d"),
    (5, "x\nShared line of all sites here\ny", None, "e"),
    (6, None, "en", "a"),
    (7, "", "en", None),
    (8, " \n\t\n ", "en", None),
    (9, "one two three four five six seven eight nine ten " * 3, "en", "a"),
    (10, "one two three four five six seven eight nine ten " * 3, "en", "a"),
    (11, "# $ % ^ & | < > é ß 中文   tab\there", "fr", "é"),
    (12, "word " * 30000, "en", "a"),
    (13, "last one\r\nwith returns\x0bvertical\x0cfeed", "es", "b"),
]
