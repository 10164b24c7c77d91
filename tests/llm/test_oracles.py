"""The operators' queries against their SQL, on the smallest tables and on awkward rows."""

import duckdb
import pandas as pd
import pytest
from test_documents import AWKWARD, PERSONAL
from test_pages import CHATS, NASTY

from sparkloom.llm import entry

TABLES = ("documents", "benchmark", "pages", "conversations")


@pytest.fixture(scope="module")
def awkward_tables(tmp_path_factory):
    top = tmp_path_factory.mktemp("tables")
    docs = [r for r in AWKWARD if r[0] not in (None, 6)] + [(100 + i, t) for i, t in enumerate(PERSONAL) if t is None or len(t) < 2000]
    docs = list(dict(docs).items())
    frames = {
        "documents": pd.DataFrame(docs, columns=["doc_id", "text"]),
        "benchmark": pd.DataFrame([(1, "b c d e f g h i j k"), (2, "one"), (3, None), (4, ""), (5, "b c d e f g h i j k l m n")], columns=["item_id", "text"]),
        "pages": pd.DataFrame([(i, "u", t.replace("\0", "")) for i, t in enumerate([*NASTY, *NASTY[:3]])] + [(90, None, None)], columns=["page_id", "url", "html"]),
        "conversations": pd.DataFrame(CHATS, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"}),
    }
    for name, df in frames.items():
        df.to_parquet(top / f"{name}.parquet")
    return str(top)


@pytest.mark.parametrize("name", list(entry.ORACLE_SQL))
@pytest.mark.parametrize("where", ["sf0.001", "awkward"])
def test_against_sql(spark, awkward_tables, name, where):
    sf = awkward_tables if where == "awkward" else f"/root/testdata/{where}"
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    other = con.sql(entry.ORACLE_SQL[name])
    df = entry.QUERIES[name](spark, sf)
    assert sorted(df.columns) == sorted(other.columns)
    assert sorted(str(tuple(r[c] for c in other.columns)) for r in df.collect()) == sorted(map(str, other.fetchall()))
