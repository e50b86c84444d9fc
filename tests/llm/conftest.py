import duckdb
import pytest

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def sorted_rows(rows):
    return sorted(rows, key=repr)


@pytest.fixture(scope="session")
def oracle():
    """Rows of a DuckDB query over the tables of a folder, columns by name."""

    def run(sql, sf_dir="/root/testdata/sf0.01"):
        con = duckdb.connect()
        for name in TABLES:
            con.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
        found = con.sql(sql)
        order = sorted(range(len(found.columns)), key=lambda i: found.columns[i])
        return sorted(found.columns), sorted_rows([tuple(r[i] for i in order) for r in found.fetchall()])

    return run
