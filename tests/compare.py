"""Holds registered queries against their SQL on the same tables."""

from __future__ import annotations

import os

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def database(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(rows) -> list[str]:
    return sorted(repr(tuple(int(v) if isinstance(v, int) and not isinstance(v, bool) else round(v, 9) + 0.0 if isinstance(v, float) else v for v in r)) for r in rows)


def difference(con, df, sql: str) -> str:
    """Empty if the rows agree; else what differs."""
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    want = got.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    order = sorted(names)
    have = plain(tuple(r[c] for c in order) for r in df.collect())
    at = [names.index(c) for c in order]
    want = plain(tuple(r[i] for i in at) for r in want)
    if have == want:
        return ""
    only = [x for x in have if x not in set(want)][:3], [x for x in want if x not in set(have)][:3]
    return f"{len(have)} and {len(want)} rows; only Spark: {only[0]}; only SQL: {only[1]}"
